"""Quality classifier: hashed word n-gram logistic regression, fitted with follow-the-regularised-leader updates.

Features of a text are its words and word pairs as they stand, and the shapes of its words (case,
digits, punctuation at the end, repetition of the word before) alone and in pairs. Each kind is
hashed into one weight table; a feature's value is its share of the text's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import U, mix, prefix_hash, span_hash, text_slices, words
from .common import free_name, free_worker

#: labelled rows that a fit reads at most: those with the smallest hash of their id
FIT_ROWS = 6_000
BITS = 18
EPOCHS = 4
#: per-coordinate learning rate, its offset, and the two penalties
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: value of a feature that fills a whole text
SCALE = 8.0
THRESHOLD = 0.3

_UPPER, _DIGIT, _LOWER = (np.zeros(256, np.int64) for _ in range(3))
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_LOWER[97:123] = 1
_LOWER[128:] = 1
_PUNCT = 1 - _UPPER - _DIGIT - _LOWER


def features(flat: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots [4, words], document of each word): slots of the word, its pair with the word before, its shape, the shape pair."""
    starts, ends, doc = words(flat, offsets)
    if not len(starts):
        return np.zeros((4, 0), np.int64), doc
    word = span_hash(prefix_hash(flat), starts, ends)
    first = np.empty(len(doc), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    # words are apart, so a count over [start, end) is a difference of running sums
    total = lambda kind: np.diff(np.concatenate(([0], np.cumsum(kind[flat]))).take(np.stack((starts, ends))), axis=0)[0]
    upper, digit, lower, punct = (total(k) for k in (_UPPER, _DIGIT, _LOWER, _PUNCT))
    last = np.where(_PUNCT[flat[ends - 1]] == 1, flat[ends - 1], 0).astype(np.int64)
    repeat = np.zeros(len(word), np.int64)
    repeat[1:] = (word[1:] == word[:-1]) & ~first[1:]
    shape = last
    for value, top in ((upper, 2), (lower, 2), (digit, 2), (punct, 4), (repeat, 1)):
        shape = shape * (top + 1) + np.minimum(value, top)
    shape = shape.astype(np.uint64)
    out = np.empty((4, len(word)), np.int64)
    down = U(64 - bits)
    for k, code in ((0, word), (2, shape)):
        before = np.empty_like(code)
        before[0] = 0
        before[1:] = code[:-1]
        before[first] = 0
        out[k] = mix(code * U(4) + U(k + 1)) >> down
        out[k + 1] = mix(mix(code) + before * U(0x9E3779B97F4A7C15) + U(k + 2)) >> down
    return out, doc


def sparse_rows(column, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text of an Arrow column, slots in order and without repeats."""
    for _, _, flat, offsets in text_slices(column):
        slots, doc = features(flat, offsets, bits)
        cut = np.searchsorted(doc, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            own = slots[:, cut[i] : cut[i + 1]]
            where, count = np.unique(own, return_counts=True)
            yield where, count * (SCALE / max(1, own.shape[1]))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the last one the intercept, by per-coordinate FTRL-proximal updates in the order given."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - np.where(at == size - 1, 0.0, L1), 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    full = [(np.append(s, size - 1), np.append(v, 1.0)) for s, v in rows]
    for _ in range(epochs):
        for (at, value), y in zip(full, labels):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * value
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / ALPHA * w
    return weights(np.arange(size)).astype(np.float32)


def score_column(column, weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text: the sparse dot product with the weights, through the logistic curve."""
    bits = (len(weights) - 1).bit_length() - 1
    out = []
    for _, _, flat, offsets in text_slices(column):
        slots, doc = features(flat, offsets, bits)
        own = weights[slots].sum(axis=0, dtype=np.float64)
        count = np.bincount(doc, minlength=len(offsets) - 1)
        dot = np.bincount(doc, own, minlength=len(offsets) - 1) * SCALE / np.maximum(count, 1)
        out.append(1 / (1 + np.exp(-np.clip(dot + weights[-1], -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, fold: Column, rows: int = FIT_ROWS, target: str = "quality") -> np.ndarray:
    """Fit on the labelled rows of ``docs`` for which ``fold`` (over ``doc_id``) holds, at most ``rows`` of them.

    The bound makes the fit one task of bounded size. Rows with a null label or id are left out; a
    fit without rows gives weights of 0, so every score is 0.5.
    """
    chosen = (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .where(fold & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            found = list(sparse_rows(batch.column(2)))
            slots = pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32()))
            values = pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), slots, values], ["at", "doc_id", "label", "slots", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        own = [b for b in batches if b.num_rows]
        found = fit_ftrl([], np.zeros(0))
        if own:
            table = pa.Table.from_batches(own).sort_by([("at", "ascending"), ("doc_id", "ascending")])
            pairs = [(s.values.to_numpy(), v.values.to_numpy()) for s, v in zip(table.column("slots"), table.column("values"))]
            found = fit_ftrl(pairs, table.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["weights"])

    # texts stay where they are: the task that fits gets features, no more of a row than there are slots
    rows = sample.select(F.xxhash64("doc_id").alias("at"), "doc_id", "text", "label").mapInArrow(cut, "at long, doc_id long, label int, slots array<int>, values array<float>")
    found = rows.repartition(1).mapInArrow(run, "weights binary").take(1)
    return np.frombuffer(found[0]["weights"], np.float32) if found else fit_ftrl([], np.zeros(0))


def add_score(docs: DataFrame, weights: np.ndarray, name: str) -> DataFrame:
    """``docs`` with all its columns and the score of each row's whole text. Null and empty texts get the score of the intercept."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            score = pa.array(score_column(batch.column(at), sent.value), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def hash_fold(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; rows whose id hashes to fold 0 of 5 are never learned from.

    Each row is scored alone: repeated ids give repeated rows, a null id is kept and counts as not
    held out. Other columns of ``docs`` are not read.
    """
    weights = fit(docs, labels, hash_fold(5) != 0)
    held = F.coalesce(hash_fold(5) == 0, F.lit(False))
    return add_score(docs.select("doc_id", "text"), weights, "score").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns unchanged."""
    score = free_name(docs, "score")
    return add_score(docs, fit(docs, labels, hash_fold(5) != 0), score).where(F.col(score) >= threshold).drop(score)
