"""Language identification with a byte convolutional network, trained and applied in numpy.

Bytes map to 128 classes and small embeddings; filters of several widths run over windows of fixed
length, each keeps its maximum over the window, and a softmax layer reads the maxima. For prediction
the embedding and the filters are folded into tables over pairs of byte classes, so a filter of
width 4 is the sum of two table rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import text_slices
from .common import free_worker
from .quality import hash_fold

#: labelled rows that a fit reads at most, each with its whole text
FIT_ROWS = 3_000
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 8
STEPS, BATCH, RATE = 500, 64, 0.01
CLASSES = 128
UNKNOWN = "und"


def _byte_classes() -> np.ndarray:
    """0 blank, 1-26 letters without case, 27 digits, 28 apostrophe and hyphen, 29 other; bytes of longer characters from 32 on."""
    out = np.full(256, 29, np.uint8)
    out[[*range(9, 14), 32]] = 0
    for k in range(26):
        out[65 + k] = out[97 + k] = 1 + k
    out[48:58] = 27
    out[[39, 45]] = 28
    out[128:192] = np.arange(32, 96)
    out[192:256] = 96 + np.arange(64) % 32
    return out


BYTE_CLASS = _byte_classes()


def windows(flat: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(byte classes [windows, size], document of each window): every byte of every text, the last window filled up with blanks."""
    count = -(-np.diff(offsets) // size)
    doc = np.repeat(np.arange(len(count)), count)
    out = np.zeros((len(doc), size), np.uint8)
    if len(flat):
        first = np.cumsum(count) - count
        out.reshape(-1)[np.arange(len(flat)) + np.repeat(first * size - offsets[:-1], np.diff(offsets))] = BYTE_CLASS[flat]
    return out, doc


class ByteCNN:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (CLASSES, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over the windows ``x`` with label numbers ``y``."""
        e = self.embed[x]
        rows = np.arange(len(x))[:, None]
        pooled, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            n = x.shape[1] - w + 1
            a = sum(e[:, k : k + n] @ f[k] for k in range(w)) + b
            at = a.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(a, at[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        r = np.maximum(h, 0)
        z = r @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        d_out, d_out_bias, d_h = r.T @ p, p.sum(0), (p @ self.out.T) * (h > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_bias = [], []
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            d = d_h[:, i * FILTERS : (i + 1) * FILTERS]
            at = where[i]
            df = np.empty_like(f)
            for k in range(w):
                byte = x[rows, at + k]
                df[k] = np.einsum("bfe,bf->ef", self.embed[byte], d)
                np.add.at(d_embed, byte.reshape(-1), (d[:, :, None] * f[k].T[None]).reshape(-1, EMBED))
            d_filters.append(df)
            d_bias.append(d.sum(0))
        return [d_embed, *d_filters, *d_bias, d_out, d_out_bias]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> ByteCNN:
        """Adam over random batches."""
        rng = np.random.default_rng(seed)
        own = self.parameters()
        m, v = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            for p, g, mi, vi in zip(own, self.gradients(x[pick], y[pick]), m, v):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= RATE * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width the summed filter rows of its first two bytes by pair of classes, and of what is left."""
        at = [[self.embed @ f[k] for k in range(len(f))] for f in self.filters]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(CLASSES * CLASSES, FILTERS)
        out = []
        for w, k, b in zip(WIDTHS, at, self.bias):
            rest = None if w == 2 else k[2] if w == 3 else pair(k[2], k[3])
            out.append((np.ascontiguousarray(pair(k[0] + b, k[1])), rest))
        return out

    def log_probabilities(self, x: np.ndarray, tables=None, block: int = 256) -> np.ndarray:
        tables = tables or self.tables()
        out = np.empty((len(x), len(self.labels)), np.float32)
        for at in range(0, len(x), block):
            c = x[at : at + block].astype(np.int32)
            p = c[:, :-1] * CLASSES + c[:, 1:]
            n = c.shape[1]
            h = []
            for w, (two, rest) in zip(WIDTHS, tables):
                a = two.take(p[:, : n - w + 1].reshape(-1), 0)
                if w > 2:
                    a += rest.take((c[:, 2:] if w == 3 else p[:, 2:]).reshape(-1), 0)
                h.append(np.maximum.reduce(a.reshape(len(c), n - w + 1, FILTERS), axis=1))
            z = np.maximum(np.concatenate(h, 1), 0) @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            out[at : at + block] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, labels=np.array(self.labels), **{f"p{i}": p for i, p in enumerate(self.parameters())})
        return to.getvalue()

    @classmethod
    def load(cls, data: bytes) -> ByteCNN:
        held = np.load(io.BytesIO(data))
        model = cls([str(x) for x in held["labels"]])
        for i, p in enumerate(model.parameters()):
            p[...] = held[f"p{i}"]
        return model


def fit(docs: DataFrame, fold: Column, rows: int = FIT_ROWS) -> bytes | None:
    """A network fitted on rows with a ``lang`` for which ``fold`` holds, at most ``rows`` of them in one task; None without such rows."""
    chosen = (
        docs.where(fold & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.xxhash64("doc_id").alias("at"), "doc_id", "lang")
        .orderBy("at", "doc_id", "lang")
        .limit(rows)
    )
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own).sort_by([("at", "ascending"), ("doc_id", "ascending")])
        lang = table.column("lang").to_pylist()
        labels = sorted(set(lang))
        number = np.array([labels.index(x) for x in lang])
        xs, ys = [], []
        for first, last, flat, offsets in text_slices(table.column("text")):
            x, doc = windows(flat, offsets)
            xs.append(x)
            ys.append(number[first + doc])
        model = ByteCNN(labels)
        if sum(map(len, xs)):
            model.fit(np.concatenate(xs), np.concatenate(ys))
        yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    found = one.mapInArrow(run, "model binary").take(1)
    return bytes(found[0]["model"]) if found else None


def predict_column(column, model: ByteCNN, tables=None) -> tuple[np.ndarray, np.ndarray]:
    """(label number, score) of each text: the windows' log probabilities, averaged over the text, then a softmax."""
    tables = tables or model.tables()
    best, score = [], []
    for _, _, flat, offsets in text_slices(column):
        x, doc = windows(flat, offsets)
        n = len(offsets) - 1
        logs = model.log_probabilities(x, tables)
        mean = np.stack([np.bincount(doc, logs[:, k], minlength=n) for k in range(logs.shape[1])], 1)
        mean /= np.maximum(1, np.bincount(doc, minlength=n))[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best.append(p.argmax(1))
        score.append(p.max(1))
    return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its whole text.

    Rows whose id hashes to fold 1 of 3 are never learned from. A text that is null or has no letter is
    ``und`` with score 0; so is every text if there is nothing to learn from. Rows are judged one by
    one, so repeated ids give repeated rows; a null id counts as not held out.
    """
    model = fit(docs, hash_fold(3) != 1)
    held = F.coalesce(hash_fold(3) == 1, F.lit(False))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    base = docs.select("doc_id", held.alias("held_out"), letter.alias("letter"), "text")
    if model is None:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        net = ByteCNN.load(sent.value)
        tables = net.tables()
        for batch in batches:
            best, score = predict_column(batch.column(3), net, tables)
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            names = np.where(letters, np.array(net.labels, object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return base.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
