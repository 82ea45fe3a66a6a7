"""Exact cosine top-k of a batch of queries over all units."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: queries that are broadcast at once: bounds the matrix at 4096 x dimension doubles; more run block by block
QUERY_BLOCK = 4_096
DIGITS = 9
#: scores that are held at once: so many units of a batch are multiplied with the block that their scores fill 8 MB
_SCORES = 1 << 20
#: units of them at most: bounds their scaled vectors
_UNITS = 2_048
#: rows that wait, besides the k best of each query, to be ranked
_WAITING = 1 << 17


def vector_topk(queries: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(query_id, unit_id, doc_id, score, rank): the ``k`` units nearest to each query, rank from 0.

    ``queries`` has (query_id, embedding), ``units`` (unit_id, doc_id, embedding). Order is by score, rounded to
    nine digits, then unit id. Units are scanned once per block of queries; a task multiplies a few at a time with the
    block's matrix and keeps its own top k, so that only k rows per query and task are shuffled.
    """
    spark = queries.sparkSession
    lean = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-lean.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        own = lean if blocks == 1 else lean.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = own.collect()
        if rows:
            parts.append(_block_topk(spark, [r[0] for r in rows], np.array([r[1] for r in rows]), units, k, queries.schema["query_id"].dataType))
    if not parts:
        parts = [_block_topk(spark, [], np.zeros((0, 1)), units.limit(0), k, queries.schema["query_id"].dataType)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_ranked(out, k)


def top_ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "unit_id")
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The ``k`` first rows of each query, in order of query; ``rows`` has (query, rounded, score, unit_id, doc_id)."""
    rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("rounded", "descending"), ("unit_id", "ascending")]))
    query = rows.column("query").to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return rows.filter(pa.array(place < k))


def _task_topk(batches: Iterator[pa.RecordBatch], q: np.ndarray, k: int) -> pa.Table | None:
    """The ``k`` best units (unit_id, doc_id, embedding) of the batches for each row of ``q``.

    A score under the k-th best that a query has so far is dropped at once; what is left waits until it is ranked. As in
    Spark's order, what is not a number is above all numbers.
    """
    bound = np.full(len(q), -np.inf)
    held, waiting = None, []
    step = max(1, min(_UNITS, _SCORES // max(1, len(q))))
    slack = 10.0**-DIGITS

    def ranked():
        rows = _best(pa.concat_tables([*([held] if held is not None else []), *waiting]), k)
        query, last = rows.column("query").to_numpy(), rows.column("rounded").to_numpy()
        full = np.flatnonzero(np.bincount(query, minlength=len(q)) >= k)
        bound[full] = last[np.searchsorted(query, full, "right") - 1]
        return rows

    for batch in batches:
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else ()
        for at in range(0, len(x), step):
            score = q @ _unit(x[at : at + step]).T
            least = bound - slack
            if score.shape[1] > k and not np.isfinite(bound).all():
                own = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                least = np.maximum(least, np.nan_to_num(own, nan=np.inf) - slack)  # ties of the k-th, as far as rounding makes them, are settled by id
            a, b = np.nonzero(~(score < least[:, None]))
            if not len(a):
                continue
            pick, of = pa.array(b + at), score[a, b]
            rounded = np.nan_to_num(np.round(of, DIGITS), nan=np.inf)
            waiting.append(pa.table([pa.array(a), pa.array(rounded), pa.array(of), batch.column(0).take(pick), batch.column(1).take(pick)], ["query", "rounded", "score", "unit_id", "doc_id"]))
            if sum(map(len, waiting)) > _WAITING + len(q) * k:
                held, waiting = ranked(), []
    return ranked() if waiting else held


def _block_topk(spark, ids, matrix, units: DataFrame, k: int, id_type) -> DataFrame:
    sent = spark.sparkContext.broadcast((ids, _unit(matrix)))
    lean = units.select("unit_id", "doc_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    kinds = {f.name: f.dataType.simpleString() for f in lean.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        rows = _task_topk(batches, q, k) if len(names) else None
        if rows is None:
            return
        shown = pa.array(names).take(rows.column("query").combine_chunks())
        yield from pa.table([shown, *[rows.column(c) for c in ("unit_id", "doc_id", "score")]], ["query_id", "unit_id", "doc_id", "score"]).to_batches(10_000)

    return lean.mapInArrow(run, f"query_id {id_type.simpleString()}, unit_id {kinds['unit_id']}, doc_id {kinds['doc_id']}, score double")
