"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees, and their components.

Vectors are compared within a label. Equal vectors are one row with a count. The top level of the
cover is distributed: every vector goes to the nearest of a bounded set of pivots, cells are split
to blocks of bounded size, and only pairs of blocks whose covering radii let them hold a
close pair meet in a task, which builds the two trees below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stage
from .cover_tree import CoverTree, Merger, close_pairs

COSINE = 0.93
#: vectors of a block, so that a task holds two of them; sampled vectors from which pivots are chosen; pivots of a label
BLOCK, SAMPLE, PIVOTS = 2_048, 1_024, 256
_PIVOT_GAP = 0.5


def _unit(data) -> np.ndarray:
    """Rows of doubles, scaled to length 1."""
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _readable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, space, vector binary): vectors that can be compared. A space is a label and a dimension."""
    base = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    ).where("vec_id is not null and label is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spaces, data = [], [], []
            for vec_id, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = v.values
                x = values.to_numpy(zero_copy_only=False)
                if not len(x) or values.null_count or not np.isfinite(x).all():
                    continue
                norm = np.linalg.norm(x)
                if not (norm > 0 and np.isfinite(norm)):
                    peak = np.abs(x).max()
                    if not peak > 0:
                        continue
                    x = x / peak  # too long or too short for its norm to be a number
                ids.append(vec_id)
                spaces.append(f"{len(x)}/{label}")
                data.append(np.ascontiguousarray(x, np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spaces, pa.string()), pa.array(data, pa.binary())], ["vec_id", "space", "vector"])

    return base.mapInArrow(run, "vec_id long, space string, vector binary")


def _pivots(sample: list, total: int) -> dict[str, np.ndarray]:
    """By space, vectors of the sample that lie apart, farthest first: as many as the space has blocks, by its share of the sample of ``total`` vectors."""
    by: dict[str, list[bytes]] = {}
    for r in sample:
        by.setdefault(r["space"], []).append(bytes(r["vector"]))
    out = {}
    for space, data in by.items():
        x = _unit(data)
        chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
        most = min(PIVOTS, -(-total * len(data) // (len(sample) * BLOCK)))
        while len(chosen) < most and far.max() > _PIVOT_GAP:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
        out[space] = x[chosen]
    return out


def link_vectors(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two vectors link when their labels are equal and not null and their cosine in double precision is at
    least ``cosine``. A vector that is null, zero, empty, or holds null or non-finite components links
    with nothing, nor do vectors of different dimension. ``component_id`` is the smallest id reachable
    by links, itself included. Rows that repeat an id with an equal vector count once; a null id
    stands alone, and its component is null. All pairs are covered: blocks bound a task, not the search.
    """
    spark = vectors.sparkSession
    ready = stage(_readable(vectors, id_col, vector_col, label_col).withColumn("key", F.sha2(F.concat("vector", F.col("space").cast("binary")), 256)).distinct(), "vectors")
    groups = stage(
        ready.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("space").alias("space"), F.first("vector").alias("vector")),
        "distinct-vectors",
    )
    pivots = _pivots(groups.select("space", "vector", F.xxhash64("key").alias("at")).orderBy("at").limit(SAMPLE).collect(), groups.count())
    sent = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spaces = batch.column(2).to_pylist()
            data = batch.column(3).to_pylist()
            cell, far = np.full(len(spaces), -1, np.int64), np.full(len(spaces), 2.0)
            for space in set(spaces) & sent.value.keys():
                at = np.array([i for i, s in enumerate(spaces) if s == space])
                x, c = _unit([data[i] for i in at]), sent.value[space]
                d = np.sqrt(np.maximum(0, 2 - 2 * (x @ c.T)))
                cell[at] = d.argmin(1)
                far[at] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], ["rep", "copies", "space", "vector", "cell", "far"])

    placed = groups.select("rep", "copies", "space", "vector").mapInArrow(nearest, "rep long, copies long, space string, vector binary, cell long, far double")
    sizes = placed.groupBy("space", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("parts"))
    rows = stage(
        placed.join(sizes, ["space", "cell"])
        .withColumn("block", F.concat_ws("/", "space", "cell", F.pmod(F.xxhash64("rep"), F.col("parts"))))
        .drop("parts"),
        "blocks",
    )
    blocks = rows.groupBy("space", "block").agg(F.first("cell").alias("cell"), F.max("far").alias("radius"))
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-7

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for space, c, d, r, s in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4, 5, 6))):
                known = sent.value.get(space)
                apart = 0.0 if known is None or c < 0 or d < 0 else float(np.linalg.norm(known[c] - known[d]))
                keep.append(apart <= r + s + reach)
            yield batch.filter(pa.array(keep, pa.bool_()))

    left = blocks.select("space", F.col("block").alias("a"), F.col("cell").alias("ca"), F.col("radius").alias("ra"))
    right = blocks.select("space", F.col("block").alias("b"), F.col("cell").alias("cb"), F.col("radius").alias("rb"))
    pairs = stage(
        left.join(right, "space")
        .where("a <= b")
        .select("space", "a", "ca", "b", "cb", "ra", "rb")
        .mapInArrow(prune, "space string, a string, ca long, b string, cb long, ra double, rb double")
        .select("a", "b"),
        "block-pairs",
    )
    slim = rows.select("block", "rep", "copies", "vector")
    sides = pairs.select("a", "b", F.col("a").alias("block")).unionByName(pairs.where("a <> b").select("a", "b", F.col("b").alias("block")))

    def traverse(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        block = np.array(table.column("block").to_pylist(), object)
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x = _unit(table.column("vector").to_pylist())
        at = [np.flatnonzero(block == k) for k in ((a, b) if a != b else (a,))]
        at = [k[np.argsort(rep[k])] for k in at]
        trees = [CoverTree(x[k]) for k in at]
        links, merger = np.zeros(len(rep), np.int64), Merger(len(rep))
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[order] = np.arange(len(rep))  # roots are the smallest id
        for u, v in close_pairs(trees[0], trees[-1], cosine):
            u, v = at[0][u], at[-1][v]
            links += np.bincount(u, copies[v], len(rep)).astype(np.int64) + np.bincount(v, copies[u], len(rep)).astype(np.int64)
            merger.add(place[u], place[v])
        some = np.flatnonzero(links > 0)
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[order][merger.root[place[some]]]})

    found = stage(
        sides.join(slim, "block").groupBy("a", "b").applyInArrow(traverse, "rep long, links long, root long"), "links"
    )
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (
        ready.select("vec_id", "key")
        .join(groups.select("key", "rep", "copies"), "key")
        .join(linked, "rep", "left")
        .join(named.withColumnRenamed("node", "rep"), "rep", "left")
        .groupBy("vec_id")
        .agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    )
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    return own.join(known, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
