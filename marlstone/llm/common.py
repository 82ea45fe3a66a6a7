"""What the operators of this subpackage share: the shared folder, staged tables, connected components.

Staged tables are Parquet folders below ``spark.checkpoint.dir`` so that every executor, and a
retried task after a lost executor, can read them again.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import forget_powers

_own_dir: dict[str, str] = {}
_worker: dict[str, object] = {}
Held = TypeVar("Held")


def worker_state(name: str, make: Callable[[], Held]) -> Held:
    """What an operator keeps from task to task in a Python worker. Spark uses workers again for other operators, so what others left is freed first, kept or only used."""
    if name not in _worker:
        _worker.clear()
        forget_powers()
        _release()
        _worker[name] = make()
        _release()
    return _worker[name]


def _release() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def free_worker() -> None:
    """Give back what operators kept in this Python worker; the first thing that a task with large arrays does."""
    if _worker:
        _worker.clear()
        _release()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names; without it a temporary one, but only where all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _own_dir:
            _own_dir["dir"] = tempfile.mkdtemp(prefix="marlstone-")
        base = _own_dir["dir"]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the work is done once."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have; names count as equal whatever their case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def with_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so that extra columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: rows (node, component), component the smallest node.

    ``edges`` has long columns ``a`` and ``b``. Alternates the large-star and small-star steps
    until the edges no longer change: O(log^2 n) rounds, each two aggregations and two joins on
    pre-aggregated minima, so a node with very many neighbours is never collected into a list.
    Nodes without edges are absent. An empty edge table gives an empty result.
    """
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        # large star: link every larger neighbour of a node to the node's smallest neighbour or itself
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # small star: link every smaller neighbour, and the node itself, to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after = stage(small, "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(current)
        current = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every node points at the smallest node of its component
    roots = current.groupBy("a").agg(F.min("b").alias("component"))
    return roots.select(F.col("a").alias("node"), "component").unionByName(
        roots.select(F.col("component").alias("node"), "component").distinct()
    )
