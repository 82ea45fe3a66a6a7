"""Exact dedup on a persistent digest index, bucketed and sorted by hash.

The index is an append-only Parquet table in buckets of the digest, each file sorted by it. A
batch of documents is reduced to one row per digest before it is shuffled, and a sort-merge
anti-join against the index, whose side needs no shuffle, finds the digests that are new.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, new_path, partitions, stage, with_id

#: white space that does not count, as a Java pattern
WHITE = "[\\x20\\x09-\\x0D]+"
SCHEMA = "digest string, keep_id long, n_points long, copies long, is_first boolean, batch string"


class DigestIndex:
    """A table of SHA-256 digests at ``path``: (digest, keep_id, n_points, copies, is_first, batch).

    Each batch appends one row per digest it holds; ``is_first`` marks the row where the digest was new,
    and ``keep_id`` is the id that stays (null if that row has none). Appending is one
    atomic Spark write; a batch name that is already there is refused, so a job that is run again cannot count rows
    twice. The number of buckets is stored beside the rows: an index that is opened again keeps it, and another number
    asked for is refused.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or new_path(spark, "digests")).rstrip("/")
        stored = self._stored_buckets()
        if stored is None:
            stored = buckets or partitions(spark, 8)
            # files that start with an underscore are not read as rows of the table
            spark.createDataFrame([(stored,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_buckets")
        elif buckets not in (None, stored):
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = stored
        self.table = f"digests_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        spark.catalog.refreshTable(self.table)

    def _stored_buckets(self) -> int | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_buckets/_SUCCESS")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema("buckets int").parquet(f"{self.path}/_buckets").first()[0]

    def close(self) -> None:
        """Take the table out of the catalog; its rows stay at ``path``."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Anti-join the digests of a batch (digest, best_id, n_points, copies) against the index and append them."""
        known = self.rows()
        if known.where(F.col("batch") == batch).limit(1).count():
            raise ValueError(f"batch {batch!r} is in the index already")
        held = known.where("is_first").select("digest")
        columns = ("digest", F.col("best_id").alias("keep_id"), "n_points", "copies")
        fresh = groups.join(held.hint("merge"), "digest", "left_anti").select(*columns, F.lit(True).alias("is_first"))
        again = groups.join(held.hint("merge"), "digest", "left_semi").select(*columns, F.lit(False).alias("is_first"))
        (
            fresh.unionByName(again)
            .withColumn("batch", F.lit(batch))
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.table)
        )

    def lookup(self) -> DataFrame:
        """(digest, keep_id, group_size): one row per digest over all batches."""
        return self.rows().groupBy("digest").agg(F.max_by("keep_id", F.col("is_first").cast("int")).alias("keep_id"), F.sum("copies").alias("group_size"))


def digest_of(text: Column) -> Column:
    """SHA-256 of a text without its white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "").cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_points, text_sha256) of each row; ``n_points`` counts the code points of the text as it is."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return with_id(docs, id_col, text_col).select("doc_id", F.length(text).cast("long").alias("n_points"), digest_of(text).alias("text_sha256"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str = "0"
) -> DataFrame:
    """Mark the rows of ``docs`` whose normalised text is new: (doc_id, keep_id, group_size, kept, text_sha256).

    Of equal texts in a batch the row with the most code points in its original text stays, then the
    smallest id; a text that the index held before keeps the id stored there. ``group_size`` counts
    rows of all batches so far. Null and empty texts are equal to each other. Rows that repeat an id
    and a text are rows like others: each counts, and each has the flag of its id. A null id is an id like others; among
    texts of equal length it comes last. Empty input gives an empty result.
    """
    held = index or DigestIndex(docs.sparkSession)
    lean = stage(digests(docs, id_col, text_col), "digest-rows")
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id")))
    groups = (
        lean.groupBy(F.col("text_sha256").alias("digest"))
        .agg(best.alias("best"), F.count("*").alias("copies"))
        .select("digest", F.col("best.doc_id").alias("best_id"), (-F.col("best.col1")).alias("n_points"), "copies")
    )
    held.append(groups, batch)
    found = held.lookup()
    if index is None:
        # nobody else reads this index; as a plain table its digests may be split in the join where one of them is hot
        found = stage(found, "digests-found")
        held.close()
    return lean.join(found, lean.text_sha256 == found.digest).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the exact copies, rows that repeat an id and a text included: the stage of the pipeline. Columns are unchanged.

    Texts are shuffled once, by id and digest, which no two of the rows that stay have in common.
    """
    own = free_name(docs, "own_key")
    row_key = lambda doc_id, digest: F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), digest)
    kept = exact_dedup(docs).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias(own)).distinct()
    named = docs.withColumn(own, row_key(F.col("doc_id").cast("long"), digest_of(F.col("text"))))
    return named.join(kept.hint("merge"), own, "left_semi").dropDuplicates([own]).select(*docs.columns)
