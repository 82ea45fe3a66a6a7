"""Ranking metrics: ranked (query_id, rank from 0, doc_id) against qrels (query_id, doc_id, gain), averaged over all queries.

A list may repeat a document: hits are looked for in the list as it is, all else counts a document at its first rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_dedup(ranked: DataFrame) -> DataFrame:
    """Each document at its first rank only, ranks closed up."""
    first = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")) - 1)


def per_query(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, hit, recall, precision, rr, ndcg) for every query, with zeros where nothing was found or is relevant."""
    ks = sorted({int(k) for k in ks})
    good = qrels.where("gain > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain")))
    ideal = good.withColumn("i", ideal_rank)
    found = rank_dedup(ranked).join(good, ["query_id", "doc_id"]).withColumn("i", F.col("rank") + 1)
    # the first relevant rank of the list as it is, by one more aggregate of it
    raw = ranked.join(good.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("raw_first"))
    zero = F.lit(0.0)
    at = lambda k, e: F.sum(F.when(F.col("i") <= k, e))
    discounted = F.col("gain") / F.log2(F.col("i") + 1.0)
    f = found.groupBy("query_id").agg(F.min("i").alias("first"), *[at(k, F.lit(1)).alias(f"n{k}") for k in ks], *[at(k, discounted).alias(f"d{k}") for k in ks])
    g = ideal.groupBy("query_id").agg(F.count("*").alias("relevant"), *[at(k, discounted).alias(f"g{k}") for k in ks])
    rows = queries.select("query_id").join(f, "query_id", "left").join(g, "query_id", "left").join(raw, "query_id", "left")
    one = lambda k: F.struct(
        F.lit(k).alias("k"),
        F.coalesce((F.col("raw_first") < k).cast("double"), zero).alias("hit"),
        F.coalesce(F.col(f"n{k}") / F.col("relevant"), zero).alias("recall"),
        F.coalesce(F.col(f"n{k}") / F.lit(float(max(k, 1))), zero).alias("precision"),
        F.coalesce(1.0 / F.col("first"), zero).alias("rr"),
        F.coalesce(F.col(f"d{k}") / F.col(f"g{k}"), zero).alias("ndcg"),
    )
    return rows.select("query_id", F.inline(F.array(*map(one, ks))))


def report(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(mode, k, hit, recall, precision, mrr, ndcg) for ``ranked`` with a column ``mode``: every mode that occurs, over all queries."""
    modes = ranked.select("mode").distinct()
    names = queries.select("query_id", F.col("query_id").alias("__q"))
    keyed = lambda df: df.withColumn("query_id", F.struct("mode", "query_id"))
    every = keyed(modes.crossJoin(names.drop("__q")))  # modes are a few constants
    wanted = keyed(qrels.crossJoin(modes))
    rows = per_query(keyed(ranked), wanted, every, ks)
    return rows.groupBy(F.col("query_id.mode").alias("mode"), "k").agg(
        F.avg("hit").alias("hit"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg")
    )
