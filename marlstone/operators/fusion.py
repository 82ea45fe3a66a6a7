"""Fusion of ranked lists of both modalities to one list of documents per query.

``ranked`` has (query_id, modality, rank from 0, doc_id, unit_id, score), ``weights`` (query_id, text_weight,
vision_weight). Lists meet by union and aggregation: one shuffle on the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METHODS, NORMS = ("rrf", "calibrated"), ("minmax", "zscore", "softmax")
_TINY = 1e-12


def _weighted(ranked: DataFrame, weights: DataFrame) -> DataFrame:
    own = F.when(F.col("modality") == "text", F.col("text_weight")).otherwise(F.col("vision_weight"))
    return ranked.join(weights, "query_id").withColumn("weight", own).where("weight > 0").withColumn("m", F.when(F.col("modality") == "text", 0).otherwise(1))


def normalized_score(norm: str, temperature: float = 0.1) -> Column:
    """The score among those of its query and modality: min-max (all equal: 1), z-score through the logistic curve (0.5), or softmax."""
    own = Window.partitionBy("query_id", "modality")
    s = F.col("score")
    if norm == "minmax":
        low, high = F.min(s).over(own), F.max(s).over(own)
        return F.when(high - low <= _TINY, F.lit(1.0)).otherwise((s - low) / (high - low))
    if norm == "zscore":
        mean, std = F.avg(s).over(own), F.stddev_pop(s).over(own)
        return F.when(std <= _TINY, F.lit(0.5)).otherwise(1 / (1 + F.exp(-(s - mean) / std)))
    if norm == "softmax":
        e = F.exp((s - F.max(s).over(own)) / F.lit(max(temperature, 1e-6)))
        return e / F.sum(e).over(own)
    raise ValueError(f"unknown norm {norm!r}")


def _assembled(parts: DataFrame, best: Column, top_k: int) -> DataFrame:
    """Sum contributions by document, take the representative unit, order by score and first appearance."""
    grouped = parts.groupBy("query_id", "doc_id").agg(
        F.sum(F.when(F.col("m") == 0, F.col("part"))).alias("c_text"),
        F.sum(F.when(F.col("m") == 1, F.col("part"))).alias("c_vision"),
        F.min_by(F.struct("modality", "unit_id"), best).alias("rep"),
        F.min(F.struct("m", "rank")).alias("first"),
    )
    score = F.coalesce("c_text", F.lit(0.0)) + F.coalesce("c_vision", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first", "doc_id")
    return (
        grouped.withColumn("score", score)
        .withColumn("pos", F.row_number().over(order) - 1)
        .where(F.col("pos") < top_k)
        .select("query_id", "pos", "doc_id", "score", F.col("rep.modality").alias("modality"), F.col("rep.unit_id").alias("unit_id"), "c_text", "c_vision")
    )


def fuse_rrf(ranked: DataFrame, weights: DataFrame, top_k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Reciprocal ranks, weight / (k + rank) with ranks from 0, summed over all of a document's units."""
    parts = _weighted(ranked, weights).withColumn("part", F.col("weight") / (rrf_k + F.col("rank")))
    return _assembled(parts, F.struct("rank", "m", "unit_id"), top_k)


def fuse_calibrated(ranked: DataFrame, weights: DataFrame, top_k: int = 10, norm: str = "minmax", temperature: float = 0.1) -> DataFrame:
    """Weighted scores on a common scale, summed over all of a document's units."""
    parts = _weighted(ranked, weights).withColumn("part", F.col("weight") * normalized_score(norm, temperature))
    return _assembled(parts, F.struct(-F.round("part", 9), F.col("m"), F.col("rank")), top_k)


def fuse(ranked: DataFrame, weights: DataFrame, method: str = "rrf", top_k: int = 10, **options) -> DataFrame:
    if method == "rrf":
        return fuse_rrf(ranked, weights, top_k, options.get("rrf_k", 60))
    if method == "calibrated":
        return fuse_calibrated(ranked, weights, top_k, options.get("norm", "minmax"), options.get("temperature", 0.1))
    raise ValueError(f"unknown fusion method {method!r}")
