"""BM25 over each query's own candidates, and blending it with the fused score."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens

K1, B = 1.5, 0.75


def bm25(queries: DataFrame, candidates: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, cand_id, bm25) for ``queries`` (query_id, query) and ``candidates`` (query_id, cand_id, text); columns to ``carry`` come along.

    The candidates of a query are the corpus of its statistics; empty ones count. Only the tokens that are among
    a query's distinct terms are exploded, and all windows and aggregates share one shuffle on the query.
    """
    terms = queries.select("query_id", F.array_distinct(tokens(F.coalesce("query", F.lit("")))).alias("terms"))
    own = Window.partitionBy("query_id")
    docs = (
        candidates.select("query_id", "cand_id", *carry, tokens(F.coalesce("text", F.lit(""))).alias("tok"))
        .join(terms, "query_id", "left")
        .withColumn("len", F.size("tok"))
        .withColumn("n", F.count("*").over(own))
        .withColumn("mean", F.avg("len").over(own))
    )
    asked = F.filter("tok", lambda t: F.array_contains("terms", t))
    tf = (
        docs.select("query_id", "cand_id", *carry, "len", "n", "mean", F.explode_outer(asked).alias("term"))
        .groupBy("query_id", "cand_id", "len", "n", "mean", "term")
        .agg(F.count("term").alias("tf"), *[F.first(c).alias(c) for c in carry])
    )
    df = F.count("*").over(Window.partitionBy("query_id", "term"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(F.lit(1.0))
    part = F.when(F.col("term").isNotNull(), idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean)))
    return tf.withColumn("df", df).groupBy("query_id", "cand_id").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("bm25"), *[F.first(c).alias(c) for c in carry])


def blend(scored: DataFrame, weight: float = 0.5, top_k: int | None = None) -> DataFrame:
    """Reorder hits (query_id, pos, doc_id, score, text[, meta]) by their ``rerank_raw`` blended with their score.

    Both are scaled to their range in the query, all equal to 0. A candidate without text keeps its fused standing. Adds ``c_rerank``.
    """
    weight = min(1.0, max(0.0, weight))
    own = Window.partitionBy("query_id")

    def scaled(name: str):
        low, high = F.min(name).over(own), F.max(name).over(own)
        return F.when(high - low < 1e-12, F.lit(0.0)).otherwise((F.col(name) - low) / (high - low))

    rows = (
        scored.withColumn("rerank_raw", F.coalesce("rerank_raw", F.lit(0.0)))
        .withColumn("__rr", scaled("rerank_raw"))
        .withColumn("__fn", scaled("score"))
        .withColumn("__rr", F.when(F.trim(candidate_text(scored)) == "", F.col("__fn")).otherwise(F.col("__rr")))
        .withColumn("score", weight * F.col("__rr") + (1 - weight) * F.col("__fn"))
        .withColumn("c_rerank", F.round("__rr", 6))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos")
    rows = rows.withColumn("__pos", F.row_number().over(order) - 1).drop("pos", "__rr", "__fn", "rerank_raw").withColumnRenamed("__pos", "pos")
    return rows.where(F.col("pos") < top_k) if top_k else rows


def candidate_text(hits: DataFrame) -> Column:
    """What a hit is scored by: its text, else the title or the recognised text that its meta data name."""
    said = F.when(F.col("text") != "", F.col("text"))
    if "meta" not in hits.columns:
        return F.coalesce(said, F.lit(""))
    return F.coalesce(said, *[F.when(F.col("meta")[k] != "", F.col("meta")[k]) for k in ("title", "ocr")], F.lit(""))


def rerank(queries: DataFrame, fused: DataFrame, weight: float = 0.5, top_k: int | None = None) -> DataFrame:
    """BM25 rerank of fused hits that carry their text; the hits are computed once and come along through the scoring."""
    own = candidate_text(fused)
    hits = fused.withColumn("__said", own).withColumnRenamed("text", "__text").withColumn("cand_id", F.col("doc_id")).withColumnRenamed("__said", "text")
    carry = tuple(c for c in hits.columns if c not in ("query_id", "cand_id", "text"))
    scored = bm25(queries, hits, carry).drop("cand_id").withColumnRenamed("__text", "text").withColumnRenamed("bm25", "rerank_raw")
    return blend(scored, weight, top_k)


def model_scores(queries: DataFrame, candidates: DataFrame, load) -> DataFrame:
    """(query_id, cand_id, rerank_raw) by a model on pairs: ``load`` runs once a task and returns a function from lists of questions and texts to scores."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for question, text in batches:
            yield pd.Series(model(list(question), list(text)), dtype=float)

    pairs = candidates.join(queries.select("query_id", "query"), "query_id")
    return pairs.select("query_id", "cand_id", score(F.col("query"), F.coalesce("text", F.lit(""))).alias("rerank_raw"))


def rerank_by_model(queries: DataFrame, fused: DataFrame, load, weight: float = 0.5, top_k: int | None = None) -> DataFrame:
    """Rerank fused hits that carry their text with a model on pairs."""
    scores = model_scores(queries, fused.select("query_id", F.col("doc_id").alias("cand_id"), candidate_text(fused).alias("text")), load)
    return blend(fused.join(scores.withColumnRenamed("cand_id", "doc_id"), ["query_id", "doc_id"], "left"), weight, top_k)


def pair_model(name: str):
    """A loader for ``model_scores``: the cross-encoder of that name, from sentence-transformers on the executors."""

    def load():
        try:
            from sentence_transformers import CrossEncoder
        except ImportError as e:
            raise ImportError(f"reranking with {name} needs sentence-transformers on the executors") from e
        model = CrossEncoder(name)
        return lambda questions, texts: [float(x) for x in model.predict(list(zip(questions, texts)))]

    return load


def rerank_with(model: str, queries: DataFrame, fused: DataFrame, weight: float = 0.5, top_k: int | None = None) -> DataFrame:
    """Rerank as the setting says: by BM25 (``lexical``) or by the cross-encoder of that name; ``none`` and an empty name leave the order as it is."""
    if model.strip() in ("", "none"):
        return fused if top_k is None else fused.where(F.col("pos") < top_k)
    if model.strip() == "lexical":
        return rerank(queries, fused, weight, top_k)
    return rerank_by_model(queries, fused, pair_model(model.strip()), weight, top_k)
