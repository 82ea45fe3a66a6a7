"""The read path: route, search both modalities, fuse, rerank, for a batch of questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import embedding, fusion, rerank, routing, topk


def weigh(queries: DataFrame, config: EngineConfig, modality: str | None = None) -> DataFrame:
    """``queries`` with text_weight and vision_weight; one modality by force sets the other's to 0 and asks no router."""
    if modality in ("text", "vision"):
        return queries.withColumn("text_weight", F.lit(config.fusion.text_weight if modality == "text" else 0.0)).withColumn(
            "vision_weight", F.lit(config.fusion.vision_weight if modality == "vision" else 0.0)
        )
    if modality not in (None, "hybrid"):
        raise ValueError(f"unknown modality {modality!r}")
    base = config.fusion.text_weight, config.fusion.vision_weight
    if not config.router.on:
        return queries.withColumn("text_weight", F.lit(base[0])).withColumn("vision_weight", F.lit(base[1]))
    weights = routing.load_router(config.router.weights_file) if config.router.weights_file else None
    return routing.route(queries, config.router.kind, weights, *base)


def rank_units(queries: DataFrame, text_units: DataFrame, vision_units: DataFrame, fetch: int, modality: str | None = None) -> DataFrame:
    """Ranked units of both modalities for ``queries`` (query_id, text_embedding, vision_embedding)."""
    parts = []
    for name, units in (("text", text_units), ("vision", vision_units)):
        if modality in (None, "hybrid", name):
            own = queries.select("query_id", F.col(f"{name}_embedding").alias("embedding"))
            parts.append(topk.vector_topk(own, units, fetch).withColumn("modality", F.lit(name)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def search(
    queries: DataFrame, text_units: DataFrame, vision_units: DataFrame, config: EngineConfig = EngineConfig(),
    top_k: int | None = None, modality: str | None = None, reranked: bool | None = None, method: str | None = None,
) -> DataFrame:
    """(query_id, pos, doc_id, score, modality, unit_id, c_text, c_vision[, c_rerank], text, image_path, page, meta) for ``queries`` (query_id, query).

    Three times as many units are fetched as documents are wanted. Text and payload are joined to the few fused rows, not
    carried through the search. ``queries`` may bring text_embedding and vision_embedding; they come from the question by the models of the settings otherwise.
    """
    top_k = top_k or config.fusion.top_k
    reranked = (config.rerank.on if reranked is None else reranked) and config.rerank.model.strip() not in ("", "none")
    depth = max(top_k, config.rerank.depth) if reranked else top_k
    q, v = F.col("query"), config.vision
    if "text_embedding" not in queries.columns and modality != "vision":
        queries = queries.withColumn("text_embedding", embedding.text_vectors(q, config.text.name, config.text.dim))
    if "vision_embedding" not in queries.columns and modality != "text":
        queries = queries.withColumn("vision_embedding", embedding.question_vectors(q, v.name, v.dim, v.family, v.batch, v.instruction))
    weights = weigh(queries.select("query_id", "query"), config, modality).select("query_id", "text_weight", "vision_weight")
    ranked = rank_units(queries, text_units, vision_units, 3 * depth, modality)
    fused = fusion.fuse(ranked, weights, method or config.fusion.method, depth, rrf_k=config.fusion.rank_offset, norm=config.fusion.norm, temperature=config.fusion.temperature)
    hits = with_payload(fused, text_units, vision_units)
    return rerank.rerank_with(config.rerank.model, queries.select("query_id", "query"), hits, config.rerank.blend, top_k) if reranked else hits


def with_payload(fused: DataFrame, text_units: DataFrame, vision_units: DataFrame) -> DataFrame:
    """Join what the chosen units hold to the fused rows."""
    absent = lambda df, name, kind: F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    rows = [
        df.select(F.col("unit_id").cast("string").alias("unit_id"), F.lit(m).alias("modality"), *[absent(df, n, k).alias(n) for n, k in (("text", "string"), ("image_path", "string"), ("page", "int"), ("meta", "map<string,string>"))])
        for m, df in (("text", text_units), ("vision", vision_units))
    ]
    wanted = fused.withColumn("unit_id", F.col("unit_id").cast("string"))
    payload = rows[0].unionByName(rows[1]).join(wanted.select("unit_id", "modality").distinct(), ["unit_id", "modality"], "left_semi").dropDuplicates(["unit_id", "modality"])
    return wanted.join(payload, ["unit_id", "modality"], "left")


def result_rows(hits: DataFrame) -> DataFrame:
    """Rows as they are handed out: score and components rounded to six digits."""
    return hits.withColumns({c: F.round(c, 6) for c in ("score", "c_text", "c_vision", "c_rerank") if c in hits.columns})


