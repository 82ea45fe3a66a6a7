"""Storage and price of an index by mode, and their projection to a number of pages."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOAT_BYTES = 4
GB, TB = 1024**3, 1024**4


@dataclass(frozen=True)
class CostModel:
    """Unit prices in dollars and sizes in bytes. The defaults are fixed values."""

    storage_usd_per_gb_month: float = 0.023
    text_embed_usd_per_1k_units: float = 0.0001
    vision_embed_usd_per_1k_units: float = 0.02
    render_usd_per_page: float = 0.0003
    text_query_usd: float = 0.000002
    vision_query_usd: float = 0.0004
    bytes_per_text_unit_raw: int = 1024
    screenshot_bytes_per_page: int = 307_200
    tile_bytes: int = 81_920
    text_chunks_per_page: float = 3.0
    tiles_per_page: float = 4.0

    @classmethod
    def from_dict(cls, data: dict) -> CostModel:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})


def index_stats(text_units: DataFrame, vision_units: DataFrame) -> DataFrame:
    """One row: text_units, vision_units, pages (distinct documents and pages of tiles), documents, duplicates folded into tiles."""
    t = text_units.agg(F.count("*").alias("text_units"))
    folded = F.coalesce(F.sum(F.col("duplicate_count") - 1), F.lit(0)) if "duplicate_count" in vision_units.columns else F.lit(0)
    v = vision_units.agg(F.count("*").alias("vision_units"), F.countDistinct("doc_id", "page").alias("pages"), folded.cast("long").alias("tiles_folded"))
    d = text_units.select("doc_id").unionByName(vision_units.select("doc_id")).agg(F.countDistinct("doc_id").alias("documents"))
    return t.crossJoin(v).crossJoin(d)  # three rows of one


def estimate(stats: DataFrame, text_dim: int = 384, vision_dim: int = 512, model: CostModel = CostModel()) -> DataFrame:
    """(mode, vector_bytes, artifact_bytes, storage_bytes, storage_usd_month, index_usd, query_usd) for text, vision and both."""
    t, v, p = (F.col(c).cast("double") for c in ("text_units", "vision_units", "pages"))
    text = (t * text_dim * FLOAT_BYTES, t * model.bytes_per_text_unit_raw, t / 1000 * model.text_embed_usd_per_1k_units, F.lit(model.text_query_usd))
    vision = (
        v * vision_dim * FLOAT_BYTES,
        p * model.screenshot_bytes_per_page + v * model.tile_bytes,
        v / 1000 * model.vision_embed_usd_per_1k_units + p * model.render_usd_per_page,
        F.lit(model.vision_query_usd),
    )
    both = tuple(a + b for a, b in zip(text, vision))
    one = lambda name, x: F.struct(
        F.lit(name).alias("mode"), x[0].cast("long").alias("vector_bytes"), x[1].cast("long").alias("artifact_bytes"), x[2].alias("index_usd"), x[3].alias("query_usd")
    )
    rows = stats.select(F.inline(F.array(one("text", text), one("vision", vision), one("hybrid", both))))
    return rows.withColumn("storage_bytes", F.col("vector_bytes") + F.col("artifact_bytes")).withColumn(
        "storage_usd_month", F.col("storage_bytes") / GB * model.storage_usd_per_gb_month
    )


def project(pages: DataFrame, text_dim: int = 384, vision_dim: int = 512, model: CostModel = CostModel()) -> DataFrame:
    """For a table (pages): (pages, mode, bytes_per_page, total_bytes, total_tb, storage_usd_month)."""
    text = round(model.text_chunks_per_page * text_dim * FLOAT_BYTES) + round(model.text_chunks_per_page * model.bytes_per_text_unit_raw)
    vision = round(model.tiles_per_page * vision_dim * FLOAT_BYTES) + round(model.screenshot_bytes_per_page + model.tiles_per_page * model.tile_bytes)
    sizes = {"text": text, "vision": vision, "hybrid": text + vision}
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(s).cast("long").alias("bytes_per_page")) for m, s in sizes.items()])
    rows = pages.select(F.col("pages").cast("long").alias("pages"), F.inline(modes)).withColumn("total_bytes", F.col("bytes_per_page") * F.col("pages"))
    return rows.withColumn("total_tb", F.round(F.col("total_bytes") / TB, 4)).withColumn(
        "storage_usd_month", F.round(F.col("total_bytes") / GB * model.storage_usd_per_gb_month, 2)
    )
