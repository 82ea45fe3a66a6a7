"""The write path: documents to units with embeddings, as one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import dedup, embedding, selection, units

OCCURRENCES = "array<struct<seq:long,unit_id:string,doc_id:string>>"


def prepare(docs: DataFrame, config: EngineConfig, image_score: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, tiles) of normalized manifest rows: text, else the text of the page's HTML; the page's title under user meta; tiles only where pixels are wanted."""
    text = F.coalesce(F.when(F.col("text") != "", F.col("text")), units.html_to_text(F.col("html")), F.lit(""))
    base = docs.withColumn("text", text)
    titled = F.when(F.col("title") != "", F.create_map(F.lit("title"), "title")).otherwise(F.create_map().cast("map<string,string>"))
    own = F.map_filter(titled, lambda k, v: ~F.map_contains_key("meta", k))  # user keys win
    base = base.withColumn("meta", F.map_concat(own, "meta"))
    chunks = units.chunk_text(base.select("doc_id", "page", "title", "meta", "seq", "text"), config.chunks.size, config.chunks.overlap)
    judged = selection.decide(base, config.pixels.mode, config.pixels.threshold, config.pixels.text_share, text=F.col("text"), image_score=image_score)
    wanted = judged.where(~F.col("apply_selection") | F.col("index_pixels"))
    tiles = wanted.select("doc_id", "page", "meta", "seq", F.posexplode("image_paths").alias("row", "image_path")).select(
        F.format_string("%s_p%d_t%d", "doc_id", "page", "row").alias("unit_id"), "doc_id", "image_path", "page", "row",
        F.lit(0).alias("col"), F.lit(None).cast("array<int>").alias("bbox"), "meta", "seq",
    )
    return chunks, tiles


def with_image_score(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """Manifest rows with ``image_score``, that of their first image where ``contents`` (image_path, content) has it."""
    first = docs.select("seq", F.get("image_paths", F.lit(0)).alias("image_path")).where("image_path is not null")
    scored = first.join(contents, "image_path").select("seq", selection.image_score_of_file(F.col("content")).alias("image_score"))
    return docs.join(scored, "seq", "left")


def text_units(chunks: DataFrame, config: EngineConfig) -> DataFrame:
    return chunks.select(
        "unit_id", F.col("doc_id").cast("string").alias("doc_id"), "text", "page", "ord", "title", "meta", "seq",
        embedding.text_vectors(F.col("text"), config.text.name, config.text.dim).alias("embedding"),
    )


def folded_tiles(tiles: DataFrame, contents: DataFrame | None, config: EngineConfig) -> DataFrame:
    """Tiles with their files' contents (image_path, content) joined, and equal ones of a document, or of all, folded."""
    if contents is None:
        joined = tiles.withColumn("content", F.lit(None).cast("binary"))
    else:
        joined = tiles.join(contents.select("image_path", "content"), "image_path", "left")
    if config.tiles.fold in ("off", "none"):
        return joined.withColumn("duplicate_count", F.lit(1).cast("long")).withColumn("occurrences", F.lit(None).cast(OCCURRENCES))
    keyed = joined.withColumn("content_key", dedup.content_key(F.col("content"), F.col("image_path"), F.col("unit_id"), config.tiles.fold_by))
    # the tiles of one page share its number
    return dedup.deduplicate(keyed, scope="global" if config.tiles.fold == "global" else "doc", order=F.struct("seq", "row", "unit_id"))


def vision_units(tiles: DataFrame, contents: DataFrame | None, config: EngineConfig) -> DataFrame:
    """Folded tiles with the vectors of the vision model."""
    own = config.vision
    vector = embedding.tile_vectors(F.col("content"), F.coalesce("image_path", "unit_id"), own.name, own.dim, own.family, own.batch)
    return folded_tiles(tiles, contents, config).select(
        "unit_id", "doc_id", "image_path", "page", "row", "col", "bbox", "meta", "occurrences", "duplicate_count", "seq", vector.alias("embedding")
    )


def page_tiles(pages: DataFrame, folder: str, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(tiles, contents) of page images (doc_id, page, seq, height, width, channels, data): the tiles' files lie below ``folder``."""
    cut = units.cut_tiles(pages.select("doc_id", "page", "height", "width", "channels", "data"), config.tiles.height, config.tiles.overlap)
    step = max(config.tiles.height - config.tiles.overlap, 1)
    top = F.col("row") * step
    named = cut.join(pages.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "seq", "height", "width"), (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")))
    rows = named.withColumn("image_path", F.concat(F.lit(folder.rstrip("/") + "/"), "unit_id", F.lit(".png")))
    tiles = rows.select(
        F.col("unit_id"), F.col("doc_id"), "image_path", F.col("page").cast("int").alias("page"), F.col("row").cast("int").alias("row"), F.lit(0).alias("col"),
        F.array(F.lit(0), top, F.col("width"), F.least(top + config.tiles.height, F.col("height"))).cast("array<int>").alias("bbox"), F.create_map().cast("map<string,string>").alias("meta"), "seq",
    )
    return tiles, rows.select("image_path", F.col("png").alias("content"))


def ingest_stats(docs: DataFrame, chunks: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row: documents, text_docs, html_docs, chunks, tiles, docs_with_pixels, vision_skipped (documents whose images are not wanted)."""
    d = docs.agg(
        F.count("*").alias("documents"),
        F.count_if(F.coalesce("text", F.lit("")) != "").alias("text_docs"),
        F.count_if((F.coalesce("text", F.lit("")) == "") & (F.coalesce("html", F.lit("")) != "")).alias("html_docs"),
        F.count_if(F.size("image_paths") > 0).alias("with_images"),
    )
    c = chunks.agg(F.count("*").alias("chunks"))
    t = tiles.agg(F.count("*").alias("tiles"), F.countDistinct("doc_id").alias("docs_with_pixels"), F.countDistinct("seq").alias("rows_with_pixels"))
    rows = d.crossJoin(c).crossJoin(t)  # rows of one
    return rows.withColumn("vision_skipped", F.col("with_images") - F.col("rows_with_pixels")).drop("with_images", "rows_with_pixels")
