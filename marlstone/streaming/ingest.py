"""Continuous ingestion: manifest files that arrive in a folder are upserted to a versioned index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..plans import ingest
from ..sources.index import VersionedIndex, upsert
from ..sources.manifests import INGEST_SCHEMA, normalize_manifest, tile_contents


def upsert_batch(index: VersionedIndex, docs: DataFrame, config: EngineConfig, contents: DataFrame | None = None) -> int:
    """Replace the batch's documents in the index; returns the new version. Images are read from their files where ``contents`` is not given."""
    if contents is None:
        contents = tile_contents(docs.sparkSession, docs.select(F.explode("image_paths").alias("image_path")))
    docs = ingest.with_image_score(docs, contents)
    chunks, tiles = ingest.prepare(docs, config, F.col("image_score"))
    old_text, old_vision = index.read()
    ids = docs.select("doc_id").distinct()
    text = upsert(old_text, ingest.text_units(chunks, config).select(*old_text.columns), ids)
    vision = upsert(old_vision, ingest.vision_units(tiles, contents, config).select(*old_vision.columns), ids)
    return index.write(text, vision, config)


def stream_folder(spark: SparkSession, folder: str, index_path: str, checkpoint: str, config: EngineConfig = EngineConfig(), files: int = 100) -> StreamingQuery:
    """Watch a folder of JSON lines. Upserting is idempotent, so a batch that is run again after a failure changes nothing."""

    def take(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert_batch(VersionedIndex(spark, index_path), normalize_manifest(batch), config)

    rows = spark.readStream.schema(INGEST_SCHEMA).option("maxFilesPerTrigger", files).json(folder)
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(tiles: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop tiles of a stream (ts, scope, content_key) that came before within the delay; state older than that is forgotten."""
    return tiles.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scope", "content_key"])


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, value): tumbling windows over ``events`` (ts, event_type, value), late rows within bounds counted."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "events", "value")
