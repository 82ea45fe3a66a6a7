"""Tile deduplication: a hash aggregate with the first tile of each group as its representative."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import read_png

TILE_BYTES = 200_000


def exact_key(content: Column, image_path: Column, unit_id: Column) -> Column:
    """Digest of the content; of the path, or the unit's name, where there is no content to read."""
    own = F.concat(F.lit("id:"), F.sha2(F.coalesce(image_path, unit_id.cast("string")).cast("binary"), 256))
    return F.coalesce(F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256)), own)


def deduplicate(tiles: DataFrame, key: str = "content_key", scope: str = "doc", order: Column | None = None) -> DataFrame:
    """A row per group of tiles with one key, by the tile that is first by ``order`` (by ``seq``, then name): its columns, ``duplicate_count`` and ``occurrences``.

    ``tiles`` needs (seq, unit_id, doc_id) and the key. Groups lie within a document (``doc``) or across all
    (``global``). ``occurrences`` lists the members of groups of more than one, in order; a
    partial aggregate on each task comes before the shuffle.
    """
    if scope not in ("doc", "global"):
        raise ValueError(f"unknown scope {scope!r}")
    by = [key, "doc_id"] if scope == "doc" else [key]
    first = F.min_by(F.struct(*tiles.columns), F.struct("seq", "unit_id") if order is None else order)
    member = F.struct("seq", "unit_id", "doc_id")
    grouped = tiles.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(
        first.alias("tile"), F.count("*").alias("duplicate_count"), F.sort_array(F.collect_list(member)).alias("occurrences")
    )
    return grouped.select("tile.*", "duplicate_count", F.when(F.col("duplicate_count") > 1, F.col("occurrences")).alias("occurrences"))


def dedup_stats(tiles: DataFrame, key: str = "content_key", scope: str = "doc", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row: input_tiles, unique_tiles, duplicate_tiles, groups, bytes_saved, ratio (4 decimals)."""
    by = [key, "doc_id"] if scope == "doc" else [key]
    n = F.col("n")
    return (
        tiles.groupBy(*by).agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("input_tiles"),
            F.count("*").alias("unique_tiles"),
            F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_tiles"),
            F.count_if(n > 1).alias("groups"),
        )
        .withColumn("bytes_saved", F.col("duplicate_tiles") * tile_bytes)
        .withColumn("ratio", F.when(F.col("input_tiles") > 0, F.round(F.col("duplicate_tiles") / F.col("input_tiles"), 4)).otherwise(F.lit(0.0)))
    )


def content_key(content: Column, image_path: Column, unit_id: Column, method: str = "exact") -> Column:
    """The key by which tiles are folded: ``exact`` by their bytes, ``ahash`` by what they look like and by bytes where no image can be decoded."""
    if method not in ("exact", "ahash"):
        raise ValueError(f"unknown method {method!r}")
    exact = exact_key(content, image_path, unit_id)
    return exact if method == "exact" else F.coalesce(F.concat(F.lit("ahash:"), average_hash_of_file(content)), exact)


def decoder():
    """(bytes of an image file) to an array [height, width] or [height, width, 3] of bytes, or None; by Pillow where the executors have it, else by a reader of plain PNG files."""
    try:
        import io

        from PIL import Image
    except ImportError:
        return read_png

    def decode(data: bytes):
        try:
            with Image.open(io.BytesIO(data)) as image:
                return np.asarray(image.convert("RGB"))
        except OSError:
            return None

    return decode


@F.pandas_udf(T.StringType())
def average_hash_of_file(content: pd.Series) -> pd.Series:
    """``average_hash`` of the bytes of image files; null for what cannot be decoded."""
    decode = decoder()

    def one(data):
        x = None if data is None else decode(bytes(data))
        return None if x is None else _hash_of(x.astype(float) if x.ndim == 2 else x[:, :, :3].astype(float) @ (0.299, 0.587, 0.114))

    return content.map(one)


def _hash_of(gray: np.ndarray) -> str | None:
    h, w = gray.shape
    if h < 8 or w < 8:
        return None
    rows, cols = np.arange(9) * h // 8, np.arange(9) * w // 8
    box = np.add.reduceat(np.add.reduceat(gray, rows[:-1], 0), cols[:-1], 1) / np.outer(np.diff(rows), np.diff(cols))
    bits = (box >= box.mean()).reshape(-1)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


@F.pandas_udf(T.StringType())
def average_hash(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """64 bits in hex of a Spark image: its gray means over 8 x 8 boxes, each against their mean. Null for images under 8 x 8."""

    def one(h, w, c, raw):
        if raw is None:
            return None
        x = np.frombuffer(raw, np.uint8).reshape(h, w, c).astype(float)
        return _hash_of(x[:, :, 0] if c < 3 else x[:, :, :3] @ (0.114, 0.587, 0.299))

    return pd.Series([one(*r) for r in zip(height, width, channels, data)])
