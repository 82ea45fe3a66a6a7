"""Which pages are worth pixels: image richness and the decision from all signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound, text_richness
from .dedup import decoder

SIGNALS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", "lines", "color", "midtone")])


def image_signals(gray: np.ndarray, rgb: np.ndarray | None) -> tuple[float, float, float, float]:
    """(score, lines, colour, midtones) of an image with values in [0, 1]."""
    if not gray.size:
        return 0.0, 0.0, 0.0, 0.0
    dark = gray < 0.5
    lines = min(1.0, (dark.mean(1) > 0.6).sum() / 8 + (dark.mean(0) > 0.6).sum() / 12)
    color = 0.0 if rgb is None else min(1.0, 4 * float((rgb.max(2) - rgb.min(2) > 0.18).mean()))
    midtone = min(1.0, 3 * float(((gray > 0.25) & (gray < 0.75)).mean()))
    return min(1.0, 0.45 * lines + 0.40 * color + 0.25 * midtone), float(lines), color, midtone


@F.pandas_udf(SIGNALS)
def image_richness(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Signals of Spark images (rows of bytes in BGR order)."""
    out = []
    for h, w, c, raw in zip(height, width, channels, data):
        x = np.frombuffer(raw, np.uint8).reshape(h, w, c) / 255.0
        rgb = x[:, :, 2::-1] if c >= 3 else None
        gray = rgb.mean(2) if rgb is not None else x[:, :, 0]
        out.append(image_signals(gray, rgb))
    return pd.DataFrame(out, columns=["score", "lines", "color", "midtone"])


@F.pandas_udf(T.DoubleType())
def image_score_of_file(content: pd.Series) -> pd.Series:
    """The score of the bytes of an image file; null for what cannot be decoded."""
    decode = decoder()

    def one(data):
        x = None if data is None else decode(bytes(data))
        if x is None:
            return None
        x = x / 255.0
        return image_signals(x if x.ndim == 2 else x[:, :, :3].mean(2), None if x.ndim == 2 else x[:, :, :3])[0]

    return content.map(one).astype(float)


def decide(
    pages: DataFrame, mode: str = "auto", threshold: float = 0.35, text_weight: float = 0.7,
    text: Column | None = None, html: Column | None = None, image_score: Column | None = None,
) -> DataFrame:
    """Add (index_pixels, richness). With an image its score leads and text can lift it; text alone decides alone; without signals pixels stay."""
    if mode in ("always", "never"):
        return pages.withColumn("index_pixels", F.lit(mode == "always")).withColumn("richness", F.lit(float(mode == "always")))
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    text = F.lit(None).cast("string") if text is None else text
    image = F.lit(None).cast("double") if image_score is None else image_score
    marked = html is not None
    html = F.lit(None).cast("string") if html is None else html

    def score(page: Column) -> Column:
        return (
            F.when(page["image"].isNotNull() & page["have"], F.greatest(page["image"], text_weight * page["t"], 0.6 * page["image"] + 0.4 * page["t"]))
            .when(page["image"].isNotNull(), page["image"])
            .when(page["have"], page["t"])
            .otherwise(F.lit(1.0))
        )

    def signals(own: Column) -> Column:
        have = (F.coalesce(own["text"], F.lit("")) != "") | (F.coalesce(own["html"], F.lit("")) != "")
        return F.struct(have.alias("have"), text_richness(own["text"], own["html"] if marked else None).alias("t"), own["image"].alias("image"))

    def judged(page: Column) -> Column:
        rich = score(page)
        return F.struct(rich.alias("richness"), ((rich >= threshold) | (~page["have"] & page["image"].isNull())).alias("index_pixels"))

    # bound: a filter by the outcome would else clean a page's text again for each regular expression
    out = bound(bound(F.struct(text.alias("text"), html.alias("html"), image.alias("image")), signals), judged)
    return pages.withColumn("__judged", out).withColumn("richness", F.col("__judged.richness")).withColumn("index_pixels", F.col("__judged.index_pixels")).drop("__judged")
