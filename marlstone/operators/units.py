"""From documents to units: visible text of HTML, chunks, tiles."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import png
from ..functions.text import clean_text

#: fixed values: elements whose content is not text, and elements that begin a line
SKIPPED = frozenset(("script", "style", "noscript", "head"))
LINE_STARTS = frozenset(("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"))


class _VisibleText(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.depth += 1
        elif tag in LINE_STARTS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data)


@F.udf(T.StringType(), useArrow=False)  # not by Arrow: a batch holds 64 MB of pages then, and a task has a worker for each step
def _visible_text(page: str | None) -> str | None:
    if page is None:
        return None
    parser = _VisibleText()
    parser.feed(page)  # never closed: an unfinished tag or entity at the end is left out
    return "".join(parser.parts)


def html_to_text(html: Column) -> Column:
    """Visible text of a page, cleaned. Text nodes of white space alone are dropped, so inline tags do not keep blanks between them."""
    return clean_text(_visible_text(html))


#: fixed values: where a chunk may end, best first
STOPS = (". ", "\n", " ")


def _soft_end(window: str, size: int) -> int:
    """Length of the window up to its last sentence end, line end or blank in the second half; its whole length without one."""
    ends = ((window.rfind(s), len(s)) for s in STOPS)
    return next((at + width for at, width in ends if 2 * at > size), len(window))


def _windows(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    pieces, at = [], 0
    while at < len(text):
        whole = at + size >= len(text)
        end = len(text) if whole else at + _soft_end(text[at : at + size], size)
        pieces.append(text[at:end].strip())
        at = len(text) if whole else max(end - overlap, at + 1)
    return list(enumerate(filter(None, pieces)))


def chunk_text(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """A row per chunk of ``text``: the other columns, then (ord, text, unit_id).

    A chunk ends at the last sentence end, else line end, else blank in the second half of its window, and the next
    starts ``overlap`` characters before that. Each start depends on the chunk before, so a function in Python
    walks a text; rows go to it a hundred at a time, which bounds its memory. The id is the start of a digest of document, number and first characters.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    @F.udf("array<struct<ord:int,text:string>>", useArrow=False)
    def split(text: str | None) -> list[tuple[int, str]]:
        return _windows(text, size, overlap) if text else []

    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.inline(split(clean_text(F.col("text"))))).withColumn("unit_id", chunk_id(F.col("doc_id"), F.col("ord"), F.col("text")))


def chunk_id(doc_id: Column, number: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", doc_id.cast("string"), number.cast("string"), F.substring(text, 1, 32)).cast("binary")), 1, 16)


def tile_geometry(pages: DataFrame, tile_height: int = 512, overlap: int = 64) -> DataFrame:
    """A row per horizontal tile of pages (doc_id, page, width, height): (unit_id, doc_id, page, row, col, x0, y0, x1, y1)."""
    step = max(tile_height - overlap, 1)
    tops = F.sequence(F.lit(0), F.greatest(F.col("height") - 1, F.lit(0)), F.lit(step))
    return (
        pages.select("doc_id", "page", "width", "height", F.posexplode(tops).alias("row", "y0"))
        .where((F.col("y0") == 0) | (F.col("y0") - step + tile_height < F.col("height")))
        .select(
            F.format_string("%s_p%d_t%d", F.col("doc_id").cast("string"), "page", "row").alias("unit_id"),
            "doc_id", "page", "row", F.lit(0).alias("col"), F.lit(0).alias("x0"), "y0", F.col("width").alias("x1"),
            F.least(F.col("y0") + tile_height, F.col("height")).alias("y1"),
        )
    )


def tiles_from_paths(paths: DataFrame) -> DataFrame:
    """(unit_id, doc_id, image_path) of image files: the name without its ending, and what stands in it before the last ``_p``."""
    stem = F.regexp_replace(F.regexp_extract("image_path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    before = F.regexp_extract(stem, r"^(.+)_p", 1)
    return paths.select(stem.alias("unit_id"), F.when(before != "", before).otherwise(stem).alias("doc_id"), "image_path")


def cut_tiles(images: DataFrame, tile_height: int = 512, overlap: int = 64) -> DataFrame:
    """(unit_id, doc_id, page, row, png) of page images (doc_id, page, height, width, channels, data), data in Spark's byte order; the tiles are those of ``tile_geometry``."""
    tiles = tile_geometry(images, tile_height, overlap).select("unit_id", F.col("doc_id").alias("__doc"), F.col("page").alias("__page"), "row", "y0", "y1")
    rows = images.join(tiles, (F.col("doc_id") == F.col("__doc")) & (F.col("page") == F.col("__page")))

    @F.pandas_udf("binary")
    def crop(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series, top: pd.Series, bottom: pd.Series) -> pd.Series:
        def one(h, w, c, raw, y0, y1):
            x = np.frombuffer(raw, np.uint8).reshape(h, w, c)[y0:y1]
            return png(x[:, :, 2::-1] if c >= 3 else x[:, :, 0])

        return pd.Series([one(*r) for r in zip(height, width, channels, data, top, bottom)])

    return rows.select("unit_id", "doc_id", "page", "row", crop("height", "width", "channels", "data", "y0", "y1").alias("png"))
