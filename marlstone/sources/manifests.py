"""Documents, evaluation sets and images from files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INGEST_SCHEMA = (
    "doc_id string, id string, text string, html string, title string, page int, image_paths array<string>, images array<string>, "
    "apply_selection boolean, meta map<string,string>"
)
EVAL_SCHEMA = (
    "name string, documents array<struct<doc_id:string,text:string,title:string,image_path:string,page:int>>, "
    "queries array<struct<id:string,query:string,relevant:variant>>"
)
#: fixed values: endings of image files
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "webp", "bmp")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Ingest documents of a JSON array, or of JSON lines, whichever the first character says. A document without an id is an error."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    return normalize_manifest(spark.read.schema(INGEST_SCHEMA).option("multiLine", array).json(path))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(query, label) of labelled questions, a JSON array or JSON lines; ``vision_label`` stands for ``label``."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    rows = spark.read.schema("query string, label double, vision_label double").option("multiLine", array).json(path)
    return rows.select("query", F.coalesce("label", "vision_label").alias("label"))


def normalize_manifest(rows: DataFrame) -> DataFrame:
    """The columns of INGEST_SCHEMA with ``id`` and ``images`` folded in, defaults set and rows numbered by ``seq``."""
    doc_id = F.coalesce("doc_id", "id")
    return rows.select(
        F.when(doc_id.isNull(), F.raise_error(F.lit("a document needs a doc_id"))).otherwise(doc_id).alias("doc_id"),
        "text", "html", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("image_paths", "images", F.array().cast("array<string>")).alias("image_paths"),
        F.coalesce("apply_selection", F.lit(True)).alias("apply_selection"), F.coalesce("meta", F.create_map().cast("map<string,string>")).alias("meta"),
        F.monotonically_increasing_id().alias("seq"),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files; bytes that are not UTF-8 become the replacement character."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.expr("make_valid_utf8(cast(content AS string))").alias("text"))


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, qrels) of an evaluation file; relevant documents are a list, with gain 1, or a map of gains."""
    raw = spark.read.option("multiLine", True).schema(EVAL_SCHEMA).json(path)
    queries = raw.select(F.inline("queries"))
    return raw.select(F.inline("documents")), queries.select(F.col("id").alias("query_id"), "query"), qrels(queries.select(F.col("id").alias("query_id"), "relevant"))


def qrels(rows: DataFrame) -> DataFrame:
    """(query_id, doc_id, gain) of rows (query_id, relevant variant)."""
    text = F.to_json("relevant")
    listed = rows.where(F.schema_of_variant("relevant").startswith("ARRAY")).select("query_id", F.explode(F.from_json(text, "array<string>")).alias("doc_id"), F.lit(1.0).alias("gain"))
    mapped = rows.where(~F.schema_of_variant("relevant").startswith("ARRAY")).select("query_id", F.explode(F.from_json(text, "map<string,double>")).alias("doc_id", "gain"))
    return listed.unionByName(mapped)


def _image_glob() -> str:
    return "*.{" + ",".join(e for x in IMAGE_ENDINGS for e in (x, x.upper())) + "}"


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_path, content) of all image files below a folder, endings in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _image_glob()).load(folder)
    return files.select(F.regexp_replace("path", "^file:", "").alias("image_path"), "content")


def _no_contents(spark: SparkSession) -> DataFrame:
    """(image_path, content) without rows, which the optimizer knows to be empty: joins with it shuffle nothing."""
    return spark.range(0).where("false").select(F.lit("").alias("image_path"), F.lit(None).cast("binary").alias("content"))


def file_contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(image_path, content) of those of the files that can be read."""
    fs = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    there = [p for p in dict.fromkeys(paths) if fs(p).getFileSystem(conf).exists(fs(p))]
    if not there:
        return _no_contents(spark)
    return spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", "^file:/*", "/").alias("image_path"), "content")


#: folders that are listed at once to find tiles
MOST_FOLDERS = 10_000


def tile_contents(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(image_path, content) of those of the image files named in ``paths`` (image_path) that can be read.

    Image files of the paths' folders, at most MOST_FOLDERS of them, are listed and read by Spark's reader, so any file system that it knows will do.
    """
    own = paths.select("image_path").where("image_path is not null").distinct()
    rows = own.select(F.regexp_extract("image_path", r"^(.*/)[^/]*$", 1).alias("folder")).where("folder <> ''").distinct().limit(MOST_FOLDERS + 1).collect()
    if len(rows) > MOST_FOLDERS:
        raise ValueError(f"tiles lie in more than {MOST_FOLDERS} folders: read them in parts, or give their contents as a table")
    fs = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    globs = [re.sub(r"([*?\[\]{}\\])", r"\\\1", r[0]) + _image_glob() for r in rows]
    there = [g for g in globs if fs(g).getFileSystem(conf).globStatus(fs(g))]
    if not there:
        return _no_contents(spark)
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    files = spark.read.format("binaryFile").load(there).select(plain("path").alias("at"), "content")
    return own.withColumn("at", plain("image_path")).join(files, "at").select("image_path", "content")


def write_files(files: DataFrame) -> DataFrame:
    """Write (path, content) to files from the executors, each whole or not at all; returns their paths. The work is done when the result is used."""

    def run(batches):
        import os

        import pyarrow as pa
        from pyarrow.fs import FileSystem, FileType

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, where = FileSystem.from_uri(path if "://" in path else f"file://{path}")
                fs.create_dir(os.path.dirname(where))
                part = f"{where}.{os.getpid()}.part"
                with fs.open_output_stream(part) as out:
                    out.write(content)
                if fs.get_file_info(where).type == FileType.File:
                    fs.delete_file(where)
                fs.move(part, where)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    return files.select("path", "content").mapInArrow(run, "path string")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image_path, height, width, channels, data) of the images that can be decoded."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(folder)
    return rows.select(
        F.regexp_replace("image.origin", "^file:/*", "/").alias("image_path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page, text) of PDF files (path, content); needs PyMuPDF on the executors."""

    def run(batches):
        import pandas as pd

        try:
            import fitz
        except ImportError as e:
            raise ImportError("reading PDF files needs PyMuPDF") from e
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with fitz.open(stream=content, filetype="pdf") as doc:
                    yield pd.DataFrame({"path": path, "page": range(len(doc)), "text": [p.get_text() for p in doc]})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def render_url(url: str, folder: str, width: int = 1280, scale: float = 1.0) -> list[str]:
    """Render a page to one image file below ``folder`` with Playwright's browser, if that is there."""
    try:
        from playwright.sync_api import sync_playwright
    except ImportError as e:
        raise ImportError("rendering a URL needs Playwright and its browser") from e
    import os

    os.makedirs(folder, exist_ok=True)
    to = os.path.join(folder, "page_0.png")
    with sync_playwright() as own:
        browser = own.chromium.launch()
        try:
            page = browser.new_page(viewport={"width": width, "height": 900}, device_scale_factor=scale)
            page.goto(url, wait_until="networkidle")
            page.screenshot(path=to, full_page=True)
        finally:
            browser.close()
    return [to]


def render_pdf(path: str, folder: str, scale: float = 1.5) -> list[str]:
    """Render the pages of a PDF file to image files below ``folder`` with PyMuPDF, if that is there."""
    try:
        import fitz
    except ImportError as e:
        raise ImportError("rendering PDF files needs PyMuPDF") from e
    import os

    os.makedirs(folder, exist_ok=True)
    out = []
    with fitz.open(path) as doc:
        for number, page in enumerate(doc):
            out.append(os.path.join(folder, f"page_{number}.png"))
            page.get_pixmap(matrix=fitz.Matrix(scale, scale)).save(out[-1])
    return out


def render_pages(targets: DataFrame, renderer, column: str = "url") -> DataFrame:
    """(target, page, image_path): ``renderer``, called once for each target on the executors, writes images and returns their paths."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for target in batch[column]:
                paths = renderer(target)
                yield pd.DataFrame({"target": target, "page": range(len(paths)), "image_path": paths})

    return targets.select(column).mapInPandas(run, "target string, page int, image_path string")
