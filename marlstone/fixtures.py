"""Small inputs of our own: an evaluation set, questions for the router, images and manifests written to the shared folder."""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .functions.images import png

#: one for each branch of the routers
ROUTE_QUERIES = (
    "which chart shows the revenue table",
    "how do I fix this json parsing exception in my function",
    "tell me about the history of rome",
    "",
    "x = {1: 2};",
    "the error log and the graph of the api",
    "code code code code code",
    "charts graphs figures diagrams tables",
    "logged in at 10 30 with 5 items",
    "stack trace of the query, map and legend, axis",
    "a->b",
    "0xFF is shown",
    "word " * 30,
)

_SAMPLE = (
    ("refunds", "Refunds are paid within thirty days of purchase. Keep the receipt.", "how long do refunds take after purchase"),
    ("solar", "The solar array reached record output in June. Panels face south.", "record output of the solar array"),
    ("bread", "Knead the dough for ten minutes and let it rise. Bake until golden.", "how long to knead dough for bread"),
    ("login", "The login service returns error 403 when the token has expired.", "why does login return error 403"),
    ("whales", "Blue whales feed on krill and can live for ninety years.", "what do blue whales eat krill"),
    ("bridge", "The bridge was closed for repairs after inspectors found cracks.", "why was the bridge closed for repairs"),
    ("coffee", "Coffee beans from the highlands are roasted slowly for a mild taste.", "roasted coffee beans from the highlands"),
    ("chess", "The queen is the strongest piece in chess and moves in any direction.", "strongest piece in chess"),
    ("rivers", "The river floods each spring when snow melts in the mountains.", "when does the river flood in spring"),
    ("invoice", "The invoice total for March was 4,210 dollars, due in April.", "invoice total for March dollars"),
    ("violin", "A violin has four strings tuned in fifths.", "how many strings has a violin"),
    ("planet", "Saturn has rings made of ice and rock.", "which planet has rings of ice"),
)


def sample_rows() -> tuple[tuple[str, str, str], ...]:
    """(document, text, question that it answers)."""
    return _SAMPLE


def sample(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, qrels): twelve of each."""
    docs = spark.createDataFrame([(d, t) for d, t, _ in _SAMPLE], "doc_id string, text string")
    queries = spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(_SAMPLE)], "query_id long, query string")
    qrels = spark.createDataFrame([(i, d, 1.0) for i, (d, _, _) in enumerate(_SAMPLE)], "query_id long, doc_id string, gain double")
    return docs, queries, qrels


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(data))
    stream.close()


def images() -> dict[str, bytes]:
    blank = np.full((120, 80), 255)
    ruled = blank.copy()
    ruled[::12] = 0
    colored = np.full((120, 80, 3), 255)
    colored[20:80, 10:60] = (220, 30, 30)
    gray = np.full((120, 80), 128)
    board = 255 * (np.add.outer(np.arange(40) // 5, np.arange(40) // 5) % 2)
    return {
        "a_p0_t0.png": png(blank), "a_p1_t0.png": png(ruled), "b_p0_t0.png": png(colored), "b_p0_t1.png": png(gray),
        "report_p2_p3_t1.png": png(board), "c_p0_t0.PNG": png(blank), "notes.txt": b"no image",
    }


def write_images(spark: SparkSession) -> str:
    folder = scratch(spark, "images")
    for name, data in images().items():
        write_bytes(spark, f"{folder}/{name}", data)
    return folder


def write_manifest(spark: SparkSession, lines: bool = False) -> str:
    path = scratch(spark, "manifest") + ".json"
    docs = [
        {"doc_id": "a", "text": "one. two.", "title": "A"},
        {"id": "b", "html": "<p>x</p>", "images": ["/1.png", "/2.png"], "page": 3},
        {"doc_id": "c", "image_paths": ["/3.png"], "apply_selection": False, "meta": {"k": "v"}},
    ]
    text = "\n\n".join(map(json.dumps, docs)) if lines else json.dumps(docs, indent=1)
    write_bytes(spark, path, text.encode())
    return path
