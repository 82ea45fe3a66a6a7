"""Extractive answers with citations, for all queries of a batch at once.

``hits`` has (query_id, rank from 0, doc_id, unit_id, modality, page, text, image_path). Every step is a
window or an aggregate on query_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sentences
from .rerank import bm25

MIN_CHARS, MIN_SHARE, MAX_SENTENCES = 20, 0.15, 3
#: fixed values: what is said where no sentence can be
VISUAL_SNIPPET = "visual evidence (table/chart/figure) — enable an LLM/VLM reader to read its contents"
VISUAL_ANSWER = ("No extractable text matched this query, but relevant visual evidence was retrieved ", ". Enable an LLM/VLM reader to read the figures.")
NO_ANSWER = "No relevant results were found in the index."
#: fixed values: the prompt for a model that reads
PROMPT_HEAD = (
    "Answer the question using ONLY the numbered sources below. Cite every claim with its source number in square brackets, "
    "e.g. [1]. If the sources do not contain the answer, say so.\n\nQuestion: "
)


def _text(hits: DataFrame) -> Column:
    """What can be read of a hit: its text, else what its meta data hold of one, of the recognised text, of a title."""
    said = [F.when(F.col("text") != "", F.col("text"))]
    if "meta" in hits.columns:
        said += [F.when(F.col("meta")[k] != "", F.col("meta")[k]) for k in ("text", "ocr", "title")]
    return F.regexp_replace(F.coalesce(*said, F.lit("")), r"(?U)^\s+|\s+$", "")


def sentence_pool(hits: DataFrame) -> DataFrame:
    """(query_id, rank, idx, doc_id, unit_id, modality, page, image_path, sent): sentences of the hits; short ones only where a hit has no other. ``idx`` orders the pool."""
    parts = hits.withColumn("parts", sentences(_text(hits)))
    rows = parts.select("query_id", "rank", "doc_id", "unit_id", "modality", "page", "image_path", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "sent"))
    order = Window.partitionBy("query_id").orderBy("rank", "at")
    return rows.where((F.length("sent") >= MIN_CHARS) | (F.col("n") == 1)).withColumn("idx", F.row_number().over(order) - 1).drop("n", "at")


def score_sentences(queries: DataFrame, pool: DataFrame) -> DataFrame:
    scored = bm25(queries, pool.select("query_id", F.col("idx").alias("cand_id"), F.col("sent").alias("text")))
    return pool.join(scored.withColumnRenamed("cand_id", "idx").withColumnRenamed("bm25", "score"), ["query_id", "idx"])


def choose_sentences(scored: DataFrame, most: int = MAX_SENTENCES) -> DataFrame:
    """The best sentence of each query, and up to ``most`` - 1 more with a score above 0 and at least 0.15 of the best; repeats, but for case, once. Adds ``n_chosen``."""
    by = Window.partitionBy("query_id")
    order = by.orderBy(F.desc(F.round("score", 9)), "rank", "idx")
    ranked = scored.withColumn("rn", F.row_number().over(order)).withColumn("best", F.max("score").over(by))
    fit = ranked.where((F.col("rn") == 1) | ((F.col("score") > 0) & (F.round("score", 9) >= F.round(MIN_SHARE * F.col("best"), 9))))
    once = fit.withColumn("k", F.row_number().over(Window.partitionBy("query_id", F.lower("sent")).orderBy("rn"))).where("k = 1")
    return once.withColumn("n_chosen", F.row_number().over(by.orderBy("rn"))).where(F.col("n_chosen") <= most).drop("k", "best")


def _marked(chosen: DataFrame, pool: DataFrame) -> DataFrame:
    """Chosen sentences in reading order, with a marker per unit in order of first use."""
    first = pool.groupBy("query_id", "sent").agg(F.min("idx").alias("first_idx"))
    rows = chosen.join(first, ["query_id", "sent"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "first_idx", "idx"))
    opens = F.min("place").over(Window.partitionBy("query_id", "doc_id", "unit_id"))
    return rows.withColumn("place", place).withColumn("opens", opens).withColumn("marker", F.dense_rank().over(Window.partitionBy("query_id").orderBy("opens")))


def visual_hits(hits: DataFrame) -> DataFrame:
    """Hits without text that have an image or are tiles, numbered by rank."""
    rows = hits.where((_text(hits) == "") & (F.col("image_path").isNotNull() | (F.col("modality") == "vision")))
    return rows.withColumn("v", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "unit_id")))


def citations(chosen: DataFrame, pool: DataFrame, hits: DataFrame, most: int = MAX_SENTENCES) -> DataFrame:
    """(query_id, marker, doc_id, unit_id, modality, page, snippet, image_path): cited units, then visual evidence as far as there is room."""
    own = _marked(chosen, pool)
    cited = own.where("place = opens").select("query_id", "marker", "doc_id", "unit_id", "modality", "page", F.substring("sent", 1, 200).alias("snippet"), "image_path")
    count = cited.groupBy("query_id").agg(F.max("marker").alias("c"))
    seen = visual_hits(hits).join(count, "query_id", "left").withColumn("marker", F.coalesce("c", F.lit(0)) + F.col("v"))
    room = F.col("c").isNull() | (F.col("v") <= F.greatest(F.lit(0), 1 + most - F.col("c")))
    extra = seen.where(room).select("query_id", "marker", "doc_id", "unit_id", "modality", "page", F.lit(VISUAL_SNIPPET).alias("snippet"), "image_path")
    return cited.unionByName(extra)


def answer_text(queries: DataFrame, chosen: DataFrame, pool: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer): the chosen sentences with their markers; what was seen instead, or that nothing was found."""
    said = _marked(chosen, pool).groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "sent", "marker"))), lambda s: F.concat(s["sent"], F.lit(" ["), s["marker"].cast("string"), F.lit("]"))), " ").alias("said")
    )
    seen = visual_hits(hits).groupBy("query_id").agg(F.max("v").alias("seen"))
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.col("seen")), lambda v: F.concat(F.lit("["), v.cast("string"), F.lit("]"))), " ")
    return (
        queries.select("query_id").join(said, "query_id", "left").join(seen, "query_id", "left")
        .select("query_id", F.when(F.col("said").isNotNull(), F.col("said")).when(F.col("seen").isNotNull(), F.concat(F.lit(VISUAL_ANSWER[0]), marks, F.lit(VISUAL_ANSWER[1]))).otherwise(F.lit(NO_ANSWER)).alias("answer"))
    )


def llm_prompt(queries: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, prompt, image_paths): the question with its first hits as numbered sources, 800 characters each."""
    number = (F.col("rank") + 1).cast("string")
    body = (
        F.when(_text(hits) != "", F.substring(_text(hits), 1, 800))
        .when(F.col("image_path").isNotNull(), F.concat(F.lit("[image tile, page "), F.col("page").cast("string"), F.lit(" — see attached image "), number, F.lit("]")))
        .otherwise(F.lit("[no content]"))
    )
    block = F.concat(F.lit("["), number, F.lit("] (doc="), F.col("doc_id").cast("string"), F.lit(", page="), F.col("page").cast("string"), F.lit(", "), F.col("modality"), F.lit(")\n"), body)
    blocks = hits.where(F.col("rank") < most).groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("rank"), block.alias("b")))), lambda s: s["b"]), "\n\n").alias("sources"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("image_path").isNotNull(), F.struct("rank", "image_path")))), lambda s: s["image_path"]).alias("image_paths"),
    )
    return queries.join(blocks, "query_id", "left").select(
        "query_id",
        F.concat(F.lit(PROMPT_HEAD), "query", F.lit("\n\nSources:\n"), F.coalesce("sources", F.lit("(no retrieved context)")), F.lit("\n\nAnswer:")).alias("prompt"),
        F.coalesce("image_paths", F.array().cast("array<string>")).alias("image_paths"),
    )


def formatted(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, shown): each answer with the list of its sources below, in a fixed format."""
    where = F.concat(F.lit("doc="), F.col("doc_id").cast("string"), F.when(F.col("page") != 0, F.concat(F.lit(" p."), F.col("page").cast("string"))).otherwise(F.lit("")))
    kind = F.when(F.coalesce("image_path", F.lit("")) != "", "image").otherwise("text")
    line = F.concat(F.lit("  ["), F.col("marker").cast("string"), F.lit("] ("), kind, F.lit(") "), where, F.lit(" — "), F.col("snippet"))
    sources = cited.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("marker"), line.alias("l")))), lambda s: s["l"]), "\n").alias("sources"))
    said = F.coalesce(F.nullif(F.trim(F.coalesce("answer", F.lit(""))), F.lit("")), F.lit("(no answer)"))
    return answers.join(sources, "query_id", "left").select("query_id", F.concat(said, F.when(F.col("sources").isNull(), F.lit("")).otherwise(F.concat(F.lit("\n\nSources:\n"), "sources"))).alias("shown"))
