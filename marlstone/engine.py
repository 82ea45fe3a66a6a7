"""The engine: a versioned index and what can be asked of it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .operators import answer, cost, dedup, routing, selection, units
from .plans import evaluate as evaluation
from .plans import ingest, search
from .sources import manifests
from .sources.index import VersionedIndex, delete_docs, doc_ids, upsert
from .sources.manifests import INGEST_SCHEMA, normalize_manifest


class Engine:
    """Units live in two DataFrames; changes make new ones, ``save`` writes them as the next version."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, path: str | None = None):
        self.spark = spark
        self.index = VersionedIndex(spark, path or (config or EngineConfig()).storage.folder)
        self.config = config or (self.index.config() if self.index.version else EngineConfig())
        self.text_units, self.vision_units = self.index.read()

    # changes

    def add_documents(
        self, docs: list[dict] | DataFrame, replace: bool = False, contents: DataFrame | None = None,
        batch_size: int = 128, on_progress: Callable[[dict], None] | None = None,
    ) -> dict:
        """Ingest documents (dicts or a manifest table); with ``replace`` the documents' old units, tiles too, go first.

        Images are read from their files, or come as ``contents`` (image_path, content). A table is one job whose tasks are its batches; a list with
        ``on_progress`` is ingested ``batch_size`` documents at a time, and the sums so far are reported after each batch.
        """
        if on_progress is None or isinstance(docs, DataFrame):
            return self._add(docs, replace, contents)
        total: dict = {}
        seen: set = set()
        for at in range(0, len(docs), max(1, batch_size)):
            part = docs[at : at + max(1, batch_size)]
            ids = {d.get("doc_id") or d.get("id") for d in part}
            if replace:  # a document in several batches is replaced once
                self.delete([i for i in ids - seen if i])
                seen |= ids
            own = self._add(part, False, contents)
            total = {k: total.get(k, 0) + v for k, v in own.items()}
            on_progress(total)
        return total

    def _add(self, docs: list[dict] | DataFrame, replace: bool, contents: DataFrame | None) -> dict:
        rows = docs if isinstance(docs, DataFrame) else normalize_manifest(self.spark.createDataFrame(docs, INGEST_SCHEMA))
        if contents is None:
            contents = manifests.tile_contents(self.spark, rows.select(F.explode("image_paths").alias("image_path")))
        scored = ingest.with_image_score(rows, contents)
        chunks, tiles = ingest.prepare(scored, self.config, F.col("image_score"))
        new_text, new_vision = ingest.text_units(chunks, self.config), ingest.vision_units(tiles, contents, self.config)
        ids = rows.select("doc_id")
        columns = self.text_units.columns, self.vision_units.columns
        if replace:
            self.text_units = upsert(self.text_units, new_text.select(*columns[0]), ids)
            self.vision_units = upsert(self.vision_units, new_vision.select(*columns[1]), ids)
        else:
            self.text_units = self.text_units.unionByName(new_text.select(*columns[0]))
            self.vision_units = self.vision_units.unionByName(new_vision.select(*columns[1]))
        folded = new_vision.agg(F.coalesce(F.sum(F.col("duplicate_count") - 1), F.lit(0)).alias("tiles_folded"))
        return ingest.ingest_stats(rows, chunks, tiles).crossJoin(folded).first().asDict()  # rows of one

    def add_text(self, doc_id: str, text: str, title: str = "", page: int = 0, replace: bool = False) -> int:
        return self.add_documents([{"doc_id": doc_id, "text": text, "title": title, "page": page}], replace)["chunks"]

    def add_html(self, doc_id: str, html: str, title: str = "", replace: bool = False) -> int:
        return self.add_documents([{"doc_id": doc_id, "html": html, "title": title}], replace)["chunks"]

    def add_tiles(self, tiles: DataFrame, contents: DataFrame | None = None) -> None:
        """Add tiles (unit_id, doc_id, image_path, page, row, col, bbox, meta, seq)."""
        self.vision_units = self.vision_units.unionByName(ingest.vision_units(tiles, contents, self.config).select(*self.vision_units.columns))

    def should_index_pixels(self, text: str | None = None, html: str | None = None, image: bytes | str | None = None) -> dict:
        """(index_pixels, score) of a page by its text, its HTML and its image: the bytes of a file, or a path."""
        if isinstance(image, str):
            rows = manifests.tile_contents(self.spark, self.spark.createDataFrame([(image,)], "image_path string")).collect()
            image = bytes(rows[0]["content"]) if rows else None
        row = self.spark.createDataFrame([(text, html, image)], "text string, html string, image binary")
        p = self.config.pixels
        judged = selection.decide(row, p.mode, p.threshold, p.text_share, text=F.col("text"), html=F.col("html"), image_score=selection.image_score_of_file(F.col("image")))
        return judged.select("index_pixels", F.round("richness", 4).alias("score")).first().asDict()

    def add_tiles_if_rich(self, tiles: DataFrame, text: str | None = None, html: str | None = None, image: bytes | str | None = None, contents: DataFrame | None = None) -> dict:
        """Add a page's tiles if it is worth pixels: (added, index_pixels, score)."""
        judged = self.should_index_pixels(text, html, image)
        if judged["index_pixels"]:
            self.add_tiles(tiles, contents)
        return {"added": tiles.count() if judged["index_pixels"] else 0, **judged}

    def add_pages(self, doc_id: str, images: list[str], texts: list[str] | None = None, with_text: bool = True, with_pixels: bool = True) -> dict:
        """Ingest the pages of one document: their texts as chunks, and tiles of those page images that are worth pixels. (chunks, tiles, skipped)."""
        texts, added = texts or [], {"chunks": 0, "tiles": 0, "skipped": 0}
        if with_text and texts:
            added["chunks"] = self.add_documents([{"doc_id": doc_id, "text": t, "page": p} for p, t in enumerate(texts)])["chunks"]
        if not (with_pixels and images):
            return added
        rows = self.spark.createDataFrame([(p, os.path.abspath(f), texts[p] if p < len(texts) else None) for p, f in enumerate(images)], "page int, image_path string, text string")
        files = manifests.tile_contents(self.spark, rows)
        p = self.config.pixels
        judged = selection.decide(rows.join(files, "image_path"), p.mode, p.threshold, p.text_share, text=F.col("text"), image_score=selection.image_score_of_file(F.col("content")))
        wanted = judged.where("index_pixels").select(F.lit(doc_id).alias("doc_id"), "page", F.col("page").cast("long").alias("seq"), "image_path").persist()
        n = wanted.count()
        added["skipped"] = len(images) - n
        if n:
            pixels = self.spark.read.format("image").load([os.path.abspath(f) for f in images]).select(F.regexp_replace("image.origin", "^file:/*", "/").alias("image_path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
            tiles, contents = ingest.page_tiles(wanted.join(pixels, "image_path"), f"{self.index.path}/tiles", self.config)
            manifests.write_files(contents.select(F.col("image_path").alias("path"), "content")).count()
            self.add_tiles(tiles, manifests.tile_contents(self.spark, tiles))
            added["tiles"] = tiles.count()
        wanted.unpersist()
        return added

    def ingest_url(self, doc_id: str, url: str, render: Callable[..., list[str]] = manifests.render_url) -> dict:
        """Render a page and ingest its pixels, if they are worth it."""
        images = render(url, f"{self.index.path}/shots/{doc_id}", self.config.tiles.width, self.config.tiles.scale)
        return self.add_pages(doc_id, images)

    def ingest_pdf(self, doc_id: str, path: str, with_text: bool = True, with_pixels: bool = True, render: Callable[..., list[str]] = manifests.render_pdf, read: Callable[[str], list[str]] | None = None) -> dict:
        """Ingest a PDF file: a document of pages with their texts and images."""
        texts: list[str] = []
        if with_text:
            if read is None:
                files = self.spark.read.format("binaryFile").load(path).select("path", "content")
                texts = [r["text"] for r in manifests.pdf_pages(files).orderBy("page").collect()]
            else:
                texts = read(path)
        images = render(path, f"{self.index.path}/shots/{doc_id}", self.config.tiles.scale or 1.5) if with_pixels else []
        return self.add_pages(doc_id, images, texts, with_text, with_pixels)

    def dedup_stats(self, files: DataFrame, scope: str | None = None, method: str | None = None, tile_bytes: int | None = None) -> dict:
        """What folding would save among tile files (seq, image_path, content)."""
        own = self.config.tiles
        scope = scope or ("global" if own.fold == "global" else "doc")
        key = dedup.content_key(F.col("content"), F.col("image_path"), F.col("unit_id"), method or own.fold_by)
        tiles = units.tiles_from_paths(files).join(files, "image_path").withColumn("content_key", key)
        return dedup.dedup_stats(tiles, scope=scope, tile_bytes=int(tile_bytes or self.config.extra.get("tile_bytes", dedup.TILE_BYTES))).first().asDict()

    def delete(self, ids: list[str]) -> dict[str, int]:
        gone = self.spark.createDataFrame([(i,) for i in ids], "doc_id string")
        counts = {
            f"{n}_removed": df.join(gone.distinct(), "doc_id", "left_semi").count() for n, df in (("text", self.text_units), ("vision", self.vision_units))
        }
        self.text_units, self.vision_units = delete_docs(self.text_units, gone), delete_docs(self.vision_units, gone)
        return counts

    def save(self) -> int:
        version = self.index.write(self.text_units, self.vision_units, self.config)
        self.text_units, self.vision_units = self.index.read()
        return version

    # questions

    def questions(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")

    def search(self, queries: DataFrame | str, top_k: int | None = None, modality: str | None = None, reranked: bool | None = None, method: str | None = None) -> DataFrame:
        queries = self.questions([queries]) if isinstance(queries, str) else queries
        return search.search(queries, self.text_units, self.vision_units, self.config, top_k, modality, reranked, method)

    def answer(self, queries: DataFrame | str, top_k: int | None = None, modality: str | None = None, reranked: bool | None = None, method: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(answers, citations) of the questions by the reader of the settings; ``none`` reads nothing, so both are empty, and an unknown name reads extractively."""
        queries = self.questions([queries]) if isinstance(queries, str) else queries
        own = self.config.answers
        hits = self.search(queries, top_k or own.hits, modality, reranked, method).withColumnRenamed("pos", "rank")
        if own.reader.strip() in ("", "none"):
            queries, hits = queries.limit(0), hits.limit(0)
        pool = answer.sentence_pool(hits)
        chosen = answer.choose_sentences(answer.score_sentences(queries, pool), own.sentences)
        return answer.answer_text(queries, chosen, pool, hits), answer.citations(chosen, pool, hits, own.sentences)

    def generate(self, queries: DataFrame, model, top_k: int | None = None) -> DataFrame:
        """(query_id, answer) by a model: a function from lists of prompts and image paths to texts, called on the executors."""
        hits = self.search(queries, top_k or self.config.answers.hits).withColumnRenamed("pos", "rank")
        prompts = answer.llm_prompt(queries, hits)

        def run(batches):
            for batch in batches:
                yield batch.assign(answer=model(list(batch["prompt"]), [list(p) for p in batch["image_paths"]]))[["query_id", "answer"]]

        return prompts.mapInPandas(run, "query_id long, answer string")

    def route(self, queries: DataFrame | str, model: str | None = None, weights: str | None = None) -> DataFrame:
        queries = self.questions([queries]) if isinstance(queries, str) else queries
        own, base = self.config.router, self.config.fusion
        path = weights or own.weights_file
        return routing.route(queries, model or own.kind, routing.load_router(path) if path else None, base.text_weight, base.vision_weight)

    def richness(self, text: str | None = None, html: str | None = None) -> dict:
        return self.should_index_pixels(text, html)

    def doc_ids(self) -> list[str]:
        return sorted(r[0] for r in doc_ids(self.text_units, self.vision_units).collect())

    def stats(self) -> dict:
        own = cost.index_stats(self.text_units, self.vision_units).first().asDict()
        c = self.config
        return own | {"text_model": c.text.name, "vision_model": c.vision.name, "text_dim": c.text.dim, "vision_dim": c.vision.dim}

    def cost(self, pages: int | None = None, model: cost.CostModel | None = None) -> DataFrame:
        model, c = model or cost.CostModel(), self.config
        if pages is None:
            return cost.estimate(cost.index_stats(self.text_units, self.vision_units), c.text.dim, c.vision.dim, model)
        return cost.project(self.spark.createDataFrame([(pages,)], "pages long"), c.text.dim, c.vision.dim, model)

    def evaluate_timed(self, queries: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), modes: tuple[str, ...] = evaluation.MODES) -> list[dict]:
        """The rows of ``evaluate`` with the time of each mode in milliseconds a question."""
        return evaluation.timed(lambda own: self.evaluate(queries, qrels, ks, own), modes, queries.count())

    def evaluate(self, queries: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), modes: tuple[str, ...] = evaluation.MODES) -> DataFrame:
        return evaluation.evaluate(queries, qrels, self.text_units, self.vision_units, ks, modes, self.config)
