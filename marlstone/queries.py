"""Registered queries for the engine's own operators; their DuckDB SQL is in ``oracles``.

Tables stand in for the engine's inputs: ``documents`` is the text corpus, ``pages`` the HTML, ``benchmark`` the questions,
``embeddings`` the tiles (document: vec_id modulo the number of documents) and the questions' images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fixtures
from .config import EngineConfig
from .functions import cues, formats, text
from .operators import answer, cost, dedup, embedding, fusion, metrics, rerank, routing, selection, topk, units
from .oracles import oracle_sql  # noqa: F401
from .plans import ingest, search
from .plans.evaluate import evaluate
from .sources import index as store
from .sources import manifests
from .streaming import ingest as streaming

CONFIG = EngineConfig()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


# text


def clean_text(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


def tokenize(spark, sf):
    t = text.tokens(F.col("text"))
    return _table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


def sentences(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("idx", "sent")).withColumn("idx", F.col("idx").cast("long"))


def looks_like_html(spark, sf):
    p = _table(spark, sf, "pages")
    return p.select("page_id", text.looks_like_html(F.col("html")).alias("page_like"), text.looks_like_html(F.regexp_replace("html", "<[a-z/]", "")).alias("bare_like"))


def tabular_lines(spark, sf):
    own = text.lines(F.col("text"))
    return _table(spark, sf, "documents").select("doc_id", F.size(own).cast("long").alias("n_lines"), F.size(F.filter(own, text.tabular_line)).cast("long").alias("n_tabular"))


def html_to_text(spark, sf):
    return _table(spark, sf, "pages").select("page_id", units.html_to_text(F.col("html")).alias("text"))


def _media(page_id, html):
    """Pages have no media, so some get a table, an image or a chart."""
    return (
        F.when(page_id % 4 == 0, html)
        .when(page_id % 4 == 1, F.concat(html, F.lit("<table>"), F.repeat(F.lit("<tr><td>1</td></tr>"), (page_id % 7).cast("int")), F.lit("</table>")))
        .when(page_id % 4 == 2, F.concat(html, F.lit("<IMG src=a><figure></figure>")))
        .otherwise(F.concat(html, F.lit("<p>the Chart below</p>")))
    )


def html_richness(spark, sf):
    return _table(spark, sf, "pages").select("page_id", _r(text.html_richness(_media(F.col("page_id"), F.col("html")))).alias("score"))


def text_richness(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", _r(text.text_richness(F.col("text"))).alias("score"))


def pixel_decision(spark, sf):
    """Pages judged by their whole text, their markup and an image score, each of which some pages lack."""
    page = F.col("page_id")
    rows = _table(spark, sf, "pages").select(
        "page_id", F.when(page % 5 != 0, units.html_to_text(F.col("html"))).alias("text"), F.when(page % 2 != 0, _media(page, F.col("html"))).alias("html"), F.when(page % 3 == 0, page % 10 / 10.0).alias("image")
    )
    judged = selection.decide(rows, text=F.col("text"), html=F.col("html"), image_score=F.col("image"))
    return judged.select("page_id", _r("richness").alias("richness"), "index_pixels")


# units


def _chunks(spark, sf):
    return units.chunk_text(_table(spark, sf, "documents").select("doc_id", "text"), CONFIG.chunks.size, CONFIG.chunks.overlap)


def chunk_text(spark, sf):
    return _chunks(spark, sf).select("doc_id", F.col("ord").cast("long").alias("ord"), "text")


def chunk_ids(spark, sf):
    return _chunks(spark, sf).select("doc_id", F.col("ord").cast("long").alias("ord"), "unit_id")


def tile_geometry(spark, sf):
    pages = _table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page"), F.lit(1280).alias("width"), (F.col("p_partkey") % 37 * 97 + 1).cast("int").alias("height"))
    rows = units.tile_geometry(pages)
    return rows.select("unit_id", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("row", "x0", "y0", "x1", "y1")])


def tiles_from_paths(spark, sf):
    path = F.concat(F.lit("/scans/doc_p"), F.col("p_partkey") % 7, F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("_p"), F.col("p_partkey"), F.lit("_t1"))), F.lit(".png"))
    return units.tiles_from_paths(_table(spark, sf, "part").select(path.alias("image_path")))


def _tiles(spark, sf):
    d = _table(spark, sf, "documents")
    key = dedup.exact_key(F.col("text"), F.lit(None).cast("string"), F.col("doc_id"))
    return d.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("unit_id"), F.col("source").alias("doc_id"), key.alias("content_key"))


def _deduped(spark, sf, scope):
    rows = dedup.deduplicate(_tiles(spark, sf), scope=scope)
    members = F.array_join(F.transform("occurrences", lambda o: o["unit_id"].cast("string")), ",")
    return rows.select("unit_id", "doc_id", "content_key", "duplicate_count", F.coalesce(members, F.lit("")).alias("members"))


def dedup_exact(spark, sf):
    return _deduped(spark, sf, "doc")


def dedup_global(spark, sf):
    return _deduped(spark, sf, "global")


def dedup_stats(spark, sf):
    return dedup.dedup_stats(_tiles(spark, sf), scope="global")


def rank_dedup(spark, sf):
    ranked = _table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("query_id"), F.floor(F.col("vec_id") / 20).cast("int").alias("rank"), (F.col("vec_id") * 7 % 13).alias("doc_id"))
    return metrics.rank_dedup(ranked).withColumn("rank", F.col("rank").cast("long"))


# embeddings


def hash_vector(spark, sf):
    names = _table(spark, sf, "nation").select(F.lower("n_name").alias("token"))
    return names.select("token", F.posexplode(embedding.hash_vector(F.col("token"), 40)).alias("i", "value")).withColumn("i", F.col("i").cast("long"))


def hash_embed(spark, sf):
    d = _table(spark, sf, "documents").select("doc_id", embedding.hash_embed(F.col("text"), 32).alias("v"))
    return embedding.long_form(d, "doc_id", "v").select("doc_id", F.col("i").cast("long").alias("i"), _r("value").alias("value"))


def l2_normalize(spark, sf):
    e = _table(spark, sf, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("vec_id") % 5)).alias("v"))
    return embedding.long_form(e.select("vec_id", embedding.normalized(F.col("v")).alias("v")), "vec_id", "v").select("vec_id", F.col("i").cast("long").alias("i"), _r("value").alias("value"))


def _questions(spark, sf):
    """Benchmark texts with the embedding that stands for their image."""
    image = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vision_embedding"))
    return _table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query")).join(image, "item_id").withColumnRenamed("item_id", "query_id")


#: indexes that this process has built, by session and folder: path
_BUILT: dict[tuple[str, str], str] = {}


def _index(spark, sf):
    """(text units, vision units) read from an index, which the first query of a session builds from the whole tables and saves; document ids are numbers again."""
    key = spark.sparkContext.applicationId, sf
    if key not in _BUILT:
        path = fixtures.scratch(spark, "search-index")
        none = lambda kind: F.lit(None).cast(kind)
        chunks = _chunks(spark, sf).select("*", F.lit(0).alias("page"), F.lit("").alias("title"), F.create_map().cast("map<string,string>").alias("meta"), F.col("doc_id").alias("seq"))
        tiles = _vision_units(spark, sf).select(
            "unit_id", F.col("doc_id").cast("string").alias("doc_id"), "image_path", "page", none("int").alias("row"), none("int").alias("col"), none("array<int>").alias("bbox"), "meta",
            none(ingest.OCCURRENCES).alias("occurrences"), F.lit(1).cast("long").alias("duplicate_count"), none("long").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding"),
        )
        store.VersionedIndex(spark, path).write(ingest.text_units(chunks, CONFIG), tiles, CONFIG)
        _BUILT[key] = path
    return tuple(t.withColumn("doc_id", F.col("doc_id").cast("long")) for t in store.VersionedIndex(spark, _BUILT[key]).read())


def _vision_units(spark, sf):
    n = _table(spark, sf, "documents").count()
    doc = F.col("vec_id") % n
    return _table(spark, sf, "embeddings").select(
        F.format_string("v%06d", "vec_id").alias("unit_id"), doc.alias("doc_id"), "embedding", F.format_string("/tiles/%d.png", "vec_id").alias("image_path"), (F.col("vec_id") % 3).cast("int").alias("page"),
        F.when(F.col("vec_id") % 7 == 0, F.create_map(F.lit("title"), F.format_string("the figure of document %d", doc))).otherwise(F.create_map().cast("map<string,string>")).alias("meta"),
    )


def _topk_queries(spark, sf):
    return _table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk(spark, sf):
    found = topk.vector_topk(_topk_queries(spark, sf), _vision_units(spark, sf), 10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "unit_id", "doc_id", _r("score").alias("score"))


def _hits(spark, sf, **how):
    """Hits as numbers, components that are absent as 0."""
    own = ("fusion_method", "fusion_norm")
    config = CONFIG.with_settings(**{k: v for k, v in how.items() if k in own})
    return search.search(_questions(spark, sf), *_index(spark, sf), config, **{k: v for k, v in how.items() if k not in own})


def _shown(hits):
    out = [_r(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("score", "c_text", "c_vision", "c_rerank") if c in hits.columns]
    return hits.select("query_id", F.col("pos").cast("long").alias("pos"), "doc_id", "modality", "unit_id", *out)


def search_text_only(spark, sf):
    return _shown(_hits(spark, sf, modality="text"))


def hybrid_search_rrf(spark, sf):
    return _shown(_hits(spark, sf))


def hybrid_search_calibrated(spark, sf):
    return _shown(_hits(spark, sf, fusion_method="calibrated", fusion_norm="softmax"))


def hybrid_search_rerank(spark, sf):
    return _shown(_hits(spark, sf, reranked=True))


def result_rows(spark, sf):
    rows = search.result_rows(_hits(spark, sf, top_k=3))
    out = F.to_json(F.struct("doc_id", "modality", "unit_id", "page"))
    return rows.select("query_id", F.col("pos").cast("long").alias("pos"), out.alias("row"), (F.col("score") + 0.0).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search_rrf(spark, sf_dir)


# fusion on ranked lists with ties, repeated documents and an equal-score query


def _ranked(spark, sf):
    e = _table(spark, sf, "embeddings")
    score = F.when(F.col("vec_id") % 20 == 3, F.lit(0.5)).otherwise(F.col("vec_id") * 37 % 11 / 10.0)
    rows = e.select(
        (F.col("vec_id") % 20).alias("query_id"), F.when(F.col("vec_id") % 3 == 0, "vision").otherwise("text").alias("modality"),
        (F.col("vec_id") * 5 % 23).alias("doc_id"), F.col("vec_id").alias("unit_id"), score.alias("score"),
    )
    order = Window.partitionBy("query_id", "modality").orderBy(F.desc("score"), "unit_id")
    return rows.withColumn("rank", F.row_number().over(order) - 1)


def _weights(spark, sf):
    q = _table(spark, sf, "embeddings").select((F.col("vec_id") % 20).alias("query_id")).distinct()
    return q.select("query_id", (F.col("query_id") % 4 / 2.0).alias("text_weight"), F.lit(1.5).alias("vision_weight"))


def _fused(rows):
    return rows.select("query_id", F.col("pos").cast("long").alias("pos"), "doc_id", "modality", "unit_id", _r("score").alias("score"), _r(F.coalesce("c_text", F.lit(0.0))).alias("c_text"), _r(F.coalesce("c_vision", F.lit(0.0))).alias("c_vision"))


def fuse_rrf(spark, sf):
    return _fused(fusion.fuse(_ranked(spark, sf), _weights(spark, sf), "rrf"))


def _calibrated(norm):
    def run(spark, sf):
        return _fused(fusion.fuse(_ranked(spark, sf), _weights(spark, sf), "calibrated", norm=norm))

    return run


# routing


def _route_queries(spark, sf):
    asked = _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return asked.unionByName(spark.createDataFrame(list(enumerate(fixtures.ROUTE_QUERIES, 1_000_000)), "query_id long, query string"))


def route_features(spark, sf):
    return _route_queries(spark, sf).select("query_id", *cues.features(F.col("query"))).withColumns({f: _r(f) for f in cues.FEATURES})


def route_heuristic(spark, sf):
    r = routing.route(_route_queries(spark, sf))
    return r.select("query_id", _r("text_weight").alias("text_weight"), _r("vision_weight").alias("vision_weight"), "reason")


def route_learned(spark, sf):
    r = routing.route(_route_queries(spark, sf), "learned")
    return r.select("query_id", _r("vision_probability").alias("p"), _r("text_weight").alias("text_weight"), _r("vision_weight").alias("vision_weight"))


def route_train(spark, sf):
    w = routing.fit_router(spark.createDataFrame(routing.SEED, "query string, label double"))
    return spark.createDataFrame([(n, round(x, 6)) for n, x in zip(cues.FEATURES, w)], "feature string, weight double")


# rerank and answers: every question's candidates are its hits of the search over all units


def _asked_hits(spark, sf, top_k, **how):
    """(questions, hits): the hits are found once and kept as a table, since the steps behind them read them several times."""
    place = fixtures.scratch(spark, "hits")
    _hits(spark, sf, top_k=top_k, **how).write.parquet(place)
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), spark.read.parquet(place)


def bm25_rerank(spark, sf):
    q, hits = _asked_hits(spark, sf, CONFIG.rerank.depth)
    c = hits.select("query_id", F.col("doc_id").alias("cand_id"), rerank.candidate_text(hits).alias("text"))
    return rerank.bm25(q, c).select("query_id", F.col("cand_id").alias("doc_id"), _r("bm25").alias("bm25"))


def rerank_blend(spark, sf):
    q, hits = _asked_hits(spark, sf, CONFIG.rerank.depth, fusion_method="calibrated")
    out = rerank.rerank(q, hits, 0.8, 10)
    return out.select("query_id", F.col("pos").cast("long").alias("pos"), "doc_id", _r("score").alias("score"), (F.col("c_rerank") + 0.0).alias("c_rerank"))


def _answer_hits(spark, sf):
    q, hits = _asked_hits(spark, sf, CONFIG.answers.hits)
    return q, hits.withColumnRenamed("pos", "rank")


def _answering(spark, sf):
    q, hits = _answer_hits(spark, sf)
    pool = answer.sentence_pool(hits)
    return q, hits, pool, answer.choose_sentences(answer.score_sentences(q, pool))


def answer_pool(spark, sf):
    p = answer.sentence_pool(_answer_hits(spark, sf)[1])
    return p.select("query_id", F.col("idx").cast("long").alias("idx"), "doc_id", "sent")


def answer_bm25(spark, sf):
    q, hits = _answer_hits(spark, sf)
    s = answer.score_sentences(q, answer.sentence_pool(hits))
    return s.select("query_id", F.col("idx").cast("long").alias("idx"), _r("score").alias("score"))


def answer_select(spark, sf):
    return _answering(spark, sf)[3].select("query_id", F.col("n_chosen").cast("long").alias("n"), F.col("idx").cast("long").alias("idx"), "sent")


def answer_text(spark, sf):
    q, hits, pool, chosen = _answering(spark, sf)
    return answer.answer_text(q, chosen, pool, hits)


def answer_citations(spark, sf):
    _, hits, pool, chosen = _answering(spark, sf)
    return answer.citations(chosen, pool, hits).select("query_id", F.col("marker").cast("long").alias("marker"), "doc_id", "unit_id", "modality", "snippet", F.coalesce("image_path", F.lit("")).alias("image_path"))


def llm_prompt(spark, sf):
    q, hits = _answer_hits(spark, sf)
    return answer.llm_prompt(q, hits).select("query_id", "prompt", F.array_join("image_paths", ",").alias("images"))


# index


def index_build(spark, sf):
    return _chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.length("text")).alias("chars"))


def index_tiles(spark, sf):
    return _vision_units(spark, sf).groupBy("doc_id").agg(F.count("*").alias("tiles"), F.countDistinct("page").alias("pages"))


def index_stats(spark, sf):
    return cost.index_stats(_chunks(spark, sf), _vision_units(spark, sf))


def index_footprint(spark, sf):
    s = cost.index_stats(_chunks(spark, sf), _vision_units(spark, sf))
    return s.select((F.col("text_units") * CONFIG.text.dim * 4).alias("text_bytes"), (F.col("vision_units") * CONFIG.vision.dim * 4).alias("vision_bytes"))


def doc_ids(spark, sf):
    return store.doc_ids(_chunks(spark, sf), _vision_units(spark, sf))


def delete_docs(spark, sf):
    gone = _table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return store.delete_docs(_table(spark, sf, "documents").select("doc_id", "source"), gone)


def upsert_docs(spark, sf):
    d = _table(spark, sf, "documents")
    toxic = _table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    new = d.join(toxic, "doc_id", "left_semi").select("doc_id", F.reverse("text").alias("text"))
    return store.upsert(d.select("doc_id", "text"), new, new)


def _manifest(spark, sf):
    """Pages as documents with HTML, every third with text of its own, a title and two images."""
    p = _table(spark, sf, "pages")
    return p.select(
        F.col("page_id").cast("string").alias("doc_id"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("own text of page "), F.col("page_id"), F.lit(". a | b | c"))).alias("text"), "html",
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("title "), F.col("page_id"))).otherwise(F.lit("")).alias("title"), F.lit(0).alias("page"),
        F.array(F.lit("/a.png"), F.concat(F.lit("/"), F.col("page_id"), F.lit(".png"))).alias("image_paths"), (F.col("page_id") % 5 != 0).alias("apply_selection"),
        F.when(F.col("page_id") % 4 == 0, F.create_map(F.lit("title"), F.lit("mine"))).otherwise(F.create_map().cast("map<string,string>")).alias("meta"), F.col("page_id").alias("seq"),
    )


def ingest_prepare(spark, sf):
    chunks, tiles = ingest.prepare(_manifest(spark, sf), CONFIG)
    c = chunks.select("doc_id", F.col("ord").cast("long").alias("ord"), F.coalesce(F.col("meta")["title"], F.lit("")).alias("title"), "text")
    t = tiles.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat("unit_id", F.lit("="), "image_path"))), ",").alias("tiles"))
    return c.join(t, "doc_id", "left").withColumn("tiles", F.coalesce("tiles", F.lit("")))


def ingest_batch(spark, sf):
    m = _manifest(spark, sf)
    chunks, tiles = ingest.prepare(m, CONFIG)
    t, v = ingest.text_units(chunks, CONFIG), ingest.vision_units(tiles, None, CONFIG.with_settings(tile_dedup="global"))
    return v.select("doc_id", "image_path", "duplicate_count").unionByName(t.groupBy("doc_id").agg(F.count("*").alias("duplicate_count")).withColumn("image_path", F.lit("text")))


def ingest_stats(spark, sf):
    m = _manifest(spark, sf)
    return ingest.ingest_stats(m, *ingest.prepare(m, CONFIG))


# evaluation


def _judged(spark, sf):
    e = _table(spark, sf, "embeddings")
    # lists repeat documents: ten units of at most a fifth as many
    doc = lambda c: F.floor(c / 5) % 29
    ranked = topk.vector_topk(_topk_queries(spark, sf), _vision_units(spark, sf).withColumn("doc_id", doc(F.substring("unit_id", 2, 6).cast("long"))), 10)
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    judged = e.where("vec_id % 4 = 1").select(doc(F.col("vec_id")).alias("doc_id"), "label").distinct()
    qrels = q.join(judged, "label").select("query_id", "doc_id", (F.col("doc_id") % 3 + 0.0).alias("gain"))
    return ranked, qrels, q.select("query_id")


def _metric(name):
    def run(spark, sf):
        rows = metrics.per_query(*_judged(spark, sf), [1, 5, 10])
        return rows.select("query_id", F.col("k").cast("long").alias("k"), _r(name).alias(name))

    return run


def eval_report(spark, sf):
    ranked, qrels, q = _judged(spark, sf)
    both = ranked.withColumn("mode", F.lit("vision")).unionByName(ranked.where("rank % 2 = 0").withColumn("mode", F.lit("half")))
    rows = metrics.report(both, qrels, q, [1, 5, 10])
    return rows.select("mode", F.col("k").cast("long").alias("k"), *[_r(n).alias(n) for n in ("hit", "recall", "precision", "mrr", "ndcg")])


def eval_sample(spark, sf):
    """The engine's own small evaluation set under all modes: nothing visual is indexed."""
    docs, queries, qrels = fixtures.sample(spark)
    t = units.chunk_text(docs).withColumn("embedding", embedding.hash_embed(F.col("text"), CONFIG.text.dim)).withColumn("page", F.lit(0))
    rows = evaluate(queries, qrels, t, spark.createDataFrame([], store.VISION_UNITS), (1, 3, 5, 10), config=CONFIG)
    return rows.select("mode", F.col("k").cast("long").alias("k"), *[_r(n).alias(n) for n in ("hit", "recall", "precision", "mrr", "ndcg")], "note")


def qrels_normalize(spark, sf):
    e = _table(spark, sf, "embeddings")
    listed = F.concat(F.lit('["d'), F.col("vec_id"), F.lit('","x"]'))
    mapped = F.concat(F.lit('{"d'), F.col("vec_id"), F.lit('":2.5,"y":0}'))
    rows = e.select(F.col("vec_id").alias("query_id"), F.parse_json(F.when(F.col("vec_id") % 2 == 0, listed).otherwise(mapped)).alias("relevant"))
    return manifests.qrels(rows)


# cost


def distinct_pages(spark, sf):
    return _vision_units(spark, sf).agg(F.countDistinct("doc_id", "page").alias("pages"))


def cost_estimate(spark, sf):
    rows = cost.estimate(cost.index_stats(_chunks(spark, sf), _vision_units(spark, sf)))
    return rows.withColumns({c: _r(c, 10) for c in ("index_usd", "query_usd", "storage_usd_month")})


def cost_project(spark, sf):
    return cost.project(spark.createDataFrame([(1,), (1_000_000,), (10_000_000,)], "pages long"))


def human_bytes(spark, sf):
    n = F.pow(F.lit(5.0), F.col("n_nationkey")).cast("long")
    return _table(spark, sf, "nation").select(n.alias("n"), formats.human_bytes(n).alias("shown"))


# files and streams


def manifest_scan(spark, sf):
    return manifests.read_manifest(spark, fixtures.write_manifest(spark)).select("doc_id", "title", F.col("page").cast("long").alias("page"), F.size("image_paths").cast("long").alias("images"))


def scan_tiles(spark, sf):
    files = manifests.scan_images(spark, fixtures.write_images(spark))
    return units.tiles_from_paths(files).withColumn("image_path", F.regexp_extract("image_path", "([^/]*)$", 1))


def image_richness(spark, sf):
    rows = manifests.read_images(spark, fixtures.write_images(spark))
    s = selection.image_richness(F.col("height"), F.col("width"), F.col("channels"), F.col("data"))
    return rows.select(F.regexp_extract("image_path", "([^/]*)$", 1).alias("file"), s.alias("s")).select("file", *[_r(f"s.{n}").alias(n) for n in ("score", "lines", "color", "midtone")])


def dedup_ahash(spark, sf):
    rows = manifests.read_images(spark, fixtures.write_images(spark))
    return rows.select(F.regexp_extract("image_path", "([^/]*)$", 1).alias("file"), dedup.average_hash(F.col("height"), F.col("width"), F.col("channels"), F.col("data")).alias("ahash"))


def hash_image_embed(spark, sf):
    files = manifests.scan_images(spark, fixtures.write_images(spark))
    v = embedding.hash_image_embed(F.col("content"), F.regexp_extract("image_path", "([^/]*)$", 1), 512)
    return files.select(F.regexp_extract("image_path", "([^/]*)$", 1).alias("file"), _r(v[0]).alias("first"), _r(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


def index_roundtrip(spark, sf):
    where = store.VersionedIndex(spark, fixtures.scratch(spark, "index"))
    m = _manifest(spark, sf)
    streaming.upsert_batch(where, m, CONFIG)
    streaming.upsert_batch(where, m.where("page_id % 2 = 0") if "page_id" in m.columns else m.where("seq % 2 = 0"), CONFIG)
    t, v = where.read()
    text = t.groupBy("doc_id").agg(F.count("*").alias("units"), _r(F.sum(F.col("embedding")[0])).alias("first"))
    return text.join(v.groupBy("doc_id").agg(F.count("*").alias("tiles")), "doc_id", "left").withColumn("tiles", F.coalesce("tiles", F.lit(0)))


def stream_ingest(spark, sf):
    folder, place = fixtures.scratch(spark, "landing"), fixtures.scratch(spark, "index")
    m = _manifest(spark, sf).drop("seq")
    m.write.json(folder)
    streaming.stream_folder(spark, folder, place, fixtures.scratch(spark, "checkpoint")).awaitTermination()
    return store.VersionedIndex(spark, place).read()[0].groupBy("doc_id").agg(F.count("*").alias("units"))


def event_windows(spark, sf):
    e = _table(spark, sf, "events")
    rows = streaming.event_windows(e.withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", _r("value", 4).alias("value"))


def queries() -> dict:
    named = [
        clean_text, tokenize, sentences, looks_like_html, tabular_lines, html_to_text, html_richness, text_richness, pixel_decision,
        chunk_text, chunk_ids, tile_geometry, tiles_from_paths, dedup_exact, dedup_global, dedup_stats, rank_dedup,
        hash_vector, hash_embed, l2_normalize, vector_topk, search_text_only, hybrid_search_rrf, hybrid_search_calibrated, hybrid_search_rerank, result_rows,
        fuse_rrf, route_features, route_heuristic, route_learned, route_train, bm25_rerank, rerank_blend,
        answer_pool, answer_bm25, answer_select, answer_text, answer_citations, llm_prompt,
        index_build, index_tiles, index_stats, index_footprint, doc_ids, delete_docs, upsert_docs, ingest_prepare, ingest_batch, ingest_stats,
        eval_report, eval_sample, qrels_normalize, distinct_pages, cost_estimate, cost_project, human_bytes,
        manifest_scan, scan_tiles, image_richness, dedup_ahash, hash_image_embed, index_roundtrip, stream_ingest, event_windows,
    ]
    out = {f.__name__: f for f in named}
    out |= {f"fuse_{n}": _calibrated(n) for n in fusion.NORMS}
    out |= {f"eval_{n}": _metric(n if n != "mrr" else "rr") for n in ("hit", "recall", "precision", "mrr", "ndcg")}
    return out
