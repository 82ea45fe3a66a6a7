import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone import fixtures
from marlstone.config import EngineConfig
from marlstone.operators import cost, dedup, embedding, fusion, metrics, rerank, routing, topk
from marlstone.plans import search


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, modality string, rank int, doc_id string, unit_id string, score double")


def weights(spark, text=1.0, vision=1.0):
    return spark.createDataFrame([(1, text, vision)], "query_id long, text_weight double, vision_weight double")


LISTS = [(1, "text", 0, "a", "a0", 0.9), (1, "text", 1, "b", "b0", 0.5), (1, "text", 2, "a", "a1", 0.5), (1, "vision", 0, "b", "v0", 0.3), (1, "vision", 1, "c", "v1", 0.3)]


def test_rrf(spark):
    rows = {r.doc_id: r for r in fusion.fuse_rrf(ranked(spark, LISTS), weights(spark)).collect()}
    assert rows["a"].score == pytest.approx(1 / 60 + 1 / 62) and rows["b"].score == pytest.approx(1 / 61 + 1 / 60)
    assert rows["b"].pos == 0 and rows["b"].modality == "vision" and rows["c"].c_text is None
    assert [r.doc_id for r in fusion.fuse_rrf(ranked(spark, LISTS), weights(spark, vision=0.0)).orderBy("pos").collect()] == ["a", "b"]
    assert fusion.fuse_rrf(ranked(spark, LISTS), weights(spark), top_k=1).count() == 1


@pytest.mark.parametrize("norm", fusion.NORMS)
def test_calibrated(spark, norm):
    rows = {r.doc_id: r for r in fusion.fuse(ranked(spark, LISTS), weights(spark), "calibrated", norm=norm).collect()}
    expected = {"minmax": 1.0, "zscore": 0.5, "softmax": 0.5}[norm]
    assert rows["c"].score == pytest.approx(expected)
    assert rows["a"].c_text > rows["b"].c_text


def test_unknown_fusion(spark):
    with pytest.raises(ValueError):
        fusion.fuse(ranked(spark, LISTS), weights(spark), "other")
    with pytest.raises(ValueError):
        fusion.normalized_score("other")


def test_bm25_and_blend(spark):
    q = spark.createDataFrame([(1, "rare the the")], "query_id long, query string")
    c = spark.createDataFrame([(1, "x", "the the the the the"), (1, "y", "the rare word"), (1, "z", "")], "query_id long, cand_id string, text string")
    s = {r.cand_id: r.bm25 for r in rerank.bm25(q, c).collect()}
    assert s["y"] > s["x"] > 0 and s["z"] == 0
    fused = c.select("query_id", F.col("cand_id").alias("doc_id"), "text").join(spark.createDataFrame([("x", 0, 0.9), ("y", 1, 0.5), ("z", 2, 0.1)], "doc_id string, pos int, score double"), "doc_id")
    assert [r.doc_id for r in rerank.rerank(q, fused, 1.0).orderBy("pos").collect()][0] == "y"
    assert [r.doc_id for r in rerank.rerank(q, fused, 0.0).orderBy("pos").collect()] == ["x", "y", "z"]


def test_topk_ties_and_blocks(spark, monkeypatch):
    units = spark.createDataFrame([(f"u{i}", f"d{i}", [1.0, float(i % 3)]) for i in range(30)], "unit_id string, doc_id string, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id long, embedding array<double>")
    one = topk.vector_topk(q, units.repartition(5), 4).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    assert topk.vector_topk(q, units.repartition(1), 4).orderBy("query_id", "rank").collect() == one
    assert [r.unit_id for r in one[:4]] == ["u0", "u12", "u15", "u18"]
    assert topk.vector_topk(q.limit(0), units, 3).count() == 0 == topk.vector_topk(q, units.limit(0), 3).count()


def test_metrics(spark):
    got = spark.createDataFrame([(1, 0, "x"), (1, 1, "b"), (1, 2, "a"), (1, 3, "b")], "query_id long, rank int, doc_id string")
    qrels = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (2, "a", 1.0)], "query_id long, doc_id string, gain double")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    rows = {(r.query_id, r.k): r for r in metrics.per_query(got, qrels, queries, [3, 1, 3]).collect()}
    r = rows[1, 3]
    assert (r.hit, r.recall, r.precision, r.rr) == (1, 1, pytest.approx(2 / 3), 0.5)
    assert r.ndcg == pytest.approx((1 / math.log2(3) + 3 / math.log2(4)) / (3 + 1 / math.log2(3)))
    assert rows[1, 1].hit == 0 and rows[2, 3].recall == 0 and rows[3, 3].ndcg == 0 and len(rows) == 6


def test_router(spark):
    seed = spark.createDataFrame(routing.SEED, "query string, label double")
    assert [round(w, 6) for w in routing.fit_router(seed)] == list(routing.SEED_WEIGHTS)
    q = spark.createDataFrame(list(enumerate(fixtures.ROUTE_QUERIES)), "query_id long, query string")
    learned = routing.route(q, "learned").orderBy("query_id").collect()
    assert learned[0].vision_probability == pytest.approx(0.954053, abs=1e-5) and learned[0].text_weight == pytest.approx(0.364326, abs=1e-5)
    assert learned[1].vision_probability == pytest.approx(0.029115, abs=1e-5) and learned[2].vision_probability == pytest.approx(0.470185, abs=1e-5)
    rules = routing.route(q).collect()
    assert all(r.text_weight > 0 and r.vision_weight > 0 for r in rules) and rules[3].text_weight == rules[3].vision_weight == 1
    with pytest.raises(ValueError):
        routing.route(q, "other")


def test_router_file(spark, tmp_path):
    path = str(tmp_path / "r.json")
    routing.save_router(list(routing.SEED_WEIGHTS), path)
    assert routing.load_router(path) == list(routing.SEED_WEIGHTS)
    routing.save_router([1.0], path)
    with pytest.raises(ValueError):
        routing.load_router(path)


def test_dedup(spark):
    rows = [(0, "t0", "d1", "k"), (1, "t1", "d1", "k"), (2, "t2", "d2", "k"), (3, "t3", "d2", "m")]
    tiles = spark.createDataFrame(rows, "seq long, unit_id string, doc_id string, content_key string")
    doc = {r.unit_id: r for r in dedup.deduplicate(tiles).collect()}
    assert set(doc) == {"t0", "t2", "t3"} and [o.unit_id for o in doc["t0"].occurrences] == ["t0", "t1"] and doc["t2"].occurrences is None
    assert {r.unit_id for r in dedup.deduplicate(tiles, scope="global").collect()} == {"t0", "t3"}
    s = dedup.dedup_stats(tiles, scope="global").first()
    assert (s.input_tiles, s.unique_tiles, s.duplicate_tiles, s.groups, s.bytes_saved, s.ratio) == (4, 2, 2, 1, 400_000, 0.5)
    assert dedup.dedup_stats(tiles.limit(0)).first().ratio == 0


def test_embedding(spark):
    t = spark.createDataFrame([(1, "a b b"), (2, ""), (3, None)], "i long, t string")
    rows = {r.i: r for r in t.select("i", embedding.hash_embed(F.col("t"), 64).alias("v"), embedding.hash_embed(F.col("t"), 32).alias("w")).collect()}
    assert sum(x * x for x in rows[1].v) == pytest.approx(1) and rows[1].v[:32] == pytest.approx(rows[1].v[32:])
    assert set(rows[2].v) == {0.0} == set(rows[3].w)
    assert [embedding.vision_backend(*x) for x in (("hash", "auto"), ("gme-x", "auto"), ("m", "auto"), ("gme", "clip"))] == ["hash", "qwen", "clip", "clip"]


def test_model_embed_batches(spark):
    t = spark.createDataFrame([("ab",), ("c",), ("ddd",)], "t string").coalesce(1)

    def load():
        import numpy as np

        return lambda items: np.array([[len(items), len(x)] for x in items], float)

    rows = [r[0] for r in t.select(embedding.model_embed(F.col("t"), load, 2)).collect()]
    assert rows[0] == pytest.approx([2**-0.5, 2**-0.5]) and rows[2] == pytest.approx([1 / 10**0.5, 3 / 10**0.5])


def test_cost(spark):
    rows = {r["mode"]: r for r in cost.project(spark.createDataFrame([(10_000_000,)], "pages long")).collect()}
    assert [rows[m].bytes_per_page for m in ("text", "vision", "hybrid")] == [7_680, 643_072, 650_752]
    assert [rows[m].storage_usd_month for m in ("text", "vision", "hybrid")] == [1.65, 137.75, 139.39]


def test_sample_search(spark):
    from marlstone.queries import eval_sample

    rows = {(r["mode"], r.k): r for r in eval_sample(spark, None).collect()}
    assert rows["text", 10].recall >= 0.75 and rows["text", 10].mrr > 0.5
    assert rows["hybrid", 10].recall == rows["text", 10].recall and rows["vision", 10].hit == 0 and "skipped" in rows["vision", 1].note


def test_weigh(spark):
    q = spark.createDataFrame([(1, "which chart")], "query_id long, query string")
    r = search.weigh(q, EngineConfig(), "text").first()
    assert (r.text_weight, r.vision_weight) == (1, 0)
    assert search.weigh(q, EngineConfig().with_settings(enable_router=False)).first().vision_weight == 1
    with pytest.raises(ValueError):
        search.weigh(q, EngineConfig(), "smell")


@pytest.mark.parametrize("ids", (str, int))
def test_task_topk_in_bounds(monkeypatch, ids):
    """A task's own top k beside a plain one, with ties, a vector that is no number, and few scores at once; only k rows a query come out."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(700, 4)), 1)
    x[::3] = x[0]
    x[5] = np.nan
    q = topk._unit(rng.normal(size=(9, 4)))
    names = [ids(i * 37 % 1000) for i in range(700)]
    flat = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), 4).cast(pa.list_(pa.float64()))
    batches = [pa.RecordBatch.from_arrays([pa.array(names[a : a + 90]), pa.array(names[a : a + 90]), flat(x[a : a + 90])], ["unit_id", "doc_id", "embedding"]) for a in range(0, 700, 90)]
    monkeypatch.setattr(topk, "_SCORES", 50)
    monkeypatch.setattr(topk, "_WAITING", 20)
    most, whole = [], topk._unit
    monkeypatch.setattr(topk, "_unit", lambda v: most.append(len(v)) or whole(v))
    got = topk._task_topk(iter(batches), q, 6)
    score = q @ whole(x).T
    for i in range(9):
        rank = sorted(range(700), key=lambda j: (-np.inf if np.isnan(score[i, j]) else -round(score[i, j], 9), names[j]))[:6]
        assert [r["unit_id"] for r in got.to_pylist() if r["query"] == i] == [names[j] for j in rank]
    assert len(got) == 54 and max(most) * len(q) <= 50 and topk._task_topk(iter([]), q, 6) is None
