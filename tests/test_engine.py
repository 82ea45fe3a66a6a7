import pytest

from marlstone import cli, fixtures, tools
from marlstone.config import EngineConfig
from marlstone.engine import Engine
from marlstone.operators import units
from marlstone.sources import manifests
from marlstone.streaming import ingest as streaming

A = "The solar array reached record output in June. Panels face south and are cleaned each week."
B = "Knead the dough for ten minutes and let it rise. Bake the bread until it is golden."


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, EngineConfig(), str(tmp_path / "index"))
    e.add_documents([{"doc_id": "a", "text": A, "title": "Sun", "image_paths": ["/1.png", "/2.png"], "apply_selection": False}, {"doc_id": "b", "text": B}])
    return e


def test_search_answer(engine):
    hits = engine.search("record output of the solar array", modality="text").orderBy("pos").collect()
    assert hits[0].doc_id == "a" and hits[0].text.startswith("The solar")
    said, cited = engine.answer("record output of the solar array", modality="text")
    assert "record output in June. [1]" in said.first().answer and cited.first().doc_id == "a"


def test_upsert_delete_save(engine, spark):
    assert engine.doc_ids() == ["a", "b"]
    assert engine.add_text("a", B, replace=True) == 1
    assert engine.vision_units.count() == 0 and engine.text_units.count() == 2
    assert engine.save() == 1 and engine.save() == 2
    again = Engine(spark, path=engine.index.path)
    assert again.doc_ids() == ["a", "b"] and again.stats()["text_units"] == 2
    assert again.delete(["a", "x"]) == {"text_removed": 1, "vision_removed": 0} and again.doc_ids() == ["b"]


def test_tools(engine):
    assert len(tools.schemas()) == 13
    assert tools.call_tool("search", {"query": "bread dough", "modality": "text"}, engine)["results"][0]["doc_id"] == "b"
    assert tools.call_tool("list_docs", {}, engine) == {"doc_ids": ["a", "b"], "count": 2}
    assert tools.call_tool("route", {"query": "which chart"}, engine)["vision_weight"] == 1.5
    assert tools.call_tool("richness", {"text": "plain"}, engine) == {"index_pixels": False, "score": 0.0}
    assert len(tools.call_tool("cost", {"pages": 10}, engine)["modes"]) == 3
    assert tools.call_tool("delete", {"doc_id": "b"}, engine)["text_removed"] == 1 and engine.index.version == 1
    with pytest.raises(KeyError):
        tools.call_tool("nothing", {}, engine)
    for bad in (("search", {}), ("add_batch", {"documents": [{"doc_id": "x"}]}), ("search", {"query": "x", "zip": 1})):
        with pytest.raises(ValueError):
            tools.call_tool(bad[0], bad[1], engine)


def test_dedup_tool(engine, spark):
    folder = fixtures.write_images(spark)
    r = tools.call_tool("dedup", {"images": [f"{folder}/a_p0_t0.png", f"{folder}/c_p0_t0.PNG", "/none_p0.png"], "scope": "global"}, engine)
    assert (r["input_tiles"], r["unique_tiles"]) == (3, 2)


def test_manifest(spark):
    for lines in (False, True):
        rows = manifests.read_manifest(spark, fixtures.write_manifest(spark, lines)).orderBy("doc_id").collect()
        assert [(r.doc_id, r.page, len(r.image_paths), r.apply_selection) for r in rows] == [("a", 0, 0, True), ("b", 3, 2, True), ("c", 0, 1, False)]
    bad = spark.createDataFrame([(None, None)], "doc_id string, id string")
    with pytest.raises(Exception, match="doc_id"):
        manifests.normalize_manifest(spark.createDataFrame([{"text": "x"}], manifests.INGEST_SCHEMA)).collect()
    assert bad.count() == 1


def test_images(spark):
    from marlstone.queries import dedup_ahash, image_richness

    score = {r.file: r for r in image_richness(spark, None).collect()}
    assert score["a_p0_t0.png"].score == 0 and score["a_p1_t0.png"].lines == 1 and score["b_p0_t0.png"].color > 0.9 and score["b_p0_t1.png"].midtone == 1
    ahash = {r.file: r.ahash for r in dedup_ahash(spark, None).collect()}
    assert ahash["a_p0_t0.png"] == ahash["c_p0_t0.PNG"] != ahash["b_p0_t0.png"]


def test_paths(spark):
    rows = units.tiles_from_paths(spark.createDataFrame([("/x/report2024_p3_t1.png",), ("/x/_p.png",), ("plain.jpg",)], "image_path string")).collect()
    assert [(r.unit_id, r.doc_id) for r in rows] == [("report2024_p3_t1", "report2024"), ("_p", "_p"), ("plain", "plain")]


def test_upsert_batch_is_idempotent(spark, tmp_path):
    from marlstone.sources.index import VersionedIndex

    index = VersionedIndex(spark, str(tmp_path / "i"))
    docs = manifests.normalize_manifest(spark.createDataFrame([{"doc_id": "a", "text": A}, {"doc_id": "b", "text": B}], manifests.INGEST_SCHEMA))
    for _ in range(2):
        streaming.upsert_batch(index, docs, EngineConfig())
    assert index.read()[0].count() == 2


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    EngineConfig.from_dict({"top_k": 3, "other": 1}).to_file(path)
    c = EngineConfig.from_file(path)
    assert c.fusion.top_k == 3 == c.get("top_k") and c.extra == {"other": 1} and c.with_settings(top_k=5).fusion.top_k == 5
    assert EngineConfig.from_dict(c.to_dict()) == c
    with pytest.raises(KeyError):
        c.with_settings(other=2)


def test_cli_parses():
    p = cli.parser()
    for line in ("search x -k 3 --no-rerank", "cost --project-pages 5", "dedup --dir d", "eval f --cost", "serve", "add-text d --replace", "route q --model learned", "ingest-url http://x --id a", "ingest-pdf f --id a --no-text", "train-router --lr 0.1", "ingest-batch m --workers 2", "dedup --images a --method ahash"):
        p.parse_args(line.split())
    with pytest.raises(SystemExit):
        p.parse_args(["nothing"])


def test_tiles_of_images(spark):
    images = manifests.read_images(spark, fixtures.write_images(spark)).selectExpr("image_path doc_id", "0 page", "height", "width", "channels", "data")
    rows = units.cut_tiles(images, 64, 16).collect()
    assert len(rows) == 5 * 3 + 1 and all(bytes(r.png).startswith(b"\x89PNG") for r in rows)


def test_formatted_and_model_rerank(engine, spark):
    from marlstone.operators import answer, rerank

    shown = answer.formatted(*engine.answer("record output of the solar array", modality="text")).first().shown
    assert "[1]\n\nSources:\n  [1] (text) doc=a — The solar array reached record output in June." in shown
    q = engine.questions(["x"])
    fused = spark.createDataFrame([(0, 0, "a", 0.9, "short"), (0, 1, "b", 0.1, "much longer text")], "query_id long, pos int, doc_id string, score double, text string")
    ranked = rerank.rerank_by_model(q, fused, lambda: lambda questions, texts: [len(t) for t in texts], 1.0).orderBy("pos").collect()
    assert [r.doc_id for r in ranked] == ["b", "a"]
