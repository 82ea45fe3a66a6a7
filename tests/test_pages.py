import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone import cli, fixtures
from marlstone.config import EngineConfig
from marlstone.engine import Engine
from marlstone.functions.formats import table
from marlstone.functions.images import png, read_png
from marlstone.operators import answer, dedup, embedding, metrics, rerank, routing
from marlstone.plans import ingest
from marlstone.sources.index import TEXT_UNITS, VISION_UNITS, VersionedIndex
from marlstone.sources.manifests import read_examples, tile_contents

GRAY = np.full((64, 48), 128)
RED = np.full((1000, 80, 3), 255)
RED[20:900, 10:60] = (220, 30, 30)


def save(path, pixels):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(png(pixels))
    return path


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, EngineConfig(), str(tmp_path / "index"))


def test_png_files_are_read_back():
    rng = np.random.default_rng(0)
    for shape in ((9, 7), (5, 11, 3)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        assert (read_png(png(x)) == x).all()
    assert read_png(b"no image") is None and read_png(png(GRAY)[:40]) is None


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    """Filtered by the rules of the format, pixel by pixel."""
    import zlib

    rng = np.random.default_rng(kind)
    x = rng.integers(0, 256, (6, 5, 3)).astype(np.int64)
    rows = []
    for y in range(6):
        line = [kind]
        for i in range(15):
            left = x[y].reshape(-1)[i - 3] if i >= 3 else 0
            up = x[y - 1].reshape(-1)[i] if y else 0
            corner = x[y - 1].reshape(-1)[i - 3] if y and i >= 3 else 0
            p = left + up - corner
            best = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line.append(int(x[y].reshape(-1)[i] - {1: left, 2: up, 3: (left + up) // 2, 4: best}[kind]) & 255)
        rows.append(bytes(line))
    plain = png(x)
    at = plain.index(b"IDAT")
    body = zlib.compress(b"".join(rows))
    data = plain[: at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + b"\0\0\0\0" + plain[-12:]
    assert (read_png(data) == x).all()


def test_equal_tiles_fold_by_their_contents(engine, spark, tmp_path):
    one, two, other = (save(str(tmp_path / f"t/{n}.png"), p) for n, p in (("one", GRAY), ("two", GRAY), ("other", RED)))
    stats = engine.add_documents([{"doc_id": "a", "text": "x", "image_paths": [one, two, other], "apply_selection": False}, {"doc_id": "b", "image_paths": [one], "apply_selection": False}])
    assert (stats["tiles"], stats["tiles_folded"], stats["vision_skipped"]) == (4, 1, 0)
    rows = {(r.doc_id, r.image_path): r for r in engine.vision_units.collect()}
    assert set(rows) == {("a", one), ("a", other), ("b", one)}
    assert [(o.unit_id, o.doc_id) for o in rows["a", one].occurrences] == [("a_p0_t0", "a"), ("a_p0_t1", "a")] and rows["b", one].occurrences is None
    with open(one, "rb") as f:
        data = f.read()
    v = np.resize(np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float), 512)
    v += 0.01 * np.resize(np.frombuffer(__import__("hashlib").sha256(one.encode()).digest(), np.uint8) - 127.5, 512)
    assert rows["a", one].embedding == pytest.approx((v / np.linalg.norm(v)).tolist())
    everywhere = Engine(spark, EngineConfig().with_settings(tile_dedup="global"), str(tmp_path / "other"))
    everywhere.add_documents([{"doc_id": "a", "image_paths": [one, two], "apply_selection": False}, {"doc_id": "b", "image_paths": [one], "apply_selection": False}])
    assert [(r.duplicate_count, len(r.occurrences)) for r in everywhere.vision_units.collect()] == [(3, 3)]


def test_tiles_that_look_alike(engine, spark, tmp_path):
    paths = [save(str(tmp_path / f"t/{i}.png"), p) for i, p in enumerate((RED, np.minimum(RED + 1, 255), GRAY))]
    docs = [{"doc_id": "a", "image_paths": paths, "apply_selection": False}]
    engine.add_documents(docs)
    assert engine.vision_units.count() == 3
    alike = Engine(spark, EngineConfig().with_settings(tile_dedup_method="ahash"), str(tmp_path / "i2"))
    alike.add_documents(docs)
    assert alike.vision_units.count() == 2
    files = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "seq long, image_path string")
    with_bytes = files.join(tile_contents(spark, files), "image_path")
    assert alike.dedup_stats(with_bytes, "global")["unique_tiles"] == 2 and alike.dedup_stats(with_bytes, "global", "exact", 10)["unique_tiles"] == 3
    with pytest.raises(ValueError):
        dedup.content_key(F.col("a"), F.col("b"), F.col("c"), "smell")


def test_images_decide_about_pixels(engine, tmp_path):
    red, gray = save(str(tmp_path / "t/r.png"), RED), save(str(tmp_path / "t/w.png"), np.full((64, 48), 255))
    assert engine.should_index_pixels(image=red)["index_pixels"] and not engine.should_index_pixels(text="plain words", image=gray)["index_pixels"]
    assert engine.should_index_pixels("plain words") == {"index_pixels": False, "score": 0.0} and engine.should_index_pixels()["index_pixels"]
    stats = engine.add_documents([{"doc_id": "a", "text": "plain words", "image_paths": [red]}, {"doc_id": "b", "text": "plain words", "image_paths": [gray]}])
    assert (stats["tiles"], stats["docs_with_pixels"], stats["vision_skipped"]) == (1, 1, 1)
    tiles = engine.vision_units.drop("occurrences", "duplicate_count", "embedding").limit(1)
    assert engine.add_tiles_if_rich(tiles, image=gray, text="plain words")["added"] == 0 and engine.add_tiles_if_rich(tiles, image=red)["added"] == 1


def render(folder_pages):
    def run(target, folder, *_):
        return [save(f"{folder}/page_{i}.png", p) for i, p in enumerate(folder_pages)]

    return run


def test_url_and_pdf(engine):
    got = engine.ingest_url("u", "http://x", render([RED]))
    assert got == {"chunks": 0, "tiles": 3, "skipped": 0}
    rows = engine.vision_units.orderBy("row").collect()
    assert [(r.unit_id, list(r.bbox)) for r in rows] == [("u_p0_t0", [0, 0, 80, 512]), ("u_p0_t1", [0, 448, 80, 960]), ("u_p0_t2", [0, 896, 80, 1000])]
    for r in rows:
        with open(r.image_path, "rb") as f:
            assert (read_png(f.read()) == RED[r.bbox[1] : r.bbox[3]]).all()
    blank = np.full((64, 48), 255)
    got = engine.ingest_pdf("p", "file.pdf", render=render([blank, RED]), read=lambda path: ["only words on this page", "a figure"])
    assert got == {"chunks": 2, "tiles": 3, "skipped": 1}
    assert {r.page for r in engine.text_units.where("doc_id = 'p'").collect()} == {0, 1} and {r.page for r in engine.vision_units.where("doc_id = 'p'").collect()} == {1}
    assert engine.ingest_pdf("q", "file.pdf", True, False, read=lambda path: ["words"]) == {"chunks": 1, "tiles": 0, "skipped": 0}
    engine.save()
    with pytest.raises(ImportError, match="Playwright"):
        engine.ingest_url("x", "http://x")


def test_progress(engine):
    seen = []
    docs = [{"doc_id": f"d{i % 4}", "text": f"text {i}"} for i in range(5)]
    total = engine.add_documents(docs, True, batch_size=2, on_progress=lambda s: seen.append(s["documents"]))
    assert seen == [2, 4, 5] and total["chunks"] == 5 and engine.text_units.count() == 5


def test_plugged_models(spark, tmp_path):
    embedding.plug("lengths", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), lambda: lambda files: np.array([[len(f), 1.0] for f in files]))
    e = Engine(spark, EngineConfig().with_settings(text_model="lengths", vision_model="lengths", vision_batch_size=1), str(tmp_path / "i"))
    red = save(str(tmp_path / "t/r.png"), RED)
    e.add_documents([{"doc_id": "a", "text": "x" * 9, "image_paths": [red, "/gone.png"], "apply_selection": False}, {"doc_id": "b", "text": "y"}])
    rows = {r.doc_id: r.embedding for r in e.text_units.collect()}
    assert rows["a"] == pytest.approx([9 / 82**0.5, 1 / 82**0.5]) and rows["b"] == pytest.approx([0.5**0.5] * 2)
    assert sorted(r.embedding is None for r in e.vision_units.collect()) == [False, True]
    hits = e.search("z" * 9, modality="text").orderBy("pos").collect()
    assert [h.doc_id for h in hits] == ["a", "b"] and {h.unit_id for h in e.search("q").where("modality = 'vision'").collect()} <= {"a_p0_t0"}
    gone = Engine(spark, EngineConfig().with_settings(text_model="some/model"), str(tmp_path / "j"))
    gone.add_documents([{"doc_id": "a", "text": "x"}])
    with pytest.raises(Exception, match="sentence-transformers"):
        gone.text_units.collect()


def test_rerank_models(spark):
    q = spark.createDataFrame([(1, "figure of bread")], "query_id long, query string")
    rows = [(1, 0, "a", 0.9, "other words", {}), (1, 1, "b", 0.5, None, {"title": "a figure of bread"}), (1, 2, "c", 0.4, None, {"ocr": "bread"}), (1, 3, "d", 0.1, "", None)]
    hits = spark.createDataFrame(rows, "query_id long, pos int, doc_id string, score double, text string, meta map<string,string>")
    found = rerank.rerank_with("lexical", q, hits, 1.0).orderBy("pos").collect()
    assert [r.doc_id for r in found] == ["b", "c", "a", "d"] and found[0].text is None and found[0].meta == {"title": "a figure of bread"}
    assert [r.doc_id for r in rerank.rerank_with("none", q, hits, top_k=2).orderBy("pos").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="sentence-transformers"):
        rerank.rerank_with("some/cross-encoder", q, hits).collect()


def test_answers_read_meta_data(spark):
    meta = [{"text": "Text of the tile is here.", "ocr": "no"}, {"ocr": "Words that a camera saw."}, {"title": "A title of some length."}, {}]
    rows = [(1, i, "d", f"u{i}", "vision", 0, None, "/x.png", m) for i, m in enumerate(meta)]
    hits = spark.createDataFrame(rows, "query_id long, rank int, doc_id string, unit_id string, modality string, page int, text string, image_path string, meta map<string,string>")
    assert [r.sent for r in answer.sentence_pool(hits).orderBy("idx").collect()] == ["Text of the tile is here.", "Words that a camera saw.", "A title of some length."]
    assert [r.unit_id for r in answer.visual_hits(hits).collect()] == ["u3"]


def test_reader_setting(engine):
    engine.add_text("a", "The solar array reached record output in June.")
    engine.config = engine.config.with_settings(reader_model="none")
    assert [x.count() for x in engine.answer("solar array")] == [0, 0]
    engine.config = engine.config.with_settings(reader_model="anything")
    assert "[1]" in engine.answer("solar array", modality="text")[0].first().answer


def test_hits_in_the_raw_list(spark):
    ranked = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b")], "query_id long, rank int, doc_id string")
    rows = metrics.per_query(ranked, spark.createDataFrame([(1, "b", 1.0)], "query_id long, doc_id string, gain double"), spark.createDataFrame([(1,)], "query_id long"), [2, 3]).collect()
    assert {r.k: (r.hit, r.recall, r.rr) for r in rows} == {2: (0, 1, 0.5), 3: (1, 1, 0.5)}


def test_router_examples(spark, tmp_path):
    array, lines, bad = (str(tmp_path / n) for n in ("a.json", "l.json", "b.json"))
    rows = [{"query": "which chart", "label": 1}, {"query": "fix the error", "vision_label": 0.0}]
    for path, text in ((array, json.dumps(rows)), (lines, "\n".join(map(json.dumps, rows))), (bad, json.dumps([{"query": "x"}]))):
        with open(path, "w") as f:
            f.write(text)
    assert sorted(tuple(r) for r in read_examples(spark, array).collect()) == sorted(tuple(r) for r in read_examples(spark, lines).collect()) == [("fix the error", 0.0), ("which chart", 1.0)]
    with pytest.raises(Exception, match="query and a label"):
        routing.fit_router(read_examples(spark, bad))
    out = str(tmp_path / "r.json")
    args = cli.parser().parse_args(["--storage", str(tmp_path / "s"), "train-router", "--out", out])
    args.run(args, Engine(spark, path=args.storage))
    assert [round(w, 6) for w in routing.load_router(out)] == list(routing.SEED_WEIGHTS)


def test_index_versions(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path / "i"))
    text, vision = spark.createDataFrame([], TEXT_UNITS), spark.createDataFrame([], VISION_UNITS)
    one = spark.createDataFrame([("u", "d", "t", 0, 0, "", {}, 0, [1.0])], TEXT_UNITS)
    assert index.version == 0 and index.read()[0].count() == 0
    assert index.write(one, vision, EngineConfig()) == 1
    old = index.read()[0]
    (tmp_path / "i" / "pointer-v=2-x").write_text("{")  # a writer that died
    assert index.version == 1 and index.write(text, vision, EngineConfig()) == 2 and old.count() == 1
    for n in (3, 4):
        assert index.write(text, vision, EngineConfig()) == n
    names = {p.name for p in (tmp_path / "i").iterdir()}
    assert {"CURRENT.3", "CURRENT.4"} <= names and "CURRENT.2" not in names and sum(n.startswith("v=") for n in names) == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    index = VersionedIndex(spark, str(tmp_path / "i"))
    text, vision = spark.createDataFrame([], TEXT_UNITS), spark.createDataFrame([], VISION_UNITS)
    index.write(text, vision, EngineConfig())
    monkeypatch.setattr(VersionedIndex, "version", property(lambda self: 0))
    with pytest.raises(RuntimeError, match="another writer"):
        index.write(text, vision, EngineConfig())
    monkeypatch.undo()
    assert index.version == 1


def test_eval_command(spark, tmp_path, capsys):
    path = str(tmp_path / "set.json")
    with open(path, "w") as f:
        json.dump({"name": "s", "documents": [{"doc_id": d, "text": t} for d, t, _ in fixtures.sample_rows()[:4]], "queries": [{"id": str(i), "query": q, "relevant": [d]} for i, (d, _, q) in enumerate(fixtures.sample_rows()[:4])]}, f)
    args = cli.parser().parse_args(["--storage", str(tmp_path / "s"), "eval", path, "-k", "1,3", "--cost"])
    args.run(args, Engine(spark, path=args.storage))
    shown = capsys.readouterr().out
    assert "ms/query" in shown and "skipped: nothing indexed" in shown and "storage a month" in shown
    assert table([(1, "ab")], ("n", "name")) == "n  name\n-  ----\n1  ab"


def test_hash_sums_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(embedding, "_TOKENS", 7)
    import pyarrow as pa

    lists = [["a", "b"], [], None, ["c"] * 20, ["b", "a", "a"]]
    got = embedding._hash_sums(pa.array(lists, pa.list_(pa.string())))
    one = lambda w: np.frombuffer(__import__("hashlib").sha256(w.encode()).digest(), np.uint8) - 127.5
    assert got == pytest.approx(np.array([sum((one(w) for w in x or []), np.zeros(32)) for x in lists]))


def test_pages_are_cleaned_once_and_go_to_python_in_small_batches(spark):
    """An Arrow batch holds 64 MB of pages; a filter names the text of a page some thirty times."""
    docs = spark.createDataFrame([("a", "", "<p>x</p>", "", 0, ["/a.png"], True, {}, 0)], "doc_id string, text string, html string, title string, page int, image_paths array<string>, apply_selection boolean, meta map<string,string>, seq long")
    for rows in ingest.prepare(docs, EngineConfig()):
        plan = rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan and plan.count("{3,}") <= 4


def test_no_images_no_shuffle(spark):
    """Where no image can be read, pages are not shuffled to look for one."""
    docs = spark.createDataFrame([("a", ["/nowhere/a.png"], 0)], "doc_id string, image_paths array<string>, seq long")
    contents = tile_contents(spark, docs.select(F.explode("image_paths").alias("image_path")))
    scored = ingest.with_image_score(docs, contents)
    assert contents.count() == 0 and [r.image_score for r in scored.collect()] == [None]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "content" not in plan


def test_image_vectors_beside_the_plain_rule(spark):
    rows = [(b"abc" * 9, "/x.png"), (None, "/y é.png"), (b"", "/z.png"), (bytes(range(256)) * 2, "/w.png")]
    files = spark.createDataFrame(rows, "content binary, path string")
    column = embedding.hash_image_embed(F.col("content"), F.col("path"), 300)
    for (raw, path), got in zip(rows, files.select(column.alias("v")).collect()):
        v = np.resize(np.bincount(np.frombuffer(path.encode() if raw is None else raw, np.uint8), minlength=256).astype(float), 300)
        v += 0.01 * np.resize(np.frombuffer(hashlib.sha256(path.encode()).digest(), np.uint8) - 127.5, 300)
        assert got.v == list(v / np.linalg.norm(v))


def test_vectors_are_scaled_in_parts(spark, monkeypatch):
    """Batches over the bound give the vectors of one text at a time, and tokens' digests are kept as bytes."""
    texts = [" ".join(f"w{i * j % 50}" for j in range(i % 9)) for i in range(40)]
    monkeypatch.setattr(embedding, "_ROWS", 7)
    monkeypatch.setattr(embedding, "_TOKENS", 11)
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", embedding.hash_embed(F.col("t"), 40).alias("v")).orderBy("i").collect()
    for row, text in zip(got, texts):
        v = np.zeros(40)
        for word in text.split():
            v += np.resize(np.frombuffer(hashlib.sha256(word.encode()).digest(), np.uint8) - 127.5, 40)
        assert row.v == pytest.approx(list(v / (np.linalg.norm(v) or 1)), abs=1e-12)
