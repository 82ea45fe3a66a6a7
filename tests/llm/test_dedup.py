import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import collection_bwt, common, cover_tree, embedding_dedup, exact_dedup, ngram_join, suffix_dedup
from tests.llm import brute

DOCS = "doc_id long, text string, source string, n_chars long, kept string, key string, component_id string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()


def frame(spark, texts):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "s", len(t or ""), "x", "y", "z") for i, t in texts.items()], DOCS).repartition(3)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def corpus():
    base = prose(1, 120)
    out = {0: base, 1: base.replace(" ", "  "), 2: None, 3: "", 4: " \n\t", 5: "one", 6: "one", 7: "One two", 8: base.upper(), 9: prose(2, 3000)}
    r = random.Random(5)
    for i in range(10, 60):
        w = base.split()
        for _ in range(r.randint(0, 12)):
            w[r.randrange(len(w))] = f"edit{i}x{r.randint(0, 9)}"
        out[i] = " ".join(w)
    passage = prose(3, 40)
    for i in range(60, 90):
        out[i] = prose(100 + i, r.randint(5, 80)) + " " + passage + " " + prose(200 + i, r.randint(0, 60))
    out[90] = "é" * 400
    out[91] = "ab" * 300
    out[92] = prose(2, 3000) + " tail"
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (500, 400)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == brute.linked(nodes, [e for e in edges if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# suffix arrays


def test_suffixes_small():
    rng = np.random.default_rng(0)
    for _ in range(60):
        strings = [bytes(rng.integers(1, 2 + rng.integers(1, 4), rng.integers(0, 14)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
        flat, offsets = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0] + [len(s) for s in strings])
        string, at, prefix = collection_bwt.suffixes(flat, offsets, 5, block=int(rng.integers(1, 12)))
        got = [strings[s][a:] for s, a in zip(string, at)]
        assert got == sorted(got) and len(set(zip(string.tolist(), at.tolist()))) == sum(len(s) + 1 for s in strings)
        for x, y, p in zip(got, got[1:], prefix[1:]):
            same = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
            assert p == min(5, same)


def check_repeats(spark, texts, span):
    rows = {r.doc_id: r for r in suffix_dedup.removal_report(frame(spark, texts), span).collect()}
    want = brute.repeats(texts, span)
    assert set(rows) == set(texts)
    for i, (size, removed, runs, digest, _) in want.items():
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (size, removed, runs, digest), i
    return want


@pytest.mark.parametrize("span", [100, 60, 9])
def test_repeats(spark, texts, span):
    check_repeats(spark, texts, span)


def test_repeats_in_small_batches(spark, texts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        check_repeats(spark, texts, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_with_zero_bytes(spark):
    check_repeats(spark, {1: "\0" * 250, 2: "a\0b" * 60, 3: "a\0b" * 50}, 100)


def test_remove_repeats(spark, texts):
    d = frame(spark, texts)
    out = suffix_dedup.remove_repeats(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    rows = {r.doc_id: r for r in out.collect()}
    want = brute.repeats(texts)
    for i, t in texts.items():
        assert rows[i].text == (t if not want[i][1] else want[i][4].decode("utf-8", "ignore"))
    assert rows[2].text is None and rows[91].source == "s"
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [300, 4000])
@pytest.mark.parametrize("batch", ["5", "10000"])
def test_hot_anchors(spark, texts, monkeypatch, limit, batch):
    passage = prose(11, 30)
    many = texts | {1000 + i: prose(1000 + i, 30) + passage + prose(3000 + i % 7, 40) for i in range(80)}
    monkeypatch.setattr(suffix_dedup, "COLLECTION_BYTES", limit)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        check_repeats(spark, many, 100)
        same = frame(spark, many).unionByName(frame(spark, many))  # repeated rows
        want = brute.repeats(many, 100)
        rows = suffix_dedup.removal_report(same).collect()
        assert len(rows) == 2 * len(many) and all((r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][1:4] for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_collection_grows_with_a_hot_anchor(monkeypatch):
    sizes = []
    monkeypatch.setattr(suffix_dedup, "COLLECTION_BYTES", 5000)
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda d, s, flat, *_: sizes.append(len(flat)) or (d[:0], s[:0]))
    passage, rows = prose(12, 40), []
    ids = pa.array(range(3000), pa.int64())
    docs = pa.record_batch([ids, pa.array([prose(10_000 + i, 25) + passage + prose(20_000 + i, 25) for i in range(3000)])], ["doc_id", "text"])
    runs = pa.Table.from_batches(list(suffix_dedup._runs(100, 48)(iter([docs]))))
    runs = runs.sort_by([(c, "ascending") for c in ("anchor", "content", "doc_id", "start")])
    known = pa.Table.from_batches(list(suffix_dedup._hot_marked(suffix_dedup._first_of_content(100), 100, 5000)(iter(runs.to_batches())))).to_pylist()
    hot = {r["anchor"] for r in known if r["n"] == 0}
    for r in known:
        if r["n"] > 0:
            rows.append((r["doc_id"], {"anchor": r["anchor"], "start": r["start"], "n": r["n"], "hot": r["anchor"] in hot}))
    by = {}
    for d, r in rows:
        by.setdefault(d, []).append(r)
    wanted = pa.record_batch([pa.array(list(by)), pa.array(list(by.values())), docs.column(1).take(pa.array(list(by)))], ["doc_id", "runs", "text"])
    strings = pa.Table.from_batches(list(suffix_dedup._strings(100)(iter([wanted])))).sort_by([(c, "ascending") for c in ("anchor", "doc_id", "start")])
    assert hot and sum(1 for r in known if r["n"] > 0) * 100 > 100_000
    list(suffix_dedup._collections(100)(iter(strings.to_batches())))
    assert max(sizes, default=0) <= 10_000


def test_repeated_rows_are_one_document(spark):
    t = prose(4, 60)
    d = frame(spark, {1: t}).unionByName(frame(spark, {1: t}))
    assert [r.n_removed for r in suffix_dedup.removal_report(d).collect()] == [0, 0]
    null = spark.createDataFrame([(None, t), (1, t)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.removal_report(null).collect()) == [0, 0]


def test_repeated_rows_of_one_slice(spark):
    t, u = prose(4, 60), prose(6, 60)
    d = spark.createDataFrame([(1, t), (1, t), (2, u + t), (2, u + t), (3, "x" * 300), (3, "x" * 300)], "doc_id long, text string").coalesce(1)
    assert d.rdd.getNumPartitions() == 1
    want = brute.repeats({1: t, 2: u + t, 3: "x" * 300})
    rows = suffix_dedup.removal_report(d).collect()
    assert len(rows) == 6 and want[1][1] == 0 < want[2][1]
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4]
    assert {r.text for r in suffix_dedup.remove_repeats(d).where("doc_id = 1").collect()} == {t}


def test_long_text_parts():
    flat = np.frombuffer(b"x" * 9_000_000, np.uint8)
    parts = suffix_dedup._long_text(flat, 100)
    assert sum(len(p) - 99 for _, p, _ in parts) == len(flat) - 99


# n-grams


@pytest.mark.parametrize("k, percent, frequent", [(4, 85, (512, 4096)), (5, 80, (512,)), (5, 80, (3, 6)), (5, 80, (2, 2)), (1, 95, (2, 3)), (2, 50, (4,))])
def test_ngram_links(spark, texts, monkeypatch, k, percent, frequent):
    monkeypatch.setattr(ngram_join, "_BLOCK", 5)
    rows = {r.doc_id: r for r in ngram_join.link_documents(frame(spark, texts), k, percent, frequent=frequent).collect()}
    sets, component = brute.ngram_components(texts, k, percent)
    assert {i: (rows[i].n_shingles, rows[i].component_id) for i in rows} == {i: (len(sets[i]), component[i]) for i in texts}


@pytest.mark.parametrize("frequent", [(512,), (4,), (3, 6), (2, 2), (2, 4, 8)])
@pytest.mark.parametrize("percent", [85, 80, 50])
def test_linked_sets_have_a_key_in_common(frequent, percent):
    rng = np.random.default_rng(percent + len(frequent))
    pools = [np.unique(rng.integers(0, 2**63, size, dtype=np.uint64)) for size in (6, 40, 150, 700)]
    sets = []
    for pool in pools:
        for share in rng.uniform(0.02, 0.3, 25):
            own = pool[rng.random(len(pool)) > share * rng.random()]
            sets.append(np.unique(np.concatenate((own, rng.integers(0, 2**63, int(share * len(pool) * rng.random()), dtype=np.uint64)))))
    sets = [s for s in sets if len(s)]
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    keys, linked = [], 0
    for s in sets:
        df = count[np.searchsorted(token, s)]
        keys.append(set(ngram_join.prefix_keys(len(s), s[df > 1], df[df > 1], percent, frequent).tolist()))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            c = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * c >= percent * (len(x) + len(y) - c):
                linked += 1
                assert keys[i] & keys[j]
    assert linked > 100


def test_number_of_combinations_is_bounded():
    """Keys of a document whose tokens are all frequent do not grow faster than its tokens."""
    rng = np.random.default_rng(8)
    for df in (600, 5000):
        for n in (500, 4000, 30_000):
            token = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            assert len(ngram_join.prefix_keys(len(token), token, np.full(len(token), df), 85)) < 4 * n


def test_ngram_edges(spark):
    assert ngram_join.link_documents(frame(spark, {1: "a"}).limit(0)).count() == 0
    d = frame(spark, {1: "a b c d e f"}).unionByName(frame(spark, {1: "a b c d e f"}))
    assert [tuple(r) for r in ngram_join.link_documents(d).collect()] == [(1, 2, 1)]
    null = spark.createDataFrame([(None, "a b"), (3, "a b"), (2, "A  b")], "doc_id long, text string")
    assert sorted((r[0] or 0, *r[1:]) for r in ngram_join.link_documents(null).collect()) == [(0, 1, None), (2, 1, 2), (3, 1, 2)]
    assert ngram_join.keep_one(null).count() == 2


def test_keep_one(spark, texts):
    d = frame(spark, texts)
    out = ngram_join.keep_one(d)
    component = brute.ngram_components(texts, 5, 80)[1]
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {i for i in texts if component[i] == i}


# exact copies


def test_exact(spark, texts):
    rows = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, texts)).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in rows.items()} == {i: (k, n, k == i) for i, (k, n) in brute.exact(texts).items()}
    d = frame(spark, texts)
    out = exact_dedup.drop_copies(d)
    assert out.columns == d.columns and {r.doc_id for r in out.collect()} == {k for k, _ in brute.exact(texts).values()}
    assert exact_dedup.exact_dedup(d.limit(0)).count() == 0


def test_exact_in_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, {1: "a b", 2: "ab", 3: "c"}), index=index, batch="one").collect()}
    assert (first[2].keep_id, first[2].group_size) == (1, 2)
    second = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, {4: "a   b", 5: "d", 6: None}), index=index, batch="two").collect()}
    assert (second[4].keep_id, second[4].group_size, second[4].kept) == (1, 3, False) and second[5].kept and second[6].kept
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(frame(spark, {7: "x"}), index=index, batch="two")
    again = spark.read.parquet(index.path)
    assert again.where("is_first").count() == 4


def test_index_opened_again_knows_its_digests(spark):
    texts = {i: prose(i, 5) for i in range(400)}
    first = exact_dedup.DigestIndex(spark, buckets=32)
    exact_dedup.exact_dedup(frame(spark, texts), index=first, batch="one")
    first.close()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        second = exact_dedup.DigestIndex(spark, first.path)
        assert second.buckets == 32
        rows = exact_dedup.exact_dedup(frame(spark, {1000 + i: t for i, t in texts.items()}), index=second, batch="two").collect()
        assert len(rows) == 400 and all(r.keep_id == r.doc_id - 1000 and not r.kept and r.group_size == 2 for r in rows)
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, first.path, buckets=8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_null_ids_across_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    batch = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r)[:4] for r in exact_dedup.exact_dedup(batch((None, "a")), index=index, batch="1").collect()] == [(None, None, 1, True)]
    assert [tuple(r)[:4] for r in exact_dedup.exact_dedup(batch((7, "a")), index=index, batch="2").collect()] == [(7, None, 2, False)]
    assert index.rows().where("is_first").count() == 1


def test_no_table_is_left_in_the_catalog(spark, texts):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.exact_dedup(frame(spark, texts)).count() == len(texts) and {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("stage", ["exact", "ngram", "suffix"])
def test_stages_with_columns_named_like_helpers(spark, texts, stage):
    names = ["own_key", "OWN_ID", "ranges", "score", "__id", "__sha", "__kept", "__ranges", "key", "component_id", "tokens", "text_sha256", "digest", "kept", "node", "a", "b", "n"]
    d = frame(spark, texts).select("doc_id", "text", "n_chars", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    run = {"exact": exact_dedup.drop_copies, "ngram": ngram_join.keep_one, "suffix": suffix_dedup.remove_repeats}[stage]
    rows = run(d).collect()
    assert run(d).dtypes == d.dtypes and {r.doc_id for r in rows} == {r.doc_id for r in run(frame(spark, texts)).collect()}
    assert all([r[c] for c in names] == list(range(len(names))) for r in rows)


def test_exact_nulls_and_repeats(spark):
    d = spark.createDataFrame([(None, "xx x"), (2, "xxx"), (2, "xxx")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect()) == [(-1, None, 3, True), (2, None, 3, False), (2, None, 3, False)]
    twice = d.where("doc_id = 2")
    assert [tuple(r)[:4] for r in exact_dedup.exact_dedup(twice).collect()] == [(2, 2, 2, True)] * 2
    assert exact_dedup.drop_copies(d).count() == 1 == exact_dedup.drop_copies(d.where("doc_id = 2")).count()


# vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_cover_tree_pairs():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 8))
    x = np.concatenate([c + 0.15 * rng.normal(size=(40, 8)) for c in centers] + [np.repeat(centers[:1], 50, 0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {tuple(p) for p in np.argwhere(np.triu(x @ x.T >= 0.93, 1)).tolist()}
    tree = cover_tree.CoverTree(x)
    got = [(int(a), int(b)) for u, v in cover_tree.close_pairs(tree, tree, 0.93) for a, b in zip(u, v)]
    assert len(got) == len(set(got)) and set(got) == want
    half = cover_tree.CoverTree(x[:200]), cover_tree.CoverTree(x[200:])
    got = {(int(a), int(b) + 200) for u, v in cover_tree.close_pairs(*half, 0.93) for a, b in zip(u, v)}
    assert got == {p for p in want if p[0] < 200 <= p[1]}


def scaled_copies(n):
    v = np.random.default_rng(4).normal(size=8)
    return [[float(k) for k in (s * v).astype(np.float32)] for s in np.linspace(0.5, 3, n)]


def test_cover_tree_pairs_in_a_large_leaf():
    x = np.array(scaled_copies(1100))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover_tree.CoverTree(x)
    assert tree.radius[0] <= 1e-6 and tree.children[0] is None
    got = np.concatenate([u * 1100 + v for u, v in cover_tree.close_pairs(tree, tree, 0.93)])
    assert len(got) == 1100 * 1099 // 2 == len(np.unique(got)) and (got // 1100 < got % 1100).all()


def test_scaled_vectors(spark):
    rows = [(i, v, 0) for i, v in enumerate(scaled_copies(1000))]
    got = embedding_dedup.link_vectors(vectors(spark, rows)).collect()
    assert len(got) == 1000 and {(r.n_links, r.component_id) for r in got} == {(999, 0)}


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(v) for v in (centers[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32)], i % 3) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(20)] + [(300, rows[0][1], 1), (301, [2 * v for v in rows[0][1]], 0)]
    odd = [(400, None, 0), (401, [0.0] * 8, 0), (402, [float("nan")] * 8, 0), (403, rows[0][1], None), (404, [1.0, None] + [0.0] * 6, 0), (405, [float("inf")] + [1.0] * 7, 0), (406, rows[0][1][:7], 0), (407, [], 0)]
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(vectors(spark, rows + odd)).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    component = brute.linked(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), component[i], component[i] == i)
    assert all(got[r[0]].n_links == 0 and got[r[0]].component_id == r[0] for r in odd)


def test_no_vectors(spark):
    assert embedding_dedup.link_vectors(vectors(spark, [])).count() == 0
    rows = embedding_dedup.link_vectors(vectors(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)])).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in rows) == [(-1, 0, -1), (1, 0, 1), (1, 0, 1)]
