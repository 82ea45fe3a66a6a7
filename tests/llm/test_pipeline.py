import os
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import packing, quality, queries
from tests.llm import brute
from tests.llm.test_dedup import corpus, prose
from tests.llm.test_single import check_places

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark, tmp_path):
    """The stages between the classifier and the packing, from a corpus with labels."""
    texts = corpus() | {500 + i: " ".join(w.upper() + "!!" for w in prose(900 + i, 50).split()) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i in texts], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    left = {i: t for i, t in texts.items() if i in good}
    assert len(left) < len(texts) - 30
    single = brute.exact(left)
    left = {i: t for i, t in left.items() if single[i][0] == i}
    component = brute.ngram_components(left, 5, 80)[1]
    left = {i: t for i, t in left.items() if component[i] == i}
    cut = {i: r[4].decode("utf-8", "ignore") for i, r in brute.repeats(left).items()}
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = step.columns
        step = f(spark, step, str(tmp_path))
        assert step.columns == before, name
        step.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id: r.text or "" for r in step.collect()} == cut
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    check_places(packed, 2048)
    assert {r.doc_id for r in packed} == set(cut)
    for i, t in cut.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        own = sorted((x for x in packed if x.doc_id == i), key=lambda x: x.start)
        assert [x.start for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))] and sum(x.length for x in own) == len(ids)
        assert all(zlib.crc32(np.asarray(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32 and x.doc_tokens == len(ids) for x in own)
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= -(-total // 2048) + 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_duckdb(spark, name):
    import duckdb

    from tests.test_oracles import TABLES, plain

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert plain(queries.queries()[name](spark, SF).toPandas()) == plain(c.sql(queries.oracle_sql()[name]).df())
