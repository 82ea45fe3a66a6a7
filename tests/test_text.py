import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import formats, text
from marlstone.operators import units


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "before, after",
    [("a\r\nb\rc", "a\nb\nc"), ("a \t\x0b\x0c b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("  x \n", "x"), ("", ""), (None, None)],
)
def test_clean_text(spark, before, after):
    assert one(spark, text.clean_text(F.col("t")), t=before) == after


@pytest.mark.parametrize(
    "html, seen",
    [
        ("a &amp; b &copy; c", "a & b © c"), ("<td>1</td><td>2</td>", "12"), ("<head><title>T</title><p>lost", ""), ("<p>a</p>b", "ab"),
        ("<b>a</b> <i>b</i>", "ab"), ("x<script>y</script>z", "xz"), ("tail &am", ""), ("a<br>b", "a\nb"), (None, None),
    ],
)
def test_html_to_text(spark, html, seen):
    assert one(spark, units.html_to_text(F.col("h")), h=html) == seen


def test_chunks(spark):
    docs = spark.createDataFrame([("d1", "Sentence one. " * 200), ("d2", ""), ("d3", None), ("d4", "short")], "doc_id string, text string")
    rows = units.chunk_text(docs, 500, 50).orderBy("doc_id", "ord").collect()
    assert [r.doc_id for r in rows] == ["d1"] * 7 + ["d4"]
    assert rows[0].unit_id == "0f4c8b9f1cefd545"
    assert all(len(r.text) <= 500 for r in rows) and len({r.unit_id for r in rows}) == len(rows)
    with pytest.raises(ValueError):
        units.chunk_text(docs, 100, 100)


def test_richness(spark):
    table = "<table>" + "<tr><td>1</td></tr>" * 5 + "</table>"
    assert one(spark, text.html_richness(F.col("h")), h=table) > 0.85
    assert one(spark, text.html_richness(F.col("h")), h="<p>plain</p>") == 0
    numbers = "\n".join(f"{i} {i * 2} {i * 3} {i * 5}" for i in range(20))
    assert one(spark, text.layout_richness(F.col("t")), t=numbers) == 1
    assert round(one(spark, text.layout_richness(F.col("t")), t="def foo(): return 1"), 3) == 0.092
    assert one(spark, text.text_richness(F.col("t")), t="") == 0


def test_human_bytes(spark):
    shown = [one(spark, formats.human_bytes(F.col("n")), n=n) for n in (0, 1023, 1536, 5 * 1024**4)]
    assert shown == ["0 B", "1023 B", "1.5 KB", "5.0 TB"] == [formats.text_bytes(n) for n in (0, 1023, 1536, 5 * 1024**4)]
    assert [formats.text_usd(x) for x in (0, 2e-6, 1.5, 2500)] == ["$0", "$2.00e-06", "$1.50", "$2,500"]


def test_tile_geometry(spark):
    pages = spark.createDataFrame([("d", 0, 800, 1300), ("e", 1, 10, 1)], "doc_id string, page int, width int, height int")
    rows = units.tile_geometry(pages).orderBy("doc_id", "row").collect()
    assert [(r.unit_id, r.y0, r.y1) for r in rows] == [("d_p0_t0", 0, 512), ("d_p0_t1", 448, 960), ("d_p0_t2", 896, 1300), ("e_p1_t0", 0, 1)]


def test_tabular_lines_beside_the_plain_rule(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice(" \t|1239,.-ab_é ٣") for _ in range(rng.randrange(14))) for _ in range(1500)]
    lines += ["".join(rng.choice(["  ", " ", "a", "12", "1,2.5,6", ".", "-3", "|"]) for _ in range(rng.randrange(10))) for _ in range(1500)]

    def plain(line):
        stripped = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        return (F.length(stripped) >= 4) & (
            (F.regexp_count(stripped, F.lit(r"\|")) >= 2)
            | (F.regexp_count(stripped, F.lit(r"(?U)(?<![\w.])-?\d[\d,]*\.?\d*")) >= 3)
            | (F.regexp_count(line, F.lit(r"(?U)\S {2,}\S")) >= 2)
        )

    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", text.tabular_line(F.col("line")).alias("got"), plain(F.col("line")).alias("plain")).collect()
    assert 100 < sum(r.plain for r in rows) < 2900 and [r.line for r in rows if r.got != r.plain] == []


def test_characters_are_counted_without_a_string_for_each(spark):
    docs = spark.createDataFrame([("a1 𝔸é٣\n|x|y|",), ("",), (None,), (" \n ",)], "text string")
    rows = docs.select(text.text_richness(F.col("text")))
    assert [round(r[0], 6) for r in rows.collect()] == [1, 0, 0, 0]
    assert r"\p{L}, 0)" not in rows._jdf.queryExecution().executedPlan().toString()
