"""Text as column expressions. Everything stays in generated JVM code; no Python runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Line ends become LF, runs of blanks one blank, three or more LF two; ends are stripped of Unicode white space."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t\f\x0B]{2,}|[\t\f\x0B]", " ")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces between white space that follows ``.``, ``!`` or ``?``; stripped, empty ones dropped."""
    parts = F.split(text, r"(?<=[.!?])(?U)\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def looks_like_html(text: Column) -> Column:
    """At least three tag openings among the first 4000 characters."""
    return F.coalesce(F.regexp_count(F.substring(text, 1, 4000), F.lit("<[a-zA-Z!/]")) >= 3, F.lit(False))


#: fixed values: how strongly a tag, or the word chart, speaks for visual content
MEDIA_WEIGHTS = {"table": 1.0, "svg": 1.0, "canvas": 1.0, "figure": 0.8, "img": 0.6, "picture": 0.6, "chart": 0.9, "math": 0.7}
#: fixed values: those that set the higher base score
STRONG_MEDIA = ("table", "svg", "canvas", "chart")


def html_richness(html: Column) -> Column:
    """0 without media; else a base, the heaviest tag's weight and a saturating count of table cells, at most 1."""
    html = F.coalesce(html, F.lit(""))

    def has(name: str) -> Column:
        return html.rlike("(?i)chart" if name == "chart" else rf"(?i)<\s*{name}\b")

    heaviest = F.greatest(*[F.when(has(t), F.lit(w)).otherwise(F.lit(0.0)) for t, w in MEDIA_WEIGHTS.items()])
    strong = has(STRONG_MEDIA[0])
    for name in STRONG_MEDIA[1:]:
        strong = strong | has(name)
    cells = F.regexp_count(html, F.lit(r"(?i)<\s*(tr|td|th|thead|tbody)\b"))
    score = F.when(strong, 0.55).otherwise(0.35) + 0.3 * heaviest + 0.25 * (1 - F.exp(-cells / F.lit(12.0)))
    return F.when(heaviest > 0, F.least(F.lit(1.0), score)).otherwise(F.lit(0.0))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row: Spark works out again whatever a filter or a lambda names twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tabular_line(line: Column) -> Column:
    """A line with two bars, three numbers or two column gaps, and four characters or more between its blank ends. Plain tests come first: few lines need the others."""
    return (
        line.rlike(r"\|[^|]*\|")
        | (line.rlike(r"^(?:\P{Nd}*+\p{Nd}){3}") & (F.regexp_count(line, F.lit(r"(?U)(?<![\w.])-?\d[\d,]*\.?\d*")) >= 3))
        | (line.contains("  ") & (F.regexp_count(line, F.lit(r"(?U)\S {2,}\S")) >= 2))
    ) & line.rlike(r"(?sU)\S.{2,}\S")


def lines(text: Column) -> Column:
    """The lines that are not blank."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r\n|[\n\r\x0B\x0C\x1c-\x1e\x85\u2028\u2029]")
    return F.filter(parts, lambda s: s.rlike(r"(?U)[^\s\x1c-\x1f\x85]"))


def layout_richness(text: Column) -> Column:
    """Share of tabular lines and of digits among letters and digits; 0 without lines."""
    # what is left of the text is counted: counting the matches would make a string of each character
    digits, letters = (F.length(F.regexp_replace(text, rf"\P{{{kind}}}+", "")) for kind in ("Nd", "L"))

    def score(own: Column) -> Column:
        share = F.size(F.filter(own["lines"], tabular_line)) / F.size(own["lines"])
        ratio = own["digits"] / F.greatest(own["digits"] + own["letters"], F.lit(1))
        total = 0.85 * F.least(F.lit(1.0), share * 2.5) + 0.4 * F.least(F.lit(1.0), ratio * 3.0)
        return F.when(F.size(own["lines"]) > 0, F.least(F.lit(1.0), total)).otherwise(F.lit(0.0))

    return bound(F.struct(lines(text).alias("lines"), digits.alias("digits"), letters.alias("letters")), score)


def text_richness(text: Column, html: Column | None = None) -> Column:
    """The best of the markup's score, the text's own as markup if it looks like it and none is given, and its layout's."""
    text = F.coalesce(text, F.lit(""))
    markup = F.when(looks_like_html(text), html_richness(text)).otherwise(F.lit(0.0))
    if html is not None:
        markup = F.when(F.coalesce(html, F.lit("")) != "", html_richness(html)).otherwise(markup)
    return F.greatest(markup, layout_richness(text))
