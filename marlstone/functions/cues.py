"""Routing cues of a question, and the two routers' formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: words that say the answer is in text
TEXT_CUES = (
    "code|function|class|def|import|stack ?trace|exception|error|log|logs|json|yaml|regex|api|endpoint|sql|query|"
    "variable|syntax|command|cli|config|null|undefined|traceback"
)
#: fixed values: words that say the answer is in the visual layout
VISION_CUES = (
    "chart|charts|graph|graphs|figure|figures|diagram|diagrams|table|tables|plot|plots|layout|screenshot|image|images|"
    "color|colou?red|axis|legend|infographic|map|maps|drawing|photo|picture|visual|appears|looks|shown"
)
#: fixed value: signs that the question itself holds code
CODE_SIGNS = r"[{}();=]|->|=>|::|\b0x[0-9a-fA-F]+\b"

FEATURES = ("bias", "text", "vision", "codeish", "numeric", "length")


def text_hits(query: Column) -> Column:
    return F.regexp_count(query, F.lit(rf"(?iU)\b({TEXT_CUES})\b"))


def vision_hits(query: Column) -> Column:
    return F.regexp_count(query, F.lit(rf"(?iU)\b({VISION_CUES})\b"))


def codeish(query: Column) -> Column:
    return query.rlike(CODE_SIGNS).cast("double")


def features(query: Column) -> list[Column]:
    """The six numbers that the learned router reads, named as in FEATURES."""
    words = F.filter(F.split(query, r"(?U)\s+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1))
    numeric = F.size(F.filter(words, lambda w: w.rlike(r"\p{Nd}")))
    values = (
        F.lit(1.0),
        F.least(text_hits(query), F.lit(4)) / 4.0,
        F.least(vision_hits(query), F.lit(4)) / 4.0,
        codeish(query),
        numeric / count,
        F.least(count, F.lit(20)) / 20.0,
    )
    return [v.cast("double").alias(n) for v, n in zip(values, FEATURES)]


def heuristic_weights(query: Column, base_text: float = 1.0, base_vision: float = 1.0) -> tuple[Column, Column, Column]:
    """(text weight, vision weight, reason). One kind of cue lifts its own side, by three cues at most, and lowers the other; both lift both."""
    t, v = text_hits(query) + codeish(query).cast("int"), vision_hits(query)
    only_text, only_vision, both = (t > 0) & (v == 0), (v > 0) & (t == 0), (t > 0) & (v > 0)
    text = (
        F.when(only_text, base_text * (1 + 0.5 * F.least(t, F.lit(3))))
        .when(only_vision, F.lit(base_text * 0.5))
        .when(both, base_text * (1 + 0.25 * t))
        .otherwise(F.lit(base_text))
    )
    vision = (
        F.when(only_text, F.lit(base_vision * 0.3))
        .when(only_vision, base_vision * (1 + 0.5 * F.least(v, F.lit(3))))
        .when(both, base_vision * (1 + 0.25 * v))
        .otherwise(F.lit(base_vision))
    )
    reason = (
        F.when(only_text, F.concat(F.lit("text-leaning: "), t.cast("string"), F.lit(" text cue(s)")))
        .when(only_vision, F.concat(F.lit("vision-leaning: "), v.cast("string"), F.lit(" vision cue(s)")))
        .when(both, F.concat(F.lit("both: "), t.cast("string"), F.lit(" text / "), v.cast("string"), F.lit(" vision cue(s)")))
        .otherwise(F.lit("balanced: no strong modality cue"))
    )
    return text.cast("double"), vision.cast("double"), reason


def learned_weights(query: Column, weights: list[float], lean: float = 0.7, base_text: float = 1.0, base_vision: float = 1.0) -> tuple[Column, Column, Column]:
    """(probability that the answer is visual, text weight, vision weight)."""
    z = sum((f * F.lit(float(w)) for f, w in zip(features(query), weights)), F.lit(0.0))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    swing = lean * (2 * p - 1)
    return p, base_text * (1 - swing), base_vision * (1 + swing)
