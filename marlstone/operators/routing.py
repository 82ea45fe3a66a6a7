"""Per-query weights of the two modalities, by rules or by a fitted logistic curve."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cues import FEATURES, features, heuristic_weights, learned_weights

#: fixed values: labelled questions, 1 where the answer is visual
SEED = (
    ("how do I fix this python stack trace exception", 0.0),
    ("what does this function return when the input is null", 0.0),
    ("parse the json config and validate the schema", 0.0),
    ("grep the logs for the error message", 0.0),
    ("def foo(): return {a: 1}", 0.0),
    ("which sql query joins these two tables by id", 0.05),
    ("explain this regex and the api endpoint it calls", 0.0),
    ("undefined variable in the cli command output", 0.0),
    ("summarise the terms of service paragraph", 0.15),
    ("what is the capital city mentioned in the article", 0.2),
    ("which chart shows the revenue trend over time", 1.0),
    ("read the value in the third row of the table", 1.0),
    ("what colour is the largest slice of the pie chart", 1.0),
    ("describe the layout of the dashboard screenshot", 1.0),
    ("which bar in the graph is the tallest", 1.0),
    ("what does the legend on the axis say", 0.95),
    ("find the figure that shows the architecture diagram", 0.95),
    ("what is drawn in the infographic on page two", 1.0),
    ("compare the two plots side by side", 0.9),
    ("which region on the map is highlighted", 0.9),
    ("show the json config and the diagram of the api", 0.5),
    ("tell me about the history of rome", 0.5),
    ("what were the quarterly revenue numbers", 0.55),
    ("does the table in the code comment match the figure", 0.6),
)
#: what ``fit_router`` finds on SEED, to six decimals
SEED_WEIGHTS = (-0.498160, -4.805311, 6.413470, -1.679581, -0.335916, 1.082168)
#: examples a fit takes at most, as it runs on the driver
MOST_EXAMPLES = 100_000


def fit_router(examples: DataFrame, steps: int = 4_000, rate: float = 0.5, l2: float = 1e-3) -> list[float]:
    """Logistic regression by full-batch gradient descent from zero on (query, label); soft labels, free intercept. An example without a query or a label is an error."""
    label = F.col("label").cast("double")
    whole = F.col("query").isNotNull() & label.isNotNull()
    checked = F.when(whole, F.greatest(F.lit(0.0), F.least(F.lit(1.0), label))).otherwise(F.raise_error(F.lit("each example needs a query and a label")).cast("double"))
    rows = examples.select(*features(F.col("query")), checked.alias("label")).limit(MOST_EXAMPLES + 1).collect()
    if not rows or len(rows) > MOST_EXAMPLES:
        raise ValueError(f"a router needs 1 to {MOST_EXAMPLES} examples")
    data = np.array(rows, float)
    x, y = data[:, :-1], data[:, -1]
    w = np.zeros(x.shape[1])
    decay = np.r_[0.0, np.full(len(w) - 1, l2)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= rate * (x.T @ (p - y) / len(y) + decay * w)
    return w.tolist()


def save_router(weights: list[float], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"features": list(FEATURES), "weights": list(weights)}, f)


def load_router(path: str) -> list[float]:
    with open(path, encoding="utf-8") as f:
        weights = json.load(f)["weights"]
    if len(weights) != len(FEATURES):
        raise ValueError(f"a router has {len(FEATURES)} weights, not {len(weights)}")
    return weights


def route(queries: DataFrame, model: str = "heuristic", weights: list[float] | None = None, base_text: float = 1.0, base_vision: float = 1.0) -> DataFrame:
    """``queries`` (query_id, query, ...) with text_weight, vision_weight, reason and, for the learned router, vision_probability."""
    q = F.col("query")
    if model == "heuristic":
        t, v, why = heuristic_weights(q, base_text, base_vision)
        return queries.withColumns({"text_weight": t, "vision_weight": v, "reason": why})
    if model == "learned":
        p, t, v = learned_weights(q, list(weights or SEED_WEIGHTS), base_text=base_text, base_vision=base_vision)
        why = F.when(p >= 0.6, "vision-leaning").when(p <= 0.4, "text-leaning").otherwise("mixed")
        return queries.withColumns({"vision_probability": p, "text_weight": t, "vision_weight": v, "reason": why})
    raise ValueError(f"unknown router {model!r}")
