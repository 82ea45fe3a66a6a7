"""Replay questions under each mode and measure the rankings."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import metrics
from .search import search

MODES = ("text", "vision", "hybrid")


def timed(evaluate_mode, modes: tuple[str, ...], questions: int) -> list[dict]:
    """Rows of the modes, each with ``ms_per_query``: the time of the mode's one job over the number of its questions."""
    out = []
    for mode in modes:
        began = time.perf_counter()
        rows = [r.asDict() for r in evaluate_mode((mode,)).orderBy("k").collect()]
        spent = 1000 * (time.perf_counter() - began) / max(questions, 1)
        out += [r | {"ms_per_query": 0.0 if r["note"] else spent} for r in rows]
    return out


def evaluate(
    queries: DataFrame, qrels: DataFrame, text_units: DataFrame, vision_units: DataFrame,
    ks: tuple[int, ...] = (1, 3, 5, 10), modes: tuple[str, ...] = MODES, config: EngineConfig = EngineConfig(),
) -> DataFrame:
    """(mode, k, hit, recall, precision, mrr, ndcg, note): one plan per mode over all questions; a mode whose store is empty has zeros and a note."""
    unknown = set(modes) - set(MODES)
    if unknown or not ks or min(ks) < 1:
        raise ValueError(f"unknown modes {sorted(unknown)}" if unknown else "ks must be positive")
    spark = queries.sparkSession
    have = {"text": not text_units.isEmpty(), "vision": not vision_units.isEmpty()}
    have["hybrid"] = have["text"] or have["vision"]
    parts = []
    for mode in modes:
        if have[mode]:
            hits = search(queries, text_units, vision_units, config, top_k=max(ks), modality=mode)
            parts.append(hits.select(F.lit(mode).alias("mode"), "query_id", F.col("pos").alias("rank"), "doc_id"))
    frame = spark.createDataFrame([(m, int(k), "" if have[m] else "skipped: nothing indexed") for m in modes for k in sorted(set(ks))], "mode string, k int, note string")
    names = ("hit", "recall", "precision", "mrr", "ndcg")
    if not parts:
        return frame.select("mode", "k", *[F.lit(0.0).alias(n) for n in names], "note")
    found = metrics.report(reduce(DataFrame.unionByName, parts), qrels, queries, list(ks))
    return frame.join(found, ["mode", "k"], "left").select("mode", "k", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names], "note")
