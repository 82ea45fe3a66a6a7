"""URL rules indexed by their rarest literal token, judged with DataFrame functions only.

A rule has a host, which fits itself and its subdomains, and a path prefix. Both become literal
tokens and one regular expression. Each rule is filed under the one of its tokens that fewest rules
share; a URL's tokens fetch the rules filed under them, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rules up to which the index is a literal map in the plan; beyond, it is a table that is joined
LITERAL_RULES = 2_000
_TOKEN = "[^0-9a-z]+"


class Rule(NamedTuple):
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        """Tokens that every URL the rule fits must have. The path's last one may be cut short by the prefix, so it counts only if a separator follows."""
        host = [t for t in re.split(_TOKEN, self.host.lower()) if t]
        path = re.split(_TOKEN, self.path.lower())[:-1]
        return host + [t for t in path if t]

    @property
    def pattern(self) -> str:
        return rf"^(?:[^/]*\.)?{_java_quote(self.host)}\n{_java_quote(self.path)}"


def _java_quote(s: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", s)


def file_rules(rules: Iterable[Rule]) -> dict[str, list[Rule]]:
    """Each rule under its rarest token; rules without a token under the empty one, which every URL has."""
    rules = list(dict.fromkeys(rules))
    shared = Counter(t for r in rules for t in set(r.tokens))
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        token = min(r.tokens, key=lambda t: (shared[t], t), default="")
        filed.setdefault(token, []).append(r)
    return filed


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*(/[^?#]*)?", 1)


def _judged(found: Column) -> Column:
    """The longest of the fitting rules, ties by text then action; null if none fits."""
    return F.array_max(found)


def judge_urls(
    pages: DataFrame, rules: Iterable[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The longest fitting rule decides; without one ``rule`` is null and the verdict is ``default``. A
    null URL, or one without ``://``, has an empty host and path and fits no rule with a host. Rows
    with equal ids are judged one by one; other columns of ``pages`` are ignored. Up to
    ``LITERAL_RULES`` rules the plan is one projection; beyond, tokens are joined with the rule table.
    """
    filed = file_rules(rules)
    count = sum(map(len, filed.values()))
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    place = F.concat("host", F.lit("\n"), "path")
    tokens = F.array_distinct(F.split(F.lower(F.concat(F.lit(" "), place)), _TOKEN))
    shape = "array<struct<length:int,rule:string,action:string,pattern:string>>"
    if count <= LITERAL_RULES:
        struct = lambda r: F.struct(
            F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern")
        )
        index = (
            F.create_map(*[x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*map(struct, rs)))])
            if filed
            else F.create_map().cast(f"map<string,{shape}>")
        )
        empty = F.array().cast(shape)
        rows = (
            base.withColumn("fetched", F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(index, t), empty))))
            .withColumn("place", place)
            .withColumn("best", _judged(F.filter("fetched", lambda r: F.rlike(F.col("place"), r["pattern"]))))
        )
    else:
        table = pages.sparkSession.createDataFrame(
            [(t, len(r.text), r.text, r.action, r.pattern) for t, rs in filed.items() for r in rs],
            "token string, length int, rule string, action string, pattern string",
        )
        keyed = base.withColumn("row", F.struct("page_id", "host", "path"))
        hits = (
            keyed.select("row", place.alias("place"), F.explode(tokens).alias("token"))
            .join(table, "token")
            .where(F.rlike(F.col("place"), F.col("pattern")))
            .groupBy("row")
            .agg(F.max(F.struct("length", "rule", "action", "pattern")).alias("best"))
        )
        rows = keyed.join(hits.withColumnRenamed("row", "hit"), F.col("row").eqNullSafe(F.col("hit")), "left")
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )
