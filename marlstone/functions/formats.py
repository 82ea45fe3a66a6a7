"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_bytes(n: Column) -> Column:
    """Bytes whole, larger units of 1024 with one decimal."""
    n = n.cast("double")
    out = F.when(F.abs(n) < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for power, unit in enumerate(_UNITS[1:-1], 1):
        out = out.when(F.abs(n) < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024.0**power))
    return out.otherwise(F.format_string("%.1f PB", n / 1024.0**5))


def text_bytes(n: float) -> str:
    for unit in _UNITS:
        if abs(n) < 1024 or unit == "PB":
            return f"{int(n)} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    raise AssertionError


def text_usd(x: float) -> str:
    if x == 0:
        return "$0"
    return f"${x:.2e}" if x < 0.01 else f"${x:,.2f}" if x < 1000 else f"${x:,.0f}"


def table(rows: list[tuple], head: tuple[str, ...]) -> str:
    """Rows as lines of columns of equal width below their names and a rule."""
    shown = [tuple(str(x) for x in r) for r in [head, *rows]]
    width = [max(len(r[i]) for r in shown) for i in range(len(head))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in shown]
    return "\n".join([lines[0], "  ".join("-" * w for w in width), *lines[1:]])
