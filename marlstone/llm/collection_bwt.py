"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

All strings are aligned at their ends. Each round puts one more symbol in front of every string that is
not used up, and so inserts one suffix per string: the transform (one byte per suffix) and the
longest common prefix with the suffix above (one byte, capped) are two files that a round reads
from start to end, block by block, and writes anew with the new rows merged in. Memory holds the
strings, one row number per string, and one block.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: rows of the two files that are held at once
BLOCK = 1 << 19
_INF = 255
_SYMBOLS = np.arange(256, dtype=np.uint8)


class _Column:
    """A column of bytes in two files: one is read from start to end while its next version goes to the other."""

    def __init__(self, folder: str, name: str):
        self.paths = [os.path.join(folder, f"{name}.{k}") for k in (0, 1)]
        for path in self.paths:
            open(path, "wb").close()
        self.size = 0

    @property
    def path(self) -> str:
        return self.paths[0]

    def save(self, data: np.ndarray) -> None:
        data.tofile(self.path)
        self.size = len(data)

    def read(self) -> np.ndarray:
        return np.fromfile(self.path, np.uint8, self.size)

    def replace(self, size: int) -> None:
        self.paths.reverse()
        self.size = size


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for each pair, lo < hi; taken from the last start down, so that reduceat does nothing between pairs."""
    order = np.argsort(-lo, kind="stable")
    at = np.empty(2 * len(lo), np.int64)
    at[::2], at[1::2] = lo[order], hi[order]
    out = np.empty(len(lo), np.uint8)
    out[order] = np.minimum.reduceat(np.append(values, np.uint8(_INF)), at)[::2]
    return out


def build(flat: np.ndarray, offsets: np.ndarray, cap: int, folder: str, block: int = BLOCK) -> tuple[_Column, _Column]:
    """Write the transform and the capped common prefixes of the strings flat[offsets[i]:offsets[i+1]] to ``folder``.

    Bytes must not be 0, which stands for a string's start. Row k < n is the empty suffix of string k;
    suffixes that are equal to their ends stand in the order of the strings.
    """
    n = len(offsets) - 1
    length = np.diff(offsets)
    bwt, lcp = _Column(folder, "bwt"), _Column(folder, "lcp")
    bwt.save(np.zeros(n, np.uint8))
    lcp.save(np.zeros(n, np.uint8))
    total = np.zeros(257, np.int64)  # suffixes by first symbol
    string = np.flatnonzero(length > 0)  # strings that still grow, in the order of their last rows
    row = string.astype(np.int64)
    rows = n
    back = 0
    while len(string):
        back += 1
        symbol = flat[offsets[string + 1] - back]
        total[: 256] += np.bincount(symbol, minlength=256)
        begin = n + np.concatenate(([0], np.cumsum(total[:255])))  # first row of each symbol
        # one pass: put the symbols in, rank them, and find common prefixes next to the new suffixes
        seen = np.zeros(256, np.int64)
        low = np.full(256, 0, np.uint8)  # least common prefix since the symbol's last row
        fresh = np.zeros(256, bool)  # whether that row belongs to this round
        new_row = np.empty(len(row), np.int64)
        fix_at, fix_to = [], []
        with open(bwt.path, "r+b") as f, open(lcp.path, "rb") as g:
            for lo in range(0, rows, block):
                f.seek(lo)
                b = np.fromfile(f, np.uint8, min(block, rows - lo))
                p = np.fromfile(g, np.uint8, len(b))
                a, z = np.searchsorted(row, (lo, lo + len(b)))
                own = row[a:z] - lo
                b[own] = symbol[a:z]
                f.seek(lo)
                b.tofile(f)
                active = np.zeros(len(b), bool)
                active[own] = True
                order = np.argsort(b, kind="stable")
                count = np.bincount(b, minlength=256)
                first = np.concatenate(([0], np.cumsum(count)[:-1]))
                shift = begin + seen - first  # of a row's place in the sorted block, to its row in the next version
                s = np.repeat(_SYMBOLS, count)
                o_active = active[order]
                new_row[a:z] = _where(order, o_active, own) + shift[symbol[a:z]]
                at = np.flatnonzero(o_active[1:] | o_active[:-1])
                at = at[(s[at + 1] == s[at]) & (s[at] > 0)]
                if len(at):
                    fix_at.append(at + 1 + shift[s[at + 1]])
                    fix_to.append(_range_minima(p, order[at] + 1, order[at + 1] + 1))
                # across the block's edge: the first row of each symbol here, after its last row before
                present = np.flatnonzero(count)
                present = present[present > 0]
                head = order[first[present]]
                cross = seen[present] > 0
                join = cross & (fresh[present] | active[head])
                if join.any():
                    least = np.minimum.accumulate(p)[head[join]]
                    fix_at.append(begin[present[join]] + seen[present[join]])
                    fix_to.append(np.minimum(least, low[present[join]]))
                alone = ~cross & active[head]
                if alone.any():  # the first suffix with its symbol shares nothing with the row above; the sign is _INF
                    fix_at.append(begin[present[alone]])
                    fix_to.append(np.full(int(alone.sum()), _INF, np.uint8))
                seen = seen + count
                if lo + len(b) == rows:
                    break
                absent = np.flatnonzero(count == 0)
                low[absent] = np.minimum(low[absent], p.min())
                tail = order[first[present] + count[present] - 1]
                after = np.append(np.minimum.accumulate(p[::-1])[::-1], np.uint8(_INF))
                low[present] = after[tail + 1]
                fresh[present] = active[tail]
        fix = np.concatenate(fix_at)
        value = np.concatenate(fix_to).astype(np.int64)
        value = np.where(value == _INF, 0, np.minimum(value + 1, cap))
        # rows of the next version in order; merging them in needs no more than one pass over the old files
        turn = np.argsort(symbol, kind="stable")
        string, new_row, grown = string[turn], new_row[turn], back
        by = np.argsort(fix, kind="stable")
        fix, value = fix[by], value[by].astype(np.uint8)
        _merge(bwt, lcp, rows, new_row, fix, value, block)
        rows += len(new_row)
        keep = length[string] > grown
        string, row = string[keep], new_row[keep]
    return bwt, lcp


def _where(order: np.ndarray, chosen: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Place in ``order`` of each of the rows ``own`` (ascending), which ``chosen`` marks there."""
    at = np.flatnonzero(chosen)
    out = np.empty(len(own), np.int64)
    out[np.argsort(np.argsort(order[at], kind="stable"), kind="stable")] = 0
    out[np.searchsorted(own, order[at])] = at
    return out


def _merge(bwt: _Column, lcp: _Column, rows: int, new_row: np.ndarray, fix: np.ndarray, value: np.ndarray, block: int) -> None:
    before = new_row - np.arange(len(new_row))  # old rows above each new one
    with open(bwt.path, "rb") as f, open(lcp.path, "rb") as g, open(bwt.paths[1], "r+b") as f2, open(lcp.paths[1], "r+b") as g2:
        done = 0
        for lo in range(0, rows, block):
            b = np.fromfile(f, np.uint8, min(block, rows - lo))
            p = np.fromfile(g, np.uint8, len(b))
            last = lo + len(b) == rows
            a, z = np.searchsorted(before, (lo, rows + 1 if last else lo + len(b)))
            size = len(b) + z - a
            old = np.ones(size, bool)
            old[new_row[a:z] - done] = False
            b2, p2 = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
            b2[old], p2[old] = b, p
            i, j = np.searchsorted(fix, (done, done + size))
            p2[fix[i:j] - done] = value[i:j]
            b2.tofile(f2)
            p2.tofile(g2)
            done += size
    bwt.replace(done)
    lcp.replace(done)


def suffixes(flat: np.ndarray, offsets: np.ndarray, cap: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start in it, capped common prefix with the row above) of every suffix, the empty ones included, in sorted order.

    The files live in a scratch folder of the task, which it deletes; a task that is run again starts anew.
    """
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        b, p = (c.read() for c in build(flat, offsets, cap, folder, block))
    n = len(offsets) - 1
    order = np.argsort(b, kind="stable")
    ends = int((b == 0).sum())
    lf = np.empty(len(b), np.int64)
    lf[order[ends:]] = n + np.arange(len(b) - ends)
    string, start = np.empty(len(b), np.int32), np.empty(len(b), np.int32)
    row, who, at = np.arange(n), np.arange(n), np.diff(offsets)
    while len(row):
        string[row], start[row] = who, at
        go = at > 0
        row, who, at = lf[row[go]], who[go], at[go] - 1
    return string, start, p
