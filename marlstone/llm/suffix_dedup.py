"""Removal of repeated byte strings with suffix arrays of many documents, built column by column.

A string of ``span`` bytes that stands in two places brings the same anchor with it: the least of its
K-byte substrings by hash. So texts are cut into runs of neighbouring windows with one anchor, runs
with equal content are merged early, and all different runs of an anchor meet in one collection,
whose Burrows-Wheeler transform and common prefixes (``collection_bwt``) show every window that they share.
Where the runs of an anchor are too many for a collection, their windows meet by hash instead. What is shuffled for a run is a few numbers; texts move only where different runs share an anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesops import U, mix, powers, prefix_hash, span_hash, text_slices
from .collection_bwt import suffixes
from .common import free_name, free_worker, partitions, stage, with_id

SPAN = 100
ANCHOR = 48
#: bytes of strings in one collection, less one anchor's; an anchor with more of them is hot, and its windows meet by hash
COLLECTION_BYTES = 3_000_000
_POSITION_BITS = 23
_SLICE = 1_000_000
RUNS = "anchor long, content long, doc_id long, start long, n long"


def anchored_runs(flat: np.ndarray, offsets: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``span`` bytes with one anchor: (start, windows, anchor hash, content hash), in order of start.

    Equal windows have equal anchors at equal places in them: the least hash, of equals the first.
    Windows do not cross texts.
    """
    none = np.zeros(0, np.int64)
    if len(flat) < span:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hash(flat)
    _, down = powers(len(flat) + 1)
    h = mix((prefix[k:] - prefix[:-k]) * down[: len(flat) - k + 1])
    low = U((1 << _POSITION_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, have, least = span - k + 1, 1, key
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        rest = width - have
        least = np.minimum(least[:-rest], least[rest:])
    long = np.diff(offsets) >= span
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, offsets[:-1][long], 1)
    np.add.at(change, offsets[1:][long] - span + 1, -1)
    valid = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if not len(valid):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    own = least[valid]
    new = np.empty(len(valid), bool)
    new[0] = True
    new[1:] = (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)
    at = np.flatnonzero(new)
    start, windows = valid[at], np.diff(np.append(at, len(valid)))
    anchor = h[(own[at] & low).astype(np.int64)]
    return start, windows, anchor, span_hash(prefix, start, start + windows + span - 1)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of the byte ranges of each document, in order."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    number = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1])))
    lift = number * (int(end.max()) + 1)  # later documents lie wholly above earlier ones
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - lift[last]


def _run_batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).view(np.int64) if np.asarray(c).dtype == U else np.asarray(c, np.int64)) for c in columns], RUNS.replace(" long", "").split(", "))


def _ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Ranges to remove travel in the same table as runs: n is minus their length, the anchor spreads them."""
    doc, start, end = merged(doc, start, end)
    return _run_batch(mix(doc.astype(np.uint64) + start.astype(np.uint64)), np.zeros(len(doc)), doc, start, start - end)


def _first_in_slice(
    anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, place: np.ndarray, windows: np.ndarray, span: int
) -> Iterator[pa.RecordBatch]:
    """The first run of each content, and the ranges of runs of that content that stand elsewhere; a repeated row of the first run is neither."""
    order = np.lexsort((place, doc, content))
    anchor, content, doc, place, windows = (x[order] for x in (anchor, content, doc, place, windows))
    new = np.ones(len(doc), bool)
    new[1:] = content[1:] != content[:-1]
    yield _run_batch(anchor[new], content[new], doc[new], place[new], windows[new])
    opener = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    again = (doc != doc[opener]) | (place != place[opener])
    if again.any():
        yield _ranges(doc[again], place[again], place[again] + windows[again] + span - 1)


def _runs(span: int, k: int):
    """Stage A, per slice of texts: runs that may be first of their content, and ranges that a run of the slice already shows to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, flat, offsets in text_slices(batch.column(1), _SLICE):
                if len(flat) >= 1 << _POSITION_BITS:
                    pieces = _long_text(flat, span)
                else:
                    pieces = [(0, flat, offsets)]
                parts = []
                for base, part, part_offsets in pieces:
                    start, windows, anchor, content = anchored_runs(part, part_offsets, span, k)
                    at = np.searchsorted(part_offsets, start, "right") - 1
                    parts.append((ids[first:last][at], start - part_offsets[at] + base, windows, anchor, content))
                doc, place, windows, anchor, content = (np.concatenate(x) for x in zip(*parts))
                yield from _first_in_slice(anchor, content, doc, place, windows, span)

    return run


def _long_text(flat: np.ndarray, span: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """One very long text in parts that overlap, so that each window lies in exactly one."""
    step = 4_000_000
    out = []
    for at in range(0, max(1, len(flat) - span + 1), step):
        part = flat[at : at + step + span - 1]
        out.append((at, part, np.array([0, len(part)])))
    return out


def _first_of_content(span: int):
    """Stage B, over runs sorted by (anchor, content, doc_id, start): ranges that repeat an earlier run, and the runs whose anchor has several contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        held = None  # the first run of the last anchor, not yet known to have company
        last = None
        several = False
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, content, doc, start, n = (c.to_numpy() for c in batch.columns)
            ready = n < 0
            if ready.any():
                yield _run_batch(*(x[ready] for x in (anchor, content, doc, start, n)))
            anchor, content, doc, start, n = (x[~ready] for x in (anchor, content, doc, start, n))
            if not len(anchor):
                continue
            new_anchor, new_content = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
            new_anchor[1:] = anchor[1:] != anchor[:-1]
            new_content[1:] = new_anchor[1:] | (content[1:] != content[:-1])
            same = np.zeros(len(anchor), bool)  # a repeated row of the run that is first
            if last is not None:
                new_anchor[0] = anchor[0] != last[0]
                new_content[0] = new_anchor[0] or content[0] != last[1]
            opener = np.maximum.accumulate(np.where(new_content, np.arange(len(anchor)), -1))
            outside = opener < 0
            opener = np.maximum(opener, 0)
            own_doc, own_start = doc[opener], start[opener]
            if last is not None:
                own_doc, own_start = np.where(outside, last[2], own_doc), np.where(outside, last[3], own_start)
            same = ~new_content & (doc == own_doc) & (start == own_start)
            again = ~new_content & ~same
            if again.any():
                yield _ranges(doc[again], start[again], start[again] + n[again] + span - 1)
            # first runs of their content: those of an anchor with more than one such run go on
            i = np.flatnonzero(new_content)
            if len(i):
                carried = held is not None and not new_anchor[i[0]]
                if held is not None and carried and not several:
                    yield _run_batch(*([x] for x in held))
                opens = new_anchor[i]
                group = np.cumsum(opens)
                count = np.bincount(group, minlength=group[-1] + 1)
                go = count[group] > 1
                if carried:
                    go |= group == 0
                tail_open = count[group[-1]] == 1 and not (carried and group[-1] == 0)
                if go.any():
                    yield _run_batch(*(x[i][go] for x in (anchor, content, doc, start, n)))
                several = not tail_open
                end = i[np.flatnonzero(group == group[-1])[0]]
                held = tuple(x[end] for x in (anchor, content, doc, start, n))
            row = opener[-1]
            last = (anchor[-1], content[-1], own_doc[-1], own_start[-1]) if outside[-1] else (anchor[row], content[row], doc[row], start[row])

    return run


def _hot_marked(stage_b, span: int, limit: int):
    """Stage B, and after the runs of each anchor that hold more than ``limit`` bytes a row that says so: n is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = None, 0  # the last anchor and the bytes of its runs
        for batch in stage_b(batches):
            yield batch
            anchor, n = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            if not len(anchor) or n[0] < 0:  # a batch has runs, in order of anchor, or ranges
                continue
            first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
            keys, sizes = anchor[first], np.add.reduceat(n + span - 1, first)
            if own is not None and own == keys[0]:
                sizes[0] += size
            elif own is not None:
                keys, sizes = np.append(own, keys), np.append(size, sizes)
            yield from _hot_rows(keys[:-1][sizes[:-1] > limit])
            own, size = keys[-1], sizes[-1]
        if size > limit:
            yield from _hot_rows(np.array([own]))

    return run


def _hot_rows(anchor: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(anchor):
        none = np.zeros(len(anchor), np.int64)
        yield _run_batch(anchor, none, none, none, none)


def _hot_windows(pieces: list[tuple[int, int, bytes]], span: int) -> Iterator[pa.RecordBatch]:
    """The windows of runs (doc_id, start, bytes) of hot anchors as runs of their own, whose anchor is the hash of the window."""
    doc, base = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
    count = np.array([len(p[2]) - span + 1 for p in pieces], np.int64)
    begin = np.cumsum(count + span - 1) - (count + span - 1)
    flat = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    piece = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[piece] + within
    key = span_hash(prefix_hash(flat), at, at + span)
    yield from _first_in_slice(key, key, doc[piece], base[piece] + within, np.ones(len(piece), np.int64), span)


def _strings(span: int):
    """Stage C: the bytes of each run that goes on; of a hot anchor, null and n of its windows or ranges, which travel as in ``_ranges``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            out: list[tuple] = []
            hot: list[tuple] = []
            held = hot_held = 0
            for doc, runs, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                for r in runs.as_py():
                    piece = data[r["start"] : r["start"] + r["n"] + span - 1]
                    if len(piece) == r["n"] + span - 1:
                        if r["hot"]:
                            hot.append((doc, r["start"], piece))
                            hot_held += len(piece)
                        else:
                            out.append((r["anchor"], doc, r["start"], piece, 0))
                            held += len(piece)
                if held > 2_000_000:
                    yield _string_batch(out)
                    out, held = [], 0
                if hot_held > _SLICE:
                    yield from map(_window_batch, _hot_windows(hot, span))
                    hot, hot_held = [], 0
            if out:
                yield _string_batch(out)
            if hot:
                yield from map(_window_batch, _hot_windows(hot, span))

    return run


STRINGS = "anchor long, doc_id long, start long, bytes binary, n long"


def _string_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], STRINGS.replace(" long", "").replace(" binary", "").split(", "))


def _window_batch(runs: pa.RecordBatch) -> pa.RecordBatch:
    anchor, _, doc, start, n = runs.columns
    return pa.RecordBatch.from_arrays(
        [anchor, doc, start, pa.nulls(len(n), pa.binary()), n], STRINGS.replace(" long", "").replace(" binary", "").split(", ")
    )


def _later_windows(windows: pa.RecordBatch, first: tuple | None, span: int) -> tuple[pa.RecordBatch, tuple]:
    """Ranges of those windows, in order of (hash, doc_id, start), that are not first of their hash, and the first of the last hash; ``first`` is that of the rows before."""
    key, doc, start = (windows.column(i).to_numpy() for i in range(3))
    if first is not None:
        key, doc, start = (np.append(x, y) for x, y in zip(first, (key, doc, start)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    opener = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    again = (doc != doc[opener]) | (start != start[opener])
    return _ranges(doc[again], start[again], start[again] + span), tuple(x[opener[-1]] for x in (key, doc, start))


def repeated_windows(doc: np.ndarray, start: np.ndarray, flat: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, byte place) of every window of the strings that also starts earlier in (document, place) order.

    ``doc`` and ``start`` say where each string stands. Windows with a common prefix of ``span`` bytes are
    neighbours in the sorted suffixes of the collection.
    """
    if flat.min(initial=1) == 0:  # 0 is the transform's own sign: shift the bytes 0 and 1 apart from it
        flat, offsets, scale = _escaped(flat, offsets)
        if scale is None:
            return repeated_plain(doc, start, flat, offsets, span)
    string, at, prefix = suffixes(flat, offsets, span)
    linked = prefix >= span
    member = linked.copy()
    member[:-1] |= linked[1:]
    rows = np.flatnonzero(member)
    group = np.cumsum(~linked)[rows]
    d, s = doc[string[rows]], start[string[rows]] + at[rows]
    order = np.lexsort((s, d, group))
    group, d, s = group[order], d[order], s[order]
    opens = np.ones(len(group), bool)
    opens[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(opens, np.arange(len(group)), 0))
    later = (d != d[first]) | (s != s[first])
    return d[later], s[later]


def _escaped(flat: np.ndarray, offsets: np.ndarray):
    """Strings with a byte 0: map the bytes that occur to 1, 2, ...; impossible only if all 256 occur."""
    used = np.unique(flat)
    if len(used) == 256:
        return flat, offsets, None
    to = np.zeros(256, np.uint8)
    to[used] = np.arange(1, len(used) + 1)
    return to[flat], offsets, True


def repeated_plain(doc, start, flat, offsets, span):
    """For collections with all 256 byte values, which UTF-8 never has: the same windows by sorting them."""
    windows = [(flat[o : o + span].tobytes(), d, s + o - a) for d, s, a, e in zip(doc, start, offsets, offsets[1:]) for o in range(a, e - span + 1)]
    windows.sort()
    first, out = None, []
    for w in windows:
        if first is None or w[0] != first[0]:
            first = w
        elif w[1:] != first[1:]:
            out.append(w[1:])
    return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)


def _collections(span: int):
    """Stage D, over strings sorted by (anchor, doc_id, start): whole anchors are gathered to collections of bounded size and searched.

    Windows of hot anchors are read past, with the first of the last hash in memory.
    """

    def search(parts: list[tuple]) -> pa.RecordBatch:
        doc, start, data = (np.concatenate(x) for x in list(zip(*parts))[:3])
        length = np.concatenate([p[3] for p in parts])
        d, s = repeated_windows(doc, start, data, np.concatenate(([0], np.cumsum(length))), span)
        return _ranges(d, s, s + span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        parts: list[tuple] = []
        size, last, window = 0, None, None
        for batch in batches:
            n = batch.column(4).to_numpy()
            if n.any():
                if (n < 0).any():
                    rows = batch.filter(pa.array(n < 0))
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.zeros(len(rows), np.int64)), rows.column(1), rows.column(2), rows.column(4)], RUNS.replace(" long", "").split(", "))
                if (n > 0).any():
                    later, window = _later_windows(batch.filter(pa.array(n > 0)), window, span)
                    yield later
                batch = batch.filter(pa.array(n == 0))
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            doc, start = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            _, _, flat, offsets = next(text_slices(batch.column(3), 1 << 62))
            cut = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]))
            at = 0
            for edge in cut[1:]:
                # [at, edge) is cut where an anchor ends and the collection is large enough
                begins = at if last is None or anchor[at] != last else None
                if begins is not None and size >= COLLECTION_BYTES:
                    yield search(parts)
                    parts, size = [], 0
                parts.append((doc[at:edge], start[at:edge], flat[offsets[at] : offsets[edge]].copy(), np.diff(offsets[at : edge + 1])))
                size += int(offsets[edge] - offsets[at])
                last, at = anchor[edge - 1], edge
        if parts:
            yield search(parts)

    return run


def repeated_ranges(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """Byte ranges (doc_id, start, end) of ``docs`` (doc_id, text) that are covered by strings of ``span`` bytes which also start earlier.

    Earlier is a smaller id, or the same document further left; judged on the texts as they are.
    Ranges of a document may touch or overlap. Rows with a null id are left out; rows that repeat an
    id are taken for one document.
    """
    spark = docs.sparkSession
    lean = docs.where("doc_id is not null").select("doc_id", "text")
    parts = partitions(spark, 8)
    runs = lean.mapInArrow(_runs(span, min(anchor, span)), RUNS).repartition(parts, "anchor")
    known = stage(
        runs.sortWithinPartitions("anchor", "content", "doc_id", "start").mapInArrow(_hot_marked(_first_of_content(span), span, COLLECTION_BYTES), RUNS), "runs"
    )
    # one row for COLLECTION_BYTES of strings at most
    hot = known.where("n = 0").select("anchor", F.lit(True).alias("hot"))
    wanted = (
        known.where("n > 0")
        .join(F.broadcast(hot), "anchor", "left")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("anchor", "start", "n", "hot")).alias("runs"))
    )
    strings = (
        wanted.join(lean, "doc_id")
        .select("doc_id", "runs", "text")
        .mapInArrow(_strings(span), STRINGS)
        .repartition(parts, "anchor")
        .sortWithinPartitions("anchor", "doc_id", "start")
    )
    found = stage(strings.mapInArrow(_collections(span), RUNS), "ranges")
    ranges = known.where("n < 0").unionByName(found).select("doc_id", "start", (F.col("start") - F.col("n")).alias("end"))
    return ranges


def _cut(text_at: int, columns: list[int], decode: bool):
    """Cut the gathered ranges out of each text: the columns asked for, then what is left and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            size, removed, spans, kept, rest = [], [], [], [], []
            for text, ranges in zip(batch.column(text_at), batch.column(batch.num_columns - 1)):
                text = text.as_py()
                data = (text or "").encode()
                whole = ranges.as_py() or []
                n = cut = 0
                if whole:
                    start = np.array([r["start"] for r in whole], np.int64)
                    end = np.minimum(np.array([r["end"] for r in whole], np.int64), len(data))
                    _, start, end = merged(np.zeros(len(start), np.int64), np.minimum(start, end), end)
                    n, cut = len(start), int((end - start).sum())
                    edges = [0, *np.stack((start, end), 1).reshape(-1).tolist(), len(data)]
                    left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                else:
                    left = data
                size.append(len(data))
                removed.append(cut)
                spans.append(n if cut else 0)
                if decode:
                    rest.append(text if not cut else left.decode("utf-8", "ignore"))
                else:
                    kept.append(hashlib.sha256(left).hexdigest())
            own = [batch.column(i) for i in columns]
            extra = [pa.array(rest, pa.string())] if decode else [pa.array(x, pa.int64()) for x in (size, removed, spans)] + [pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(own + extra, [f"c{i}" for i in range(len(own) + len(extra))])

    return run


def _gathered(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    own, gathered = free_name(docs, "own_id"), free_name(docs, "ranges")
    lists = ranges.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start", "end")).alias(gathered))
    return docs.join(lists, docs.doc_id == F.col(own), "left").drop(own)


def removal_report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256), by the rule of ``repeated_ranges``.

    ``n_spans`` counts maximal removed runs and ``kept_sha256`` is the digest of the bytes left, joined.
    A null text is empty. A row with a null id is reported with nothing removed.
    """
    base = with_id(docs, "doc_id", "text")
    return _gathered(base, repeated_ranges(base, span)).mapInArrow(
        _cut(1, [0], False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; ``n_chars``, if there, is set to what is left. Other columns unchanged.

    A character that a cut splits is dropped. Texts without a repeat, nulls included, stay as they are.
    """
    base = with_id(docs, "doc_id", "text")
    at = docs.columns.index("text")
    columns = [i for i in range(len(docs.columns)) if i != at]
    fields = [docs.schema.fields[i] for i in columns] + [T.StructField("text", T.StringType())]
    out = _gathered(docs, repeated_ranges(base, span)).mapInArrow(_cut(at, columns, True), T.StructType(fields)).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
