"""Jaccard join of documents on sets of word n-grams, with token-combination prefixes.

1. Every document's distinct shingles are hashed and counted over the whole corpus. A document in which so
   many occur in no other set that none can reach the similarity is done. The rest are the
   candidates, equal sets merged.
2. Tokens are ordered, rare ones first. Rare tokens are indexed singly, frequent ones by combinations of two,
   still more frequent ones by three, within groups of tokens that bound their number; a document's prefix is
   extended until it must share a key with every document it can link to.
3. Documents under one key are compared with the key's pivot, then all that are not in one component
   yet with each other. Bit maps rule most pairs out in the join; the rest are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, U, mix, prefix_hash, span_hash, text_slices, words
from .common import components, free_worker, partitions, stage, unstage, with_id

WORDS, PERCENT = 5, 80
#: sets in which a token occurs from which on its keys are pairs, then triples
FREQUENT = (512, 4_096)
_SLICE = 1_000_000
#: documents of a key that meet others in one task
_BLOCK = 512
#: 64-bit words of the bit map of a set
_LONGS = 16
_NEXT = U(0x9E3779B97F4A7C15)


def shingles(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, cuts): the distinct hashed shingles of each text in ascending order, text i's at cuts[i]:cuts[i+1].

    A-Z are lower-cased; words are runs without white space; a text of fewer than ``k`` words has one
    shingle, all of its words; a text without words has none.
    """
    flat = LOWER[flat]
    starts, ends, doc = words(flat, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = span_hash(prefix_hash(flat), starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    left = (first + count)[doc] - np.arange(len(doc))  # words from here to the text's end
    opens = (left >= k) | ((np.arange(len(doc)) == first[doc]) & (count[doc] < k))
    at = np.flatnonzero(opens)
    size = np.minimum(left[at], k)
    token = mix(word[at] + size.astype(np.uint64))
    for i in range(1, k):
        more = size > i
        step = np.minimum(at + i, len(word) - 1)
        token = np.where(more, mix(token * U(3) + word[step] * _NEXT), token)
    doc = doc[at]
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(n + 1))


def prefix_size(n, percent: int):
    """Tokens of a set of ``n`` of which one must be shared with every set that is as similar as asked."""
    return n + percent * -n // 100 + 1  # n - ceil(percent * n / 100) + 1


def _digests(token: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each text's set; 0 for an empty one."""
    one, two = np.zeros(len(cuts) - 1, np.uint64), np.zeros(len(cuts) - 1, np.uint64)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        one[some] = np.add.reduceat(mix(token ^ U(0x5851F42D4C957F2D)), cuts[some])
        two[some] = np.bitwise_xor.reduceat(mix(token + U(0x14057B7EF767814F)), cuts[some])
    return one, two


def _count_messages(k: int, buckets: int):
    """Per slice and bucket of hashes: the slice's tokens, 32 bits of each, and the digest of the set and the document it is in.

    A bucket holds a bounded share of the hash range, so 32 bits tell its tokens apart but for few; two that fall
    together only make a token seem shared. A token that different sets of a slice share is sent once,
    as document 65535, so a very common token is a row per slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, flat, offsets in text_slices(batch.column(1), _SLICE):
                for lo in range(first, last, 60_000):
                    hi = min(last, lo + 60_000)
                    a, z = offsets[lo - first], offsets[hi - first]
                    token, cuts = shingles(flat[a:z], offsets[lo - first : hi - first + 1] - a, k)
                    yield _message(ids[lo:hi], token, cuts, buckets)

    return run


def _message(own: np.ndarray, token: np.ndarray, cuts: np.ndarray, buckets: int) -> pa.RecordBatch:
    name = int(mix(np.array([own[0], len(token)], np.int64).view(np.uint64)).sum(dtype=np.uint64).view(np.int64))
    doc = np.repeat(np.arange(len(own), dtype=np.uint16), np.diff(cuts))
    digest, second = _digests(token, cuts)
    spread = mix(token)
    order = np.argsort(spread, kind="stable")
    spread, doc = spread[order], doc[order]
    if len(spread):
        opens = np.flatnonzero(np.concatenate(([True], spread[1:] != spread[:-1])))
        held = digest[doc]
        mixed = np.minimum.reduceat(held, opens) != np.maximum.reduceat(held, opens)
        size = np.diff(np.append(opens, len(spread)))
        mixed_row = np.repeat(mixed, size)
        doc = np.where(mixed_row, np.uint16(65535), doc)
        keep = ~mixed_row
        keep[opens[mixed]] = True
        spread, doc = spread[keep], doc[keep]
    bucket = (spread >> U(40)).astype(np.int64) * buckets >> 24  # by range, so that the order of hashes is the order of buckets
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    short = (spread & U(0xFFFFFFFF)).astype("<u4")
    rows = [(-1, name, own.tobytes(), np.diff(cuts).tobytes(), digest.tobytes() + second.tobytes())]
    for b in np.flatnonzero(np.diff(edge)).tolist():
        part = doc[edge[b] : edge[b + 1]]
        sets = np.unique(part[part < 65535])
        rows.append((b, name, short[edge[b] : edge[b + 1]].tobytes(), part.astype("<u2").tobytes(), sets.astype("<u2").tobytes() + digest[sets].tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "slice", "tokens", "docs", "sets"])


def _unique_here(table: pa.Table) -> pa.Table:
    """In one bucket: for each slice how many tokens of each of its documents occur in no other set."""
    names = table.column("slice").to_pylist()
    tokens = [np.frombuffer(x, "<u4") for x in table.column("tokens").to_pylist()]
    docs = [np.frombuffer(x, "<u2") for x in table.column("docs").to_pylist()]
    held = []
    for doc, x, serial in zip(docs, table.column("sets").to_pylist(), range(len(docs))):
        n = len(x) // 10
        of = np.empty(65536, np.uint64)
        of[np.frombuffer(x, "<u2", n)] = np.frombuffer(x, np.uint64, n, 2 * n)
        of[65535] = mix(np.array([serial], np.uint64))[0]  # no set's digest, and another one in each slice
        held.append(of[doc])
    every, held, shared = np.concatenate(tokens), np.concatenate(held), np.concatenate(docs) == 65535
    order = np.argsort(every, kind="stable")
    in_order = every[order]
    opens = np.flatnonzero(np.concatenate(([True], in_order[1:] != in_order[:-1])))
    digest = held[order]
    one = np.minimum.reduceat(digest, opens) == np.maximum.reduceat(digest, opens)
    lone = np.empty(len(every), bool)
    lone[order] = np.repeat(one, np.diff(np.append(opens, len(every))))
    lone &= ~shared
    out, at = [], 0
    for doc in docs:
        out.append(np.bincount(doc[lone[at : at + len(doc)]]).astype(np.uint32).tobytes())
        at += len(doc)
    none = pa.array([None] * len(names), pa.binary())
    return pa.table({"slice": pa.array(names, pa.int64()), "ids": none, "sizes": none, "sets": none, "lone": pa.array(out, pa.binary())})


def _sum_slice(table: pa.Table) -> pa.Table:
    """The sums of a slice's messages: (doc_id, n, lone, one, two)."""
    heads = []
    for ids, sizes, sets in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "sets"))):
        if ids is not None:
            heads.append((np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(sets, np.int64).reshape(2, -1)))
    lone = np.zeros(max(len(h[0]) for h in heads), np.int64)
    for x in table.column("lone").to_pylist():
        if x is not None:
            part = np.frombuffer(x, np.uint32)
            lone[: len(part)] += part
    if len(heads) > 1:  # slices that share a name: nothing is known to be lone
        lone[:] = 0
    return pa.concat_tables(pa.table({"doc_id": i, "n": s, "lone": lone[: len(i)], "one": d[0], "two": d[1]}) for i, s, d in heads)


def _all_tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            for first, last, flat, offsets in text_slices(batch.column(1), _SLICE):
                token, cuts = shingles(flat, offsets, k)
                ids = batch.column(0).slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(token.view(np.int64)))], ["doc_id", "tokens"]
                )

    return run


def _combinations(token: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all combinations of ``k`` tokens of one group; the tokens of a group come one after another."""
    ends = np.searchsorted(group, group, "right")
    last, key = np.arange(len(token)), mix(token)
    for _ in range(k - 1):
        more = ends[last] - last - 1
        of = np.repeat(np.arange(len(last)), more)
        last = last[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(more) - more, more)
        key = mix(key[of] * U(3) + token[last] * _NEXT)
    return key


def _level_keys(token: np.ndarray, each: np.ndarray, needed: int, level: int, first: int) -> list[np.ndarray]:
    """Keys of one document at one level of size; ``first`` of the ``needed`` tokens are known to be lone.

    ``each`` says how many tokens of a class make a key. A class of combinations is dealt to groups, as
    many as grow with the level, and combinations are made within a group. A prefix in which a group has
    c tokens tells of c - k + 1 that are missing elsewhere at most before no combination is left, so it is extended
    until these sums exceed what a similar document can miss. A document too small for that
    has all of its combinations, and singles that only meet those of other such documents.
    """
    groups = U(max(4, (1 << level) // 4))
    group = np.where(each > 1, (mix(token + U(level)) % groups).astype(np.int64) + (each.astype(np.int64) << 40), 0)
    order = np.argsort(group, kind="stable")
    opens = np.searchsorted(group[order], group[order])
    nth = np.empty(len(token), np.int64)
    nth[order] = np.arange(len(token)) - opens + 1
    told = first + np.cumsum((nth >= each) | (each == 1))
    take = int(np.searchsorted(told, needed)) + 1
    keys = []
    if take > len(token):
        take = len(token)
        keys.append(mix(mix(token[: needed - first]) + U(2 * level + 1)))
    single = token[:take][each[:take] == 1]
    keys.append(single)
    for k in np.unique(each[:take]).tolist():
        if k > 1:
            own = order[(order < take) & (each[order] == k)]
            keys.append(mix(_combinations(token[own], group[own], k) + U(2 * level)))
    return keys


def prefix_keys(n: int, token: np.ndarray, df: np.ndarray, percent: int, frequent: tuple[int, ...] = FREQUENT) -> np.ndarray:
    """Distinct index keys of a set of ``n`` tokens, of which ``token`` also occur elsewhere, in ``df`` sets.

    Two sets that are as similar as asked have a key in common: see ``_level_keys``. They meet at the level of the larger
    one, so a set has the keys of each level in which a partner at least as large may be.
    """
    needed = prefix_size(n, percent)
    first = n - len(token)
    if first >= needed:
        return np.zeros(0, np.uint64)
    order = np.lexsort((token, df))
    token, df = token[order], df[order]
    each = 1 + np.searchsorted(np.array(frequent), df, "right")
    if each[min(len(each), needed - first) - 1] == 1:
        return token[: needed - first]  # all rare
    levels = range(n.bit_length() - 1, (100 * n // percent).bit_length())
    return np.unique(np.concatenate([x for level in levels for x in _level_keys(token, each, needed, level, first)]))


def _profiles(percent: int, frequent: tuple[int, ...]):
    """Per document its keys, a bit map of the tokens it can share, and by how much these outnumber the bits; from (doc_id, n, tokens that other sets have, too)."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n", "rest", "bits", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            rows, held = [], 0
            for doc, n, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                v = listed.values
                token, df = v.field(0).to_numpy().view(np.uint64), v.field(1).to_numpy()
                bits = np.zeros(64 * _LONGS, np.uint8)
                bits[(mix(token) % U(64 * _LONGS)).astype(np.int64)] = 1
                keys = prefix_keys(n, token, df, percent, frequent)
                rows.append((doc, n, len(token) - int(bits.sum()), np.packbits(bits).view(np.int64), keys.view(np.int64)))
                held += len(keys)
                if held > 500_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def _verified(percent: int):
    """Of pairs (a, b, tokens of a, tokens of b) those that link; tokens are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _set_sizes(k: int):
    """(doc_id, n) of rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            for first, last, flat, offsets in text_slices(batch.column(1), _SLICE):
                _, cuts = shingles(flat, offsets, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(cuts))], ["doc_id", "n"])

    return run


def _sets(lean: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, lone, one, two) of all documents, staged: size of the set, its tokens that no other set has, two digests of it."""
    spark = lean.sparkSession
    # a bucket is one task's share in memory: that of some 8 MB of input files
    size = int(lean._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = max(partitions(spark, 8), size // 8_000_000 if size < 1 << 50 else 0)  # larger: the optimiser does not know the size
    messages = stage(lean.mapInArrow(_count_messages(k, buckets), "bucket long, slice long, tokens binary, docs binary, sets binary"), "counts")
    parts = "slice long, ids binary, sizes binary, sets binary, lone binary"
    heads = messages.where("bucket < 0").select("slice", F.col("tokens").alias("ids"), F.col("docs").alias("sizes"), "sets", F.lit(None).cast("binary").alias("lone"))
    counted = messages.where("bucket >= 0").groupBy("bucket").applyInArrow(_unique_here, parts)
    found = heads.unionByName(counted).groupBy("slice").applyInArrow(_sum_slice, "doc_id long, n long, lone long, one long, two long")
    out = stage(found, "sizes")
    unstage(messages)
    return out


def _index(sets: DataFrame, percent: int, frequent: tuple[int, ...]) -> DataFrame:
    """(key, doc_id, n, rest, bits, weight), staged: documents by index key, without keys that one document has alone.

    ``bits`` maps the tokens of a set that can be shared, ``rest`` says how many fell on a bit that was set; ``weight`` is the sum of the
    sizes of a document's keys.
    """
    spread = sets.select("doc_id", F.explode("tokens").alias("token"))
    common = spread.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    listed = spread.join(common, "token").groupBy("doc_id").agg(F.collect_list(F.struct("token", "df")).alias("listed"))
    profiles = stage(
        listed.join(sets.select("doc_id", F.size("tokens").cast("long").alias("n")), "doc_id")
        .select("doc_id", "n", "listed")
        .mapInArrow(_profiles(percent, frequent), "doc_id long, n long, rest long, bits array<long>, keys array<long>"),
        "profiles",
    )
    rows = profiles.select("doc_id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    rows = stage(rows.join(shared, "key"), "shared-keys")
    weight = rows.groupBy("doc_id").agg(F.sum("c").alias("weight"))
    index = stage(rows.select("doc_id", "key").join(profiles.select("doc_id", "n", "rest", "bits").join(weight, "doc_id"), "doc_id"), "index")
    unstage(rows)
    unstage(profiles)
    return index


def link_documents(
    docs: DataFrame, words_each: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", frequent: tuple[int, ...] = FREQUENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A document's set holds its distinct shingles of ``words_each`` words, A-Z lower-cased; with fewer
    words, the whole sequence as one. Two documents link when 100 * intersection >= ``percent`` *
    union. Null, empty and blank texts have an empty set and link with nothing. ``component_id`` is the
    smallest id reachable by links, itself included. Rows that repeat an id are one document and one row of
    the result; a row with a null id is a row of the result, links with nothing and has no component.
    ``frequent``: in how many sets a token occurs from which on its keys are pairs, triples and so on.
    """
    base = with_id(docs, id_col, text_col)
    lean = base.where("doc_id is not null")
    sizes = _sets(lean, words_each)
    by = ["n", "one", "two"]
    classes = sizes.where("n > 0").groupBy(*by).agg(F.min("doc_id").alias("rep"), F.max("lone").alias("lone"))
    p = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    wanted = classes.where(F.col("lone") < p).select(F.col("rep").alias("doc_id"))
    texts = lean.join(wanted, "doc_id", "left_semi")
    sets = stage(texts.mapInArrow(_all_tokens(words_each), "doc_id long, tokens array<long>").dropDuplicates(["doc_id"]), "sets")
    index = _index(sets, percent, frequent)
    named = _resolve(index, sets, percent)
    unstage(index)
    unstage(sets)
    # every document has the component of the first document with its set
    placed = classes.select(*by, "rep").join(named, F.col("rep") == F.col("node"), "left").select(*by, F.coalesce("component", "rep").alias("component"))
    every = sizes.groupBy("doc_id").agg(F.max(F.struct(*by)).alias("s")).select("doc_id", "s.*")
    nameless = base.where("doc_id is null").mapInArrow(_set_sizes(words_each), "doc_id long, n long")
    return (
        every.join(placed, by, "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        .unionByName(nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
    )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, staged. One ``a`` may have very many ``b``: its rows meet its tokens before they carry others."""
    return stage(
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_verified(percent), "a long, b long"),
        "links",
    )


def _may_link(percent: int, x: str, y: str):
    """False only where the bit maps prove that two sets do not link.

    A set shares none of its lone tokens, and of the others no more than the bits that both maps have, and as many as fell on bits
    that were set. One short sum, so that the join's loop stays small enough for the JVM to compile.
    """
    both = sum((F.bit_count(F.get(f"{x}.bits", F.lit(i)).bitwiseAND(F.get(f"{y}.bits", F.lit(i)))) for i in range(_LONGS)), F.lit(0))
    most = both + F.least(f"{x}.rest", f"{y}.rest")
    return F.lit(100 + percent) * most >= F.lit(percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _resolve(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of all documents that link: first with the pivots of keys, then all pairs under keys that still hold several components."""
    # the document that shares most with others is the pivot of its keys: it links most of them at once
    pivots = index.groupBy("key").agg(F.max_by(F.struct("doc_id", "n", "rest", "bits"), F.struct("weight", -F.col("doc_id"))).alias("row")).select("key", "row.*")
    x, y = index.alias("x"), pivots.alias("y")
    pairs = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") != F.col("y.doc_id")) & _may_link(percent, "x", "y"))
        .select(F.col("y.doc_id").alias("a"), F.col("x.doc_id").alias("b"))
        .distinct()
    )
    links = _linked(pairs, sets, percent)
    named = components(links)
    placed = stage(index.join(named, index.doc_id == named.node, "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node", "weight"), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("greatest"), F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    rows = placed.join(mixed.where("least <> greatest").select("key", "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # a hot key's documents are dealt to blocks, and each pair of blocks is a task's share of its own
    x = rows.withColumn("lower", F.col("own")).withColumn("upper", F.explode(F.sequence("own", F.col("blocks") - 1))).alias("x")
    y = rows.withColumn("upper", F.col("own")).withColumn("lower", F.explode(F.sequence(F.lit(0), F.col("own")))).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.lower") == F.col("y.lower")) & (F.col("x.upper") == F.col("y.upper"))
    once = (F.col("x.lower") < F.col("x.upper")) | (F.col("x.doc_id") < F.col("y.doc_id"))
    pairs = (
        x.join(y, same & once & (F.col("x.component") != F.col("y.component")) & _may_link(percent, "x", "y"))
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
        .distinct()
    )
    more = _linked(pairs, sets, percent)
    if not more.isEmpty():
        named = components(links.unionByName(more))
    for done in (placed, links, more):
        unstage(done)
    return named


def keep_one(docs: DataFrame, words_each: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; columns unchanged. Rows without an id stay."""
    drop = link_documents(docs, words_each, percent).where("component_id <> doc_id").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
