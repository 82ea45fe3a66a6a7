"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacity.

Documents are tokenised a batch of words at a time, cut into pieces, and the pieces packed in bins of
bounded size that are independent of each other, so packing is one task per bin at any input size.
"""

from __future__ import annotations

import json
import os
import string
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import text_slices
from .common import stage, with_id, worker_state

assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are written as the machine has them"

WINDOW = 2048
END_ID = 1
#: pieces to a bin on average: bounds a packing task, and the padding of its last windows stays under 1 in 10,000
BIN_PIECES = 50_000
#: what may stand behind a word without a part in common with it
SIGNS = frozenset(string.punctuation)
#: distinct words whose ids a worker remembers; half of them just fit a dict of 2^19 places
CACHE_WORDS = 690_000
#: words to a call of the tokenizer, whose results are some hundred bytes each and more
ENCODED = 2_000
#: bytes of texts that are encoded at once
SLICE = 4_000_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, with a bounded memory of words.

    The tokenizer never joins across a blank or a line feed and takes no notice of case, so a text's ids are
    the ids of its lower-cased words in a row. Only texts whose characters all lie below U+0100,
    where lower case and normal form are plain, are lower-cased here; a text that may hold a special
    token's string goes to the tokenizer whole. Arrow cuts the texts and puts the ids of their words in a row, so Python
    meets each distinct word of a call once. The memory has two generations of half the bound
    each: words that come up again move to the younger one. It holds ids in two bytes each where all ids fit. New words in plain lower case are encoded without the steps that cannot change them:
    the normaliser, and for words of letters alone the search for parts.
    """

    def __init__(self, path: str, bound: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain, self.letters = self._shortened()
        self.marks = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.kind = "H" if max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "I"
        self.half = bound // 2
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _shortened(self) -> tuple:
        """Tokenizers for printable lower-case ASCII words and for lower-case words of letters below U+0100; the whole one where its steps are not those that these words pass unchanged. All share one model."""
        from tokenizers import Tokenizer

        normalizer, cutter = (json.loads(part.__getstate__()) if part else {} for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        kinds = [n["type"] for n in normalizer.get("normalizers", [])], [p["type"] for p in cutter.get("pretokenizers", [])]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or "[\\p{L}]+|" not in str(cutter["pretokenizers"][0]["pattern"].get("Regex")):
            return self.tokenizer, self.tokenizer
        plain, letters = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = self.tokenizer.pre_tokenizer
        letters.pre_tokenizer = self.tokenizer.pre_tokenizer[1]
        return plain, letters

    def _ids(self, tokenizer, texts: list[str]) -> list[bytes]:
        parts = (tokenizer.encode_batch_fast(texts[at : at + ENCODED], add_special_tokens=False) for at in range(0, len(texts), ENCODED))
        return [array(self.kind, e.ids).tobytes() for part in parts for e in part]

    def _learn(self, words: list[str]) -> None:
        """Put new words' ids in memory. A word of letters with one sign behind it has the ids of both, one after the other."""
        letters: list[str] = []
        plain: list[str] = []
        other: list[str] = []
        signed: list[tuple[str, str]] = []
        for w in words:
            if w != w.lower() or max(w) >= "\u0100":
                other.append(w)
            elif w.isalpha():
                letters.append(w)
            elif w[-1] in SIGNS and w[:-1].isalpha():
                signed.append((w, w[:-1]))
            elif w.isascii() and w.isprintable():
                plain.append(w)
            else:
                other.append(w)
        fresh = set(letters)
        for base in {base for _, base in signed}.difference(self.known, fresh):
            held = self.old.get(base)
            if held is None:
                letters.append(base)
            else:
                self.known[base] = held
        for tokenizer, own in ((self.letters, letters), (self.plain, plain), (self.tokenizer, other)):
            self.known.update(zip(own, self._ids(tokenizer, own)))
        signs = sorted({w[-1] for w, _ in signed})
        sign = dict(zip(signs, self._ids(self.plain, signs)))
        self.known.update((w, self.known[base] + sign[w[-1]]) for w, base in signed)

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, new ones learned."""
        found = list(map(self.known.get, words))
        gaps = [i for i, held in enumerate(found) if held is None]
        if len(self.known) + len(gaps) > self.half:
            self.old, self.known = self.known, {"": b""}
            self.known.update((w, held) for w, held in zip(words, found) if held is not None)
        new = []
        for i in gaps:
            held = self.old.get(words[i])
            if held is None:
                new.append(words[i])
            else:
                self.known[words[i]] = held
        self._learn(new)
        for i in gaps:
            found[i] = self.known[words[i]]
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        whole: dict[int, str] = {}
        lower: list[str] = []
        for text in texts:
            if any(m in text for m in self.marks):
                whole[len(lower)] = text
                text = ""
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
            lower.append(text.replace("\n", " "))
        cells = pc.split_pattern(pa.array(lower, pa.large_string()), " ")
        if not len(cells):
            return []
        words = cells.values.dictionary_encode()
        row = pa.array(self._of_words(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        edge = np.frombuffer(row.buffers()[1], np.int64)[cells.offsets.to_numpy()].tolist()
        flat = np.frombuffer(row.buffers()[2] or b"", self.kind)
        size = flat.itemsize
        out = [flat[a // size : b // size].astype("<u4").tobytes() for a, b in zip(edge, edge[1:])]
        for at, text in whole.items():
            out[at] = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out


def token_pieces(
    docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut every document into pieces of at most ``window`` ids: (doc_id, start, length, ids, doc_tokens).

    A document's ids are those of its text (null: empty) and ``end_id``. It is cut into full windows
    from its start; what is left is its last piece. Rows stand for themselves, repeated ids included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_tokenizer()
        encoder = worker_state(f"packing {path}", lambda: WordEncoder(path))
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, last, _, _ in text_slices(batch.column(1), SLICE):
                texts = [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]
                out: list[tuple] = []
                for doc_id, ids in zip(doc_ids[first:last], encoder.ids(texts)):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        part = ids[4 * start : 4 * (start + window)]
                        out.append((doc_id, start, len(part) // 4, part, total))
                yield _batch(out)

    return with_id(docs, id_col, text_col).mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class CapacityTree:
    """Segment tree whose leaf c counts the open windows with c ids of room left; finds the tightest that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the open window with the least room of at least ``need``, taken out; None if there is none."""
        count, at = self.count, need + self.size
        if not count[at]:
            while at & 1 or not count[at + 1]:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, packed longest first (ties in the order given)."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need) if need < window else None
        if found is None:
            room, number = window, made
            made += 1
        else:
            room, number = found
        sequence[i], offset[i] = number, window - room
        if room > need:
            tree.add(room - need, number)
    return sequence, offset


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add (sequence_id, offset) to the pieces: no sequence holds more than ``window`` ids, offsets have no gaps from 0.

    Pieces are dealt by the hash of (doc_id, start) to bins of about ``BIN_PIECES``, however the ids
    repeat, and each bin is packed on its own. ``sequence_id`` is bin * 2^32 + number in the bin.
    """
    total = pieces.count()
    bins = max(1, -(-total // BIN_PIECES))
    columns = [f for f in pieces.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", sequence_id long, offset long"
    salted = pieces.withColumn("bin", F.pmod(F.xxhash64(*[f.name for f in columns]), F.lit(bins)).cast("long"))

    def pack(table: pa.Table) -> pa.Table:
        number = table.column("bin")[0].as_py()
        table = table.drop_columns(["bin"]).sort_by([("doc_id", "ascending"), ("start", "ascending")])
        sequence, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        return table.append_column("sequence_id", pa.array(sequence + (number << 32))).append_column("offset", pa.array(offset))

    return salted.groupBy("bin").applyInArrow(pack, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack ``docs`` (doc_id, text): one row per piece with its place, and its checksum in place of its ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Empty and null texts are
    one piece that holds the end id; empty input gives an empty result. The ids themselves come from
    ``token_pieces``; (doc_id, start) names a piece in both.
    """
    lean = token_pieces(docs, tokenizer, window).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"
    )
    return place(stage(lean, "pieces"), window)
