"""SentencePiece encoding and decoding with numpy over batches of words of equal length.

Texts are cut into units that no piece crosses, and each distinct unit is encoded once for all texts of a
batch. Units of equal length advance together: the hashes of all their substrings probe the sorted
keys of the pieces at once. Unigram models are segmented by Viterbi, whose vectorised maxima store
backpointers. For merge (BPE) models the best sum of scores is not the model's segmentation, so there
the same table of substrings drives merging: each round joins the best pair of every unit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, mix, text_slices
from .common import with_id, worker_state

SPACE = "▁"
#: distinct units that a worker remembers
CACHE_UNITS = 800_000
#: units longer than this are merged one by one with a queue of pairs
LONG_UNIT = 64
_BASE = U(0x9E3779B97F4A7C15)
_UNK_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model: sorted hash keys, scores and ids, byte pieces, and the bytes of each id."""

    def __init__(self, pieces: list[tuple[str, float, int]], merge: bool, unknown: int = 0, prefix: bool = True):
        """``pieces`` are (text, score, type) by id; types as the model format numbers them: 1 normal, 2 unknown, 3 control, 6 byte."""
        self.merge, self.unknown, self.prefix = merge, unknown, prefix
        normal = [(text, score, i) for i, (text, score, kind) in enumerate(pieces) if kind in (1, 4) and text]
        self.ids = {text: i for text, _, i in normal}
        self.score = {text: score for text, score, _ in normal}
        self.longest = max((len(t) for t in self.ids), default=1)
        keys = np.array([self._key(t) for t in self.ids], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.scores = np.array([s for _, s, _ in normal])[order]
        self.of = np.array([i for _, _, i in normal], np.int64)[order]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.floor = float(self.scores.min(initial=0.0)) - _UNK_PENALTY
        self.text = [
            bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces
        ]
        #: units are cut at blanks if no piece has one after another character, at line feeds if no piece has one
        self.blank_starts = not any(SPACE in t[1:] and t.strip(SPACE) for t in self.ids)
        self.line_splits = not any("\n" in t for t in self.ids)

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are can be used")
        kinds = [(p.piece, p.score, p.type) for p in model.pieces]
        return cls(kinds, model.trainer_spec.model_type == 2, next((i for i, p in enumerate(kinds) if p[2] == 2), 0), spec.add_dummy_prefix)

    @staticmethod
    def _key(text: str) -> int:
        codes = np.array([[ord(c) for c in text]], np.uint64)
        return int(Pieces._hashes(codes, len(text))[0, 0])

    @staticmethod
    def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all substrings of ``size`` characters of words of equal length."""
        n = codes.shape[1] - size + 1
        h = np.zeros((len(codes), n), np.uint64)
        for k in range(size):
            h = h * _BASE + codes[:, k : k + n] + U(1)
        return mix(h + U(size))

    def table(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) by word, start and size - 1; -inf and -1 where the substring is no piece."""
        n, length = codes.shape
        top = min(self.longest, length)
        score, own = np.full((n, length, top), -np.inf), np.full((n, length, top), -1, np.int64)
        running = np.zeros((n, length), np.uint64)
        for size in range(1, top + 1):
            m = length - size + 1
            running = running[:, :m] * _BASE + codes[:, size - 1 :] + U(1)
            key = mix(running + U(size))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            score[:, :m, size - 1] = np.where(hit, self.scores[at], -np.inf)
            own[:, :m, size - 1] = np.where(hit, self.of[at], -1)
        return score, own

    def ends(self, codes: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Where the symbol that starts at a place ends, by word and place; 0 where none starts."""
        return self._merged(codes, score) if self.merge else self._best_path(codes, score)

    def _merged(self, codes: np.ndarray, score: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        top = score.shape[2]
        end = np.tile(np.arange(1, length + 1), (n, 1))
        place = np.arange(length)[None]
        active = np.arange(n)
        while len(active) and length > 1:
            e = end[active]
            after = np.take_along_axis(np.concatenate((e, np.zeros((len(e), 1), e.dtype)), 1), np.where(e > 0, e, length), 1)
            size = after - place
            can = (e > 0) & (after > 0) & (size <= top)
            value = np.where(can, np.take_along_axis(score[active], np.clip(size - 1, 0, top - 1)[:, :, None], 2)[:, :, 0], -np.inf)
            best = value.argmax(1)
            rows = np.arange(len(active))
            go = value[rows, best] > -np.inf
            active, rows, best = active[go], rows[go], best[go]
            middle = e[rows, best]
            end[active, best] = after[rows, best]
            end[active, middle] = 0
        return end

    def _best_path(self, codes: np.ndarray, score: np.ndarray) -> np.ndarray:
        n, length = codes.shape
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), np.int64)
        for to in range(1, length + 1):
            sizes = np.arange(1, min(to, score.shape[2]) + 1)
            step = score[:, to - sizes, sizes - 1]
            step[:, 0] = np.where(np.isneginf(step[:, 0]), self.floor, step[:, 0])
            total = best[:, to - sizes] + step
            pick = total.argmax(1)
            best[:, to] = total[np.arange(n), pick]
            back[:, to] = sizes[pick]
        end = np.zeros((n, length), np.int64)
        at, rows = np.full(n, length), np.arange(n)
        while len(rows):
            start = at[rows] - back[rows, at[rows]]
            end[rows, start] = at[rows]
            at[rows] = start
            rows = rows[start > 0]
        return end

    def _fallback(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(units)
        by: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by.setdefault(len(u), []).append(i)
        for length, group in by.items():
            if not length:
                continue
            if length > LONG_UNIT and self.merge:
                for i in group:
                    out[i] = np.asarray(self._merge_long(units[i]), "<u4").tobytes()
                continue
            step = max(1, 400_000 // (length * min(length, self.longest)))
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                codes = np.frombuffer("".join(units[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length).astype(np.uint64)
                score, own = self.table(codes)
                end = self.ends(codes, score)
                word, start = np.nonzero(end)
                stop = end[word, start]
                ids = own[word, start, stop - start - 1]
                cut = np.searchsorted(word, np.arange(len(part) + 1))
                plain = np.bincount(word, ids < 0, len(part)) == 0
                flat = ids.astype("<u4").tobytes()
                for k, i in enumerate(part):
                    a, b = int(cut[k]), int(cut[k + 1])
                    if plain[k]:
                        out[i] = flat[4 * a : 4 * b]
                    else:
                        parts = []
                        for t in range(a, b):
                            parts += [int(ids[t])] if ids[t] >= 0 else self._fallback(units[i][start[t] : stop[t]])
                        out[i] = np.asarray(parts, "<u4").tobytes()
        return out

    def _merge_long(self, unit: str) -> list[int]:
        n = len(unit)
        after, before, text = list(range(1, n + 1)), list(range(-1, n - 1)), list(unit)
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                joined = text[i] + text[j]
                score = self.score.get(joined)
                if score is not None:
                    heapq.heappush(queue, (-score, i, joined))

        for i in range(n):
            offer(i)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i]
            if not text[i] or j >= n or text[i] + text[j] != joined:
                continue
            text[i], text[j], after[i] = joined, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out: list[int] = []
        for t in text:
            if t:
                out += [self.ids[t]] if t in self.ids else self._fallback(t)
        return out


class PieceEncoder:
    def __init__(self, pieces: Pieces, bound: int = CACHE_UNITS):
        self.pieces, self.half = pieces, bound // 2
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._run = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def _units(self, text: str) -> list[str]:
        """Keys of a text's units. A key that starts with neither a blank sign nor a line feed stands for itself after a blank."""
        p = self.pieces
        if not text:
            return []
        if p.prefix and p.blank_starts and p.line_splits and SPACE not in text and "  " not in text and " \n" not in text and text[0] not in " \n":
            return text.replace("\n", " \n").split(" ")
        whole = (SPACE if p.prefix else "") + text.replace(" ", SPACE)
        units = self._run.findall(whole) if p.blank_starts else [whole]
        return [u if u[0] in SPACE + "\n" else "\0" + u for u in units]

    @staticmethod
    def _unit(key: str) -> str:
        return SPACE + key if not key or key[0] not in SPACE + "\n\0" else key[1:] if key[0] == "\0" and len(key) > 1 else key

    def encode(self, texts: list[str]) -> list[bytes]:
        keys = [self._units(t) if "\0" not in t else None for t in texts]
        distinct: set[str] = set()
        for k in keys:
            if k:
                distinct.update(k)
        missing = [k for k in distinct if k not in self.known]
        if len(self.known) + len(missing) > self.half:
            self.old, self.known = self.known, {}
            missing = list(distinct)
        new = []
        for k in missing:
            held = self.old.get(k)
            if held is None:
                new.append(k)
            else:
                self.known[k] = held
        self.known.update(zip(new, self.pieces.encode_units([self._unit(k) for k in new])))
        find = self.known.__getitem__
        return [self._odd(t) if k is None else b"".join(map(find, k)) for t, k in zip(texts, keys)]

    def _odd(self, text: str) -> bytes:
        """A text with the character that marks keys: its units are encoded as they are."""
        whole = (SPACE if self.pieces.prefix else "") + text.replace(" ", SPACE)
        return b"".join(self.pieces.encode_units(self._run.findall(whole) if self.pieces.blank_starts else [whole]))

    def decode(self, ids: bytes) -> str:
        """The text of the ids: byte pieces are joined to characters, the blank put in front is taken off."""
        out = b"".join(map(self.pieces.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.pieces.prefix and out.startswith(b" "):
            out = out[1:]
        return out.decode("utf-8", "replace")


def _encoder(path: str) -> PieceEncoder:
    return worker_state(f"pieces {path}", lambda: PieceEncoder(Pieces.load(path)))


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, ids) of every row: ids as little-endian unsigned 32-bit bytes, none for null and empty texts. Rows stand for themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model or default_model())
        for batch in batches:
            for first, last, _, _ in text_slices(batch.column(1), 1_000_000):
                part = batch.slice(first, last - first)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    return with_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Add ``decoded`` to a table with a column ``ids``."""
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model or default_model())
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [None if x is None else encoder.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, fields + ", decoded string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, same): every text encoded and decoded again; ``same`` says whether it came back, null as empty.

    Only texts with the blank sign itself, U+2581, come back changed: as blanks, as the format has it.
    """
    return decode(encode(docs, model), model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"),
    )
