import gzip
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bytesops, common, language, packing, quality, sentence_pieces, url_filter, warc
from tests.llm.test_dedup import frame, prose

ODD = {0: None, 1: "", 2: " \n", 3: "plain words here", 4: "plain words here", 5: "Ünïcode – 日本 😀", 6: "x" * 5000, 7: "a " * 4000}


# packing


def test_capacity_tree_finds_the_tightest():
    r = random.Random(0)
    tree, room = packing.CapacityTree(64), {}
    for n in range(500):
        if r.random() < 0.6:
            c = r.randint(1, 64)
            tree.add(c, n)
            room[n] = c
        else:
            need = r.randint(1, 64)
            fit = [c for c in room.values() if c >= need]
            got = tree.take(need)
            assert (got is None) == (not fit)
            if got:
                assert got[0] == min(fit) == room.pop(got[1])


def check_places(rows, window):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return by


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    r = random.Random(1)
    texts = ODD | {i: prose(i, r.randint(0, 300)).title() for i in range(10, 60)} | {60: "<|endoftext|> A<|ENDOFTEXT|>", 61: "İstanbul ΣΑΣ ß\u212a", 62: "it's we'll 12,345\u00a0b\x1cc"}
    rows = packing.pack(frame(spark, texts), window=256).collect()
    by = check_places(rows, 256)
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((x for x in rows if x.doc_id == i), key=lambda x: x.start)
        assert [x.start for x in own] == list(np.cumsum([0] + [x.length for x in own])[:-1]) and sum(x.length for x in own) == len(ids) == own[0].doc_tokens
        for x in own:
            assert zlib.crc32(np.asarray(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32
    total = sum(x.length for x in rows)
    assert len(by) <= -(-total // 256) + 1
    assert packing.pack(frame(spark, texts).limit(0)).count() == 0


def test_words_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    e = packing.WordEncoder(packing.default_tokenizer())
    assert e.plain is not e.tokenizer and e.letters is not e.plain
    r = random.Random(6)
    texts = ["".join(r.choice("abzAÉéßµª²½'stvel1٣_-.,!\t\r\x0b\xa0\x85 \n\x00é日") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t, ids in zip(texts, e.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packing.pack(d).collect()
    assert len(rows) == 3
    check_places(rows, packing.WINDOW)


def test_word_memory_is_bounded():
    e = packing.WordEncoder(packing.default_tokenizer(), bound=50)
    texts = [prose(i, 40) for i in range(20)]
    whole = packing.WordEncoder(packing.default_tokenizer())
    assert [e.ids([t])[0] for t in texts] == whole.ids(texts)
    assert len(e.known) <= 150


def test_words_without_ids_and_with_wide_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["<|endoftext|>", "", "ab  ab\nÉa, 日本 " * 3, "a" * 300]
    wide = packing.WordEncoder(packing.default_tokenizer())
    assert wide.kind == "H"
    wide.kind = "I"
    for e in (packing.WordEncoder(packing.default_tokenizer()), wide):
        assert e.ids([]) == [] and e.ids([""]) == [b""] and e.ids(["", " \n"]) == [b"", b""]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.ids(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


FULL_MEMORY = """
import numpy, re
from marlstone.llm import packing

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

before = held()
e = packing.WordEncoder(packing.default_tokenizer())
r = numpy.random.default_rng(0)
while not e.old or len(e.known) < 0.9 * e.half:
    letters = r.integers(97, 123, (20_000, 10), numpy.uint8)
    letters[:, 9] = 32
    e.ids([letters.tobytes().decode()])
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="the system does not tell what a process holds")
def test_full_word_memory_is_small():
    out = subprocess.run([sys.executable, "-c", FULL_MEMORY], check=True, capture_output=True, text=True, timeout=300).stdout
    assert float(out) < 250, out


def test_kept_state_begins_with_free_memory():
    bytesops.powers(1 << 21)
    assert common.worker_state("test", list) is common.worker_state("test", list)
    assert bytesops._power_table.cache_info().currsize == 0
    common.free_worker()
    assert not common._worker


# SentencePiece


def test_pieces_like_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())
    r = random.Random(2)
    texts = [t or "" for t in ODD.values()] + ["\0a b", "▁x", "a▁▁b", "  a \n b", "the" * 80, "é\u0301", "<s> <0x41>", "\n\n"]
    texts += ["".join(r.choice("abthe  \n▁é,.日\0x") for _ in range(r.randint(0, 30))) for _ in range(500)]
    texts += ["".join(r.choice("abthe") for _ in range(n)) for n in (63, 64, 65, 300)]
    e = sentence_pieces.PieceEncoder(sentence_pieces.Pieces.load(sentence_pieces.default_model()), bound=200)
    for t in texts:
        ids = e.encode([t])[0]
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t), t
        assert e.decode(ids) == t.replace("▁", " ")


def best_path(pieces, word):
    """Best segmentation by trying all."""
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        found = []
        for start in range(end):
            part = word[start:end]
            score = pieces.score.get(part, pieces.floor if end - start == 1 else None)
            if score is not None and start in best:
                found.append((best[start][0] + score, best[start][1] + [part]))
        best[end] = max(found, key=lambda x: x[0])
    return best[len(word)]


def test_viterbi():
    r = random.Random(3)
    table = [("<unk>", 0.0, 2)] + [(p, -r.random() * 5, 1) for p in {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(60)}]
    pieces = sentence_pieces.Pieces(table, merge=False)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 12))) for _ in range(200)]
    for w, ids in zip(words, pieces.encode_units(words)):
        got = np.frombuffer(ids, "<u4").tolist()
        score, parts = best_path(pieces, w)
        assert got == [pieces.ids.get(p, pieces.unknown) for p in parts] or sum(table[i][1] if i else pieces.floor for i in got) == pytest.approx(score)


def test_pieces_round_trip(spark):
    rows = {r.doc_id: r for r in sentence_pieces.round_trip(frame(spark, ODD)).collect()}
    assert all(r.same for r in rows.values()) and rows[0].n_pieces == 0 and rows[3].ids_crc32 == rows[4].ids_crc32
    assert sentence_pieces.round_trip(frame(spark, ODD).limit(0)).count() == 0


# language


def languages():
    r = random.Random(4)
    parts = {"xx": ["tha", "ing", "ed", "the"], "yy": ["ño", "ció", "ar", "que"], "zz": ["ung", "sch", "ä", "der"]}
    return {i: (lang, " ".join("".join(r.choice(own) for _ in range(r.randint(1, 3))) for _ in range(r.randint(20, 200)))) for i, (lang, own) in enumerate(list(parts.items()) * 60)}


def test_language(spark):
    own = languages()
    rows = [(i, t, lang) for i, (lang, t) in own.items()] + [(1000, None, "xx"), (1001, "12 34!", "xx"), (1002, "", None), (None, "tha ing", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in language.identify(d).collect()}
    held = [i for i in own if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in own)
    assert np.mean([got[i].lang_pred == own[i][0] for i in held]) >= 0.95
    assert all((got[i].lang_pred, got[i].score) == ("und", 0) for i in (1000, 1001, 1002)) and got[None].lang_pred == "xx"
    assert {r.lang_pred for r in language.identify(d.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}
    assert language.identify(d.limit(0)).count() == 0


def test_language_rows_against_plain_version(spark):
    """The whole query beside a plain one: fold, order, windows, fit, convolution, averages."""
    own = {i: v for i, v in languages().items() if i < 60}
    d = spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in own.items()], "doc_id long, text string, lang string, lang_pred string, letter int").repartition(3)
    got = {r.doc_id: r for r in language.identify(d).collect()}
    learned = [r.doc_id for r in d.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    labels = sorted({own[i][0] for i in learned})

    def cut(text):
        data = text.encode()
        return [[int(language.BYTE_CLASS[b]) for b in data[at : at + 256].ljust(256)] for at in range(0, len(data), 256)]

    x = [(w, labels.index(own[i][0])) for i in learned for w in cut(own[i][1])]
    net = language.ByteCNN(labels).fit(np.array([w for w, _ in x], np.uint8), np.array([y for _, y in x]))
    for i, (_, text) in own.items():
        logs = []
        for w in cut(text):
            e = net.embed[w]
            top = [max(0.0, float(b + max(sum(e[at + k] @ f[k][:, j] for k in range(len(f))) for at in range(len(w) - len(f) + 1)))) for f, bias in zip(net.filters, net.bias) for j, b in list(enumerate(bias))[:4]] if i < 3 else None
            h = np.concatenate([np.maximum(np.stack([sum(e[at + k] @ f[k] for k in range(len(f))) for at in range(len(w) - len(f) + 1)]).max(0) + bias, 0) for f, bias in zip(net.filters, net.bias)])
            assert top is None or top == pytest.approx([float(v) for n in range(len(net.filters)) for v in h[16 * n : 16 * n + 4]], abs=1e-4)
            z = h @ net.out + net.out_bias
            logs.append(z - np.log(np.exp(z).sum()))
        p = np.exp(np.mean(logs, axis=0))
        p /= p.sum()
        assert got[i].score == pytest.approx(p.max(), abs=1e-3) and (got[i].lang_pred == labels[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-3)


def test_network_tables_and_gradients():
    net = language.ByteCNN(["a", "b", "c"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 128, (5, 40)).astype(np.uint8), rng.integers(0, 3, 5)
    e = net.embed[x]
    h = [np.maximum(sum(e[:, k : k + 41 - w] @ f[k] for k in range(w)).max(1) + b, 0) for w, f, b in zip(language.WIDTHS, net.filters, net.bias)]
    z = np.concatenate(h, 1) @ net.out + net.out_bias
    assert net.log_probabilities(x) == pytest.approx(z - np.log(np.exp(z).sum(1, keepdims=True)), abs=1e-4)
    loss = lambda: -net.log_probabilities(x)[np.arange(5), y].mean()
    for p, g in zip(net.parameters(), net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1, abs=2e-3)


def test_windows_cover_every_byte():
    flat = np.frombuffer(b"ab" * 300 + b"c" + b"d" * 256, np.uint8)
    x, doc = language.windows(flat, np.array([0, 600, 600, 601, 857]))
    assert doc.tolist() == [0, 0, 0, 2, 3] and (x[:3].reshape(-1)[:600] == language.BYTE_CLASS[flat[:600]]).all() and not x[2, 88:].any()


# quality


def test_quality(spark):
    texts = {i: prose(i, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 60).split()) for i in range(300)} | {1000 + i: t for i, t in ODD.items()}
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    d = frame(spark, texts)
    got = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    assert set(got) == set(texts) and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(300) if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in texts)
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in held]) >= 0.95
    assert got[1000].score == got[1001].score == got[1002].score
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in texts if got[i].score >= 0.3}
    assert {r.score for r in quality.classify(d, labels.limit(0)).collect()} == {0.5} and quality.classify(d.limit(0), labels).count() == 0


def test_quality_rows_against_plain_version(spark):
    """The whole query beside a plain one: fold, order, updates a coordinate at a time, dot products."""
    texts = {i: prose(i, 30) if i % 3 else " ".join(w.upper() + "!!" for w in prose(i, 30).split()) for i in range(80)} | {100: None, 101: ""}
    d = frame(spark, texts).withColumn("label", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(80)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(d, labels).collect()}
    order = [r.doc_id for r in labels.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]

    def features(text):
        slots, _ = quality.features(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        out = {"intercept": 1.0}
        for s in slots.reshape(-1).tolist():
            out[s] = out.get(s, 0.0) + quality.SCALE / slots.shape[1]
        return out

    z, n = {}, {}

    def weight(k):
        shrunk = z.get(k, 0.0)
        if k != "intercept":
            shrunk = (shrunk > 0) * max(0.0, shrunk - quality.L1) - (shrunk < 0) * max(0.0, -shrunk - quality.L1)
        return -shrunk / ((quality.BETA + n.get(k, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    def score(f):
        return 1 / (1 + np.exp(-sum(weight(k) * v for k, v in f.items())))

    for _ in range(quality.EPOCHS):
        for i in order:
            f = features(texts[i])
            p, w = score(f), {k: weight(k) for k in f}
            for k, v in f.items():
                g, old = (p - (i % 3 > 0)) * v, n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (n[k] ** 0.5 - old**0.5) / quality.ALPHA * w[k]
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].score == pytest.approx(score(features(t)), abs=1e-5)
    kept = quality.keep_good(d, labels)
    assert kept.dtypes == d.dtypes and {r.score for r in kept.collect()} == {"clash"}


def test_features_tell_words_apart():
    """Two places have one slot exactly where the word, or the word and the one before, are the same."""
    text = "A b, b b!! 12 A b, c B, b"
    w = text.split()
    slots, _ = quality.features(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    for i in range(len(w)):
        for j in range(len(w)):
            assert (slots[0, i] == slots[0, j]) == (w[i] == w[j])
            assert (slots[1, i] == slots[1, j]) == (w[max(0, i - 1) : i + 1] == w[max(0, j - 1) : j + 1] and (i > 0) == (j > 0))


def test_features_and_scores_agree():
    texts = pa.array([prose(1, 30), None, "", "A b, b b!! 12", "é" * 10])
    rng = np.random.default_rng(0)
    w = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    slow = [1 / (1 + np.exp(-(w[s].astype(float) @ v + w[-1]))) for s, v in quality.sparse_rows(texts)]
    assert quality.score_column(texts, w) == pytest.approx(slow, rel=1e-5)


# WARC


def record(n, payload=b"<p>x</p>", digest=None):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
    return head % (n, (digest or warc.base32_sha1(payload)).encode(), len(http) + len(payload)) + http + payload + b"\r\n\r\n"


def ids(found):
    return [int(re.search(r"\d+", r["headers"]["warc-record-id"])[0]) for r in found]


def test_salvage_plain():
    good = [record(i, b"payload %d WARC/1.1\r\n" % i) for i in range(5)]
    found, gaps = warc.salvage(b"".join(good))
    assert ids(found) == [0, 1, 2, 3, 4] and not gaps
    cut = good[0] + good[1][:-30] + good[2] + b"junk" + record(9, digest="A" * 32) + good[3] + good[4][: len(good[4]) // 2]
    found, gaps = warc.salvage(cut)
    assert ids(found) == [0, 2, 3] and len(gaps) == 3
    covered = sum(len(g) for g in (good[0], good[2], good[3])) + sum(b - a for a, b, _ in gaps)
    assert covered == len(cut) and warc.salvage(b"") == ([], []) and warc.salvage(b"no archive")[1] == [(0, 10, "no version line")]


def test_salvage_members():
    members = [warc.gzip_member(record(i, bytes([65 + i]) * 3000)) for i in range(4)]
    assert ids(warc.salvage(b"".join(members))[0]) == [0, 1, 2, 3]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    found, gaps = warc.salvage(members[0] + bytes(broken) + members[2] + record(7) + members[3][:-9])
    assert [i for i in ids(found) if i != 1 and i != 3] == [0, 2, 7] and len(gaps) == 2
    many = warc.gzip_member(b"".join(record(i, random.Random(i).randbytes(400)) for i in range(50)))
    found, gaps = warc.salvage(many[: len(many) // 2])
    assert ids(found) == list(range(len(found))) and len(found) > 15 and len(gaps) == 1


def test_salvage_before_the_fault():
    plain = b"".join(record(i, bytes(random.Random(i).choices(b"abcdef", k=400))) for i in range(50))
    member = warc.gzip_member(plain)
    assert len(member) < 1 << 16
    found, gaps = warc.salvage(member[:-8] + bytes([member[-8] ^ 1]) + member[-7:])  # a wrong checksum
    assert ids(found) == list(range(50)) and len(gaps) == 1
    broken = bytearray(member)
    broken[len(member) // 2] ^= 255
    found, gaps = warc.salvage(bytes(broken))
    assert ids(found)[:20] == list(range(20)) and gaps[-1][1] == len(member)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = stored.compress(plain) + stored.flush()
    found, _ = warc.salvage(stored[:-8] + bytes([stored[-8] ^ 1]) + stored[-7:])
    assert ids(found) == list(range(50))


def test_written_archives_lose_only_the_damaged_record(spark, tmp_path):
    r = random.Random(7)
    pages = spark.createDataFrame([(i, f"http://a/{i}", "".join(r.choices("abcdefgh ", k=3000))) for i in range(20)], "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"))
    seen, most = [], 0
    for f in (tmp_path / "w").glob("archive=*/part-*"):
        data = f.read_bytes()
        found, gaps = warc.salvage(data)
        assert not gaps and gzip.decompress(data).count(b"WARC/1.1\r\n") == len(found)
        seen, most = seen + ids(found), max(most, len(found))
        for k, hit in enumerate(found):
            broken = bytearray(data)
            broken[hit["offset"] + 700] ^= 255
            left, gaps = warc.salvage(bytes(broken))
            assert ids(left) == ids(found[:k]) + ids(found[k + 1 :]) and gaps
    assert sorted(seen) == list(range(20)) and most > 2


def test_written_archive_of_a_very_long_record(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, "z" * 17_000_000), (2, None, None)], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w"), False).withColumn("page_id", warc.page_id("record_id")).collect()}
    assert {k: (r.payload_bytes, r.quarantine) for k, r in rows.items()} == {1: (17_000_000, None), 2: (0, None)}
    for f in (tmp_path / "w").glob("archive=*/part-*"):
        assert gzip.decompress(f.read_bytes()).endswith(b"\r\n\r\n")


def test_one_long_page_does_not_make_an_archive_of_each_page(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, f"http://a/{i}", "".join(r.choices("abcdefgh ", k=2000))) for i in range(300)] + [(1000, "http://a/", "".join(r.choices("abcdefghij", k=200_000)))]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    files = list((tmp_path / "w").glob("archive=*/part-*"))
    assert len(files) <= 8
    assert warc.read_warc(spark, str(tmp_path / "w"), False).count() == 301


def test_archives_end_by_bytes(monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5_000)
    warc._filled.clear()
    r = random.Random(3)
    numbers = [(n, len(data)) for n, data in (warc._filed("".join(r.choices("abcdefgh", k=1000))) for _ in range(100))]
    by = {}
    for n, size in numbers:
        by[n] = by.get(n, 0) + size + 1
    assert sorted(by) == list(range(len(by))) and len(by) > 5 and max(by.values()) < 6_000
    warc._filled.clear()


def test_a_damaged_round_trip_is_an_error(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "http://a/", f"page {i}") for i in range(5)], "page_id long, url string, html string")
    write = warc.write_warc

    def damaged(pages, path, *more):
        write(pages, path, *more)
        from pathlib import Path

        file = max(Path(path).glob("archive=*/part-*"), key=lambda f: f.stat().st_size)
        data = bytearray(file.read_bytes())
        data[len(data) // 3] ^= 255
        file.write_bytes(bytes(data))
        for crc in file.parent.glob(".*.crc"):
            crc.unlink()

    monkeypatch.setattr(warc, "write_warc", damaged)
    with pytest.raises(Exception, match="gap in"):
        warc.round_trip(pages.coalesce(1)).select("payload_bytes").collect()


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    html = {1: "<p>é</p>", 2: "same text", 3: "same text", 4: None, 5: "", 6: "abc", 7: "abc", 8: "WARC/1.1\r\n\r\n" * 3, 9: "x" * 100_000}
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://h/{i} \r\n", h, "clash") for i, h in html.items()], "page_id long, url string, html string, sha string")
    rows = {r.page_id: r for r in warc.round_trip(pages.repartition(3), least).collect()}
    assert set(rows) == set(html)
    for i, h in html.items():
        data = (h or "").encode()
        first = max(j for j in html if (html[j] or "") == (h or "")) if len(data) >= least else i
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), warc.base32_sha1(data), "response" if first == i else "revisit", None if first == i else first)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_and_gaps(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record(1) + b"broken" + record(2, b"two"))
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [bytes(r.payload) if r.payload is not None else None for r in rows] == [b"<p>x</p>", None, b"two"] and rows[1].length == 6 and rows[1].quarantine


@pytest.mark.parametrize("payloads", [False, True])
def test_reading_does_not_hold_what_an_archive_inflates_to(payloads):
    data = b"".join(warc.gzip_member(record(i, b"%d " % i + b"x" * 1_000_000)) for i in range(100)) + b"junk"
    assert len(data) < 1_000_000
    spark = mock.MagicMock()
    warc.read_warc(spark, "", payloads)
    run = spark.read.format().option().load().select().mapInArrow.call_args[0][0]
    tracemalloc.start()
    try:
        seen, reasons, most = [], [], 0
        for batch in run(iter([pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([data], pa.binary())], ["path", "content"])])):
            assert batch.nbytes < 20_000_000
            seen += [(r["offset"], r["payload_bytes"], r["payload"] and len(r["payload"])) for r in batch.select(["offset", "payload_bytes", "payload"]).to_pylist()]
            reasons += batch.column("quarantine").drop_null().to_pylist()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(seen) == 101 and reasons == ["no version line"] and seen == sorted(seen, key=lambda x: x[0])
    assert [n for _, n, _ in seen[:100]] == [len(b"%d " % i) + 1_000_000 for i in range(100)]
    assert [n for _, _, n in seen[:100]] == [n if payloads else None for _, n, _ in seen[:100]]
    assert most < 40_000_000


# URLs


def judge(spark, urls, rules, **how):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", __import__("pyspark").sql.functions.lit("clash"))
    return [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, **how).orderBy("page_id").collect()]


RULES = [
    url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "x-y.org", "/a.b"),
]


@pytest.mark.parametrize("limit", [2_000, 0])
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "LITERAL_RULES", limit)
    got = judge(spark, ["http://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://example.com/de", "https://notexample.com/en/", None, "example.com/en/", "http://a.net/es/1", "http://a.net?x=/es/", "h://x-y.org/a.bc", "h://xzy.org/a.b", "http://com", "http://a.net/es/1"], RULES)
    assert got == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"), ("example.com", "/de", "com/", "allow"),
        ("notexample.com", "/en/", "com/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "/es/1", "net/es/", "block"), ("a.net", "", None, "allow"),
        ("x-y.org", "/a.bc", "x-y.org/a.b", "block"), ("xzy.org", "/a.b", None, "allow"), ("com", "", None, "allow"), ("a.net", "/es/1", "net/es/", "block"),
    ]
    assert judge(spark, ["http://a.b/"], [], default="block") == [("a.b", "/", None, "block")]


def test_rules_lie_under_their_rarest_token():
    filed = url_filter.file_rules(RULES)
    assert {t: [r.text for r in rs] for t, rs in filed.items()}["www"] == ["www.example.com/en/"]
    assert sum(map(len, filed.values())) == len(RULES)


def test_url_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = url_filter.judge_urls(pages, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
