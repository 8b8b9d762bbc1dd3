"""Byte-level BPE, edits, media, sharding: against brute force and exact round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from flowbench.llm import bpe, edits, media, sharding
from flowbench.llm.queries import vocabulary

TEXTS = [None, "", "a", "Hello  world's\n\n  it''s 12345!!! é😀", " " * 700, "a" * 900, "'s " * 300 + "\t\n x" * 200, "word " * 400, "Größe ñandú 中文字符 " * 60]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "z") for k, t in enumerate(TEXTS)] + [(None, "same", "z"), (3, "same", None), (3, "same", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (64, 8), (150, 32)])
def test_encode_decode(docs, reference, chunk, overlap):
    rows = bpe.decode(bpe.encode(docs, vocabulary(), out="tokens", chunk=chunk, overlap=overlap), vocabulary(), "tokens").collect()
    assert len(rows) == docs.count() and "ids" in rows[0].asDict()
    for r in rows:
        assert list(r.tokens) == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_digests(docs, reference):
    for r in bpe.digests(docs, vocabulary()).where("doc_id < 3").collect():
        text = (TEXTS[r.doc_id] or "") if r.doc_id < 3 else ""
        ids = reference.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_decode_by_blocks(monkeypatch, reference, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    for text in (t or "" for t in TEXTS):
        ids = np.array(reference.encode_ordinary(text), np.int32)
        raw, ends = vocabulary().words.decode(ids)
        assert raw.tobytes() == text.encode() and ends.tolist() == np.cumsum([len(reference.decode_single_token_bytes(i)) for i in ids.tolist()]).tolist()


def test_encode_without_texts(docs, reference):
    rows = bpe.encode(docs.withColumn("copy", F.col("text")), vocabulary(), keep=False, chunk=150, overlap=32)
    assert rows.columns == ["doc_id", "copy", "ids"]
    assert all(list(r.ids) == reference.encode_ordinary(r["copy"] or "") for r in rows.collect())


def test_parts_begin_where_pre_tokens_do(reference):
    """Encoding by parts is encoding the whole, for all white space and whatever stands beside it."""
    import sys

    import regex

    white = regex.compile(r"\s")
    for c in map(chr, range(sys.maxunicode + 1)):
        assert not (bpe.SPACE.search(f" {c}") and white.match(c)), hex(ord(c))
    rng, words = random.Random(11), vocabulary()
    for letters in (" \t\n\x0b\x1c\x1f\x85\xa0\u3000a'", "  'sdrelvmt1!é", "  中文\u200b\u2028x ", " a"):
        for _ in range(150):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 80)))
            assert words.encode(text) == reference.encode_ordinary(text)
            assert b"".join(map(words.by_piece, words.find.findall(text))) == words.encode_bytes(text)


def test_merging_many_is_merging_each():
    rng, words = random.Random(12), vocabulary()
    letters = "".join(map(chr, range(32, 127))) + "éßñ中文😀\x00"
    pieces = [b"", b"a", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))).encode() for _ in range(800)), *(c * n for c in (b"a", b" ", b"ab") for n in (2, 63, 64, 65, 200))]
    assert [np.frombuffer(x, np.int32).tolist() for x in words.merge_many(pieces)] == [list(words.merge(x)) if x else [] for x in pieces]
    assert words.merge_many([]) == []


def test_leaves_are_runs_of_pre_tokens(reference):
    """After any edits the leaves' edges are pre-token boundaries of the whole text, however short leaves are."""
    rng, words, leaf = random.Random(13), vocabulary(), edits.LEAF
    try:
        for edits.LEAF in (1, 2, 16):
            for _ in range(60):
                letters = rng.choice(["  \n\t a", "a'' rellvesd ", "ab  '\n1!", " word is"])
                text = "".join(rng.choice(letters) for _ in range(rng.choice([3, 30, 200])))
                tree = edits.TokenTree.build(words, text)
                for _ in range(6):
                    at, removed = rng.randrange(len(text) + 1), rng.choice([0, 1, 2, 9])
                    new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 12])))
                    tree.edit(at, removed, new)
                    text = text[:at] + new + text[at + removed :]
                    ends = {m.end() for m in words.find.finditer(text)} | {0}
                    edges, where = [], 0
                    for x in tree.leaves:
                        where += len(x)
                        edges.append(where)
                    assert tree.text() == text and set(edges) <= ends
                    assert tree.ids[1] == len(reference.encode_ordinary(text))
    finally:
        edits.LEAF = leaf


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert bpe.digests(none, vocabulary()).count() == media.digests(none).count() == edits.counts(none, vocabulary()).count() == 0
    assert sharding.shard(none, sharding.topology()).count() == 0


def test_edits_follow_any_change(reference):
    rng, words = random.Random(3), vocabulary()
    for _ in range(120):
        letters = rng.choice(["ab '\n  s", "word is   it's ''re  \t\n1 2!?é", "   a"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 300, 2000])))
        tree = edits.TokenTree.build(words, text)
        for _ in range(8):
            at, removed = rng.randrange(-2, len(text) + 5), rng.choice([0, 0, 1, 5, 100, len(text)])
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 40, 1500])))
            tree.edit(at, removed, new)
            at = min(max(0, at), len(text))
            text = text[:at] + new + text[min(at + removed, len(text)) :]
            assert tree.text() == text and tree.ids[1] == len(reference.encode_ordinary(text))


def test_edit_counts(docs, reference):
    words = vocabulary()
    rows = edits.build(docs.select("doc_id", "text"), words).withColumn("edits", edits.own_edits(F.col("doc_id"), F.coalesce("text", F.lit("")), 3))
    out = edits.apply(rows, words)
    assert out.count() == docs.count()
    for r in out.collect():
        assert sum(r.leaf_ids) == len(reference.encode_ordinary(r.text)) and sum(r.leaf_chars) == len(r.text)
    assert edits.counts(docs, words).count() == docs.count()


def test_jpeg_round_trip(docs):
    payloads = [media.pad((t or "").encode()) for t in TEXTS] + [np.random.default_rng(k).integers(0, 256, 576 * k, dtype=np.uint8).tobytes() for k in (1, 2, 7)] + [bytes(576 * 400)]
    stored = media.write(payloads)
    assert [x[2].tobytes() for x in media.read(stored)] == payloads
    assert all(m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9" for m in stored)
    rows = {r.doc_id: r for r in media.digests(docs).collect()}
    raw = media.pad(TEXTS[3].encode())
    assert rows[1].payload_bytes == 576 and rows[0].payload_sha256 == rows[1].payload_sha256 and rows[0].n_bytes == 0
    assert media.digests(docs.where("doc_id = 4")).first().tail_crc32 == zlib.crc32(media.pad(TEXTS[4].encode())[-32:])
    assert len(raw) == 576


def bits(pairs):
    text = "".join(format(v, f"0{n}b") for v, n in pairs if n)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")


def colour_jpeg(luma, interval):
    """A picture of 2 by 1 sampled luminance and one colour, with AC values in between, from DC values in scan order."""
    dc = {s: (c, n) for s, c, n in media.codes(media.DC_COUNTS, bytes(range(12)))}
    ac_counts, ac_symbols = bytes([0, 2, 1] + [0] * 13), bytes([0x00, 0x01, 0xF0])
    ac = {s: (c, n) for s, c, n in media.codes(ac_counts, ac_symbols)}

    def block(diff):
        size = abs(diff).bit_length()
        return [dc[size], ((diff if diff > 0 else diff + (1 << size) - 1), size), ac[0x01], (1, 1), ac[0xF0], ac[0x01], (0, 1), ac[0x00]]

    out, units = b"", [luma[k : k + 2] for k in range(0, len(luma), 2)]
    for start in range(0, len(units), interval):
        last, codes_ = 0, []
        for unit in units[start : start + interval]:
            for v in unit:
                codes_ += block(v - last)
                last = v
            codes_ += block(0)
        out += bits(codes_) + bytes([0xFF, 0xD0 + start // interval % 8])
    head = b"\xff\xd8" + media.segment(0xDB, bytes([0] + [8] * 64)) + media.segment(0xC0, b"\x08" + (8).to_bytes(2, "big") + (16 * len(units)).to_bytes(2, "big") + b"\x02\x01\x21\x00\x02\x11\x00")
    head += media.segment(0xC4, b"\x00" + media.DC_COUNTS + bytes(range(12))) + media.segment(0xC4, b"\x10" + ac_counts + ac_symbols) + media.segment(0xDD, interval.to_bytes(2, "big"))
    return head + media.segment(0xDA, b"\x02\x01\x00\x02\x00\x00\x3f\x00") + out[:-2] + b"\xff\xd9"


@pytest.mark.parametrize("interval", [2, 3, 100])
def test_jpeg_with_colour_and_detail(interval):
    luma = [random.Random(interval).randrange(-120, 120) for _ in range(14)]
    (width, height, picture), = media.read([colour_jpeg(luma, interval)])
    assert (width, height, picture.tolist()) == (112, 8, [[v + 128 for v in luma]])


def test_media_that_is_none(spark):
    good = media.write([media.pad(b"x")])[0]
    rows = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"nope")), (3, None), (4, bytearray(good[:-9]))], "k int, media binary")
    found = {r.k: r for r in media.features(rows).collect()}
    assert found[1].width == 192 and [found[k].width for k in (2, 3, 4)] == [None] * 3


def test_sharding_law(spark):
    rows = [(k, "x" * (k % 50)) for k in range(3000)] + [(None, None), (5, "again"), (5, "again")]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), sharding.topology(), 4).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) == set(range(24))
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part))) and 60 < len(part) < 200
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {24} and 60 < len(moved) < 200
    five = out[out["doc_id"] == 5]
    assert five["shard"].nunique() == 1 and set(five["text_crc32"]) == {zlib.crc32(b"xxxxx"), zlib.crc32(b"again")}
    null = out[out["doc_id"].isna()].iloc[0]
    assert (null["size"], null["text_crc32"]) == (8, 0)


def test_weights_confine_movement(spark):
    docs = spark.createDataFrame([(k, "") for k in range(4000)], "doc_id long, text string")
    tree = sharding.topology()
    heavy = (sharding.Node("0", 12.0, tree[0].children), *tree[1:])
    a = {r.doc_id: r.shard for r in sharding.assign(docs, tree).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(docs, heavy).collect()}
    changed = [(a[k], b[k]) for k in a if a[k] != b[k]]
    assert changed and all(old >= 8 > new for old, new in changed)
