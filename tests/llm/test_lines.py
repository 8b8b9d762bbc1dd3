"""Line dedup against brute force, over ranges that cut keys."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest

from flowbench.llm import lines

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string"


def brute(rows, min_chars=40, min_docs=5):
    order = lambda i: (i is not None, i or 0)
    key = lambda line: line.strip(SPACE).translate(FOLD)
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        stay = [p for p in parts if len(holders[key(p)]) < min_docs or i == max(holders[key(p)], key=order)]
        out.append((i, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return out


def long(name):
    return f"{name} is a line that is long enough to be looked at by everyone"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    hot = [long("the very common one"), "  " + long("THE very common ONE") + "\t\r"]
    made = []
    for k in range(400):
        parts = [rng.choice(hot)] * rng.choice([0, 0, 1, 3]) + [long(f"shared {rng.randrange(90)}") for _ in range(rng.randrange(4))] + [long(f"own {k}"), "short", "", "é" * 39, "é" * 40]
        rng.shuffle(parts)
        made.append((k, "\n".join(parts)))
    made += [(k, None) for k in range(3)] + [(900, ""), (None, long("the very common one")), (None, long("own 1")), (5, hot[0]), (5, long("a second text of one id"))]
    return made + [(1000 + k, long("four hold it")) for k in range(4)] + [(2000, "\n".join([long("four hold it"), "x"]))] * 3 + [(3000, f"{long('once')}\n" * 7)]


@pytest.mark.parametrize("ranges", [1, 3, 37])
def test_lines_against_brute_force(spark, rows, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
        found = collections.Counter(map(tuple, lines.digests(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = collections.Counter((i, n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, n, gone, text in brute(rows))
    assert found == want and sum(r[2] for r in want) > 300


def test_bitmaps_and_texts(spark, rows):
    docs = spark.createDataFrame([(i, t, "mine", 1) for i, t in rows], "doc_id long, text string, keep string, n_dropped int")
    made = {(r.doc_id, r.text_key.a): r for r in lines.keep_bitmaps(docs).collect()}
    assert all(r.n_dropped == r.n_lines - sum(k.end - k.start for k in r.keep) > 0 for r in made.values())
    out = lines.without_shared_lines(docs)
    assert out.columns == docs.columns and {(r.keep, r.n_dropped) for r in out.collect()} == {("mine", 1)}
    texts = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert texts == collections.Counter((i, None if t is None else kept) for (i, t), (_, _, _, kept) in zip(rows, brute(rows), strict=True))


def test_very_long_texts_and_empty_tables(spark):
    text = "\n".join(long(f"number {k % 7000}") for k in range(30000))
    docs = spark.createDataFrame([(k, text) for k in range(6)], SCHEMA)
    out = {r.doc_id: r for r in lines.digests(docs).collect()}
    assert [out[k].n_dropped for k in range(6)] == [30000] * 5 + [0] and out[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert lines.digests(docs.limit(0)).count() == 0 and lines.without_shared_lines(docs.limit(0)).count() == 0
