"""Collocations against brute force: overlaps, pieces, cuts, ties, languages, and supports that no shard reaches alone."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from flowbench.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, support=10, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in found.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in found.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = [*[f"w{k}" for k in range(12)], "A", "a", "É", "é x", "b-c", "🙂", "ab", "\x00"]
    made = []
    for k in range(1200):
        lang = rng.choice(["en", "de", None, "und", ""])
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "?"]) for _ in range(rng.randrange(60)))
        made.append((k, text, lang))
    made = [(k + 1000, *r[1:]) for k, r in enumerate(made)]
    return made + [(900, None, "en"), (901, "", None), (902, "a a a a a a a a a a a a a", "fr"), (903, " \t.;", "xx")] + [(910, "ten times over here", "es")] * 10 + [(920 + k, "only nine times", "es") for k in range(9)]


@pytest.mark.parametrize(("parts", "shards", "top"), [(7, 4, 2000), (3, 1, 5), (40, 10, 50)])
def test_collocations_against_brute_force(spark, rows, parts, shards, top):
    out = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(parts), shards=shards, top=top).collect()
    want = brute(rows, top=top)
    assert sorted(map(tuple, out)) == sorted(want) and len(want) > 15 and any(r[2] == "a a a" for r in want)


def test_what_no_shard_holds_often_is_found(spark):
    """Ten occurrences in as many tasks, so that a shard has no more than its proportion."""
    docs = spark.createDataFrame([(k, "rare pair" if k % 4 == 0 else f"other{k} word{k}", "en") for k in range(40)], SCHEMA).repartition(40)
    assert [(r.phrase, r.a) for r in phrases.collocations(docs).collect()] == [("rare pair", 10)]


def test_scores_beyond_64_bits(spark):
    big = [("en", "x", 4 * 10**12), ("en", "y", 3 * 10**12), ("en", "x y", 2 * 10**12 + 1), ("en", None, 10**14)]
    (row,) = phrases.scored(spark.createDataFrame(big, "lang string, phrase string, n long")).collect()
    assert row.score == 1000000 * (2 * 10**12 + 1) ** 2 // (12 * 10**24)


def test_filter_holds_all_candidates(spark):
    h = np.random.default_rng(3).integers(0, 2**64, 20000, dtype=np.uint64)
    words = phrases.filter_of(spark.createDataFrame([(int(x),) for x in h[:5000].view(np.int64)], "h long"))
    assert phrases.passes(words, h[:5000]).all() and phrases.passes(words, h[5000:]).mean() < 0.01


def test_long_and_empty(spark):
    docs = spark.createDataFrame([(1, "one two " * 200000, "en"), (2, "x " * 9, "de")], "doc_id long, text string, lang string")
    assert {(r.lang, r.phrase, r.a) for r in phrases.collocations(docs).collect()} == {("en", "one two one", 199999), ("en", "two one two", 199999)}
    clash = docs.selectExpr("*", "'mine' AS phrase", "1 AS n", "2 AS h", "3 AS shard")
    assert phrases.collocations(clash).count() == 2 and phrases.collocations(docs.limit(0)).count() == 0
