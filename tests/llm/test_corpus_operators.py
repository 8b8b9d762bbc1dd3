"""Decontamination, personal data, near copies, classifiers, pseudo-likelihood and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.llm import components, decontamination, jaccard, labelled, pii, pseudo, quality, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, n, percent):
    sets, inverted, parent = [], collections.defaultdict(list), list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (_, text) in enumerate(docs):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if x]
        size = min(n, len(w))
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if w else set())
        shared = collections.Counter(m for s in sets[k] for m in inverted[s])
        for m, v in shared.items():
            if 100 * v >= percent * (len(sets[k]) + len(sets[m]) - v):
                parent[find(k)] = find(m)
        for s in sets[k]:
            inverted[s].append(k)
    low = {}
    for k, (i, _) in enumerate(docs):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: (len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(docs)}


@pytest.fixture(scope="module")
def copies():
    rng, base = random.Random(5), [f"b{k}" for k in range(100)]
    docs = [(k, " ".join(words(rng, 60))) for k in range(40)]
    for k in range(120):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            own[rng.randrange(100)] = f"x{rng.randrange(6)}"
        docs.append((1000 + k, " ".join(own)))
    passage = " ".join(words(rng, 30))
    docs += [(2000 + k, passage + " " + " ".join(words(rng, 60))) for k in range(20)]
    return docs + [(3000, ""), (3001, None), (3002, "a"), (3003, "A"), (3004, "a b"), (3005, " \t"), (3006, "a\vb")]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_near_groups(spark, copies, n, percent):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(table(spark, copies), n, percent).collect()}
    assert found == brute(copies, n, percent)


def test_no_similar_pair_is_held_unlikely(spark):
    """What an eighth of the sets rules out is never similar; most unrelated pairs are ruled out."""
    rng = random.Random(41)
    docs = []
    for k in range(120):
        base = words(rng, rng.choice([1, 4, 30, 200, 600]))
        near = [w if rng.random() > 0.008 else "new" for w in base]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    found = jaccard.profiles(table(spark, docs).select(F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text")), "_text", 5, 80)
    reps = found.groupBy("class_id").agg(F.min("_doc_id").alias("rep"))
    source = table(spark, docs).select(F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"))
    names = {r.rep: bytes(r.class_id) for r in reps.collect()}
    ids = sorted(names)
    pairs = {tuple(sorted((names[a], names[b]))) for a in ids for b in rng.sample(ids, 12) if a != b} | {tuple(sorted((names[a], names[a + 1]))) for a in ids[:-1] if a % 2 == 0 and a + 1 in names}
    df = spark.createDataFrame(sorted(pairs), "a binary, b binary")
    maybe, sure = ({(bytes(r.a), bytes(r.b)) for r in f(df, source, reps, "_text", 5, 80).collect()} for f in (jaccard.likely, jaccard.verified))
    assert sure <= maybe <= pairs and len(sure) > 40 and len(maybe) < len(pairs) / 4, (len(sure), len(maybe), len(pairs))


def test_one_of_each(spark, copies):
    docs = table(spark, copies)
    kept = jaccard.one_of_each(docs.unionByName(docs.limit(5)).withColumn("class_id", F.lit(1)))
    expected = {low for _, low in brute(copies, 5, 80).values()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected) and kept.columns == [*docs.columns, "class_id"]
    odd = table(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, "q r s t u v"), (1, "other words stand here for once")])
    assert sorted((r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(odd).collect()) == [(0, ""), (0, "a b c d e f"), (1, "other words stand here for once"), (1, "q r s t u v")]
    assert jaccard.one_of_each(odd.limit(0)).count() == jaccard.components(odd.limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}


def test_leaks(spark):
    rng = random.Random(2)
    items = [(k, " ".join(words(rng, 20 + k))) for k in range(6)] + [(90, "too short"), (91, None)]
    near = items[5][1].split()
    near[-1] = "changed"
    docs = [(k, " ".join(words(rng, 80))) for k in range(30)] + [(50, " ".join(words(rng, 40)) + " " + items[3][1].upper() + ", " + " ".join(words(rng, 9))), (51, items[4][1]), (52, " ".join(near)), (53, None), (54, ""), (55, " ".join(items[2][1].split()[:9])), (51, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.leaks(table(spark, docs), bench)
    assert sorted((r.doc_id, r.item_id, r.start) for r in found.collect()) == [(50, 3, 40), (51, 4, 0), (51, 4, 0), (52, 5, 0)]
    kept = decontamination.clean(table(spark, docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), 53, 54, 55] and kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert decontamination.leaks(table(spark, docs), bench.limit(0)).count() == 0
    assert decontamination.leaks(table(spark, docs).limit(0), bench).count() == 0


def weighed(words_, n=5):
    return {tuple(words_[k : k + n]): sum(map(len, words_[k : k + n])) for k in range(len(words_) - n + 1)}


def similarity(a, b):
    x, y = weighed(a), weighed(b)
    shared = sum(w for s, w in x.items() if s in y)
    return shared / (sum(x.values()) + sum(y.values()) - shared) if x or y else 0.0


def altered(rng, item):
    """An item with words replaced, put in, taken out, cut off or its two parts swapped."""
    e, kind = list(item), rng.randrange(5)
    if kind == 0:
        for _ in range(rng.choice([1, 2])):
            e[rng.randrange(len(e))] = f"n{rng.randrange(9999)}"
    elif kind == 1:
        at = rng.randrange(len(e))
        e[at:at] = [f"n{rng.randrange(9999)}" for _ in range(rng.choice([1, 2, 3]))]
    elif kind == 2:
        at = rng.randrange(len(e))
        del e[at : at + rng.choice([1, 2])]
    elif kind == 3:
        cut = rng.randrange(1, 5)
        e = e[cut:] if rng.random() < 0.5 else e[:-cut]
    else:
        at = rng.randrange(5, len(e) - 5)
        e = e[at:] + e[:at]
    return e


@pytest.mark.parametrize(("radius", "least_recall"), [(decontamination.RADIUS, 0.95), (28, 1.0)])
def test_windows_against_brute_force(spark, radius, least_recall):
    """Of all windows of all texts: nothing is found that is not similar, and what is similar is found."""
    rng = random.Random(21)
    items = [words(rng, rng.randrange(18, 60)) for _ in range(8)]
    docs = [(k, words(rng, 60)) for k in range(20)]
    for k in range(420):
        a, b = words(rng, rng.randrange(0, 50)), words(rng, rng.randrange(0, 50))
        docs.append((100 + k, a + altered(rng, rng.choice(items)) + b))
    truth = {}
    for i, text in docs:
        for j, item in enumerate(items):
            n = len(item)
            best = max(similarity(text[s : s + n], item) for s in range(max(1, len(text) - n + 1)))
            if best >= 0.8:
                truth[i, j] = best
    bench = spark.createDataFrame([(j, " ".join(item)) for j, item in enumerate(items)], "item_id long, text string")
    rows = decontamination.hits(table(spark, [(i, " ".join(t)) for i, t in docs]), bench, radius=radius)
    keyed = table(spark, [(i, " ".join(t)) for i, t in docs]).select("doc_id", pii.text_key(F.col("text")))
    found = {(r.doc_id, r.item_id): r for r in rows.join(keyed, "text_key").collect()}
    assert len(truth) > 90 and set(found) <= set(truth) and len(found) >= least_recall * len(truth)
    texts = dict(docs)
    for (i, j), r in found.items():
        assert r.similarity == pytest.approx(similarity(texts[i][r.start : r.start + r.n_words], items[j])) and r.hamming <= radius
        assert r.similarity == pytest.approx(truth[i, j]) or radius < 28


def test_unrelated_windows_seldom_meet():
    """Rows of the block join for a pair of unrelated fingerprints, as blocks of equal bits give them."""
    edges = [64 * k // (decontamination.RADIUS + 1) for k in range(decontamination.RADIUS + 2)]
    assert sum(2.0 ** (a - b) for a, b in zip(edges, edges[1:], strict=False)) < 0.5


def test_leaks_in_long_and_repeated_texts(spark):
    rng = random.Random(22)
    item = words(rng, 30)
    long_ = words(rng, 30000) + item + words(rng, 200) + item
    docs = [(1, " ".join(long_)), (2, " ".join(item * 3)), (2, " ".join(item * 3)), (3, " ".join(item[:29])), (None, " ".join(item)), (4, "\x00 " + " ".join(item).upper())]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (None, "a b"), (9, "")], "item_id long, text string")
    own = table(spark, docs).withColumn("text_key", F.lit("mine")).withColumn("start", F.lit(0))
    found = collections.Counter((r.doc_id, r.item_id, r.start) for r in decontamination.leaks(own, bench).collect())
    assert found == {(i, j, s): n for i, s, n in ((1, 30000, 1), (2, 0, 2), (3, 0, 1), (None, 0, 1), (4, 0, 1)) for j in (7, 8)}
    kept = decontamination.clean(own.unionByName(own.limit(1).withColumn("text", F.lit("clean"))), bench)
    assert [r.text for r in kept.collect()] == ["clean"] and kept.columns == own.columns


def test_sieve_loses_no_row(spark):
    rng = random.Random(23)
    held = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    other = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    seen = spark.createDataFrame([(h, k) for k, h in enumerate(held + other)], "h long, _cell int").unionByName(spark.createDataFrame([(None, -1)], "h long, _cell int"))
    items = spark.createDataFrame([(h,) for h in [*held, held[0], None]], "h long")
    found = decontamination.sieved(seen, items)
    kept = {r["_cell"] for r in found.collect()}
    size = 1 << decontamination.SIEVE
    assert found.columns == seen.columns and kept == {k for k, h in enumerate(held + other) if h % size in {x % size for x in held}}


def test_a_million_shingles_of_items(spark):
    """More shingles than are broadcast: the sieve stands before the join, and what was planted is found."""
    word = "concat('w', conv(substr(sha1(concat(id, ' ', k)), 1, 6), 16, 36))"
    bench = spark.range(25000).withColumnRenamed("id", "id_").selectExpr("id_ AS id", "explode(sequence(0, 43)) AS k").selectExpr("id", f"struct(k, {word} AS w) AS w")
    bench = bench.groupBy("id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("w")), lambda x: x["w"])).alias("text")).withColumnRenamed("id", "item_id")
    planted = bench.where("item_id % 2500 = 7").select((F.col("item_id") + 100000).alias("doc_id"), F.concat(F.lit("some words before "), "text", F.lit(" and after")).alias("text"))
    rng = random.Random(24)
    docs = planted.unionByName(spark.createDataFrame([(k, " ".join(words(rng, 80))) for k in range(40)], "doc_id long, text string"))
    found = {(r.doc_id, r.item_id, r.start, r.similarity) for r in decontamination.leaks(docs, bench).collect()}
    assert found == {(100000 + i, i, 3, 1.0) for i in range(7, 25000, 2500)}


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(0, 21)):
            b ^= 1 << k
        rows.append((a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(rows, "a long, b long").select(decontamination.blocks("a", 20).alias("x"), decontamination.blocks("b", 20).alias("y"))
    assert df.where(F.size(F.array_intersect("x", "y")) == 0).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sound(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_base_spans(spark):
    rng = random.Random(4)
    docs = [(1, None), (2, ""), (3, "x@y.z_a@b.c-d.e.f@g.hh 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4444 0001.2.3.255"), (4, "😀 é a@b.co 4111 1111 1111 1111 +1 (222) 333-4444 +12 3 4111-1111-1111-1112 +1.2.3.4.5.6.7.8 12345678901234567890123"), (5, "a@b" + ".c" * 4000 + " " + "z" * 20000 + " " + "1" * 5000), (6, ".@b.c. %+a@-.-x")]
    docs += [(100 + k, "".join(rng.choice("ab@@..-_ +(1234567890") for _ in range(rng.randrange(5, 120)))) for k in range(400)]
    for r in pii.digests(table(spark, docs)).collect():
        text = dict(docs)[r.doc_id] or ""
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if sound(k, m[0])]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.spans.startswith(listed)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in BASE]


def test_disclosing_terms(spark):
    docs = [(k, f"lead word{k} Zorblax mail jo@ex.com and q{k} the end") for k in range(4)] + [(100 + k, f"and the lead of plain words {k}") for k in range(60)] + [(999, "Zorblax alone with other@ex.com"), (0, None)]
    out = pii.sanitise(table(spark, docs))
    texts = {r.doc_id: r.text for r in out.where("doc_id in (1, 100, 999)").collect()}
    assert texts[1] == "lead word1 [WORD] [REMOVED] [EMAIL] and q1 the end" and texts[100] == docs[4][1]
    assert texts[999] == "Zorblax alone with [EMAIL]" and out.count() == len(docs)
    assert pii.sanitise(table(spark, docs).limit(0)).count() == 0


def test_terms_far_from_a_mention_disclose(spark):
    far = " ".join(["plain words that all texts hold"] * 20)
    docs = [(k, f"Zorblax wrote: {far} agent77 mail jo@ex.com {far} so Zorblax") for k in range(4)]
    docs += [(4, f"Kwyjibo {far} la@ex.com"), (5, f"agent77 {far}"), *((100 + k, f"wrote mail {far}") for k in range(2000))]
    texts = {r.doc_id: r.text for r in pii.sanitise(table(spark, docs)).where("doc_id < 6").collect()}
    assert texts[0] == texts[3] == f"[REMOVED] wrote: {far} [CODE] mail [EMAIL] {far} so [REMOVED]"
    assert texts[4] == f"[WORD] {far} [EMAIL]" and texts[5] == docs[5][1]


def test_copies_of_a_row_are_numbered_apart(spark):
    docs = table(spark, [(None, "one text")]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40000)))).drop("copy")
    out = sharding.shard(docs.unionByName(table(spark, [(k, f"t{k}") for k in range(500)])), sharding.topology(3, 2, 4), 8)
    found = out.groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert all(r.a == 0 and r.b + 1 == r.n == r.rows for r in found) and sum(r.rows for r in found) == 40500
    assert "_copies" in out._jdf.queryExecution().optimizedPlan().toString()  # numbered once, not copy by copy


def test_quality(spark):
    rng = random.Random(6)
    docs = [(k, " ".join(words(rng, 60, 300)) if k % 4 else "BUY!! " + " ".join(f"{w.upper()}!!" for w in words(rng, 40))) for k in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(300)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.classify(table(spark, docs), labels).collect()
    assert len(rows) == 302 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.doc_id % 4 > 0) for r in rows if r.doc_id < 300)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    plain = quality.classify(table(spark, docs), labels.limit(0)).collect()
    assert {r.score for r in plain} == {0.5}


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["grumble", "snarlish", "snarling"]
    docs = [(k, " ".join([*words(rng, 50, 300), *([rng.choice(bad), rng.choice(bad)] if k % 5 == 0 else [])])) for k in range(400)] + [(900, None), (901, ""), (902, "snarlier")]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.classify(table(spark, docs), labels).collect()}
    assert all(r.predicted == (k % 5 == 0) for k, r in rows.items() if k < 400) and rows[0].evidence and rows[0].neighbours
    assert rows[900].score == rows[901].score < 0.5 and rows[902].predicted == 1
    none = toxicity.classify(table(spark, docs), labels.limit(0)).collect()
    assert len(none) == len(docs) and {r.predicted for r in none} == {0}


def test_toxicity_without_telling_terms(spark):
    """Alike texts, no toxic ones, no words at all, one label: every text is scored, and nothing breaks."""
    alike = [(k, "the same words again") for k in range(20)] + [(30, None), (31, " 12 !"), (32, "Ω" * 30), (33, "word " * 40000)]
    for labels in ([(k, 1, k % 2) for k in range(20)], [(k, 1, 0) for k in range(20)], [(31, 1, 1), (30, 1, 0)], [(5, 1, 1)]):
        table_ = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        rows = {r.doc_id: r for r in toxicity.classify(table(spark, alike), table_).collect()}
        assert len(rows) == 24 and all(0 <= r.score <= 1 for r in rows.values()) and len({rows[k].score for k in range(20)}) == 1
    again = table(spark, [*alike, (3, "another text"), (3, "the same words again")])
    assert toxicity.classify(again, table_).count() == 26 and toxicity.classify(again.limit(0), table_).count() == 0
    own = again.withColumn("score", F.lit(42.0)).withColumn("evidence", F.lit("mine"))
    out = toxicity.score(own, toxicity.learn(own, table_), names=("_score", "_near", "_cosines", "_evidence"))
    assert {(r.score, r.evidence) for r in out.collect()} == {(42.0, "mine")}


def test_every_term_of_the_examples_is_searched(spark):
    """The nearest are those of whole TF-IDF vectors, by brute force; held-out examples are told apart."""
    rng = random.Random(17)
    docs = [(k, " ".join([*words(rng, rng.randrange(1, 80), 400), *(["grumblish"] * 2 if k % 6 == 0 else [])])) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(table(spark, docs), labels)
    texts = dict(docs)
    examples = [model.near([texts[i]]) for i in model.ids.tolist()]
    vectors = [dict(zip(*map(np.ndarray.tolist, v), strict=True)) for (_, _, v), in examples]
    held = [t for i, t in docs if i not in set(model.ids.tolist())]
    assert len(held) > 150 and {t for v in vectors for t in v} == set(range(len(model.names)))
    for text in held[:60]:
        (_, (cosines, found), v), = model.near([text])
        query = dict(zip(*map(np.ndarray.tolist, v), strict=True))
        brute_ = sorted(((-round(sum(w * query.get(t, 0.0) for t, w in x.items()), 6), k) for k, x in enumerate(vectors)))[:15]
        assert np.allclose(cosines, [-c for c, _ in brute_], atol=1e-5)
    rows = {r.doc_id: r for r in toxicity.classify(table(spark, docs), labels).collect()}
    assert all(r.predicted == (k % 6 == 0) for k, r in rows.items() if r.held_out)


def test_sample_is_bounded_in_bytes(spark):
    docs = table(spark, [(k, "x" * 1000) for k in range(300)] + [(k, "y") for k in range(100)])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    rows = labelled.sample(docs, labels, "quality", 4, 2, 5000, 50_000).collect()
    assert 50 <= len(rows) <= 52 and {r.text[0] for r in rows} == {"x"}
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.doc_id)] == sorted({r.doc_id for r in rows})


def test_index_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        v = {int(t): float(w) for t, w in zip(rng.choice(40, 5, replace=False), rng.random(5), strict=True)}
        size = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / size for t, w in v.items()})
    index = toxicity.Index.build(vectors, 40)
    for k in range(60):
        cosines = [round(sum(w * v.get(t, 0.0) for t, w in vectors[k].items()), 12) for v in vectors]
        best = sorted(((-c, i) for i, c in enumerate(cosines) if c > 0 and i != k))[:10]
        assert [i for _, i in index.nearest(vectors[k], 10, without=k)] == [i for _, i in best]


def test_sample_leaves_the_held_out_fold(spark):
    docs = table(spark, [(k, "x") for k in range(200)])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    rows = labelled.sample(docs, labels, "quality", 4, 2, 50)
    assert rows.count() == 50 and rows.where(labelled.held_out(F.col("doc_id"), 4, 2)).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(1)
    net = pseudo.Network()
    ids = np.concatenate([[pseudo.PAD] * 2, rng.integers(0, pseudo.WORDS, 40), [pseudo.PAD] * 2])
    at = np.arange(2, 42)
    grads = net.gradients(ids, at)
    for name, spot in (("a1", (int(ids[4]) // pseudo.HALF,)), ("u2", (int(ids[4]) % pseudo.HALF, 3)), ("c", (int(ids[5]) // pseudo.HALF, 2)), ("b", (1,))):
        view, old = getattr(net, name), getattr(net, name)[spot]
        sides = []
        for step in (1e-2, -1e-2):
            view[spot] = old + step
            sides.append(-net.log_likelihood(ids, at).mean())
        view[spot] = old
        assert grads[name][spot] == pytest.approx((sides[0] - sides[1]) / 2e-2, abs=2e-4)


def test_pseudo_likelihood(spark):
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice(["the cat sat on the mat", "a dog ran in the park"]) for _ in range(30))) for k in range(60)] + [(100, " ".join(sorted("the cat sat on the mat".split() * 30))), (101, None), (102, " ")]
    rows = {r.doc_id: r for r in pseudo.pseudo_likelihood(table(spark, docs)).collect()}
    assert len(rows) == len(docs) and rows[0].n_words == 180 and rows[101].log_likelihood == rows[102].log_likelihood == 0
    assert min(rows[k].mean_log_likelihood for k in range(60)) > rows[100].mean_log_likelihood
    assert pseudo.pseudo_likelihood(table(spark, docs).limit(0)).count() == 0


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    """One table in two layouts, trained in several parts: the same scores but for rounding. Null rows and copies included."""
    monkeypatch.setattr(pseudo, "PART", 3000)
    rng = random.Random(31)
    docs = table(spark, [(k, " ".join(words(rng, rng.randrange(0, 120), 60))) for k in range(200)] + [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, None), (300, "w5 " * 70000)])
    rows = [pseudo.pseudo_likelihood(d).collect() for d in (docs.coalesce(1), docs.repartition(7, "text"))]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, round(r.log_likelihood, 1))
    a, b = (sorted(x, key=key) for x in rows)
    assert len(a) == 204 and [(r.doc_id, r.n_words) for r in a] == [(r.doc_id, r.n_words) for r in b]
    assert np.allclose([r.log_likelihood for r in a], [r.log_likelihood for r in b], rtol=1e-4, atol=1e-3)


def test_steps_follow_the_gradients():
    """A step over ordered places hands each context's rows what rows summed one by one get."""
    rng = np.random.default_rng(2)
    ids, at = pseudo.joined([rng.integers(0, 30, n).astype(np.int32) for n in (5, 0, 1, 40)], pseudo.PAD)
    plain, trained = pseudo.Network(), pseudo.Trainer(pseudo.Network())
    dh = plain.gradients(ids, at)["h"]
    trained.step(ids, at)
    for k, o in enumerate(pseudo.OFFSETS):
        g = np.zeros_like(plain.e[k])
        np.add.at(g, ids[at + o], dh)
        assert np.allclose(trained.network.e[k], plain.e[k] - pseudo.RATE * g / np.sqrt(1e-6 + g * g), atol=1e-5)


def test_vocabulary_grows_with_the_corpus(spark):
    rng = random.Random(10)
    small, large = ([(k, " ".join(f"w{rng.randrange(size)}" for _ in range(400))) for k in range(n)] for size, n in ((500, 50), (5000, 1000)))
    few, many = (pseudo.vocabulary(pseudo.word_counts(table(spark, d))) for d in (small, large))
    assert len(few) == 500 and len(many) > 4096 and pseudo.half_of(len(many)) ** 2 > len(many)


def test_rare_words_have_probabilities_of_their_own(spark):
    common = " ".join(["the cat sat on the mat"] * 40)
    frequent = ["rareword"] * 9
    docs = [(k, common) for k in range(200)] + [(1000 + k, w) for k, w in enumerate(frequent)]
    probe = next(f"x{k}" for k in range(100000) if pseudo.zlib.crc32(f"x{k}".encode()) % (64 * 64 - 5) == pseudo.zlib.crc32(b"rareword") % (64 * 64 - 5))
    rows = {r.doc_id: r for r in pseudo.pseudo_likelihood(table(spark, [*docs, (2000, probe)])).collect()}
    assert rows[1000].log_likelihood - rows[2000].log_likelihood == pytest.approx(np.log(9), abs=1e-3)
    assert len(rows) == 210 and rows[0].n_words == 240


def test_shares_are_sent_or_joined(spark, monkeypatch):
    """However many words' shares are sent, scores are the same; frequent words' are sent first, and only the rest is joined."""
    rng = np.random.default_rng(5)
    docs = table(spark, [(k, " ".join(f"w{n}" for n in (rng.pareto(0.6, 200) * 5).astype(int) % 30000)) for k in range(200)])
    counts = pseudo.word_counts(docs)
    known = pseudo.vocabulary(counts)
    rare, scores = {r.word: r.n for r in pseudo.rare_words(counts, known).collect()}, []
    for most in (0, 100, 1 << 18):
        monkeypatch.setattr(pseudo, "SENT", most)
        sent, shares, rest = pseudo.parted(pseudo.rare_words(counts, known))
        rest = {r.word for r in rest.collect()}
        assert len(sent) == len(shares) <= most and set(sent) | rest == set(rare) and len(sent) + len(rest) == len(rare)
        assert min((rare[w] for w in sent), default=0) > max((rare[w] for w in rest), default=0) or not sent
        rows = pseudo.coded(docs, known, sent, shares).collect()
        assert {w for r in rows for w in r[pseudo.RARE]} == rest and bool(sent) == bool(most)
        scores.append([r.log_likelihood for r in sorted(pseudo.pseudo_likelihood(docs).collect())])
    assert np.allclose(scores[0], scores[1]) and np.allclose(scores[0], scores[2])


@pytest.mark.parametrize("large", [False, True])
def test_blocks_of_a_step(monkeypatch, large):
    """A step's gradients and the scores do not depend on the blocks, and are finite where logits are large."""
    rng = np.random.default_rng(4)
    ids, at = pseudo.joined([rng.integers(0, 4096, n).astype(np.int32) for n in (300, 1, 70)], pseudo.PAD)
    net = pseudo.Network()
    net.a1[...] += 200 * large
    found = []
    for size in (7, 128, 1 << 10):
        monkeypatch.setattr(pseudo, "ROWS", size)
        found.append((net.gradients(ids, at), net.log_likelihood(ids, at)))
    for grads, scores in found:
        assert np.isfinite(scores).all() and np.allclose(scores, found[0][1], atol=1e-4)
        assert all(np.isfinite(g).all() and np.allclose(g, found[0][0][k], atol=1e-6) for k, g in grads.items())


def test_near_copies_go_to_workers_in_small_batches(spark, monkeypatch):
    """The stage's tables are written in batches of 4 MB, and the setting is as before afterwards."""
    name, seen, plain = "spark.sql.execution.arrow.maxBytesPerBatch", [], jaccard.saved
    before = spark.conf.get(name, None)
    monkeypatch.setattr(jaccard, "saved", lambda df: seen.append(spark.conf.get(name, None)) or plain(df))
    docs = table(spark, [(k, "one two three four five six seven") for k in range(3)] + [(3, "a b c d e f g h"), (4, None)])
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [0, 3, 4]
    assert seen[0] == seen[1] == str(4 << 20) and spark.conf.get(name, None) == before


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    item = " ".join(words(rng, 25))
    docs = [(k, " ".join([*words(rng, 60), *(["grumble", "grumble"] if k % 5 == 0 else [])])) for k in range(150)]
    docs += [(500, docs[1][1]), (501, docs[2][1] + " tail"), (502, item + " and more words here"), (503, "mail me at jo@ex.com please now"), (504, None)]
    table(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [*(k for k in range(150) if k % 5), 503, 504] and all(r.round_trip for r in rows.values())
    assert rows[504].n_tokens == 0 and rows[503].n_tokens > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "byte_level_bpe"]
