"""Nulls, empty and very long texts, repeated rows, clashing names and empty tables, for every operator and stage."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from flowbench.llm import bpe, decontamination, edits, jaccard, media, pii, pseudo, quality, sharding, toxicity
from flowbench.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long text of words " * 20000
ROWS = [(1, "some words stand here"), (1, "some words stand here"), (1, "other words for one id"), (2, None), (2, ""), (None, None), (None, "no id here at all"), (3, LONG), (4, LONG), (5, "😀 \x00 é"), (6, " \t\n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")


def clashing(df):
    """Extra columns with names that operators use themselves."""
    taken = ("score", "ids", "decoded", "slot", "shard", "text_key", "_row", "_ids", "class_id", "component_id", "media", "leaf_ids", "n_words", "spans", "terms", "h", "pos", "rep", "label", "held_out", "_digest", "_text_key", "count")
    return df.select("*", *[F.lit("mine").alias(c) for c in taken])


def ids(df):
    return collections.Counter(r.doc_id for r in df.select("doc_id").collect())


QUERIES = {
    "op1": lambda d, l, b: decontamination.leaks(d, b), "op2": lambda d, l, b: sharding.shard(d, sharding.topology(), 3), "op3": lambda d, l, b: media.digests(d),
    "op4": lambda d, l, b: edits.counts(d, vocabulary()), "op5": lambda d, l, b: pseudo.pseudo_likelihood(d), "op6": lambda d, l, b: quality.classify(d, l),
    "op7": lambda d, l, b: bpe.digests(d, vocabulary()), "op8": lambda d, l, b: jaccard.components(d), "op9": lambda d, l, b: toxicity.classify(d, l), "op10": lambda d, l, b: pii.digests(d),
}


@pytest.mark.parametrize("name", QUERIES)
def test_every_row_has_its_result(spark, docs, labels, name):
    """All rows come back, equal texts have equal results, and extra columns don't matter; empty tables give none."""
    bench = spark.createDataFrame([(9, "long text of words long text of words"), (10, None)], "item_id long, text string")
    out = QUERIES[name](clashing(docs), labels, bench)
    expected = collections.Counter(i for i, _ in ROWS) if name != "op1" else {3: 1, 4: 1}
    assert ids(out) == expected
    for empty in (docs.limit(0), clashing(docs).limit(0)):
        assert QUERIES[name](empty, labels, bench).count() == QUERIES[name](empty, labels.limit(0), bench.limit(0)).count() == 0


def test_classifiers_without_documents_or_labels(docs, labels):
    for f in (quality.classify, toxicity.classify):
        plain = f(docs, labels.limit(0)).collect()
        assert len(plain) == len(ROWS) and {r.score for r in plain} == {0.5} and {r.predicted for r in plain} == {0}


def test_spans_that_touch_and_overlap(spark):
    """Marks of spans of several kinds in one place: the first to start, of equal starts the longest, gives the mark."""
    text = "a1.2.3.4@b.co 1.2.3.4+1.2.3.4.5.6.7.8 x 4111111111111111@x.yz +4111111111111111"
    rows = spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string").withColumn("spans", F.lit("mine"))
    out = pii.sanitise(rows).collect()
    assert len(out) == 3 and {r.spans for r in out} == {"mine"} and [r.text for r in out if r.doc_id == 2] == [None]
    assert {r.text for r in out if r.doc_id == 1} == {"[EMAIL] [IP][PHONE] x [EMAIL] +[CARD]"}


def test_null_keys_and_texts_share_a_shard(docs):
    rows = sharding.shard(docs, sharding.topology(), 3).collect()
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 2} == {(8, 0)} and len({(r.shard, r.slot) for r in rows}) == len(ROWS)


def test_stages_of_the_pipeline(spark, docs, labels, tmp_path):
    """Each stage keeps columns and clean rows of odd tables, and takes empty ones; copies go but for one."""
    import corpus_pipeline

    bench = [(9, "one item of the benchmark stands here in full"), (10, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.where("doc_id = 1").withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    rows = clashing(docs.unionByName(docs.limit(1).withColumn("text", F.lit(f"see {bench[0][1]} now")).withColumn("doc_id", F.lit(50).cast("long"))))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, rows, str(tmp_path))
        if name != "byte_level_bpe":
            assert out.columns == rows.columns and {r.score for r in out.collect()} == {"mine"}
        found = ids(out)
        if name == "ngram_jaccard_join":
            assert found == {1: 2, 2: 2, None: 2, 3: 1, 5: 1, 6: 1, 50: 1}
        elif name == "benchmark_decontamination":
            assert found == ids(rows.where("doc_id IS NULL OR doc_id <> 50"))
        else:
            assert found == ids(rows), name


def test_edits_of_very_long_texts(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab  \n'1") for _ in range(60000))
    out = edits.counts(spark.createDataFrame([(1, text), (2, "a" * 30000)], "doc_id long, text string"), vocabulary()).collect()
    assert len(out) == 2 and all(r.tokens_after > 0 and r.reencoded > 0 for r in out)
