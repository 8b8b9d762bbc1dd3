"""Collocations: phrases of two or three words whose parts rarely stand without each other, exactly, by SON partitioning.

The documents are dealt into shards. Each shard is mined completely at a support lowered in proportion: a phrase that
occurs ``support`` times in all occurs support / shards times in one of them at least, so the union of what shards find
frequent misses nothing. Only hashes are counted there. A second pass counts the union's phrases over all documents, by
their words, exactly; a Bloom filter of fixed size tells tasks which phrases those are (one that it takes for a candidate
by mistake is counted and falls below the support). Tasks count phrases in numpy, chunk by chunk, before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.llm.common import saved, slices

SUPPORT, SHARDS, TOP = 10, 4, 2000
#: Text that a task counts at once, in bytes; a longer text is a chunk of its own.
CHUNK = 1 << 22
#: Phrases of chunks that a task adds up before it hands them on, and ranges of hashes for each shuffle partition.
PAIRS, BUCKETS = 1 << 20, 8
#: Bits of the candidates' filter and bits a candidate sets. It costs 16 MB; on larger corpora it lets more phrases through.
FILTER_BITS, FILTER_HASHES, STRIDE = 1 << 27, 4, 12
#: Fixed kinds of bytes: 0 of a word, 1 between words, 2 between pieces.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """One hash of two, in order."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of texts, A-Z in lower case, and whether each stands in one piece with the word before it.

    Separators are ASCII, so bytes of UTF-8 decide as characters do.
    """
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kinds = KINDS[data]
    inside = kinds == 0
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    piece = np.cumsum(kinds == 2, dtype=np.int32)[starts]
    offsets = np.concatenate((np.cumsum(inside, dtype=np.int32)[starts] - 1, [np.count_nonzero(inside)])).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words.dictionary_encode(), np.concatenate((np.zeros(min(len(piece), 1), bool), piece[1:] == piece[:-1]))


def phrases_of(texts: list[bytes], lang: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array]]]:
    """Phrases of one, two and three words in texts of one language: their hashes, counts and words."""
    coded, joined = words_of(texts)
    ids, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if not len(ids):
        return
    salt, own = (pd.util.hash_array(np.array(w, object), categorize=False) for w in ([lang], names.to_pylist()))
    size = len(names)
    yield mixed(mixed(salt, np.uint64(1)), own), np.bincount(ids, minlength=size), [names]
    at = np.flatnonzero(joined[1:])
    pairs, place, counts = np.unique(ids[at] * size + ids[at + 1], return_inverse=True, return_counts=True)
    first, second = pairs // size, pairs % size
    both = mixed(own[first], own[second])
    yield mixed(mixed(salt, np.uint64(2)), both), counts, [names.take(pa.array(i)) for i in (first, second)]
    longer = np.flatnonzero(at[1:] == at[:-1] + 1)
    triples, counts = np.unique(place[longer] * size + ids[at[longer] + 2], return_counts=True)
    pair, last = triples // size, triples % size
    yield mixed(mixed(salt, np.uint64(3)), mixed(both[pair], own[last])), counts, [names.take(pa.array(i)) for i in (first[pair], second[pair], last)]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts by language in chunks of about CHUNK bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text) + 64
            if size >= CHUNK:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, each once, with the sums of their counts."""
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h, n = h[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n, first) if len(first) else n


def mine(shards: int, buckets: int):  # noqa: ANN201
    """A mapInArrow function: ``bucket, shard, h, n`` of a task's phrases, whose documents are of one shard.

    A row holds the hashes of one range and their counts, as bytes, so that what is shuffled is a few rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, size = TaskContext.get().partitionId() % shards, [], 0
        edges = [(k << 64) // buckets for k in range(1, buckets)]

        def flush() -> pa.RecordBatch:
            h, n = merged(parts)
            n = n.astype(np.int32)
            at = [0, *np.searchsorted(h, np.array(edges, np.uint64)).tolist(), len(h)]
            full = [k for k in range(buckets) if at[k] < at[k + 1]]
            cut = lambda x: pa.array([x[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([shard] * len(full), pa.int32()), cut(h), cut(n)], names=["bucket", "shard", "h", "n"])

        for lang, texts in chunks(batches):
            for h, n, _ in phrases_of(texts, lang):
                parts.append((h, n.astype(np.int32)))
                size += len(h)
            if size >= PAIRS:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    return run


def frequent_in_shards(support: int):  # noqa: ANN201
    """A mapInArrow function over mine()'s rows in order of bucket and shard: ``h`` of phrases that a shard finds frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, found = None, [], []

        def mined() -> np.ndarray:
            h, n = merged(parts)
            return h[n >= support]

        def union() -> Iterator[pa.RecordBatch]:
            yield from cut_up(pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64))], names=["h"]))

        for batch in batches:
            for bucket, shard, h, n in zip(*[batch.column(c).to_pylist() for c in ("bucket", "shard", "h", "n")], strict=True):
                if own != (bucket, shard):
                    if own is not None:
                        found.append(mined())
                        if own[0] != bucket:
                            yield from union()
                            found = []
                    own, parts = (bucket, shard), []
                parts.append((np.frombuffer(h, np.uint64), np.frombuffer(n, np.int32)))
        if own is not None:
            found.append(mined())
            yield from union()

    return run


def cut_up(batch: pa.RecordBatch, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A batch in slices that the JVM takes one by one."""
    for k in range(0, batch.num_rows, most):
        yield batch.slice(k, most)


def filter_words(h: Column) -> Column:
    """array<struct<word,bit>>: where a candidate's bits are."""
    at = [F.shiftrightunsigned(h, STRIDE * k).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(FILTER_HASHES)]
    bit = lambda a: F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int"))
    return F.array(*[F.struct(F.shiftright(a, 6).cast("int").alias("word"), bit(a).alias("bit")) for a in at])


def filter_of(candidates: DataFrame) -> np.ndarray:
    """The candidates' Bloom filter: at most FILTER_BITS / 64 rows come to the driver, whatever the input."""
    rows = candidates.select(F.explode(filter_words(F.col("h"))).alias("x")).groupBy("x.word").agg(F.bit_or("x.bit").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def passes(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through."""
    out = np.ones(len(h), bool)
    for k in range(FILTER_HASHES):
        at = (h >> np.uint64(STRIDE * k)) & np.uint64(FILTER_BITS - 1)
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return out


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> DataFrame:
    """``lang, phrase, n`` of all phrases of one to three words that occur ``support`` times or more, and, with a null phrase, all words of each language.

    A null lang is ``und``, a null text is empty. Repeated rows count as often as they stand there.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = rows.mapInArrow(mine(shards, buckets), "bucket int, shard int, h binary, n binary").repartition("bucket").sortWithinPartitions("bucket", "shard")
    union = saved(local.mapInArrow(frequent_in_shards(-(-support // shards)), "h long"))
    words = docs.sparkSession.sparkContext.broadcast(filter_of(union))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])
            yield from table.to_batches(max_chunksize=1 << 16)

        for lang, texts in chunks(batches):
            for k, (h, n, parts) in enumerate(phrases_of(texts, lang)):
                if k == 0:
                    held.append(pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([int(n.sum())])], names=["lang", "phrase", "n"]))
                stay = pa.array(np.flatnonzero(passes(words.value, h)))
                phrase = pa.compute.binary_join_element_wise(*[p.take(stay) for p in parts], " ")
                held.append(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(phrase)), phrase, pa.array(n).take(stay).cast(pa.int64())], names=["lang", "phrase", "n"]))
                size += len(phrase)
            if size >= PAIRS // 2:
                yield from summed()
                held, size = [], 0
        if held:
            yield from summed()

    counts = rows.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return saved(counts.where(F.col("phrase").isNull() | (F.col("n") >= support)))


def scored(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, k, a, l, r, score`` of the candidates of frequent_phrases(), by their lowest-scoring cut."""
    w, size = F.split("phrase", " ", -1), F.size("w")
    found = frequent.where(F.col("phrase").isNotNull()).select("lang", "phrase", w.alias("w"), F.col("n").alias("a")).where(size > 1)

    def cut(k: int) -> Column:
        part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), p.alias("part")) for s, p in (("l", part(1, F.lit(k))), ("r", part(k + 1, size - k)))])

    each = found.select("lang", "phrase", "a", F.explode(F.when(size == 2, cut(1)).otherwise(F.concat(cut(1), cut(2)))).alias("c"))
    parts = frequent.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias("f"))
    each = each.select("lang", "phrase", "a", "c.*").join(parts, (F.col("lang") == F.col("_lang")) & (F.col("part") == F.col("_part")))
    of = lambda k, s: F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f")))
    cuts = each.groupBy("lang", "phrase", "a").agg(*[of(k, s).alias(f"{s}{k}") for k in (1, 2) for s in "lr"])
    # whole numbers below 10^16, so that no product passes 38 digits
    exact = lambda *c: reduce(mul, [F.col(x).cast("decimal(16,0)") for x in c])
    rows = cuts.select("*", (exact("a", "a") * F.lit(1000000)).cast("decimal(38,0)").alias("top"), *[exact(f"l{k}", f"r{k}").cast("decimal(38,0)").alias(f"q{k}") for k in (1, 2)])
    rows = rows.select("*", *[F.expr(f"top div q{k}").alias(f"s{k}") for k in (1, 2)])
    late = F.col("s2").isNotNull() & (F.col("s2") < F.col("s1"))
    pick = lambda a, b: F.when(late, F.col(b)).otherwise(F.col(a))
    return rows.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))


def collocations(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` candidates by score, count and phrase.

    A candidate is a phrase of two or three words of a piece that occurs ``support`` times in its language; those of two words
    inside one of three with at least half their count go. Ties in all but the phrase go by its UTF-8 bytes. Documents are
    lower-cased in A-Z and cut into pieces at .,;:!? and line ends; overlapping occurrences all count.
    """
    frequent = frequent_phrases(docs, support, shards)
    found = scored(frequent)
    w = F.split("phrase", " ", -1)
    longer = found.where(F.size(w) == 3).select("lang", F.col("a").alias("over"), F.explode(F.array(*[F.array_join(F.slice(w, k, 2), " ") for k in (1, 2)])).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    rows = found.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < 50 * F.col("a"))).drop("over")
    # first within parts of a language, so that no task ranks all its candidates
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = frequent.where(F.col("phrase").isNull()).select("lang", F.col("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
