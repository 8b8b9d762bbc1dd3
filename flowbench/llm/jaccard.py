"""N-gram Jaccard join by grouped prefixes, and the groups of near copies that its links make.

A document is its set of word shingles; equal sets are one class. Shingles have one global order, rare ones first
(any order gives the same result; a good one gives few candidates); two sets that are similar enough share a shingle within their prefixes. Classes with the same prefix and size are one
group: group pairs are found and filtered by size, by position, and by what the counts of their shingles in 64 bins
allow them to share; then they expand to their members, which are verified on the whole sets.

Groups of thousands of near copies would make the square of their number in pairs, of which components need few.
So each shingle's bucket first links its groups to its most typical one (a star: as many pairs as members); what is
then connected already needs no further pair, and all pairs across the components found so far follow, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import arrow_bytes, fresh, saved, slices, small, tree_sum
from flowbench.llm.components import connected_components

#: Counters of the sketch that orders shingles, in blocks; they bound what every task is sent (8 bytes each).
COUNTERS, BLOCK = 1 << 19, 1 << 12
#: Sets beyond this size have no counts by bin (the counts are 16-bit numbers); groups of a shingle that meet in one task.
MOST_COUNTED, TOGETHER = 1 << 19, 1 << 9
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """Word -> 64-bit hash, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


def mixed(h: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * by
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Texts to sorted sets of shingle hashes; its words are bounded."""

    def __init__(self, n: int) -> None:
        self.n, self.words = n, Hashes()

    def hashed(self, text: str) -> np.ndarray:
        """Hashes of a text's words, of which A-Z are folded; the space and code points 9 to 13 divide them."""
        if len(self.words) > 1 << 17:
            self.words.clear()
        found = text.encode().lower().split()  # of bytes: both hold for ASCII alone
        return np.fromiter(map(self.words.__getitem__, found), np.uint64, len(found))

    def shingles(self, h: np.ndarray) -> np.ndarray:
        """A shingle for each run of n words; with fewer words the whole sequence is one; without words none."""
        size = min(self.n, len(h))
        if not size:
            return h
        total = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            total = mixed(total + h[k : len(h) - size + 1 + k], A)
        return total

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(self.shingles(self.hashed(text)))

    def ordered(self, text: str, order: Order) -> tuple[np.ndarray, np.ndarray]:
        """The set, and the same shingles from the rarest on."""
        words = self.hashed(text)
        h, at = np.unique(self.shingles(words), return_index=True)
        common = order.common(h)
        weights, size = order.word_weights(words), min(self.n, len(words))
        rarity = sum(weights[k : len(words) - size + 1 + k] for k in range(size))[at] if len(h) else common
        return h, h[np.lexsort((h, rarity, common))]


@dataclass(frozen=True)
class Order:
    """One order of all shingles: those that stand out in the counts last, by count; the others by how rare their words are."""

    shingle_counts: np.ndarray
    log_word_counts: np.ndarray
    standing_out: float

    @classmethod
    def of(cls, counts: np.ndarray) -> Order:
        shingles, words = counts[:COUNTERS], counts[COUNTERS:]
        usual = float(np.median(shingles))
        return cls(shingles.astype(np.float32), np.log1p(words).astype(np.float32), usual + 6 * usual**0.5 + 1)

    def common(self, h: np.ndarray) -> np.ndarray:
        counts = self.shingle_counts[counter(h)]
        return np.where(counts > self.standing_out, counts, 0)

    def word_weights(self, h: np.ndarray) -> np.ndarray:
        return self.log_word_counts[counter(h)]


def counter(h: np.ndarray) -> np.ndarray:
    """The counter of each hash."""
    return (h >> np.uint64(8)).astype(np.int64) % COUNTERS


def prefix_length(n: int, percent: int) -> int:
    """How many of the first shingles of n one must share with any set that is similar enough."""
    return n - -(-n * percent // 100) + 1


def bins(h: np.ndarray) -> np.ndarray | None:
    """How many of a set's hashes begin with each of the 64 runs of six bits."""
    return np.bincount((h >> np.uint64(58)).astype(np.int64), minlength=64).astype(np.int16) if len(h) <= MOST_COUNTED else None


def sketch(docs: DataFrame, text: str, n: int) -> Order:
    """The order of shingles from counts over all documents: exact sums, in counters of bounded number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, shingle, part = np.zeros(2 * COUNTERS, np.float64), Shingler(n), TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole, text):
                words = [shingle.hashed(t or "") for t in batch.column(text).to_pylist()]
                sets = np.concatenate([np.unique(shingle.shingles(w)) for w in words])
                total[:COUNTERS] += np.bincount(counter(sets), minlength=COUNTERS)
                total[COUNTERS:] += np.bincount(counter(np.concatenate(words)), minlength=COUNTERS)
        keys = [k for k in range(len(total) // BLOCK) if total[k * BLOCK : (k + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([part] * len(keys), pa.int32()), pa.array([total[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in keys], pa.binary())],
            names=["key", "part", "vector"],
        )

    source = docs.select(text)
    parts = source.mapInArrow(count, "key int, part int, vector binary")
    out = np.zeros(2 * COUNTERS)
    for row in tree_sum(parts, source.rdd.getNumPartitions()).collect():  # as many numbers as counters
        out[row.key * BLOCK : (row.key + 1) * BLOCK] = np.frombuffer(row.vector)
    return Order.of(out)


def profiles(docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """docs with ``n_shingles``, ``class_id`` (128 bits of hash of the set), ``group_id`` (of prefix and size), ``prefix``, ``typical``, ``bins``.

    ``bins`` counts the set's shingles by the first six bits of their hash.
    """
    order = docs.sparkSession.sparkContext.broadcast(sketch(docs, text, n))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = ["n_shingles", "class_id", "group_id", "prefix", "typical", "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for whole in batches:
            for batch in slices(whole, text):
                rows = []
                for t in batch.column(text).to_pylist():
                    h, ranked = shingle.ordered(t or "", order.value)
                    first = ranked[: prefix_length(len(h), percent)]
                    key = xxhash.xxh3_128_digest(h.tobytes())
                    group = xxhash.xxh3_128_digest(first.tobytes() + len(h).to_bytes(8, "little"))
                    rows.append((len(h), key, group, first.astype(np.int64), float((order.value.common(h) > 0).mean()) if len(h) else 0.0, bins(h)))
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int16())]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{fields}, n_shingles long, class_id binary, group_id binary, prefix array<long>, typical double, bins array<short>")


def likely(pairs: DataFrame, docs: DataFrame, reps: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """Those of the class pairs ``a, b`` whose sets may be similar enough, judged by an eighth of each set, exactly.

    The hashes that begin with three zero bits are compared; of the other eighths the smaller one bounds what two sets
    share. Unrelated sets share next to nothing of the first, and so never meet whole.
    """

    def part(h: np.ndarray) -> bytes:
        sizes = np.bincount((h >> np.uint64(61)).astype(np.int64), minlength=8)
        return np.concatenate([sizes.astype(np.uint64), h[: sizes[0]]]).tobytes()  # sets are in order

    def may_be(x: np.ndarray, y: np.ndarray) -> bool:
        shared = len(x) + len(y) - 16 - len(np.union1d(x[8:], y[8:])) + int(np.minimum(x[1:8], y[1:8]).sum())
        return 100 * shared >= percent * (int(x[:8].sum()) + int(y[:8].sum()) - shared)

    return compared(pairs, docs, reps, text, n, part, may_be)


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """Those of the class pairs ``a, b`` whose sets are similar enough."""

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        shared = len(x) + len(y) - len(np.union1d(x, y))
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    return compared(pairs, docs, reps, text, n, lambda h: h.tobytes(), similar)


def compared(pairs: DataFrame, docs: DataFrame, reps: DataFrame, text: str, n: int, part: Callable[[np.ndarray], bytes], keep: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """Those of the class pairs ``a, b`` that are to be kept by what ``part`` gives of their sets.

    Only the classes in the pairs are read again, one document of each.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    chosen = reps.join(asked, "class_id", "left_semi").select("rep").where(F.col("rep").isNotNull()).distinct()
    rows = docs.join(small(chosen.withColumnRenamed("rep", "_id")), F.col("_doc_id") == F.col("_id"), "left_semi").select(text)
    if reps.where(F.col("rep").isNull()).limit(1).count():
        rows = rows.unionByName(docs.where(F.col("_doc_id").isNull()).select(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for whole in batches:
            for batch in slices(whole, text):
                found = [shingle(t or "") for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary()), pa.array([part(h) for h in found], pa.binary())],
                    names=["class_id", "shingles"],
                )

    # each pair's two sets meet once; of repeated rows any stands for all
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.lit(True).alias("left")), F.struct(F.col("b").alias("class_id"), F.lit(False).alias("left")))).alias("side"))
    sides = small(saved(sides.select("a", "b", "side.*")))
    sets = rows.mapInArrow(run, "class_id binary, shingles binary").join(sides, "class_id")
    both = sets.groupBy("a", "b").agg(F.max(F.when(F.col("left"), F.col("shingles"))).alias("x"), F.max(F.when(~F.col("left"), F.col("shingles"))).alias("y"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chosen = [keep(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(chosen, pa.bool_()))

    return both.mapInArrow(test, "a binary, b binary")


def close(a: Column, b: Column, at: Column, bt: Column, percent: int) -> Column:
    """Whether sets of these sizes that share a shingle at these positions (from 0) may be similar enough."""
    return (a * 100 >= b * percent) & (b * 100 >= a * percent) & (F.least(a - at, b - bt) >= needed(a, b, percent))


def needed(a: Column, b: Column, percent: int) -> Column:
    """The least number of shingles that similar sets of these sizes share."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


def plausible(a: Column, b: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether sets of these sizes and counts by bin (null: unknown) may share so many: in no bin more than the smaller count."""
    most = F.aggregate(F.zip_with(x, y, lambda p, q: F.least(p, q)), F.lit(0), lambda total, v: total + v)
    return F.coalesce(most >= needed(a, b, percent), F.lit(True))


def join_classes(found: DataFrame, docs: DataFrame, text: str, n: int, percent: int) -> DataFrame:
    """Rows ``class_id, root`` of the classes that links connect to others; found has the profiles of all documents."""
    full = found.where("n_shingles > 0")
    reps = saved(full.groupBy("class_id").agg(F.min("_doc_id").alias("rep"), F.first("group_id").alias("group_id")))
    # a group of several classes has no counts by bin: these belong to a class
    one = F.min("class_id") == F.max("class_id")
    groups = full.groupBy("group_id").agg(
        F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.max(F.struct("typical", "class_id")).alias("top"), one.alias("one"), F.when(one, F.first("bins")).alias("bins")
    )
    groups = saved(groups)
    # shingles in the prefix of one group alone pair nothing: only narrow counts of them are shuffled
    tokens = groups.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token")
    index = groups.select("group_id", "n", F.col("top.typical").alias("typical"), F.posexplode("prefix").alias("at", "token")).join(small(saved(tokens), 1_000_000), "token")
    index = saved(index.select("token", "group_id", "n", "at", "typical"))
    # stars: every group of a bucket with the bucket's most typical one, and the members of a group with their own
    tops = index.groupBy("token").agg(F.max(F.struct("typical", "group_id", "n", "at")).alias("hub"))
    rays = index.join(tops, "token").where((F.col("group_id") != F.col("hub.group_id")) & close(F.col("n"), F.col("hub.n"), F.col("at"), F.col("hub.at"), percent))
    rays = rays.select(F.col("group_id").alias("g"), F.col("hub.group_id").alias("h")).distinct()
    left = groups.select(F.col("group_id").alias("g"), F.col("n").alias("n"), F.col("bins").alias("x"))
    right = groups.select(F.col("group_id").alias("h"), F.col("n").alias("m"), F.col("bins").alias("y"), F.col("top.class_id").alias("b"))
    rays = rays.join(left, "g").join(right, "h").where(plausible(F.col("n"), F.col("m"), F.col("x"), F.col("y"), percent)).select("g", "b")
    own = groups.where(~F.col("one")).select(F.col("group_id").alias("g"), F.col("top.class_id").alias("b"))
    members = reps.select(F.col("group_id").alias("g"), F.col("class_id").alias("a"))
    pairs = members.join(rays.unionByName(own).distinct(), "g").where(F.col("a") != F.col("b"))
    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    stars = saved(verified(pairs, docs, reps, text, n, percent))
    roots = connected_components(stars).withColumnRenamed("node", "class_id")
    # the rest: pairs across components, of groups that may hold such, in buckets of more than one component
    state = saved(reps.select("class_id", "group_id").join(roots, "class_id", "left").select("class_id", "group_id", F.coalesce("root", "class_id").alias("root")))
    whole = saved(state.groupBy("group_id").agg(F.min("root").alias("lo"), F.max("root").alias("hi")))
    mixed = index.select("token", "group_id").join(whole, "group_id").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("size"))
    mixed = small(saved(mixed.where("lo < hi").select("token", F.ceil(F.col("size") / TOGETHER).cast("int").alias("parts"))))
    placed = index.join(mixed, "token").join(whole, "group_id").join(groups.select("group_id", "bins"), "group_id")
    placed = saved(placed.select("token", "parts", "group_id", "n", "at", "lo", "hi", "bins"))
    # large buckets are dealt: each group on the left is in one part, on the right in all
    left = placed.withColumn("part", F.pmod(F.xxhash64("group_id"), F.col("parts")).cast("int")).alias("l")
    right = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("r")
    across = left.join(
        right,
        (F.col("l.token") == F.col("r.token")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.group_id") < F.col("r.group_id"))
        & ~((F.col("l.lo") == F.col("r.hi")) & (F.col("l.hi") == F.col("r.lo")))
        & close(F.col("l.n"), F.col("r.n"), F.col("l.at"), F.col("r.at"), percent)
        & plausible(F.col("l.n"), F.col("r.n"), F.col("l.bins"), F.col("r.bins"), percent),
    ).select(F.col("l.group_id").alias("g"), F.col("r.group_id").alias("h")).distinct()
    within = whole.where(F.col("lo") < F.col("hi")).select(F.col("group_id").alias("g"), F.col("group_id").alias("h"))
    left = state.select(F.col("group_id").alias("g"), F.col("class_id").alias("a"), F.col("root").alias("p"))
    right = state.select(F.col("group_id").alias("h"), F.col("class_id").alias("b"), F.col("root").alias("q"))
    rest = across.unionByName(within).join(left, "g").join(right, "h").where(
        (F.col("p") != F.col("q")) & ((F.col("g") != F.col("h")) | (F.col("a") < F.col("b")))
    )
    rest = saved(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"))
    more = verified(saved(likely(rest, docs, reps, text, n, percent)), docs, reps, text, n, percent)
    return connected_components(stars.unionByName(more)).withColumnRenamed("node", "class_id")


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id, n_shingles, class_id, component_id``, one a document, for sets with 100 * shared >= percent * union.

    component_id is the smallest id of those that links reach, the own one included; null ids are passed over, and a
    component of null ids alone has none. Empty sets (null or blank texts) link with nothing. Repeated rows are one
    class, and each keeps its row.
    """
    source = docs.select(F.col(key).alias("_doc_id"), F.col(text).alias("_text"))
    found = saved(profiles(source, "_text", n, percent).drop("_text"))
    roots = join_classes(found, source, "_text", n, percent)
    linked = found.where("n_shingles > 0").groupBy("class_id").agg(F.min("_doc_id").alias("rep")).join(roots, "class_id", "left")
    linked = linked.withColumn("root", F.coalesce("root", "class_id"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = saved(linked.join(least, "root").select("class_id", "component_id"))
    full = found.where("n_shingles > 0").join(answer, "class_id").select(F.col("_doc_id").alias("doc_id"), "n_shingles", "class_id", "component_id")
    empty = found.where("n_shingles = 0").select(F.col("_doc_id").alias("doc_id"), "n_shingles", "class_id", F.col("_doc_id").alias("component_id"))
    return full.unionByName(empty)


def components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per document the size of its set and its component."""
    return near_groups(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: a row with the group's smallest id. Columns stay.

    Groups without ids keep one row; documents without words are no copies and all stay. Rows that are to go are few
    or many; they are found by id and text, so repeated ids don't matter.
    """
    from flowbench.llm.pii import text_key

    hashed, verdict, number = fresh(docs, "_text_key", "_verdict", "_number")
    keyed = docs.withColumn(hashed, text_key(F.coalesce(F.col(text), F.lit(""))))
    slim = keyed.select(F.col(key).alias("_doc_id"), F.col(hashed).alias("_key"), F.col(text).alias("_text"))
    # a stage among others: workers and executors still hold what earlier ones left, so texts go over in small batches
    with arrow_bytes(docs.sparkSession):
        found = saved(profiles(slim, "_text", n, percent).drop("_text"))
        roots = join_classes(found, slim.drop("_key"), "_text", n, percent)
    # one row a text and id, with how often it occurs
    rows = found.where("n_shingles > 0").groupBy("class_id", "_key", "_doc_id").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("_doc_id").isNull().alias("none"), "_doc_id", "_key", "class_id")).alias("first"))
    judged = rows.join(first, "root").withColumn("keep", F.col("_doc_id").eqNullSafe(F.col("first._doc_id")) & (F.col("_key") == F.col("first._key")))
    judged = judged.where(~F.col("keep") | (F.col("times") > 1)).select(F.col("_key").alias(hashed), F.col("_doc_id").alias(number), F.when(F.col("keep"), "once").otherwise("drop").alias(verdict)).distinct()
    judged = small(saved(judged))
    joined = keyed.alias("d").join(judged.alias("j"), (F.col(f"d.{hashed}") == F.col(f"j.{hashed}")) & F.col(f"d.{key}").eqNullSafe(F.col(f"j.{number}")), "left")
    joined = joined.select("d.*", f"j.{verdict}")
    once = joined.where(F.col(verdict) == "once").dropDuplicates([key, hashed])
    return joined.where(F.col(verdict).isNull()).unionByName(once).select(docs.columns)
