"""Masked pseudo-likelihood: a bidirectional window network scores each word from those on both sides of it.

The counts of all words of the corpus are a table. Words whose count reaches ``cutoff`` have a number of their own and
rows of the embedding; how many they are grows with the corpus. The rest share the numbers of hash buckets, and each
has its share of its bucket's count as its probability there: no two words need score alike. The shares of the most
frequent of these, of bounded number, are sent to all tasks, which add them up as they number the words; those of all
others are joined by word. A number's upper and lower half are predicted in turn from the two words before and the two
after.

The network is trained in numpy on the words of all documents. These are dealt, by a hash of the row, into as many parts
as the number of words asks for, and put in order within each; every part takes steps of its own from the common start,
and the parameters are averaged, weighted by words, through the tree of ``tree_sum``. So neither the parts nor the steps
depend on how the table is split, and scores are the same but for rounding. A document's score is the sum of its words'
log-probabilities.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbench.llm.common import saved, slices, tree_sum

#: Numbers for words are a square, of HALF at least; the size of the hidden layer; the square root of all words is
#: divided by CUTOFF for the count that gives a word its own number.
HALF, HIDDEN, CUTOFF = 64, 24, 10
WORDS, PAD = HALF * HALF, HALF * HALF
OFFSETS = (-2, -1, 1, 2)
ROW, IDS, RARE, SHARE, REST = "_row", "_ids", "_rare", "_share", "_rest"
#: Words of a step, and of those whose logits are made at once, so that they stay in a core's cache.
BATCH, RATE, BLOCK, ROWS = 8192, 0.15, 1 << 14, 1 << 10
#: Words without a number whose shares are sent to all tasks, at most; the others' are joined.
SENT = 1 << 18
#: Words that one part is to have about, and words of whole documents that a part's steps are cut from at once.
PART, CHUNK = 1 << 22, 1 << 16


class Numbers(dict):
    """Word -> code: its number, if it has its own; then the places of the words whose shares were sent; then buckets."""

    def __init__(self, words: list[str], sent: list[str]) -> None:
        super().__init__((w, k) for k, w in enumerate(words))
        self.update((w, k) for k, w in enumerate(sent, len(words)))
        self.first, self.buckets = len(self), buckets(len(words))

    def __missing__(self, word: str) -> int:
        return self.first + bucket(word, self.buckets)


def bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


def buckets(n_words: int) -> int:
    """Numbers that words without their own share, beside so many words."""
    return half_of(n_words) ** 2 - n_words


def half_of(n_words: int) -> int:
    """Side of the square of numbers for so many words and some buckets beside them."""
    return max(HALF, math.isqrt(n_words + math.isqrt(n_words)) + 1)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows ``word, n`` of all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for whole in batches:
            for b in slices(whole, text):
                for t in b.column(text).to_pylist():
                    found.update((t or "").lower().split())
                if len(found) > 1 << 18:
                    yield made()
                    found.clear()
        yield made()

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> list[str]:
    """The words that have numbers of their own, by count, of equal ones the first in order.

    The count that they need grows with the square root of the corpus, and so does about their number.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    cutoff = max(2, math.ceil(math.sqrt(total) / CUTOFF))
    return [r.word for r in counts.where(F.col("n") >= cutoff).orderBy(F.desc("n"), "word").select("word").collect()]


def rare_words(counts: DataFrame, words: list[str]) -> DataFrame:
    """Rows ``word, n, share`` of the words without a number of their own: the logarithm of the share of the bucket's count."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(w,) for w in words], "word string")
    rest = counts.join(F.broadcast(known), "word", "left_anti").withColumn("bucket", F.crc32(F.col("word").cast("binary")) % buckets(len(words)))
    mass = rest.groupBy("bucket").agg(F.sum("n").alias("mass"))  # as many rows as buckets
    return rest.join(F.broadcast(mass), "bucket").select("word", "n", F.log(F.col("n") / F.col("mass")).alias("share"))


def parted(rare: DataFrame) -> tuple[list[str], np.ndarray, DataFrame]:
    """The words of ``rare_words()`` whose shares are sent, and their shares; the rows of all others.

    The first are all words from some count on, the least one that leaves no more than SENT of them.
    """
    least, total = None, 0
    for r in rare.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():  # counts below the cutoff
        total += r.words
        if total > SENT:
            break
        least = r.n
    if least is None:
        return [], np.zeros(0), rare
    sent = rare.where(F.col("n") >= least).select("word", "share").toArrow()
    return sent.column("word").to_pylist(), sent.column("share").to_numpy(), rare.where(F.col("n") < least)


class Network:
    """Parameters as one flat array, and views of it. A number's rows of all offsets lie side by side."""

    def __init__(self, flat: np.ndarray | None = None, half: int = HALF) -> None:
        self.half = half
        shapes = {"wide": (half**2 + 1, len(OFFSETS) * HIDDEN), "b": (HIDDEN,), "u1": (half, HIDDEN), "a1": (half,), "c": (half, HIDDEN), "u2": (half, HIDDEN), "a2": (half,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        if flat is None:
            flat = (np.random.default_rng(7).standard_normal(size) * 0.1).astype(np.float32)
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n
        self.e = self.wide.reshape(-1, len(OFFSETS), HIDDEN).transpose(1, 0, 2)

    def hidden(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hidden layer, and a column of ones that the biases are multiplied with."""
        first, n = at[0] + OFFSETS[0], at[-1] - at[0] + 1  # places are in order and near each other
        near, total = self.wide[ids[first : at[-1] + OFFSETS[-1] + 1]], self.b
        for k, o in enumerate(OFFSETS):
            total = total + near[o - OFFSETS[0] :][:n, k * HIDDEN : (k + 1) * HIDDEN]
        if n > len(at):
            total = total[at - at[0]]
        out = np.ones((len(at), HIDDEN + 1), np.float32)
        np.tanh(total, out=out[:, :-1])
        return out

    def weights(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Those of both halves with the biases as last column; whether logits can pass 80 (hidden layers are within 1)."""
        first, second = np.column_stack([self.u1, self.a1]), np.column_stack([self.u2, self.a2])
        reach = 1 + np.append(np.abs(self.c).max(axis=0), 0)
        return first, second, not max(np.abs(first).sum(axis=1).max(), (np.abs(second) @ reach).max()) < 80

    def logits(self, ids: np.ndarray, at: np.ndarray, weights: tuple[np.ndarray, np.ndarray, bool]) -> tuple[np.ndarray, ...]:
        """Hidden layer, the one with the upper half's embedding, and the logits of both halves."""
        h = self.hidden(ids, at)
        g = h.copy()
        g[:, :-1] += self.c[ids[at] // self.half]
        x, y = h @ weights[0].T, g @ weights[1].T
        if weights[2]:  # exp() stays finite
            np.minimum(x, 80, out=x)
            np.minimum(y, 80, out=y)
        return h, g, x, y

    def log_likelihood(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of each word at these places."""
        out, weights, ones = np.zeros(len(at)), self.weights(), np.ones(self.half, np.float32)
        for k in range(0, len(at), ROWS):
            some = at[k : k + ROWS]
            _, _, x, y = self.logits(ids, some, weights)
            rows, word = np.arange(len(some)), ids[some]
            picked = x[rows, word // self.half] + y[rows, word % self.half]
            sums = (np.exp(x, out=x) @ ones) * (np.exp(y, out=y) @ ones).astype(np.float64)
            out[k : k + ROWS] = picked - np.log(sums)
        return out

    def gradients(self, ids: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood; under "h" that of the sums which the context's rows of e share."""
        weights, n = self.weights(), np.float32(1 / len(at))
        upper, lower, ones = np.zeros_like(weights[0]), np.zeros_like(weights[1]), np.ones(self.half, np.float32)
        dh, dg = (np.empty((len(at), HIDDEN), np.float32) for _ in range(2))
        for k in range(0, len(at), ROWS):
            some = at[k : k + ROWS]
            h, g, p, q = self.logits(ids, some, weights)
            rows, word = np.arange(len(some)), ids[some]
            # of both halves: what is common to a row of the gradient is multiplied into the narrow sides
            scales = []
            for z, half in ((p, word // self.half), (q, word % self.half)):
                sums = np.exp(z, out=z) @ ones
                z[rows, half] -= sums
                scales.append((n / sums)[:, None])
            upper += p.T @ (h * scales[0])
            lower += q.T @ (g * scales[1])
            h = h[:, :-1]
            dg[k : k + ROWS] = d = (q @ self.u2) * scales[1]
            dh[k : k + ROWS] = ((p @ self.u1) * scales[0] + d) * (1 - h * h)
        dc = np.zeros_like(self.c)
        add_rows(dc, ids[at] // self.half, dg)
        return {"u1": upper[:, :-1], "a1": upper[:, -1], "u2": lower[:, :-1], "a2": lower[:, -1], "c": dc, "b": dh.sum(axis=0), "h": dh}


def sorting(index: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0 on; small ones are sorted by their digits."""
    return np.argsort(index.astype(np.uint16) if index.max(initial=0) < 1 << 16 else index, kind="stable")


def summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    order = sorting(index)
    index = index[order]
    starts = np.flatnonzero(np.diff(index, prepend=-1))
    return index[starts], np.add.reduceat(rows[order], starts, axis=0)


def add_rows(to: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    where, total = summed(index, rows)
    to[where] += total


class Trainer:
    """Steps with a rate for each parameter that falls with the squares of its gradients."""

    def __init__(self, network: Network) -> None:
        self.network, self.squares = network, Network(np.full_like(network.flat, 1e-6), network.half)

    def step(self, ids: np.ndarray, at: np.ndarray) -> None:
        """A step on the words at these places, which are in order."""
        net, sq = self.network, self.squares
        grads = net.gradients(ids, at)
        dh = grads.pop("h")
        for name, g in grads.items():
            s = getattr(sq, name)
            s += g * g
            getattr(net, name)[...] -= RATE * g / np.sqrt(s)
        # what a place hands to its neighbours lies so far away; all offsets side by side, as the parameters are
        reach = OFFSETS[-1]
        first, last = at[0] - reach, at[-1] + reach + 1
        handed = np.zeros((HIDDEN, last - first + 2 * reach))
        handed[:, at - first + reach] = dh.T
        order = sorting(ids[first:last])
        new = np.diff(ids[first:last][order], prepend=-1) != 0
        where, place = ids[first:last][order[new]], np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        # numbers are many and mostly seen a few times: counting column by column is the quickest sum
        sums = np.array([np.bincount(place, column[reach - o :][: last - first], len(where)) for o in OFFSETS for column in handed])
        g = np.ascontiguousarray(sums.T, np.float32)
        squares = sq.wide[where] + g * g
        sq.wide[where] = squares
        net.wide[where] -= RATE * g / np.sqrt(squares)


def joined(documents: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some documents with two pads before and after each, and the words' places."""
    gap = np.full(2, pad, np.int32)
    ids = np.concatenate([gap, *(x for d in documents for x in (d, gap))]) if documents else gap
    return ids, np.flatnonzero(ids != pad)


def coded(docs: DataFrame, words: list[str], sent: list[str], shares: np.ndarray, text: str = "text") -> DataFrame:
    """docs without the text, with ``_row``, ``_ids`` (32-bit numbers), ``_share`` (the sum of the sent words' shares) and
    ``_rare`` (the words with neither a number of their own nor a share sent)."""
    known, n = len(words), buckets(len(words))
    # by code: the number, and what is added
    number = np.concatenate([np.arange(known), known + np.array([bucket(w, n) for w in sent], np.int64), known + np.arange(n)]).astype(np.int32)
    added = np.concatenate([np.zeros(known), shares, np.zeros(n)])
    shared = docs.sparkSession.sparkContext.broadcast((words, sent, number, added))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, sent, number, added = shared.value
        numbers, at = Numbers(words, sent), TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in slices(whole, text):
                ids, share, rare = [], [], []
                for t in b.column(text).to_pylist():
                    found = (t or "").lower().split()
                    made = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                    ids.append(number[made].tobytes())
                    share.append(float(added[made].sum()))
                    rare.append([found[k] for k in np.flatnonzero(made >= numbers.first).tolist()])
                kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != text]
                yield pa.RecordBatch.from_arrays(
                    [*(c for _, c in kept), pa.array(np.arange(at, at + len(ids))), pa.array(ids, pa.binary()), pa.array(share, pa.float64()), pa.array(rare, pa.list_(pa.string()))],
                    names=[*(n for n, _ in kept), ROW, IDS, SHARE, RARE],
                )
                at += len(ids)

    return docs.mapInArrow(run, f"{fields}, {ROW} long, {IDS} binary, {SHARE} double, {RARE} array<string>".removeprefix(", "))


def train(rows: DataFrame, words: list[str], n_parts: int) -> np.ndarray:
    """Parameters learned from all words of all rows of ``coded()`` in one pass, in so many parts."""
    half = half_of(len(words))
    plain = [F.col(f"`{f.name}`") for f in rows.schema if f.name not in (ROW, SHARE, RARE) and not isinstance(f.dataType, (T.MapType, T.VariantType))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, trainer, part, held, size, seen = None, None, -1, [], 0, 0

        def steps() -> None:
            nonlocal held, size, seen
            ids, places = joined(held, half**2)
            for k in range(0, len(places), BATCH):
                trainer.step(ids, places[k : k + BATCH])
            held, size, seen = [], 0, seen + len(places)

        def made() -> Iterator[pa.RecordBatch]:
            steps()
            if seen:
                flat = np.append(network.flat.astype(np.float64) * seen, seen)
                cuts = range(0, len(flat), BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cuts)), pa.int32()), pa.array([part] * len(cuts), pa.int32()), pa.array([flat[c : c + BLOCK].tobytes() for c in cuts], pa.binary())],
                    names=["key", "part", "vector"],
                )

        for b in batches:
            for p, raw in zip(b.column("part").to_pylist(), b.column(IDS), strict=True):
                if p != part:
                    if network is not None:
                        yield from made()
                    network, part, held, size, seen = Network(half=half), p, [], 0, 0
                    trainer = Trainer(network)
                document = np.frombuffer(raw.as_buffer(), np.int32)
                for k in range(0, len(document), CHUNK):  # very long texts are several documents here
                    held.append(document[k : k + CHUNK])
                    size += len(held[-1])
                    if size >= CHUNK:
                        steps()
        if network is not None:
            yield from made()

    dealt = rows.select(F.xxhash64(*plain).alias("deal"), IDS).withColumn("part", F.pmod("deal", F.lit(n_parts)).cast("int"))
    dealt = dealt.repartitionById(n_parts, "part").sortWithinPartitions("part", "deal", IDS)
    parts = dealt.select("part", IDS).mapInArrow(run, "key int, part int, vector binary")
    total = sorted((r.key, bytes(r.vector)) for r in tree_sum(parts, n_parts).collect())  # as many numbers as parameters
    if not total:
        return Network(half=half).flat
    flat = np.concatenate([np.frombuffer(v) for _, v in total])
    return (flat[:-1] / flat[-1]).astype(np.float32)


def score(rows: DataFrame, words: list[str], flat: np.ndarray, rare: DataFrame) -> DataFrame:
    """Rows of ``coded()`` with ``n_words`` and ``log_likelihood``, the sum over all words; both 0 for null and empty texts.

    rare has the shares that were not sent. Columns with these names are replaced; the others stay.
    """
    shared, half = rows.sparkSession.sparkContext.broadcast(flat), half_of(len(words))
    keep = [c for c in rows.columns if c not in (IDS, RARE, "n_words", "log_likelihood")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shared.value, half)
        for whole in batches:
            for b in slices(whole, IDS):
                documents = [np.frombuffer(x.as_buffer(), np.int32) for x in b.column(IDS)]
                ids, places = joined(documents, half**2)
                counts = np.array([len(d) for d in documents], np.int64)
                each = [network.log_likelihood(ids, places[k : k + BATCH]) for k in range(0, len(places), BATCH)]
                sums = np.concatenate([[0.0], np.cumsum(np.concatenate(each))]) if each else np.zeros(1)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in keep), pa.array(counts), pa.array(sums[ends] - sums[ends - counts])], names=[*keep, "n_words", "log_likelihood"]
                )

    made = rows.select(*[F.col(f"`{c}`") for c in keep], IDS).mapInArrow(run, f"{fields}, n_words long, log_likelihood double")
    asked = rows.select(ROW, F.explode(RARE).alias("word"))
    extra = asked.join(rare.select("word", "share"), "word").groupBy(ROW).agg(F.sum("share").alias(REST))
    return made.join(extra, ROW, "left").withColumn("log_likelihood", F.col("log_likelihood") + F.col(SHARE) + F.coalesce(REST, F.lit(0.0))).drop(ROW, SHARE, REST)


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Per document its words, the summed log-probability, and the mean over its words (no words: 0)."""
    rows = docs.select("doc_id", "text")
    counts = saved(word_counts(rows))
    words = vocabulary(counts)
    n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    sent, shares, rest = parted(rare_words(counts, words))
    rows = saved(coded(rows, words, sent, shares))
    return score(rows, words, train(rows, words, max(1, math.ceil(n_words / PART))), rest).select(
        "doc_id", "n_words", "log_likelihood", (F.col("log_likelihood") / F.greatest("n_words", F.lit(1))).alias("mean_log_likelihood")
    )
