"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and their first five letters: all that the labelled examples hold. A term's IDF is multiplied by a
soft weight, the logarithm of how much oftener toxic examples hold it than others, drawn down where few do; a term that
tells nothing or leans the other way keeps the weight FLOOR, so no term is left out. The examples' unit vectors form an
inverted index, with the largest weight of each common term in each block of examples. A search adds up the postings of
a text's rare terms, then visits the blocks that the maxima of its common terms put first, and leaves out those that can
hold no nearer example. So the nearest are exact. They vote by cosine; the votes of the examples on one another, each without
itself, calibrate the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import per_text, slices
from flowbench.llm.labelled import held_out, sample

#: Labelled rows in the index at most, and bytes of their texts; neighbours that vote; examples in a block, and blocks
#: that a search visits first; searches made together; one in so many examples holds a common term; the least soft
#: weight; doubt, in examples, in a term's log-odds.
TRAIN_ROWS, TRAIN_BYTES, NEAREST, BLOCK, FIRST, TOGETHER, COMMON, FLOOR, DOUBT = 4000, 1 << 25, 15, 64, 4, 64, 16, 0.02, 3.0
Vector = tuple[np.ndarray, np.ndarray]
WORD = re.compile(r"[^\W\d_]+")
PREFIX = 5


def terms_of(word: str) -> tuple[str, ...]:
    """The terms of a word in lower case: itself and its beginning."""
    return (word, f"{word[:PREFIX]}-") if len(word) >= PREFIX else (word,)


def term_weights(toxic: np.ndarray, held: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """IDF times soft weight of terms that so many toxic examples and so many examples in all hold."""
    idf = np.log((1 + n) / (1 + held)) + 1
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((held - toxic + 0.5) / (n - n_toxic + 1))
    return idf * np.maximum(FLOOR, odds * np.sqrt(toxic / (toxic + DOUBT)))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1 ... of each run, one run after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


@dataclass
class Index:
    """Block-max inverted index of unit vectors, and the vectors themselves."""

    own: np.ndarray  # (examples + 1): where the terms of an example begin
    terms: np.ndarray
    weights: np.ndarray
    n_terms: int

    @classmethod
    def build(cls, vectors: list[dict[int, float]], n_terms: int) -> Index:
        """The index of vectors given as term and weight."""
        sizes = np.array([len(v) for v in vectors], np.int64)
        terms = np.fromiter((t for v in vectors for t in v), np.int32, int(sizes.sum()))
        return cls(np.concatenate([[0], np.cumsum(sizes)]), terms, np.fromiter((w for v in vectors for w in v.values()), np.float64, len(terms)), n_terms)

    def __getstate__(self) -> tuple:
        return self.own, self.terms, self.weights, self.n_terms

    def __setstate__(self, state: tuple) -> None:
        self.own, self.terms, self.weights, self.n_terms = state
        self.__post_init__()

    def __post_init__(self) -> None:
        n, held = len(self.own) - 1, np.bincount(self.terms, minlength=self.n_terms)
        # row of a common term in each block's matrix and in most; -1 for rare ones, which have postings
        self.common = np.full(self.n_terms, -1, np.int32)
        often = np.flatnonzero(held > n // COMMON)
        self.common[often] = np.arange(len(often))
        rows, examples = self.common[self.terms], np.repeat(np.arange(n, dtype=np.int32), np.diff(self.own))
        self.whole = np.zeros((-(-n // BLOCK), len(often), BLOCK), np.float32)
        at = rows >= 0
        self.whole[examples[at] // BLOCK, rows[at], examples[at] % BLOCK] = self.weights[at]
        self.most = self.whole.max(axis=2, initial=0).T.copy()
        rare = np.flatnonzero(rows < 0)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.starts = np.searchsorted(self.terms[rare], np.arange(self.n_terms + 1))
        self.examples, self.values = examples[rare], self.weights[rare]
        self.dense = np.zeros(self.n_terms)

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest positive cosine, of equal ones those that stand first: exact."""
        asked = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query))
        (cosines, found), = self.search([asked], k, [without])
        return list(zip(cosines.tolist(), found.tolist(), strict=True))

    def search(self, queries: list[Vector], k: int, without: list[int] | None = None) -> list[Vector]:
        """Cosines and positions of the nearest to each of some queries, whose terms are distinct."""
        n_blocks, n_common, slack = *self.whole.shape[:2], 1e-5  # slack: of sums in single precision
        total, by = np.zeros((len(queries), n_blocks * BLOCK), np.float32), np.zeros((len(queries), n_common), np.float32)
        for i, (terms, q) in enumerate(queries):
            held = self.starts[terms + 1] - self.starts[terms]
            at = runs(self.starts[terms], held)
            total[i] = np.bincount(self.examples[at], self.values[at] * np.repeat(q, held), total.shape[1])
            rows = self.common[terms]
            by[i, rows[rows >= 0]] = q[rows >= 0]
            if without and without[i] >= 0:
                total[i, without[i]] = -2
        blocks = total.reshape(len(queries), n_blocks, BLOCK)
        bounds = by @ self.most + blocks.max(axis=2, initial=-2)
        visit, seen = np.zeros(bounds.shape, bool), np.zeros(bounds.shape, bool)
        np.put_along_axis(visit, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        while True:
            for b in np.flatnonzero(visit.any(axis=0)).tolist():
                asked = np.flatnonzero(visit[:, b])
                blocks[asked, b] += by[asked] @ self.whole[b]
            seen |= visit
            # sums that lack the common terms are too small, so the k-th largest is a lower bound at any time
            least = np.maximum(0, np.partition(total, total.shape[1] - k, axis=1)[:, total.shape[1] - k]) if total.shape[1] > k else np.zeros(len(total))
            visit = ~seen & (bounds >= least[:, None] - slack)
            if not visit.any():
                return [self.compared(terms, q, np.flatnonzero((row > 0) & (row >= low - slack)), k) for (terms, q), row, low in zip(queries, total, least, strict=True)]

    def compared(self, terms: np.ndarray, q: np.ndarray, near: np.ndarray, k: int) -> Vector:
        """The k nearest of some examples, in full precision."""
        self.dense[terms] = q
        sizes = self.own[near + 1] - self.own[near]
        at = runs(self.own[near], sizes)
        exact = np.round(np.bincount(np.repeat(np.arange(len(near)), sizes), self.dense[self.terms[at]] * self.weights[at], len(near)), 12)
        self.dense[terms] = 0
        best = np.lexsort((near, -exact))[:k]
        best = best[exact[best] > 0]
        return exact[best], near[best]


class Pairs(dict):
    """Word -> its two terms in one number, made when first asked for; one past the last term stands for none."""

    def __init__(self, names: list[str]) -> None:
        super().__init__()
        self.terms, self.none = {t: i for i, t in enumerate(names)}, len(names)

    def __missing__(self, word: str) -> int:
        get, none = self.terms.get, self.none
        made = self[word] = get(word, none) << 32 | (get(f"{word[:PREFIX]}-", none) if len(word) >= PREFIX else none)
        return made


class Vectoriser:
    """Texts to unit TF-IDF vectors; the words that it keeps are bounded."""

    def __init__(self, names: list[str], weights: np.ndarray) -> None:
        self.pairs, self.weights = Pairs(names), weights

    def __call__(self, text: str) -> Vector:
        """Distinct terms and their weights."""
        if len(self.pairs) > 1 << 17:
            self.pairs.clear()
        words = WORD.findall(text.lower())
        both = np.fromiter(map(self.pairs.__getitem__, words), np.int64, len(words))
        ids, n = np.unique(np.concatenate([both >> 32, both & 0xFFFFFFFF]), return_counts=True)
        known = len(ids) - (len(ids) > 0 and ids[-1] == len(self.weights))
        ids, n = ids[:known], n[:known]
        raw = (1 + np.log(n)) * self.weights[ids]
        size = np.sqrt((raw * raw).sum())
        return ids, raw / size if size else raw


@dataclass
class Model:
    """Vocabulary, index and calibration; bounded by the sample it was fitted on."""

    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    index: Index = field(default_factory=lambda: Index.build([], 0))
    prior: float = 0.5
    slope: tuple[float, float] = (0.0, 0.0)
    vector: Vectoriser | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vector": None}  # every worker makes its own

    def near(self, texts: list[str], without: list[int] | None = None) -> Iterator[tuple[float, Vector, Vector]]:
        """For each text the share of toxic votes, weighted by cosine and drawn to the prior, the voters, and its vector."""
        if self.vector is None:
            self.vector = Vectoriser(self.names, self.weights)
        for start in range(0, len(texts), TOGETHER):
            vectors = [self.vector(t) for t in texts[start : start + TOGETHER]]
            for (cosines, found), v in zip(self.index.search(vectors, NEAREST, without and without[start : start + TOGETHER]), vectors, strict=True):
                yield float((cosines @ self.labels[found] + 0.5 * self.prior) / (cosines.sum() + 0.5)), (cosines, found), v

    def scores(self, texts: list[str]) -> Iterator[tuple[float, list[int], list[float], list[str]]]:
        """Score, ids and cosines of the nearest examples, and the weightiest terms that the text shares with any."""
        for share, (cosines, found), (terms, q) in self.near(texts):
            top = np.lexsort((terms, -q))[:5]
            value = float(1 / (1 + np.exp(-(self.slope[0] + self.slope[1] * share))))
            yield value, self.ids[found[:3]].tolist(), cosines[:3].tolist(), [self.names[t] for t in terms[top]]


def calibrate(shares: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through votes and labels, with softened targets, by Newton steps."""
    if not len(shares):
        return 0.0, 0.0
    pos = labels.sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (len(labels) - pos + 2))
    x, w = np.stack([np.ones(len(shares)), shares]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        grad = x @ (p - target) + 1e-2 * np.array([0.0, w[1]])
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.diag([1e-6, 1e-2]), grad)
        w = w - np.clip(step, -4, 4)
    return float(w[0]), float(w[1])


def fit(rows: DataFrame) -> Model:
    """A model of ``doc_id, text, label``, a bounded sample.

    Spark makes the counts of terms, the vectors and the votes; the driver gets them as numbers, bounded like the sample.
    """
    spark, model = rows.sparkSession, Model()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                found = [sorted({x for w in set(WORD.findall(t.lower())) for x in terms_of(w)}) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(found, pa.list_(pa.string()))], names=["label", "terms"])

    toxic = F.when(F.col("label") > 0, 1).otherwise(0)
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(toxic), F.lit(0))).first()
    if not n:
        return model
    held = rows.select("label", "text").mapInArrow(words, "label int, terms array<string>").select(toxic.alias("toxic"), F.explode("terms").alias("term"))
    counts = held.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("held")).toArrow().sort_by("term")
    model.prior = (n_toxic + 0.5) / (n + 1)
    model.names = counts["term"].to_pylist()
    model.weights = term_weights(counts["toxic"].to_numpy(), counts["held"].to_numpy(), n_toxic, n)
    bare = spark.sparkContext.broadcast((model.names, model.weights))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = Vectoriser(*bare.value)
        for whole in batches:
            for b in slices(whole, "text"):
                found = [vector(t) for t in b.column("text").to_pylist()]
                made = [pa.array([v[k].astype(kind).tobytes() for v in found], pa.binary()) for k, kind in enumerate((np.int32, np.float32))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), *made], names=["doc_id", "label", "terms", "weights"])

    made = rows.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, terms binary, weights binary").toArrow().sort_by("doc_id")
    bare.destroy()
    found = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(b.as_buffer(), np.float32)) for a, b in zip(made["terms"], made["weights"], strict=True)]
    # neighbours share their weightiest term: blocks are alike, and bounds tight
    order = sorted(range(len(found)), key=lambda i: (int(found[i][0][found[i][1].argmax()]) if len(found[i][0]) else -1, i))
    found = [found[i] for i in order]
    model.ids = made["doc_id"].to_numpy()[order]
    model.labels = (made["label"].to_numpy()[order] > 0).astype(float)
    own = np.concatenate([[0], np.cumsum([len(t) for t, _ in found])])
    model.index = Index(own, np.concatenate([t for t, _ in found]), np.concatenate([w for _, w in found]), len(model.names))
    del counts, made, found
    shared = spark.sparkContext.broadcast(model)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {i: k for k, i in enumerate(shared.value.ids.tolist())}
        for whole in batches:
            for b in slices(whole, "text"):
                own = [places[i] for i in b.column("doc_id").to_pylist()]
                shares = [share for share, _, _ in shared.value.near(b.column("text").to_pylist(), own)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(shares, pa.float64())], names=["doc_id", "label", "share"])

    voted = rows.select("doc_id", "label", "text").mapInArrow(votes, "doc_id long, label int, share double").toArrow().sort_by("doc_id")
    shared.destroy()
    model.slope = calibrate(voted["share"].to_numpy(), (voted["label"].to_numpy() > 0).astype(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str, str] = ("score", "neighbours", "cosines", "evidence")) -> DataFrame:
    """docs with a score (0 to 1), the ids and cosines of the nearest examples, and the weightiest terms, under ``names``.

    Null and empty texts, and texts without a term of any example, get the score of a vote without voters. Columns
    with the given names are replaced; all others, and all rows, stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kinds = (pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string()))

    def run(texts: list[str]) -> dict[str, pa.Array]:
        asked = list(dict.fromkeys(texts))  # copies that come together cost one search
        known = dict(zip(asked, shared.value.scores(asked), strict=True))
        found = [known[t] for t in texts]
        return {name: pa.array([f[k] for f in found], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))}

    made = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("double", "array<long>", "array<double>", "array<string>"), strict=True))
    return docs.mapInArrow(per_text(text, run), f"{fields}, {made}")


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """A model of the labels whose id's checksum modulo 3 isn't 1."""
    return fit(sample(docs, labels, "toxic", 3, 1, train_rows, train_bytes))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Scores of all documents with their evidence."""
    return score(docs.select("doc_id", "text"), learn(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "evidence"
    )
