"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Features are hashed unigrams and bigrams of words and runs of signs, and bigrams of their shapes (lower, title or
upper case, digits, signs, a repeated word). A score is a sparse dot product with the learned weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import per_text
from flowbench.llm.labelled import held_out, sample

#: Hash buckets, and labelled rows that the model is fitted on at most.
BUCKETS, TRAIN_ROWS = 1 << 18, 4000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SCALE = 8.0


class Tokens(dict):
    """Token -> 256 * hash + shape, made when first asked for."""

    def __missing__(self, t: str) -> int:
        if t[0].isalpha():
            shape = 1 if t.islower() else 2 if t.istitle() else 3 if t.isupper() else 4
        else:
            shape = 5 if t.isdigit() else 6 + zlib.crc32(t[:3].encode()) % 200
        made = self[t] = zlib.crc32(t.encode()) << 8 | shape
        return made


class Hasher:
    """Texts to feature buckets; the tokens it keeps are bounded."""

    def __init__(self) -> None:
        self.seen = Tokens()

    def buckets(self, text: str) -> tuple[np.ndarray, float]:
        """Buckets of a text's features, repeated ones too, and the value of each: shares count, not length."""
        if len(self.seen) > 1 << 18:
            self.seen.clear()
        tokens = TOKEN.findall(text)
        both = np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))
        word, shape = both >> 8, both & 255
        pair = (word[:-1] * 0x9E3779B1 + word[1:] * 0x85EBCA77) >> 7
        turn = np.where(word[:-1] == word[1:], 255 * 257, shape[:-1] * 256 + shape[1:]) * 0xC2B2AE35 >> 5
        return np.concatenate([word, pair, turn]) % BUCKETS, SCALE / max(1, len(tokens))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets and their values."""
        index, value = self.buckets(text)
        index, count = np.unique(index, return_counts=True)
        return index, value * count


class Ftrl:
    """Logistic regression with per-coordinate follow-the-regularised-leader updates."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.01) -> None:
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def with_bias(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(index, BUCKETS), np.append(value, 1.0)


def train(rows: DataFrame, updates: int = 8000) -> np.ndarray:
    """Weights learned from ``doc_id, text, label``, a bounded sample. Features are made by the executors.

    Passes over the rows go on until about so many updates, at least two and at most 40 times; without rows all
    weights are 0, and every score 0.5.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            found = [hasher(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                names=["doc_id", "label", "buckets", "shares"],
            )

    made = rows.select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, buckets binary, shares binary")
    data = sorted(((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.label, bytes(r.buckets), bytes(r.shares)) for r in made.collect()))
    data = [(label, *with_bias(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(np.float64))) for _, _, label, i, v in data]
    model = Ftrl()
    for _ in range(min(40, max(2, updates // max(1, len(data)))) if data else 0):
        for label, index, value in data:
            model.update(index, value, label)
    return model.weights(slice(None)).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 in ``out`` (null and empty texts: that of no words)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    hasher = Hasher()

    def run(texts: list[str]) -> dict[str, pa.Array]:
        w = shared.value
        raw = np.array([w[BUCKETS] + w[i].sum() * v for i, v in map(hasher.buckets, texts)])
        return {out: pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))), pa.float64())}

    return docs.mapInArrow(per_text(text, run), f"{fields}, `{out}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Scores of all documents, learned from labels whose id's checksum modulo 4 isn't 2."""
    weights = train(sample(docs, labels, "quality", 4, 2, train_rows))
    return score(docs.select("doc_id", "text"), weights).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
