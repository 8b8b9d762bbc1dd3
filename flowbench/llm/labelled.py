"""Labelled rows to learn from: a bounded, deterministic sample, without held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbench.llm.common import saved


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id (as text; null: false) leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, most_bytes: int = 1 << 25) -> DataFrame:
    """At most ``rows`` rows ``doc_id, text, label`` outside the held-out fold, the first by a hash of their id.

    The row that takes the texts to ``most_bytes`` is the last, so rows and bytes are bounded (but for one text). Rows
    without an id or a label are left out; of several labels of an id the largest counts, of several documents of an
    id the text that is first in order. The chosen ids are bounded by ``rows``, so they are sent to the documents.
    """
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(*order).limit(rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = saved(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))
    before = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    within = found.select("doc_id", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < most_bytes).select("doc_id")
    return found.join(F.broadcast(within), "doc_id")
