"""A training-data pipeline over ``documents``: each stage's rows are written and read again as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.llm import bpe, decontamination, jaccard, pii, toxicity
from flowbench.llm.common import arrow_bytes, fresh, saved, shared_dir, table
from flowbench.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.7 or more for toxicity; a column called score, or otherwise as the model's, stays."""
    model, names = toxicity.learn(docs, table(spark, sf_dir, "labels")), fresh(docs, "_score", "_neighbours", "_cosines", "_evidence")
    return toxicity.score(docs, model, names=tuple(names)).where(F.col(names[0]) < 0.7).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 80 percent of five-word shingles make."""
    return jaccard.one_of_each(docs, 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data and the terms that disclose it replaced; n_chars follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else clean


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, and whether they decode to its text; all other columns end here."""
    words = vocabulary()
    texts = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    same = F.sha2("decoded", 256) == F.col("digest")
    # written in between: two Python workers a core at once would take twice the memory
    with arrow_bytes(spark):
        coded = saved(bpe.encode(texts, words, keep=False))
        return saved(bpe.decode(coded, words).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("pii", replace_personal_data),
    ("byte_level_bpe", tokenise),
]
#: SQL can't state nearest labelled examples; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
