"""Row-wise jobs on streams of documents: no state, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowbench.operators.validate import validate_graphs
from flowbench.sources.readers import parse_results


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents that arrive in a folder, one file each, as rows ``path, value``."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(path)
    return rows.selectExpr("_metadata.file_path AS path", "value")


def stream_violations(documents: DataFrame) -> DataFrame:
    """What arriving graph documents violate."""
    return validate_graphs(documents, ["path"])


def stream_results(documents: DataFrame) -> DataFrame:
    """Arriving result documents with the reason why one does not rank."""
    return parse_results(documents)
