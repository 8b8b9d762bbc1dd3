"""What several operators share: tables, saved intermediate tables, batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes, as stored, up to which a side is sent to every executor; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new one, of this machine, in local mode alone."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowbench-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df saved, and marked for broadcast if it has at most so many rows, and bytes; else Spark's join shuffles it."""
    df = df if "stored_at" in vars(df) else saved(df)
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    size = path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def folded(text: Column) -> Column:
    """Text with A-Z in lower case and all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts have about ``most`` bytes, or lists so many members, together.

    Memory stays bounded by the longest text.
    """
    rows = batch.column(column)
    length = pa.compute.list_value_length if pa.types.is_list(rows.type) else pa.compute.binary_length
    sizes = pa.compute.fill_null(length(rows), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


@contextmanager
def arrow_bytes(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Within it, jobs send rows to Python workers in batches of about so many bytes, or of one longer row.

    Batches stand in the executor's and in the worker's memory at once, once a core. The setting counts when a job
    starts, so what is to run under it must be written within.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def per_text(text_column: str, function: Callable[[list[str]], dict[str, pa.Array]], keep: bool = True) -> Callable:
    """A mapInArrow function that appends the columns which ``function`` makes of each run of texts (null: empty).

    The texts themselves go on only if they are to be kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                made = function([x or "" for x in part.column(text_column).to_pylist()])
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | made
                if not keep:
                    del columns[text_column]
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def tree_sum(parts: DataFrame, n_parts: int, fan_in: int = 32) -> DataFrame:
    """Sums vectors by key without gathering all parts of a key in one task.

    parts has ``key int, part int, vector binary`` (float64 bytes; part in [0, n_parts)); the result has one
    row ``key, part 0, vector`` a key. Each round adds at most fan_in vectors in a group, so a group's memory is
    bounded whatever the number of parts.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, dtype=np.float64) for v in sorted(map(bytes, pdf["vector"])))  # one order of summing
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "part": pdf["part"].iloc[:1], "vector": [total.tobytes()]})

    while True:
        n_parts = -(-n_parts // fan_in)
        parts = (
            parts.withColumn("part", (F.col("part") % n_parts).cast("int"))
            .groupBy("key", "part")
            .applyInPandas(add, "key int, part int, vector binary")
        )
        if n_parts <= 1:
            return parts
