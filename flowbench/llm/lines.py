"""Dropping lines that many documents share, by compressed bitmaps of the lines to keep.

Only hashes travel: of every long line its 128-bit key, document and position. They are dealt by ranges of key and
document, so that a line which a third of all documents hold is spread over many tasks, and sorted by key, then document
(largest first), then position. A task streams its range: the first document of a key keeps its lines, those of later
ones go once enough documents have been seen. A key that reaches over the end of a range is decided from the counts that
its ranges give; there are at most two such keys a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import folded, fresh, saved, small

#: Fixed white space of a line's ends.
SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: What a row of the stream is: a line that goes, a line whose key reaches over the end of a range, the count of such a key.
GOES, OPEN, COUNT = 0, 1, 2


def text_key(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.struct(F.xxhash64(text).alias("a"), F.octet_length(text).alias("b"))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` (null: empty) with their text_key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), text_key(text).alias("text_key"))


def long_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """``h1, h2, doc_id, text_key, n_lines, pos`` of the lines of keyed() whose key has at least ``min_chars`` code points."""
    # what a text gives once stands below the explode, or it would be made for every line
    once = rows.select("doc_id", "text_key", F.split("text", "\n", -1).alias("lines")).select("*", F.size("lines").alias("n_lines"))
    each = once.select("doc_id", "text_key", "n_lines", F.posexplode("lines").alias("pos", "line"))
    key = folded(F.btrim("line", F.lit(SPACE)))
    each = each.select("doc_id", "text_key", "n_lines", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return each.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_key", "n_lines", "pos")


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal to each other."""
    left, right = column.slice(0, max(len(column) - 1, 0)), column.slice(1)
    differ = pa.compute.fill_null(pa.compute.not_equal(left, right), False)
    return differ.to_numpy(zero_copy_only=False) | (left.is_null().to_numpy(zero_copy_only=False) != right.is_null().to_numpy(zero_copy_only=False))


def stream(min_docs: int):  # noqa: ANN201
    """A mapInArrow function over sorted lines that tells which of them go; see the module.

    It holds the lines of fewer than ``min_docs`` documents at a time, of one key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, first, n, edge, held = None, None, None, 0, True, []

        def rows(batch: pa.RecordBatch, kind: int, counts: int = 0) -> pa.RecordBatch:
            size = batch.num_rows
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *batch.columns, pa.array(np.full(size, counts, np.int64))], names=["kind", *batch.schema.names, "docs"])

        def closed() -> Iterator[pa.RecordBatch]:
            """What the key that ends at a range's border leaves open."""
            yield from (rows(h, OPEN) for h in held)
            yield rows(first, COUNT, n)

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            new_key = np.concatenate(([key != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            new_doc = np.concatenate(([new_key[0] or last != batch.column(2)[0].as_py()], changes(batch.column(2)))) | new_key
            starts = np.flatnonzero(new_key)
            bounds = np.concatenate(([0], starts[starts > 0], [len(h1)]))
            ordinal = np.cumsum(new_doc)
            # a key that begins and ends in this batch, in too few documents, asks for nothing
            many = ordinal[bounds[1:] - 1] - ordinal[bounds[:-1]] >= min_docs - 1
            many[[0, -1]] = True
            for at in np.flatnonzero(many).tolist():
                lo, hi = int(bounds[at]), int(bounds[at + 1])
                if new_key[lo]:
                    if key is not None:
                        if edge:
                            yield from closed()
                        edge = False
                    key, first, n, held = (h1[lo], h2[lo]), batch.slice(lo, 1), 0, []
                place = ordinal[lo:hi] - ordinal[lo] + int(new_doc[lo]) + n
                n = int(place[-1])
                part = batch.slice(lo, hi - lo)
                if edge:
                    yield rows(part, OPEN)
                    continue
                if (place > 1).any():
                    held.append(part.filter(pa.array(place > 1)))
                if n >= min_docs and held:
                    yield from (rows(h, GOES) for h in held)
                    held = []
            last = batch.column(2)[-1].as_py()
        if key is not None:
            yield from closed()

    return run


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text_key, n_lines, n_dropped long, keep`` of the documents that lose lines; all others keep all.

    keep is a bitmap of the lines that stay, compressed as runs: array<struct<start,end>>, the end exclusive.
    A line's key is the line without white space at its ends, A-Z in lower case. Keys of ``min_chars`` code points or more
    in ``min_docs`` documents or more lose their lines in all but the largest doc_id. Rows of one doc_id are one document,
    whatever their texts; a null id is a document of its own, smaller than all others; repeated rows count once. A null
    text is one empty line. Memory of a task is bounded by the lines of ``min_docs`` documents.
    """
    lines = long_lines(keyed(docs), min_chars).distinct()
    order = [F.col("h1"), F.col("h2"), F.desc("doc_id")]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "text_key", "pos")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    told = saved(dealt.mapInArrow(stream(min_docs), f"kind int, {kinds}, docs long"))
    # at most two keys a range, so as many rows as there are shuffle partitions, twice
    counts = told.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc_id").alias("largest")).where(F.col("docs") >= min_docs).drop("docs")
    late = told.where(F.col("kind") == OPEN).join(F.broadcast(counts), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    columns = ["doc_id", "text_key", "n_lines", "pos"]
    gone = told.where(F.col("kind") == GOES).select(*columns).unionByName(late.select(*columns))
    lists = gone.groupBy("doc_id", "text_key", "n_lines").agg(F.sort_array(F.collect_list("pos")).alias("gone"), F.count(F.lit(1)).alias("n_dropped"))
    starts, ends = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1)), F.concat("gone", F.array("n_lines"))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return lists.select("doc_id", "text_key", "n_lines", "n_dropped", F.filter(runs, lambda r: r["end"] > r["start"]).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """A text's lines that its bitmap keeps; all where there is none."""
    runs = F.transform(keep, lambda r: F.slice(F.split(text, "\n", -1), r["start"] + 1, r["end"] - r["start"]))
    return F.when(keep.isNull(), text).otherwise(F.array_join(F.flatten(runs), "\n"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """keyed(docs) with ``n_dropped`` and ``keep``, both null where all lines stay."""
    marks = small(bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_dropped", "keep"))
    rows = keyed(docs)
    return rows.join(marks, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_key == F.col("_key")), "left").drop("_id", "_key")


def without_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with their texts less the lines of keep_bitmaps(); all rows and columns stay, a null text stays null."""
    own, key, mark, keep = fresh(docs, "_id", "_key", "_mark", "_keep")
    bitmaps = small(keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("keep").alias(keep)))
    rows = docs.withColumn(mark, text_key(F.coalesce("text", F.lit(""))))
    rows = rows.join(bitmaps, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(mark) == F.col(key)), "left")
    return rows.select(*[kept_text(F.col("text"), F.col(keep)).alias(c) if c == "text" else F.col(c) for c in docs.columns])


def digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of all documents, from their bitmaps."""
    rows = with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    n_lines, dropped = F.size(F.split("text", "\n", -1)).cast("long"), F.coalesce("n_dropped", F.lit(0).cast("long"))
    return rows.select("doc_id", n_lines.alias("n_lines"), dropped.alias("n_dropped"), F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"))
