"""Records of JSON arrays of any size, read by many tasks.

Spark's text source cuts the files at commas into splits of its own size, and hands each split's pieces over in order. A
first pass tells, for each way in which a split may begin (outside a string, inside one, behind a backslash), how it ends,
how much deeper the nesting then is, and how many commas stand at the depth of the list. These are few numbers a split;
chained file by file they give the depth, state and record at which each split begins. A second pass cuts the splits into
records at the commas of the list; a record that lies over a border is put together from its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a split may begin: outside strings, inside one, inside one behind a backslash.
OUT, INSIDE, ESCAPED = STATES = 0, 1, 2
QUOTE, SLASH, COMMA, WHITE = 34, 92, 44, b" \t\n\r"
TURN = np.zeros(256, np.int8)
TURN[[91, 123]], TURN[[93, 125]] = 1, -1


def structure(data: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas outside strings, the change of depth at each (0: a comma), and the state at the end."""
    quotes, slashes = np.flatnonzero(data == QUOTE), np.flatnonzero(data == SLASH)
    led = np.zeros(0, bool)
    if len(slashes) or state == ESCAPED:
        # the length of the run of backslashes before a place decides whether what stands there is escaped
        first = np.concatenate(([True], np.diff(slashes) > 1)) if len(slashes) else led
        start = np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0)) if len(slashes) else slashes
        begin = slashes[start] if len(slashes) else slashes
        extra = (begin == 0) & (state == ESCAPED)
        odd = (slashes - begin + 1 + extra) % 2 == 1
        led = np.zeros(len(data) + 1, bool)
        led[slashes + 1] = odd
        led[0] = state == ESCAPED
        quotes = quotes[~led[quotes]]
    inside = int(state != OUT)
    marks = np.flatnonzero((TURN[data] != 0) | (data == COMMA))
    marks = marks[(np.searchsorted(quotes, marks) + inside) % 2 == 0]
    ends_inside = (len(quotes) + inside) % 2
    escaped = ends_inside and len(led) and led[len(data)]
    return marks, TURN[data[marks]].astype(np.int64), (ESCAPED if escaped else INSIDE) if ends_inside else OUT


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The bytes of each split, a batch at a time, every piece with its comma."""
    for batch in batches:
        keys = batch.select(columns)
        if not batch.num_rows:
            continue
        block, path = batch.column("block").to_numpy(), batch.column("path")
        cuts = np.flatnonzero((block[1:] != block[:-1]) | pa.compute.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            pieces = batch.column("value").slice(lo, hi - lo).cast(pa.binary()).to_pylist()
            yield tuple(keys.slice(lo, 1).to_pylist()[0].values()), np.frombuffer(b",".join(pieces) + b",", np.uint8)


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, block, is_list, state, ends, deeper, least, at_least, above`` of each split and each state that it may begin in.

    least is the lowest depth in the split, from its own start; at_least and above count the commas there and one deeper.
    """
    own, found, head, is_list = None, [], b"", False

    def done() -> list[tuple]:
        return [(*own, is_list, s, ends, depth, least, commas.get(least, 0), commas.get(least + 1, 0)) for s, (ends, depth, least, commas) in enumerate(found)]

    out = []
    for key, data in runs(batches, ["path", "block"]):
        if key != own:
            out += done() if own is not None else []
            own, found, head, is_list = key, [(s, 0, 0, {}) for s in STATES], b"", False
        if not is_list and not head:
            head = data.tobytes().lstrip(WHITE + b"\xef\xbb\xbf")[:1]
            is_list = head == b"["
        for s in STATES:
            state, depth, least, commas = found[s]
            _, turns, state = structure(data, state)
            at = depth + np.cumsum(turns)
            if len(at):
                values, counts = np.unique(at[turns == 0], return_counts=True)
                for v, n in zip(values.tolist(), counts.tolist(), strict=True):
                    commas[v] = commas.get(v, 0) + n
                depth, least = int(at[-1]), min(least, int(at.min()))
            found[s] = (state, depth, least, {v: n for v, n in commas.items() if v <= least + 1})
    out += done() if own is not None else []
    names = ["path", "block", "is_list", "state", "ends", "deeper", "least", "at_least", "above"]
    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names).astype({"path": object, "is_list": bool} | {c: "int64" for c in names if c not in ("path", "is_list")}), preserve_index=False)


def chained(frame: pd.DataFrame) -> pd.DataFrame:
    """``path, block, state, depth, records`` at which each split of a file begins; no rows for a file that is no whole list."""
    state, depth, records, out = OUT, 0, 0, []
    rows = {(r.block, r.state): r for r in frame.itertuples(index=False)}
    blocks = sorted(frame["block"].unique())
    if not rows[blocks[0], OUT].is_list:
        blocks = []
    for block in blocks:
        row = rows[block, state]
        out.append((row.path, block, state, depth, records))
        records += {-depth: row.above, 1 - depth: row.at_least}.get(row.least, 0)
        if depth + row.least < 0:
            out = []
            break
        state, depth = row.ends, depth + row.deeper
    if state != OUT or depth:
        out = []
    return pd.DataFrame(out, columns=["path", "block", "state", "depth", "records"])


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, rec_pos, block, whole, record``: records of each split, and parts (not whole) of those over its borders."""
    names = ["path", "rec_pos", "block", "whole", "record"]
    own, state, depth, record, begun, text, held, size = None, OUT, 0, 0, False, bytearray(), [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=names)

    for key, data in runs(batches, ["path", "block", "state", "depth", "records"]):
        if key[:2] != own:
            if text and depth:
                held.append((own[0], record, own[1], False, bytes(text)))
            own, (state, depth, record) = key[:2], key[2:]
            begun, text = False, bytearray()
        marks, turns, state = structure(data, state)
        at = depth + np.cumsum(turns)
        # the list's own bracket opens its first record, its commas end one and begin the next, its last bracket ends the last
        spots = marks[((turns == 0) & (at == 1)) | ((turns == 1) & (at == 1)) | ((turns == -1) & (at == 0))].tolist()
        last = 0
        raw = data.tobytes()
        for spot in spots:
            kind = raw[spot : spot + 1]
            if kind == b"[" and not depth:
                depth, begun, text = 1, True, bytearray()
            elif kind in b"{[" or kind == b"}":
                continue
            else:
                text += raw[last:spot]
                held.append((own[0], record, own[1], begun, bytes(text)))
                size += len(text)
                record, begun, text = record + 1, True, bytearray()
            last = spot + 1
        depth = int(at[-1]) if len(at) else depth
        if depth:
            text += raw[last:]
        if len(held) >= 4096 or size > 1 << 22:
            yield batch()
            held, size = [], 0
    if text and depth:
        held.append((own[0], record, own[1], False, bytes(text)))
    if held:
        yield batch()


def read_array_records(spark: SparkSession, paths: str | list[str], glob: str = "*.json", limit: int | None = None) -> DataFrame:
    """``path, rec_pos, record`` (text, as it stands) of files that are JSON lists, or of each one's first ``limit`` records.

    A file may be of any size: its splits are those of Spark's text source (``spark.sql.files.maxPartitionBytes``), and a
    task holds one batch of pieces and one record. A file that is no list, or whose brackets or strings do not close, has no
    records. What stands between the list's commas is not checked further. The text is UTF-8.
    """
    rows = spark.read.text(paths, lineSep=",", pathGlobFilter=glob, recursiveFileLookup=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    kinds = "path string, block long, is_list boolean, state long, ends long, deeper long, least long, at_least long, above long"
    begins = rows.mapInArrow(summaries, kinds).groupBy("path").applyInPandas(chained, "path string, block long, state long, depth long, records long")
    if limit is not None:
        begins = begins.where(F.col("records") < limit)
    # one row a split, so the side grows with the bytes by one row in a hundred million; order within splits must stay
    parts = rows.join(F.broadcast(begins), ["path", "block"]).select("path", "block", "value", "state", "depth", "records")
    parts = parts.mapInArrow(cut, "path string, rec_pos long, block long, whole boolean, record binary")
    whole = parts.where("whole").select("path", "rec_pos", "record")
    over = parts.where("NOT whole").groupBy("path", "rec_pos").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("p"))
    joined = over.select("path", "rec_pos", F.aggregate(F.transform("p", lambda x: x["record"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("record"))
    out = whole.unionByName(joined).select("path", "rec_pos", F.btrim(F.col("record").cast("string"), F.lit(" \t\n\r")).alias("record"))
    # an empty list has one record without text
    out = out.where((F.col("rec_pos") > 0) | (F.col("record") != ""))
    return out if limit is None else out.where(F.col("rec_pos") < limit)
