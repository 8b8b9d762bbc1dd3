"""Byte-level BPE encoding and decoding over documents of any length.

Long texts are cut into overlapping chunks that separate tasks pre-tokenise. Neighbouring chunks report the
pre-token boundaries they see in the overlap; the first common one is where the later chunk has fallen into step
(what follows a boundary depends on the text after it alone), and there the pieces are stitched. Each piece is
then encoded by itself. Decoding looks up each id's bytes and joins them.

A piece is encoded in parts that begin with a space before a character that is none: there always is a boundary there,
and what a part's pre-tokens are depends on the part alone. The ids of short parts are kept from text to text.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.llm.common import fresh, per_text, saved, slices

#: Texts beyond this many characters are cut, into chunks of so many, with this much overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Distinct pre-tokens, and parts, whose ids a Python worker keeps, and the longest of them in characters.
CACHE, LONGEST = 1 << 17, 64
#: Ids that are decoded at once, and those of a run of rows.
BLOCK, RUN = 1 << 16, 1 << 18
#: Bytes up to which pre-tokens are merged together.
SHORT = 64
#: The space before each part.
SPACE = re.compile(r" (?=\S)")


class Parts(dict):
    """Part without its space -> ids as bytes, made when first asked for; long parts are not kept."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, part: str) -> bytes:
        made = self.vocabulary.by_pieces(" " + part)
        if len(part) <= LONGEST:
            if len(self) > CACHE:
                self.clear()
            self[part] = made
        return made


@dataclass(frozen=True)
class Words:
    """The bytes of all ids, one after the other: what decoding needs of a vocabulary."""

    lengths: np.ndarray
    starts: np.ndarray
    bytes: np.ndarray

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each id's bytes end; byte by byte numbers are made for BLOCK ids at a time."""
        ends = np.cumsum(self.lengths[ids])
        out = np.empty(ends[-1] if len(ends) else 0, self.bytes.dtype)
        for start in range(0, len(ids), BLOCK):
            part, before = ids[start : start + BLOCK], int(ends[start - 1]) if start else 0
            lengths, stop = self.lengths[part], int(ends[start + len(part) - 1])
            shift = self.starts[part] - (ends[start : start + BLOCK] - lengths)
            out[before:stop] = self.bytes[np.arange(before, stop) + np.repeat(shift, lengths)]
        return out, ends


class Vocabulary:
    """Ranks of byte strings, as in a .tiktoken file, and the pattern that splits a text before the merges."""

    def __init__(self, content: bytes, pattern: str) -> None:
        pairs = (line.split() for line in content.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pattern = pattern
        self.find = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        self.parts = Parts(self)
        self.known_pairs: tuple[np.ndarray, np.ndarray] | None = None
        self.byte_ids = np.array([self.ranks.get(bytes([b]), 0) for b in range(256)], np.int32)
        size = max(self.ranks.values(), default=-1) + 1
        words = [b""] * size
        for raw, rank in self.ranks.items():
            words[rank] = raw
        self.lengths = np.fromiter(map(len, words), np.int64, size)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if size else np.zeros(0, np.int64)
        self.words = Words(self.lengths, starts, np.frombuffer(b"".join(words), np.uint8))

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def __reduce__(self) -> tuple:
        lines = b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in self.ranks.items())
        return Vocabulary, (lines, self.pattern)

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost of equal ones."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return (whole,)
        n = len(raw)
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ends[j] != end:
                continue
            ends[i], alive[j], after[i] = end, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(raw[i : ends[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[j]]))
            if (p := before[i]) >= 0 and (r := ranks.get(raw[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return tuple(ranks[raw[i : ends[i]]] for i in range(n) if alive[i])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of ids that stand for the two parts of a byte string with a rank, as one sorted number each, and the ranks."""
        if self.known_pairs is None:
            get, size = self.ranks.get, len(self.lengths)
            found = [(a * size + b, r) for raw, r in self.ranks.items() for k in range(1, len(raw)) if (a := get(raw[:k])) is not None and (b := get(raw[k:])) is not None]
            keys, ranks = np.array(sorted(found), np.int64).reshape(-1, 2).T
            self.known_pairs = keys.copy(), ranks.astype(np.int32)
        return self.known_pairs

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens, as 32-bit numbers: as merge(), one merge in every word at a time."""
        keys, ranks = self.pairs()
        size, never = len(self.lengths), np.int32(len(self.lengths))

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            asked = a.astype(np.int64) * size + b
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return np.where(keys[at] == asked, ranks[at], never) if len(keys) else np.full(len(asked), never)

        known = map(self.ranks.get, words)
        out = [b"" if r is None else r.to_bytes(4, "little") for r in known]
        for k, raw in enumerate(words):
            if not out[k] and len(raw) > SHORT:
                out[k] = np.array(self.merge(raw), np.int32).tobytes()
        left = [k for k, made in enumerate(out) if not made]
        lengths = np.fromiter((len(words[k]) for k in left), np.int64, len(left))
        order = np.argsort(lengths, kind="stable")
        cuts = np.searchsorted(lengths[order], [0, 5, 9, 13, 17, 25, 41, SHORT + 1])  # words of like length go together
        for at in (order[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b):
            group, n, width = [left[k] for k in at.tolist()], lengths[at], int(lengths[at].max())
            inside = np.arange(width) < n[:, None]
            ids = np.zeros((len(group), width), np.int32)
            ids[inside] = self.byte_ids[np.frombuffer(b"".join([words[k] for k in group]), np.uint8)]
            rank, alive = np.full((len(group), width), never, np.int32), inside.copy()
            both = inside[:, 1:]
            rank[:, :-1][both] = rank_of(ids[:, :-1][both], ids[:, 1:][both])
            after, before = np.tile(np.arange(1, width + 1), (len(group), 1)), np.tile(np.arange(-1, width - 1), (len(group), 1))
            rows = np.arange(len(group))
            while True:
                i = rank[rows].argmin(axis=1)
                least = rank[rows, i]
                rows, i, least = rows[least < never], i[least < never], least[least < never]
                if not len(rows):
                    break
                j = after[rows, i]
                k = after[rows, j]
                ids[rows, i], alive[rows, j], rank[rows, j], rank[rows, i], after[rows, i] = least, False, never, never, k
                right = k < n[rows]
                r, c, d = rows[right], i[right], k[right]
                before[r, d] = c
                rank[r, c] = rank_of(ids[r, c], ids[r, d])
                p = before[rows, i]
                r, c, d = rows[p >= 0], p[p >= 0], i[p >= 0]
                rank[r, c] = rank_of(ids[r, c], ids[r, d])
            flat, ends = ids[alive].tobytes(), np.cumsum(alive.sum(axis=1)) * 4
            for word, a, b in zip(group, [0, *ends.tolist()], ends.tolist(), strict=False):
                out[word] = flat[a:b]
        return out

    def learn(self, texts: list[str]) -> None:
        """Takes the parts of some texts in, all that are new at once."""
        if len(self.parts) > CACHE:
            self.parts.clear()
        if len(self.cache) > CACHE:
            self.cache.clear()
        split = [SPACE.split(t) for t in texts]
        new = {p for parts in split for p in parts[1:]} - self.parts.keys()
        words = [p for p in new if p.isalpha() and len(p) <= LONGEST]  # one pre-token each
        found = {p: self.find.findall(" " + p) for p in new.difference(words)}
        pieces = {x for f in found.values() for x in f}
        pieces.update(x for parts in split for x in self.find.findall(parts[0]))
        pieces = [x for x in pieces - self.cache.keys() if len(x) <= LONGEST]
        ids = self.merge_many([(" " + p).encode() for p in words] + [x.encode() for x in pieces])
        self.parts.update(zip(words, ids, strict=False))
        self.cache.update(zip(pieces, ids[len(words) :], strict=True))
        self.parts.update((p, b"".join(map(self.by_piece, f))) for p, f in found.items() if len(p) <= LONGEST)

    def by_pieces(self, text: str) -> bytes:
        """Ids of a text, as 32-bit numbers, from pre-token to pre-token."""
        return b"".join(map(self.by_piece, self.find.findall(text)))

    def by_piece(self, piece: str) -> bytes:
        """Ids of a pre-token, as 32-bit numbers."""
        if (ids := self.cache.get(piece)) is None:
            ids = np.array(self.merge(piece.encode()), np.int32).tobytes()
            if len(piece) <= LONGEST:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text, as 32-bit numbers."""
        first, *rest = SPACE.split(text)
        return b"".join([self.by_pieces(first), *map(self.parts.__getitem__, rest)])

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()


def id_lists(lists: Iterable[list[int]]) -> pa.Array:
    """Lists of ids as one Arrow column."""
    lists = list(lists)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encoded(vocabulary: Vocabulary, texts: list[str]) -> pa.Array:
    """The ids of some texts as one Arrow column."""
    vocabulary.learn(texts)
    found = list(map(vocabulary.encode_bytes, texts))
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def boundaries(vocabulary: Vocabulary, text: str, first: bool, last: bool, core: int, overlap: int) -> tuple[list[int], list[int]]:
    """Boundaries of a chunk's pre-tokens in its first ``overlap`` characters and in those after ``core``.

    A token that ends where the chunk does may go on in the next one: its end is no boundary, but at the text's end.
    """
    head, tail, size = [], [], len(text)
    if first:
        head.append(0)
    for m in vocabulary.find.finditer(text):
        for p in {m.start(), m.end()}:
            if p < size or last:
                if p <= overlap and not first:
                    head.append(p)
                if p >= core:
                    tail.append(p)
    return sorted(set(head)), sorted(set(tail))


def stitched_pieces(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str, chunk: int, overlap: int) -> DataFrame:
    """Rows ``key, _no, _piece`` of each text: pieces that begin and end at pre-token boundaries and join to the text.

    Where two chunks have no common boundary in their overlap (a pre-token longer than it), all that follows stays
    one piece: slower, never wrong.
    """
    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):  # long texts: one at a time
                t = whole.column(text)[k].as_py()
                starts = range(0, max(1, len(t)), chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole.column(key)[k].as_py() for _ in starts), pa.array(range(len(starts)), pa.int32()), pa.array([c + chunk >= len(t) for c in starts], pa.bool_()), pa.array([t[c : c + chunk + overlap] for c in starts], pa.string())],
                    names=[key, "_no", "_last", "_chunk"],
                )

    schema_text = f"{key} string, _no int, _chunk string, _head array<int>, _tail array<int>"
    cut = docs.select(key, text).mapInArrow(pieces_of, f"{key} string, _no int, _last boolean, _chunk string").repartition(F.col(key), F.col("_no"))

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, "_chunk")):
            rows = list(zip(*(b.column(c).to_pylist() for c in ("_no", "_last", "_chunk")), strict=True))
            seen = [boundaries(vocabulary, t, no == 0, last, chunk, overlap) for no, last, t in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("_no"), b.column("_chunk"), id_lists(h for h, _ in seen), id_lists(t for _, t in seen)],
                names=[key, "_no", "_chunk", "_head", "_tail"],
            )

    chunks = saved(cut.mapInArrow(see, schema_text))
    order = W.partitionBy(key).orderBy("_no")
    # the narrow table of boundaries alone is gathered by text
    joint = F.array_min(F.array_intersect(F.transform(F.col("_tail"), lambda p: p - chunk), F.lead("_head").over(order)))
    marks = chunks.select(key, "_no", "_tail", "_head").select(
        key, "_no", joint.alias("_joint"), F.lead("_no").over(order).isNull().alias("_end")
    )
    marks = marks.withColumn("_from", F.when(F.col("_no") == 0, 0).otherwise(F.lag("_joint").over(order)))
    # from the first chunk that nothing joins to the one before it, the rest is one piece
    lost = F.max(F.col("_from").isNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) > 0
    marks = marks.withColumn("_lost", lost)
    next_lost = F.coalesce(F.lead("_lost").over(order), F.lit(False))
    marks = marks.select(key, "_no", "_from", "_joint", "_end", "_lost", next_lost.alias("_next_lost"))
    begin = F.when(F.col("_lost"), 0).otherwise(F.col("_from"))
    stop = F.when(F.col("_end"), F.length("_chunk")).when(F.col("_next_lost"), F.lit(chunk)).otherwise(F.col("_joint") + chunk)
    pieces = chunks.join(marks, [key, "_no"]).select(
        key, "_no", (F.col("_lost") | F.col("_next_lost")).alias("_open"),
        F.substring(F.col("_chunk"), begin + 1, stop - begin).alias("_piece"),
    )
    shut = pieces.where(~F.col("_open")).select(key, "_no", "_piece")
    open_ = pieces.where("_open").groupBy(key).agg(
        F.min("_no").alias("_no"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_no", "_piece"))), lambda x: x["_piece"])).alias("_piece"),
    )
    return shut.unionByName(open_)


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP, keep: bool = True
) -> DataFrame:
    """docs with the ids of each whole text in ``out`` (array of int), as ordinary text without special tokens.

    A null or empty text has no ids. Rows keep all their columns, but the text goes where keep is false; a column called
    ``out`` is replaced. Texts of at most ``chunk`` characters are encoded where they are read; longer ones are cut, once
    for each distinct text, and the ids of their pieces meet again by the text's digest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.drop(out)
    as_ids = f"`{out}` array<int>"

    def ids_of(texts: list[str]) -> dict[str, pa.Array]:
        return {out: encoded(shared.value, texts)}

    def with_ids(rows: DataFrame, column: str, keep: bool) -> DataFrame:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if keep or f.name != column]
        return rows.mapInArrow(per_text(column, ids_of, keep), ", ".join([*fields, as_ids]))

    if docs.where(F.length(text) > chunk).limit(1).count() == 0:
        return with_ids(docs, text, keep)
    key, = fresh(docs, "_digest")
    short = docs.where(F.coalesce(F.length(text), F.lit(0)) <= chunk)
    long_ = docs.where(F.length(text) > chunk).withColumn(key, F.sha2(F.col(text), 256))
    texts = long_.select(key, F.col(text).alias("_text")).dropDuplicates([key])
    parts = with_ids(stitched_pieces(texts, shared.value, key, "_text", chunk, overlap), "_piece", False)
    whole = parts.groupBy(key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_no", out))), lambda x: x[out])).alias(out)
    )
    long_ = long_ if keep else long_.drop(text)
    return with_ids(short, text, keep).unionByName(long_.join(whole, key).drop(key))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the bytes that ``ids`` stand for in ``out`` (binary; null or no ids: empty)."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.words)
    rows = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ids, RUN):
                lists = batch.column(ids)
                raw, ends = shared.value.decode(lists.flatten().to_numpy(zero_copy_only=False))
                after = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                offsets = np.concatenate([[0], np.concatenate([[0], ends])[after]]).astype(np.int64)
                found = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*batch.columns, found.cast(pa.binary())], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{out}` binary")


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document the number of its ids, their digest, and the digest of what they decode to."""
    coded = encode(docs.select("doc_id", "text"), vocabulary, keep=False)
    return decode(coded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
