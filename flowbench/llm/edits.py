"""Token counts that follow edits: a segment tree of pre-token leaves for each document.

A leaf holds a run of pre-tokens; inner nodes hold the characters and ids below them. An edit finds its leaves by
descending the tree, encodes again only those leaves and as many after them as it takes for the pre-token
boundaries to fall in with the old ones (with the text beyond as context), and updates the sums above.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.llm.bpe import LONGEST, SPACE, Vocabulary
from flowbench.llm.common import slices

#: Parts (a space and the word after it) or, in texts with parts of over LONGEST characters, pre-tokens in a leaf at
#: first; a leaf is split anew where it has grown to more than eight times as many pre-tokens.
LEAF = 16
EDIT = "struct<start:int,removed:int,inserted:string>"


class TokenTree:
    """A text in leaves with sums of characters and ids."""

    def __init__(self, vocabulary: Vocabulary, leaves: list[str], ids: list[int]) -> None:
        self.vocabulary, self.reencoded = vocabulary, 0
        self.load(leaves, ids)

    @classmethod
    def build(cls, vocabulary: Vocabulary, text: str) -> TokenTree:
        tree = cls(vocabulary, [""], [0])
        parts = SPACE.split(text)
        if max(map(len, parts)) <= LONGEST:
            sizes = [len(vocabulary.by_pieces(parts[0])), *(len(vocabulary.parts[p]) for p in parts[1:])]
            leaves = [" " * (k > 0) + " ".join(parts[k : k + LEAF]) for k in range(0, len(parts), LEAF)]
        else:
            pieces = vocabulary.find.findall(text)
            sizes = [len(vocabulary.by_piece(p)) for p in pieces]
            leaves = ["".join(pieces[k : k + LEAF]) for k in range(0, len(pieces), LEAF)]
        tree.load(leaves, [sum(sizes[k : k + LEAF]) // 4 for k in range(0, len(sizes), LEAF)])
        return tree

    def load(self, leaves: list[str], ids: list[int]) -> None:
        self.leaves, self.size = leaves, 1 << (len(leaves) - 1).bit_length()
        self.chars, self.ids = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = map(len, leaves)
        self.ids[self.size : self.size + len(leaves)] = ids
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.ids[k] = self.ids[2 * k] + self.ids[2 * k + 1]

    def count(self, piece: str) -> int:
        """Number of ids of a pre-token."""
        return len(self.vocabulary.by_piece(piece)) // 4

    def put(self, leaf: int, text: str, ids: int) -> None:
        self.leaves[leaf] = text
        k = self.size + leaf
        by_chars, by_ids = len(text) - self.chars[k], ids - self.ids[k]
        while k:
            self.chars[k] += by_chars
            self.ids[k] += by_ids
            k //= 2

    def locate(self, at: int) -> tuple[int, int]:
        """The leaf of the character at this position (past the end: the last leaf), and where the leaf begins."""
        if at >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, self.chars[1] - self.chars[self.size + last]
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if at - begin >= self.chars[k]:
                begin += self.chars[k]
                k += 1
        return k - self.size, begin

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` characters from ``start`` on; both are cut to the text."""
        total = self.chars[1]
        start = min(max(0, start), total)
        end = min(start + max(0, removed), total)
        # a pre-token depends on its text and at most two characters more (white space before a word, contractions):
        # all leaves that end three characters ahead of the edit stay as they are
        first, begin = self.locate(max(0, start - 3))
        last, _ = self.locate(end)
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - begin] + inserted + old[end - begin :]
        while True:
            context, beyond = "", last + 1
            while beyond < len(self.leaves) and len(context) < 3:
                context += self.leaves[beyond]
                beyond += 1
            pieces, at = [], 0
            for m in self.vocabulary.find.finditer(new + context):
                if at >= len(new):
                    break
                pieces.append(m[0])
                at = m.end()
            if at == len(new):
                break
            last, new = beyond - 1, new + context
        self.reencoded += len(pieces)
        spots = last - first + 1
        each = -(-len(pieces) // spots) if pieces else 1
        if each > 8 * LEAF:
            parts = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)]
            ids = self.ids[self.size : self.size + len(self.leaves)]
            self.load(
                [*self.leaves[:first], *map("".join, parts), *self.leaves[last + 1 :]],
                [*ids[:first], *(sum(map(self.count, p)) for p in parts), *ids[last + 1 :]],
            )
            return
        for k in range(spots):
            own = pieces[k * each : (k + 1) * each]
            self.put(first + k, "".join(own), sum(map(self.count, own)))

    def text(self) -> str:
        return "".join(self.leaves)


def build(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """docs with ``leaf_chars`` and ``leaf_ids`` (arrays): the leaves of each text's tree; a null text is an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.drop("leaf_chars", "leaf_ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                texts = [t or "" for t in b.column(text).to_pylist()]
                shared.value.learn(texts)
                trees = [TokenTree.build(shared.value, t) for t in texts]
                made = [pa.array([[len(x) for x in t.leaves] for t in trees], pa.list_(pa.int32())), pa.array([t.ids[t.size : t.size + len(t.leaves)] for t in trees], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "leaf_chars", "leaf_ids"])

    return docs.mapInArrow(run, f"{fields}, leaf_chars array<int>, leaf_ids array<int>")


def apply(trees: DataFrame, vocabulary: Vocabulary, text: str = "text", edits: str = "edits") -> DataFrame:
    """trees with their array column of edits applied, in order: text and leaves are new, ``reencoded`` counts pre-tokens.

    Edits that reach beyond the text are cut to it; null edits and null positions change nothing; a null text is
    edited as an empty one.
    """
    shared = trees.sparkSession.sparkContext.broadcast(vocabulary)
    trees = trees.drop("reencoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trees.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                out = []
                for t, chars, ids, todo in zip(*(b.column(c).to_pylist() for c in (text, "leaf_chars", "leaf_ids", edits)), strict=True):
                    leaves, at = [], 0
                    for n in chars:
                        leaves.append((t or "")[at : at + n])
                        at += n
                    tree = TokenTree(shared.value, leaves, ids)
                    for e in todo or []:
                        if e and e["start"] is not None:
                            tree.edit(e["start"], e["removed"] or 0, e["inserted"] or "")
                    out.append(tree)
                made = {
                    text: pa.array([t.text() for t in out], pa.string()),
                    "leaf_chars": pa.array([[len(x) for x in t.leaves] for t in out], pa.list_(pa.int32())),
                    "leaf_ids": pa.array([t.ids[t.size : t.size + len(t.leaves)] for t in out], pa.list_(pa.int32())),
                    "reencoded": pa.array([t.reencoded for t in out], pa.int64()),
                }
                columns = dict(zip(b.schema.names, b.columns, strict=True)) | made
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return trees.mapInArrow(run, f"{fields}, reencoded long")


def own_edits(key: Column, text: Column, n: int = 4) -> Column:
    """n edits that a document's id decides: up to 39 characters give way to up to 59 from elsewhere in the text."""
    size = F.length(text)

    def draw(k: int, part: str, below: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(k), F.lit(part)), below.cast("long")).cast("int")

    return F.array(*[
        F.named_struct(
            F.lit("start"), draw(k, "start", size + 1), F.lit("removed"), draw(k, "removed", F.lit(40)),
            F.lit("inserted"), F.substring(text, draw(k, "from", size + 1) + 1, draw(k, "long", F.lit(60))),
        )
        for k in range(n)
    ])


def counts(docs: DataFrame, vocabulary: Vocabulary, n: int = 4) -> DataFrame:
    """Per document its ids before and after its own edits, what was encoded again, and the digest of the edited text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trees = build(rows, vocabulary).withColumn("edits", own_edits(F.col("doc_id"), F.col("text"), n))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    trees = trees.withColumn("tokens_before", total(F.col("leaf_ids")))
    return apply(trees, vocabulary).select(
        "doc_id", F.lit(n).cast("long").alias("n_edits"), "tokens_before", total(F.col("leaf_ids")).alias("tokens_after"),
        "reencoded", F.sha2("text", 256).alias("edited_sha256"),
    )
