"""Sharding by a hierarchical weighted hash tree.

A topology is a tree of regions, racks and shards. At each level a row draws ``-ln(u) / weight`` for every child,
with u a hash of the row's key and the child's name, and descends into the smallest draw. A child wins in
proportion to its weight, and a change of one child's weight changes only that child's draw: rows move into the
subtree that grew, or out of the one that shrank, and nowhere else. A new shard enters as a region of its own, so
it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A child of the tree: its name, its weight, and either its children or the number of its shard."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def topology(regions: int = 3, racks: int = 2, shards: int = 4) -> tuple[Node, ...]:
    """Regions of equal racks of equal shards, numbered from 0; weights are numbers of shards."""
    tree, number = [], 0
    for r in range(regions):
        inner = []
        for k in range(racks):
            leaves = tuple(Node(f"{r}/{k}/{s}", 1.0, (), number + s) for s in range(shards))
            number += shards
            inner.append(Node(f"{r}/{k}", float(shards), leaves))
        tree.append(Node(f"{r}", float(racks * shards), tuple(inner)))
    return tuple(tree)


def count_shards(tree: tuple[Node, ...]) -> int:
    """Number of shards below these nodes."""
    return sum(count_shards(n.children) if n.children else 1 for n in tree)


def grown(tree: tuple[Node, ...]) -> tuple[Node, ...]:
    """The tree with one more shard of weight 1, in a region of its own."""
    r, number = len(tree), count_shards(tree)
    return (*tree, Node(f"{r}", 1.0, (Node(f"{r}/0", 1.0, (Node(f"{r}/0/0", 1.0, (), number),)),)))


def draw(key: Column, node: Node) -> Column:
    """The key's exponential draw for a node: smaller wins, in proportion to the weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(node.weight)


def shard_of(key: Column, tree: tuple[Node, ...]) -> Column:
    """The shard that a key (null too) descends to; of equal draws the first child wins."""

    def of(node: Node) -> Column:
        return shard_of(key, node.children) if node.children else F.lit(node.shard)

    if len(tree) == 1:
        return of(tree[0])
    draws = [draw(key, n) for n in tree]
    best = F.least(*draws)
    choice = F.when(draws[0] == best, of(tree[0]))
    for n, d in zip(tree[1:-1], draws[1:-1], strict=True):
        choice = choice.when(d == best, of(n))
    return choice.otherwise(of(tree[-1]))


def assign(docs: DataFrame, tree: tuple[Node, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of each row, its size, checksum, shard and its shard after one more is added.

    Only the key decides. Null keys all go to one shard; repeated keys go to the same one; a null text has size 8
    and checksum 0, as an empty one. Other columns are neither read nor clash.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), tree).cast("int").alias("shard"),
    )
    more = grown(tree)
    # a grown tree differs in its new region alone: its draw decides whether a row leaves its shard
    old, new = [draw(F.col("doc_id"), n) for n in more[:-1]], draw(F.col("doc_id"), more[-1])
    return rows.withColumn(
        "grown_shard",
        F.when(new < (F.least(*old) if len(old) > 1 else old[0]), count_shards(tree)).otherwise(F.col("shard")).cast("int"),
    )


#: Copies of a row that are made at once.
RUN = 1 << 14


def with_slots(rows: DataFrame, bins: int) -> DataFrame:
    """Appends ``slot``, a gapless number from 0 within each shard.

    Rows are dealt to ``bins`` hash bins a shard and numbered in their bin; a bin starts where the ones before it
    end. So no task holds a shard, and the table of bins has shards x bins rows whatever the input. Equal rows are
    counted and numbered as one, and made again in runs of at most RUN, so copies don't gather in a task either.
    """
    names = rows.columns
    rows = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    rows = rows.withColumn("_bin", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("bin")), F.lit(bins)).cast("int"))
    counts = rows.groupBy("shard", "_bin").agg(F.sum("_copies").alias("count"))
    starts = counts.select(
        "shard",
        "_bin",
        (F.sum("count").over(W.partitionBy("shard").orderBy("_bin")) - F.col("count")).alias("_start"),
    )
    order = W.partitionBy("shard", "_bin").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("_at", F.sum("_copies").over(order) - F.col("_copies"))
        .join(F.broadcast(starts), ["shard", "_bin"])
        .withColumn("_first", F.col("_start") + F.col("_at"))
        .withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(RUN).cast("long"))))
        .repartition("shard", "_first", "_run")
        .withColumn("_copy", F.explode(F.sequence("_run", F.least(F.col("_run") + RUN, F.col("_copies")) - 1)))
        .select(*names, (F.col("_first") + F.col("_copy")).cast("long").alias("slot"))
    )


def shard(docs: DataFrame, tree: tuple[Node, ...], bins: int | None = None) -> DataFrame:
    """assign() and with_slots(), with as many bins as the session has shuffle partitions unless given."""
    bins = bins or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_slots(assign(docs, tree), bins).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
