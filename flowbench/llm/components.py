"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.llm.common import saved


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows ``node, root`` for every node of ``a, b``; root is the smallest node that links reach.

    Alternating star contraction: each node hands its larger neighbours, then its smaller ones, to the smallest.
    Every round halves long paths and is written to the shared folder; the number of links never grows. Degrees are
    joined back rather than gathered, so a hub is no group.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    links = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s")).first()
    for _ in range(rounds):
        if not mark.n:
            break
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        links = saved(small.select("x.a", "x.b").where(F.col("a") != F.col("b")).distinct())
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s")).first()
        if now == mark:
            break
        mark = now
    else:
        if mark.n:
            raise RuntimeError("the components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
