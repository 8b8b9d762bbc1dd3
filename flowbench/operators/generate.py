"""Synthetic diagrams: patterns laid out with small random shifts.

Draws are hashes of seed, sample and number of the draw, so that samples are independent and any part of a dataset
can be made alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A layout: boxes (id, x, y, w, h) on a canvas, and edges."""

    name: str
    canvas: tuple[int, int]
    boxes: tuple[tuple[str, int, int, int, int], ...]
    edges: tuple[tuple[str, str], ...]


#: Fixed layouts.
SYNTHFLOW = (
    Pattern(
        "chain_horizontal", (640, 360),
        (("0", 60, 150, 120, 56), ("1", 260, 150, 120, 56), ("2", 460, 150, 120, 56)),
        (("0", "1"), ("1", "2")),
    ),
    Pattern(
        "chain_vertical", (640, 360),
        (("0", 260, 30, 120, 56), ("1", 260, 145, 120, 56), ("2", 260, 260, 120, 56)),
        (("0", "1"), ("1", "2")),
    ),
    Pattern(
        "branch", (640, 360),
        (("0", 60, 150, 120, 56), ("1", 240, 120, 120, 56), ("2", 460, 45, 120, 56), ("3", 460, 225, 120, 56)),
        (("0", "1"), ("1", "2"), ("1", "3")),
    ),
    Pattern(
        "merge", (640, 360),
        (("0", 60, 150, 120, 56), ("1", 240, 70, 120, 56), ("2", 240, 230, 120, 56), ("3", 460, 150, 120, 56)),
        (("0", "1"), ("0", "2"), ("1", "3"), ("2", "3")),
    ),
    Pattern(
        "decision_merge", (640, 360),
        (("0", 40, 150, 120, 56), ("1", 180, 150, 120, 56), ("2", 340, 60, 120, 56), ("3", 340, 240, 120, 56), ("4", 500, 150, 120, 56)),
        (("0", "1"), ("1", "2"), ("1", "3"), ("2", "4"), ("3", "4")),
    ),
)
REALWORLD_LIKE = (
    Pattern(
        "simple_horizontal", (360, 320),
        (("A", 50, 120, 90, 70), ("B", 215, 120, 88, 68)),
        (("A", "B"),),
    ),
    Pattern(
        "branch_merge", (576, 324),
        (("A", 40, 120, 82, 78), ("B", 210, 38, 82, 78), ("C", 210, 205, 82, 78), ("D", 405, 120, 82, 78)),
        (("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")),
    ),
    Pattern(
        "staged_directional", (400, 300),
        (("A", 70, 40, 78, 60), ("B", 225, 45, 78, 60), ("C", 38, 185, 78, 60), ("D", 225, 175, 78, 60)),
        (("C", "A"), ("A", "B"), ("C", "D"), ("B", "D")),
    ),
    Pattern(
        "fan_out_pipeline", (720, 420),
        (("A", 40, 165, 88, 68), ("B", 220, 60, 82, 64), ("C", 235, 165, 84, 66), ("D", 220, 285, 82, 64), ("E", 470, 165, 96, 68)),
        (("A", "B"), ("A", "C"), ("A", "D"), ("B", "E"), ("C", "E"), ("D", "E")),
    ),
    Pattern(
        "staggered_multirow", (760, 460),
        (("A", 70, 65, 88, 66), ("B", 260, 40, 86, 64), ("C", 255, 210, 84, 64), ("D", 475, 110, 92, 68), ("E", 610, 285, 88, 66)),
        (("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")),
    ),
    Pattern(
        "loop_return", (700, 420),
        (("A", 110, 70, 84, 64), ("B", 320, 70, 84, 64), ("C", 320, 250, 86, 66), ("D", 535, 160, 90, 68)),
        (("A", "B"), ("B", "D"), ("A", "C"), ("C", "D"), ("D", "B")),
    ),
)
BASIC = (
    Pattern(
        "chain", (400, 300),
        (("A", 50, 100, 80, 80), ("B", 240, 100, 80, 80)),
        (("A", "B"),),
    ),
    Pattern(
        "branch", (500, 350),
        (("A", 60, 120, 80, 80), ("B", 260, 60, 80, 80), ("C", 260, 200, 80, 80)),
        (("A", "B"), ("A", "C")),
    ),
    Pattern(
        "diamond", (600, 400),
        (("A", 60, 160, 80, 80), ("B", 260, 80, 80, 80), ("C", 260, 240, 80, 80), ("D", 460, 160, 80, 80)),
        (("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")),
    ),
)


def draw(seed: Column, i: Column, number: str, most: int) -> Column:
    """A whole number from -most to most."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"), F.lit(number))), 1, 8), 16, 10).cast("long")
    return bits % (2 * most + 1) - most


def pattern_table(spark: SparkSession, patterns: tuple[Pattern, ...]) -> DataFrame:
    """A row a pattern and box; fixed and small."""
    rows = [(k, p.name, *p.canvas, len(p.boxes), pos, *b) for k, p in enumerate(patterns) for pos, b in enumerate(p.boxes)]
    return spark.createDataFrame(rows, "k int, name string, canvas_w int, canvas_h int, n_boxes int, pos int, node_id string, bx int, by int, bw int, bh int")


def edge_table(spark: SparkSession, patterns: tuple[Pattern, ...]) -> DataFrame:
    return spark.createDataFrame([(k, pos, *e) for k, p in enumerate(patterns) for pos, e in enumerate(p.edges)], "k int, pos int, source string, target string")


def choose(ids: DataFrame, seed: int, patterns: tuple[Pattern, ...], dealt: bool) -> DataFrame:
    """ids (column i, from 0) with the number k of their pattern: in turn, or drawn."""
    n = len(patterns)
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("i").cast("string"), F.lit("pattern"))), 1, 8), 16, 10).cast("long")
    return ids.select("i", ((F.col("i") if dealt else bits) % n).cast("int").alias("k"))


def clamp(v: Column, size: Column, canvas: Column) -> Column:
    return F.greatest(F.lit(10), F.least(canvas - size - 10, v))


def generate(ids: DataFrame, dataset: str, patterns: tuple[Pattern, ...], seed: int, move: int, grow_w: int, grow_h: int, least: tuple[int, int] = (1, 1)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, nodes and edges with shifts and sizes drawn box by box, kept 10 pixels inside the canvas."""
    spark, s, i = ids.sparkSession, F.lit(seed), F.col("i")
    chosen = choose(ids, seed, patterns, dealt=False)
    sample = F.concat(F.lit(f"{dataset}-"), F.lpad(i.cast("string"), F.greatest(F.lit(4), F.length(i.cast("string"))), F.lit("0"))).alias("sample_id")
    rows = chosen.join(F.broadcast(pattern_table(spark, patterns)), "k")
    at = lambda part: F.concat_ws(":", F.col("pos").cast("string"), F.lit(part))
    bits = lambda part: F.conv(F.substring(F.md5(F.concat_ws(":", s.cast("string"), i.cast("string"), at(part))), 1, 8), 16, 10).cast("long")
    jitter = lambda part, most: bits(part) % (2 * most + 1) - most
    sized = rows.select(
        "*", F.greatest(F.lit(least[0]), F.col("bw") + jitter("w", grow_w)).alias("w"), F.greatest(F.lit(least[1]), F.col("bh") + jitter("h", grow_h)).alias("h"),
    )
    nodes = sized.select(
        F.lit(dataset).alias("dataset"), sample, "pos", "node_id", clamp(F.col("bx") + jitter("x", move), F.col("w"), F.col("canvas_w")).cast("double").alias("x"),
        clamp(F.col("by") + jitter("y", move), F.col("h"), F.col("canvas_h")).cast("double").alias("y"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"),
    )
    edges = chosen.join(F.broadcast(edge_table(spark, patterns)), "k").select(F.lit(dataset).alias("dataset"), sample, "pos", "source", "target")
    names = F.element_at(F.array(*[F.lit(p.name) for p in patterns]), F.col("k") + 1)
    return chosen.select(F.lit(dataset).alias("dataset"), sample, names.alias("pattern")), nodes, edges


def numbers(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """0 to n - 1, dealt over partitions."""
    if n <= 0:
        raise ValueError("a dataset needs samples")
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "i")


def generate_synthflow(ids: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    return generate(ids, "synthflow", SYNTHFLOW, seed, 8, 6, 4)


def generate_realworld_like(ids: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    return generate(ids, "realworld-like", REALWORLD_LIKE, seed, 10, 10, 6, (60, 35))


def generate_synthetic_basic(ids: DataFrame, seed: int = 0, width: int = 4) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of three patterns in turn, each sample moved as a whole; samples count from 1."""
    spark, i = ids.sparkSession, F.col("i")
    chosen = choose(ids, seed, BASIC, dealt=True)
    number = (i + 1).cast("string")
    names = F.element_at(F.array(*[F.lit(p.name) for p in BASIC]), F.col("k") + 1)
    sample = F.concat(F.lpad(number, F.greatest(F.lit(width), F.length(number)), F.lit("0")), F.lit("_"), names).alias("sample_id")
    rows = chosen.join(F.broadcast(pattern_table(spark, BASIC)), "k")
    shift = lambda part: draw(F.lit(seed), i, part, 10)
    nodes = rows.select(
        F.lit("synthetic-basic").alias("dataset"), sample, "pos", "node_id", (F.col("bx") + shift("x")).cast("double").alias("x"), (F.col("by") + shift("y")).cast("double").alias("y"),
        F.col("bw").cast("double").alias("w"), F.col("bh").cast("double").alias("h"),
    )
    edges = chosen.join(F.broadcast(edge_table(spark, BASIC)), "k").select(F.lit("synthetic-basic").alias("dataset"), sample, "pos", "source", "target")
    return nodes, edges


def generate_synthetic_legacy(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same patterns without shifts, with ids from 0 and samples from 000."""
    spark, i = ids.sparkSession, F.col("i")
    chosen = choose(ids, 0, BASIC, dealt=True)
    names = F.element_at(F.array(*[F.lit(p.name) for p in BASIC]), F.col("k") + 1)
    sample = F.concat(F.lpad(i.cast("string"), F.greatest(F.lit(3), F.length(i.cast("string"))), F.lit("0")), F.lit("_"), names).alias("sample_id")
    number = lambda c: (F.ascii(c) - 65).alias(c)
    nodes = chosen.join(F.broadcast(pattern_table(spark, BASIC)), "k").select(sample, "pos", number("node_id"), *[F.col(f"b{c}").alias(c) for c in "xywh"])
    edges = chosen.join(F.broadcast(edge_table(spark, BASIC)), "k").select(sample, "pos", number("source"), number("target"))
    return nodes, edges
