"""Matching predicted nodes to ground truth, and edges carried over.

Tables: nodes ``dataset, sample_id, pos, node_id, x, y, w, h``; edges ``dataset, sample_id, pos, source, target``;
predicted ones have ``predictor`` besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.functions.geometry import Box, bbox_center, bbox_diag
from flowbench.operators.keys import KEY

PRED_KEY = ["predictor", *KEY]


#: Ground-truth nodes beyond which a sample's candidates come from a grid and are matched as a stream.
LARGE = 200
#: Fixed smallest size class of the grid; smaller boxes share its cells.
FINEST = -10


def last_of_id(nodes: DataFrame) -> DataFrame:
    """One row a sample with a list ``n`` of its nodes, one a node id: of several the last in the list."""
    keys = [c for c in PRED_KEY if c in nodes.columns and c not in KEY]
    rows = nodes.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*keys, "node_id", "pos", "x", "y", "w", "h"))).alias("n"))
    same = lambda a, b: F.coalesce(a["node_id"] == b["node_id"], F.lit(False)) & (F.coalesce(a["predictor"] == b["predictor"], F.lit(False)) if keys else F.lit(True))
    return rows.select(*KEY, F.filter("n", lambda e, k: ~same(e, F.get("n", k + 1))).alias("n"))


def spread(rows: DataFrame, side: str, *more: str) -> DataFrame:
    """The nodes of last_of_id() rows, a row each; boxes as ``g*`` or ``p*``."""
    name = {"g": "gt_id", "p": "pred_id"}[side]
    keys = ["predictor"] if side == "p" else []
    rows = rows.select(*KEY, *more, F.explode("n").alias("e"))
    return rows.select(*[f"e.{k}" for k in keys], *KEY, *more, F.col("e.node_id").alias(name), *[F.col(f"e.{c}").alias(f"{side}{c}") for c in "xywh"])


def within_reach(pairs: DataFrame, alpha: float) -> DataFrame:
    """Pairs whose centres are at most alpha ground-truth diagonals apart, with the distance."""
    g, p = Box.of("g"), Box.of("p")
    (gx, gy), (px, py) = bbox_center(g), bbox_center(p)
    return pairs.withColumn("distance", F.hypot(gx - px, gy - py)).where(F.col("distance") <= alpha * bbox_diag(g)).select(*PRED_KEY, "distance", "pred_id", "gt_id")


def plain_candidates(gt: DataFrame, pred: DataFrame, alpha: float) -> DataFrame:
    """Candidates of last_of_id() rows by a join on the sample."""
    return within_reach(spread(pred, "p").join(spread(gt, "g"), KEY), alpha)


def grid_candidates(gt: DataFrame, pred: DataFrame, alpha: float) -> DataFrame:
    """Candidates of last_of_id() rows by a grid of several levels.

    A box belongs to the level of its reach: cells there are at least twice and less than four times as wide, so that it
    stands in at most four. A predicted node looks into the one cell of each level that its centre is in. However large
    some boxes are, those of another size keep small cells, and no pair of nodes meets twice.
    """
    reach = lambda w, h: alpha * F.hypot(w, h)
    level = lambda w, h: F.greatest(F.lit(FINEST), F.ceil(F.log2(F.greatest(2 * reach(w, h), F.lit(2.0**FINEST)))).cast("int"))
    levels = gt.select(*KEY, F.array_distinct(F.transform("n", lambda e: level(e["w"].cast("double"), e["h"].cast("double")))).alias("levels"))
    # dealt anew, a few rows, so that Spark knows their number before it plans the join
    pred = pred.join(levels.repartition(*KEY), KEY)
    g, p = Box.of("g"), Box.of("p")
    (gx, gy), (px, py), far = bbox_center(g), bbox_center(p), reach(g.w, g.h)
    cell = lambda c, k: F.floor(c / F.pow(F.lit(2.0), k))
    span = lambda c: F.explode(F.sequence(cell(c - far, F.col("level")), cell(c + far, F.col("level"))))
    gt = spread(gt, "g").withColumn("level", level(g.w, g.h)).withColumn("across", span(gx)).withColumn("down", span(gy))
    pred = spread(pred, "p", "levels").withColumn("level", F.explode("levels")).drop("levels")
    pred = pred.withColumn("across", cell(px, F.col("level"))).withColumn("down", cell(py, F.col("level")))
    return within_reach(pred.join(gt, [*KEY, "level", "across", "down"]), alpha)


def split_by_size(gt: DataFrame, large: int) -> tuple[DataFrame, DataFrame]:
    """last_of_id() rows of small samples and of large ones."""
    return gt.where(F.size("n") <= large), gt.where(F.size("n") > large)


def match_candidates(gt_nodes: DataFrame, pred_nodes: DataFrame, alpha: float = 0.35, grid: bool = False, large: int = LARGE) -> DataFrame:
    """Pairs whose centres are at most alpha ground-truth diagonals apart: ``predictor, dataset, sample_id, distance, pred_id, gt_id``.

    Both sides are dealt by the sample once. Samples of up to ``large`` ground-truth nodes pair all their nodes; larger ones
    go through a grid, so that what is joined grows with the nodes and not with their square. ``grid`` sends all there.
    """
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    gt, pred = last_of_id(gt_nodes), last_of_id(pred_nodes)
    few, many = split_by_size(gt, 0 if grid else large)
    return plain_candidates(few, pred, alpha).unionByName(grid_candidates(many, pred, alpha))


def match_nodes(candidates: DataFrame, helper_above: int | None = None) -> DataFrame:
    """Greedy one-to-one matching in the order of distance, predicted id, ground-truth id (ids as strings).

    Runs as a fold over each sample's sorted candidates; with ``helper_above``, samples with more than so many stream by.
    """
    if helper_above is not None:
        sized = candidates.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*PRED_KEY)))
        few, many = (sized.where(c).drop("_n") for c in (F.col("_n") <= helper_above, F.col("_n") > helper_above))
        return match_nodes(few).unionByName(match_stream(many))
    return match_lists(candidates).select(*PRED_KEY, F.explode("m").alias("m")).select(*PRED_KEY, "m.pred_id", "m.gt_id")


def match_lists(candidates: DataFrame) -> DataFrame:
    """match_nodes() as one row a predictor and sample with the list ``m`` of its pairs; dealt as the candidates are."""
    ordered = candidates.groupBy(*PRED_KEY).agg(F.array_sort(F.collect_list(F.struct("distance", "pred_id", "gt_id"))).alias("c"))
    none = F.array().cast("array<struct<pred_id:string,gt_id:string>>")

    def step(taken, c):  # noqa: ANN001, ANN202
        used = F.exists(taken, lambda m: (m["pred_id"] == c["pred_id"]) | (m["gt_id"] == c["gt_id"]))
        return F.when(used, taken).otherwise(F.concat(taken, F.array(F.struct(c["pred_id"].alias("pred_id"), c["gt_id"].alias("gt_id")))))

    return ordered.select(*PRED_KEY, F.aggregate("c", none, step).alias("m"))


def match_stream(candidates: DataFrame) -> DataFrame:
    """match_nodes() for samples with many candidates: sorted rows stream by, and a task keeps the ids taken in one sample."""
    schema = ", ".join(f"{c} string" for c in (*PRED_KEY, "pred_id", "gt_id"))

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, left, right = None, set(), set()
        for frame in frames:
            keep = []
            for key, p, g in zip(zip(*[frame[c] for c in PRED_KEY], strict=True), frame["pred_id"], frame["gt_id"], strict=True):
                if key != own:
                    own, left, right = key, set(), set()
                keep.append(p not in left and g not in right)
                if keep[-1]:
                    left.add(p)
                    right.add(g)
            yield frame.loc[keep, [*PRED_KEY, "pred_id", "gt_id"]]

    rows = candidates.repartition(*PRED_KEY).sortWithinPartitions(*PRED_KEY, "distance", "pred_id", "gt_id")
    return rows.select(*PRED_KEY, "pred_id", "gt_id").mapInPandas(greedy, schema)


def by_candidates(gt_nodes: DataFrame, pred_nodes: DataFrame, alpha: float, large: int) -> tuple[DataFrame, DataFrame]:
    """Candidates of samples of up to ``large`` ground-truth nodes, dealt by the sample, and of larger ones."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    gt, pred = last_of_id(gt_nodes), last_of_id(pred_nodes)
    few, many = split_by_size(gt, large)
    return plain_candidates(few, pred, alpha), grid_candidates(many, pred, alpha)


def matched(gt_nodes: DataFrame, pred_nodes: DataFrame, alpha: float = 0.35, large: int = LARGE) -> DataFrame:
    """match_nodes(match_candidates(...)), where each sample's size decides how: all pairs and a fold, or a grid and a stream."""
    few, many = by_candidates(gt_nodes, pred_nodes, alpha, large)
    return match_nodes(few).unionByName(match_stream(many))


def matched_lists(gt_nodes: DataFrame, pred_nodes: DataFrame, alpha: float = 0.35, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """matched() as rows with a list ``m`` a predictor and sample: of small samples and of large ones, both dealt by the sample."""
    few, many = by_candidates(gt_nodes, pred_nodes, alpha, large)
    streamed = match_stream(many).repartition(*KEY).groupBy(*PRED_KEY).agg(F.collect_list(F.struct("pred_id", "gt_id")).alias("m"))
    return match_lists(few), streamed


def project_edges(pred_edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct predicted edges between ground-truth ids; an edge with an unmatched end goes."""
    start = matches.select(*PRED_KEY, F.col("pred_id").alias("source"), F.col("gt_id").alias("gt_source"))
    end = matches.select(*PRED_KEY, F.col("pred_id").alias("target"), F.col("gt_id").alias("gt_target"))
    return pred_edges.join(start, [*PRED_KEY, "source"]).join(end, [*PRED_KEY, "target"]).select(
        *PRED_KEY, F.col("gt_source").alias("source"), F.col("gt_target").alias("target")
    ).distinct()
