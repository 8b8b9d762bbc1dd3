"""Ordered pairs of a sample's nodes, their ranks and features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.functions.geometry import Box, bbox_area, overlap_ratio, pair_delta, safe_log_ratio
from flowbench.operators.boxes import asked_ranks
from flowbench.operators.keys import KEY

#: Fixed names and order of the features.
FEATURES = (
    "dx_norm", "dy_norm", "abs_dx_norm", "abs_dy_norm", "euclidean_norm", "manhattan_norm", "src_w_norm", "src_h_norm",
    "dst_w_norm", "dst_h_norm", "src_area_norm", "dst_area_norm", "log_w_ratio", "log_h_ratio", "log_area_ratio",
    "is_right_of", "is_left_of", "is_below", "is_above", "vertical_overlap_ratio", "horizontal_overlap_ratio",
    "same_row_like", "same_col_like", "rank_by_distance_norm", "rank_by_abs_dx_norm", "rank_by_abs_dy_norm",
    "is_nearest_right_neighbor", "is_nearest_down_neighbor",
)


SIZE = ["width", "height"]

#: Nodes beyond which a sample's pairs are searched by a helper and not made as rows.
LARGE = 500


def by_size(nodes: DataFrame, large: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of samples of up to ``large`` nodes, and of larger ones."""
    sized = nodes.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*KEY)))
    return sized.where(F.col("_n") <= large).drop("_n"), sized.where(F.col("_n") > large).drop("_n")


def node_pairs(nodes: DataFrame) -> DataFrame:
    """All ordered pairs of nodes with different ids, with boxes ``s*``, ``t*`` and steps between centres."""
    return paired(nodes)


def paired(nodes: DataFrame, *more: str) -> DataFrame:
    """node_pairs() with further columns of the source."""
    side = lambda name, p, *own: nodes.select(*KEY, F.col("node_id").alias(name), F.col("pos").alias(f"{name}_pos"), *[F.col(c).cast("double").alias(f"{p}{c}") for c in "xywh"], *own)
    left, right = side("src", "s", *more), side("dst", "t")
    pairs = left.join(right, KEY).where(F.col("src") != F.col("dst"))
    return pairs.select("*", *[c.alias(n) for n, c in pair_delta(Box.of("s"), Box.of("t")).items()])


def labelled_pairs(nodes: DataFrame, gold: DataFrame, *more: str) -> DataFrame:
    """label_pairs(paired(nodes, *more), gold) by a join on the sample alone: pairs, which are many, are not dealt anew.

    A sample's gold edges go to its nodes as a list, and each source keeps its own targets.
    """
    edges = gold.groupBy(*KEY).agg(F.collect_set(F.struct("source", "target")).alias("_gold"))
    own = F.transform(F.filter("_gold", lambda e: e["source"] == F.col("node_id")), lambda e: e["target"])
    pairs = paired(nodes.join(edges, KEY, "left").withColumn("_targets", own), "_targets", *more)
    hit = F.coalesce(F.array_contains("_targets", F.col("dst")), F.lit(False))
    return pairs.withColumn("label", F.when(hit, 1).otherwise(0)).drop("_targets")


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """nearest_right_down(rank_features(pairs)) in three sorts, one a rank."""
    own = W.partitionBy(*KEY, "src", "src_pos")
    near, across, down = (own.orderBy(c, "dst_pos") for c in (F.col("euclidean"), F.abs("dx"), F.abs("dy")))
    every, so_far = near.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), near.rowsBetween(W.unboundedPreceding, W.currentRow)
    place = lambda w: F.row_number().over(w)
    first = lambda step: (F.col(step) > 0) & (F.count_if(F.col(step) > 0).over(so_far) == 1)
    return pairs.select(
        "*", place(near).alias("rank_distance"), place(across).alias("rank_dx"), place(down).alias("rank_dy"),
        F.count(F.lit(1)).over(every).alias("candidates"), first("dx").alias("nearest_right"), first("dy").alias("nearest_down"),
    )


def rank_features(pairs: DataFrame) -> DataFrame:
    """Ranks from 1 of each pair among those of its source, by distance and by steps across and down; ties by position."""
    own = W.partitionBy(*KEY, "src", "src_pos")
    rank = lambda c: F.row_number().over(own.orderBy(c, "dst_pos"))
    return pairs.select(
        "*", rank(F.col("euclidean")).alias("rank_distance"), rank(F.abs("dx")).alias("rank_dx"), rank(F.abs("dy")).alias("rank_dy"),
        F.count(F.lit(1)).over(own).alias("candidates"),
    )


def nearest_right_down(pairs: DataFrame) -> DataFrame:
    """Whether the target is the nearest with a step to the right, and the nearest with one down; of equal ones the first by position.

    Least values of a whole partition, which any order of its rows will do for: no sort beyond those of the ranks.
    """
    own = W.partitionBy(*KEY, "src", "src_pos")

    def first(step: str) -> Column:
        ahead, place = F.col(step) > 0, F.struct("euclidean", "dst_pos")
        return ahead & (place == F.min(F.when(ahead, place)).over(own))

    return pairs.select("*", first("dx").alias("nearest_right"), first("dy").alias("nearest_down"))


def image_extent(nodes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Width and height of each image: as given where both are, else the far edges of its boxes, at least 1."""
    box = Box.of()
    far = nodes.groupBy(*KEY).agg(F.max(box.x + box.w).alias("fx"), F.max(box.y + box.h).alias("fy"))
    one = F.lit(1.0)
    if sizes is None:
        return far.select(*KEY, F.greatest("fx", one).alias("width"), F.greatest("fy", one).alias("height"))
    both = F.col("gw").isNotNull() & F.col("gh").isNotNull()
    given = sizes.select(*KEY, F.col("width").cast("double").alias("gw"), F.col("height").cast("double").alias("gh"))
    pick = lambda g, f: F.when(both, F.col(g)).otherwise(F.greatest(F.col(f), one))
    return far.join(given, KEY, "left").select(*KEY, pick("gw", "fx").alias("width"), pick("gh", "fy").alias("height"))


def feature_columns() -> dict[str, Column]:
    """Features over the columns of pairs with ranks, nearest flags, width and height."""
    s, t = Box.of("s"), Box.of("t")
    one = F.lit(1.0)
    w, h = F.greatest("width", one), F.greatest("height", one)
    dx, dy, area = F.col("dx"), F.col("dy"), F.greatest(w * h, one)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    made = [
        dx / w, dy / h, F.abs(dx) / w, F.abs(dy) / h, F.col("euclidean") / F.hypot(w, h), F.col("manhattan") / (w + h),
        s.w / w, s.h / h, t.w / w, t.h / h, bbox_area(s) / area, bbox_area(t) / area,
        safe_log_ratio(t.w, s.w), safe_log_ratio(t.h, s.h), safe_log_ratio(bbox_area(t), bbox_area(s)),
        flag(dx > 0), flag(dx < 0), flag(dy > 0), flag(dy < 0),
        overlap_ratio(s.y, s.h, t.y, t.h), overlap_ratio(s.x, s.w, t.x, t.w),
        flag(F.abs(dy) / F.greatest(s.h, t.h, one) < 0.75), flag(F.abs(dx) / F.greatest(s.w, t.w, one) < 0.75),
        F.col("rank_distance") / F.col("candidates"), F.col("rank_dx") / F.col("candidates"), F.col("rank_dy") / F.col("candidates"),
        flag(F.col("nearest_right")), flag(F.col("nearest_down")),
    ]
    return dict(zip(FEATURES, made, strict=True))


def pair_features(nodes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Rows ``dataset, sample_id, src, dst, src_pos, dst_pos`` with the 28 features; each is computed once a pair.

    A feature that is no finite number raises an error when the row is made.
    """
    return features_of(ranked_pairs(paired(with_extent(nodes, sizes), *SIZE)))


def labelled_features(nodes: DataFrame, gold: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """label_pairs(pair_features(nodes, sizes), gold), labelled before pairs are ranked."""
    return features_of(ranked_pairs(labelled_pairs(with_extent(nodes, sizes), gold, *SIZE)), "label")


def with_extent(nodes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Nodes with ``width`` and ``height`` of their image, which their pairs carry on."""
    return nodes.select(*KEY, "pos", "node_id", "x", "y", "w", "h").join(image_extent(nodes, sizes), KEY)


def features_of(ranked: DataFrame, *more: str) -> DataFrame:
    """The 28 features of pairs with ranks, nearest flags, width and height, and further columns as they are.

    In whole-stage code they would be one method that is longer than what the JVM compiles, and so be interpreted; a
    higher-order function has no such code, and Spark then makes many small methods of this step.
    """

    def finite(name: str, c: Column) -> Column:
        # boxes that are no numbers, or of negative size, show in these
        if name not in ("dx_norm", "dy_norm", "log_w_ratio", "log_h_ratio"):
            return c
        sound = F.abs(c) < float("inf") if name != "dx_norm" else F.exists(F.array(c), lambda v: F.abs(v) < float("inf"))
        return F.when(sound, c).otherwise(F.raise_error(F.lit(f"{name} is not finite")).cast("double"))

    key = [c for c in (*KEY, "src", "dst", "src_pos", "dst_pos") if c in ranked.columns]
    return ranked.select(*key, *[finite(n, c).alias(n) for n, c in feature_columns().items()], *more)


def asked_features(nodes: DataFrame, asked: DataFrame, sizes: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """pair_features() of the pairs ``dataset, sample_id, src, dst`` alone; those with an unknown node or of one with itself go.

    In samples of more than ``large`` nodes ranks are counted in the coordinates, so that other pairs are not made as rows:
    time grows with the asked pairs times the nodes, rows with the asked pairs.
    """
    wanted = asked.select(*KEY, "src", "dst")
    few, many = by_size(nodes, large)
    gold = wanted.withColumnsRenamed({"src": "source", "dst": "target"})
    plain = ranked_pairs(labelled_pairs(with_extent(few, sizes), gold, *SIZE)).where("label = 1")
    boxes = many.select(*KEY, "node_id", "pos", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    schema = "dataset string, sample_id string, src string, dst string, src_pos int, dst_pos int, " + ", ".join(f"{p}{c} double" for p in "st" for c in "xywh")
    schema += ", dx double, dy double, euclidean double, manhattan double, rank_distance long, rank_dx long, rank_dy long, candidates long, nearest_right boolean, nearest_down boolean"

    def ranks(own: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(at=np.arange(len(own)))
        some = some[some["src"] != some["dst"]]
        some = some.merge(own.add_prefix("s_"), left_on="src", right_on="s_node_id").merge(own.add_prefix("t_"), left_on="dst", right_on="t_node_id")
        x, y = (own[a].to_numpy() + own[b].to_numpy() / 2 for a, b in ("xw", "yh"))
        source, target = some["s_at"].to_numpy(np.int64), some["t_at"].to_numpy(np.int64)
        ids = np.unique(own["node_id"].to_numpy().astype(str), return_inverse=True)[1]
        dx, dy = x[target] - x[source], y[target] - y[source]
        made = {c: some[c].to_numpy() for c in (*KEY, "src", "dst")} | {"src_pos": some["s_pos"].to_numpy(), "dst_pos": some["t_pos"].to_numpy()}
        made |= {f"{p}{c}": some[f"{p}_{c}"].to_numpy() for p in "st" for c in "xywh"}
        made |= {"dx": dx, "dy": dy, "euclidean": np.hypot(dx, dy), "manhattan": np.abs(dx) + np.abs(dy)}
        return pd.DataFrame(made | asked_ranks(x, y, own["pos"].to_numpy(), ids, source, target))

    far = wanted.join(many.select(*KEY).distinct(), KEY, "left_semi").distinct()
    counted = boxes.groupBy(*KEY).cogroup(far.groupBy(*KEY)).applyInPandas(ranks, schema).join(image_extent(many, sizes), KEY)
    return features_of(plain.select(*counted.columns)).unionByName(features_of(counted))


def label_pairs(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """pairs with ``label``: 1 where the pair is a gold edge."""
    edges = gold.select(*KEY, F.col("source").alias("src"), F.col("target").alias("dst")).distinct().withColumn("_gold", F.lit(1))
    return pairs.join(edges, [*KEY, "src", "dst"], "left").withColumn("label", F.coalesce("_gold", F.lit(0))).drop("_gold")
