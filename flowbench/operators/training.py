"""Learning a pairwise edge model."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.functions.geometry import Box, pair_delta
from flowbench.operators.keys import KEY
from flowbench.operators.pairs import FEATURES, SIZE, feature_columns, features_of, labelled_pairs, ranked_pairs, with_extent
from flowbench.operators.predictors import Model, sigmoid_score
from flowbench.sources.files import shared_dir


def union_datasets(parts: list[DataFrame]) -> DataFrame:
    """Tables of several datasets as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def select_hard_negatives(labelled: DataFrame, ratio: int = 3) -> DataFrame:
    """All positives, and so many negatives for each in a sample: plausible ones first, then near ones, then as listed.

    A pair is plausible that is in line or nearest to the right or down. A sample without positives gives nothing.
    """
    plausible = (F.col("same_row_like") > 0.5) | (F.col("same_col_like") > 0.5) | (F.col("is_nearest_right_neighbor") > 0.5) | (F.col("is_nearest_down_neighbor") > 0.5)
    own = W.partitionBy(*KEY)
    order = W.partitionBy(*KEY, "label").orderBy(F.when(plausible, 0).otherwise(1), "rank_by_distance_norm", "src_pos", "dst_pos")
    ranked = labelled.withColumn("_positives", F.sum("label").over(own)).withColumn("_place", F.row_number().over(order))
    return ranked.where((F.col("label") == 1) | (F.col("_place") <= ratio * F.col("_positives"))).drop("_positives", "_place")


def training_pairs(nodes: DataFrame, edges: DataFrame, samples: DataFrame, split: str = "train", ratio: int = 3) -> DataFrame:
    """Features and labels of the pairs of a split's samples that a model is fitted on."""
    return features_of(chosen_pairs(nodes, edges, samples, split, ratio), "label")


def chosen_pairs(nodes: DataFrame, edges: DataFrame, samples: DataFrame, split: str = "train", ratio: int = 3) -> DataFrame:
    """training_pairs() with what features are made of in place of features; no pair leaves the task that has its sample."""
    chosen = samples.where(F.col("split") == split).select(*KEY)
    own = nodes.join(chosen, KEY, "left_semi")
    ranked = ranked_pairs(labelled_pairs(with_extent(own), edges, *SIZE))
    order = ("same_row_like", "same_col_like", "is_nearest_right_neighbor", "is_nearest_down_neighbor", "rank_by_distance_norm")
    made = feature_columns()
    return select_hard_negatives(ranked.withColumns({n: made[n] for n in order}), ratio).drop(*order)


#: What the features of a pair are made of, besides the steps between its centres.
RAW = [f"{p}{c}" for p in "st" for c in "xywh"] + ["rank_distance", "rank_dx", "rank_dy", "candidates", "nearest_right", "nearest_down", *SIZE]


def stored_rows(chosen: DataFrame) -> DataFrame:
    """Features and labels of chosen_pairs() over a table in the shared folder, for what reads its rows again and again.

    Boxes, sizes and ranks are stored, which take a tenth of the features' space; features are made at each reading.
    """
    path = f"{shared_dir(chosen.sparkSession)}/pairs-{uuid.uuid4().hex}"
    chosen.select(*RAW, "label").write.parquet(path)
    rows = chosen.sparkSession.read.schema(chosen.select(*RAW, "label").schema).parquet(path)
    return features_of(rows.withColumns(pair_delta(Box.of("s"), Box.of("t"))), "label")


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def class_weights(rows: DataFrame) -> DataFrame:
    """Weights that make both classes count the same; an error if one is empty."""
    n = label_counts(rows)
    empty = (F.col("positives") == 0) | (F.col("negatives") == 0)
    half = lambda c: F.when(empty, F.raise_error(F.lit("both classes are needed")).cast("double")).otherwise(F.col("examples") / (2.0 * F.col(c)))
    return n.select(half("positives").alias("positive_weight"), half("negatives").alias("negative_weight"))


def newton_sums(rows: DataFrame, theta: np.ndarray, positive: float, negative: float) -> np.ndarray:
    """Weight, weighted log-loss, its gradient and its Hessian at coefficients and intercept, summed over all rows."""
    n = len(theta)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + n + n * n)
        for batch in batches:
            x = np.column_stack([*[batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], np.ones(batch.num_rows)])
            y = batch.column("label").to_numpy(zero_copy_only=False) == 1
            weight, z = np.where(y, positive, negative), x @ theta
            p = np.exp(-np.logaddexp(0, -z))
            total[0] += weight.sum()
            total[1] += weight @ np.logaddexp(0, np.where(y, -z, z))
            total[2:2 + n] += x.T @ (weight * (p - y))
            total[2 + n:] += (x.T @ (x * (weight * p * (1 - p))[:, None])).ravel()
        yield pa.record_batch({"k": np.arange(len(total), dtype=np.int32), "v": total})

    found = rows.select(*FEATURES, "label").mapInArrow(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([v for _, v in sorted(map(tuple, found))])


def train_edge_model(rows: DataFrame, l2: float = 1e-4, epochs: int = 25, threshold: float = 0.5, top_k: int = 2) -> Model:
    """Balanced logistic regression on mean weighted log-loss plus l2 / 2 times the squared coefficients, by Newton's steps.

    A step is one pass that sums 29 by 29 second derivatives, and about ten steps are made (4 * epochs at most); nothing is
    cached. rows are read at each step: stored_rows() has them without making pairs again.
    """
    weights = class_weights(rows).first()
    n = len(FEATURES) + 1
    ridge = np.array([l2] * (n - 1) + [0.0])

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = newton_sums(rows, theta, weights.positive_weight, weights.negative_weight)
        return s[1] / s[0] + ridge @ theta**2 / 2, s[2:2 + n] / s[0] + ridge * theta, s[2 + n:].reshape(n, n) / s[0] + np.diag(ridge)

    theta, least = np.zeros(n), None
    for _ in range(4 * epochs):
        loss, gradient, hessian = objective(theta)
        if least is not None and loss > least[0] + 1e-12:
            step = step / 2  # too far
        else:
            least = loss, theta
            step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            if np.abs(gradient).max() < 1e-8:
                break
        theta = least[1] - step
    return Model(tuple(map(float, least[1][:-1])), float(least[1][-1]), threshold, top_k)


def loss_gradient(rows: DataFrame, model: Model, l2: float = 1e-4) -> DataFrame:
    """``feature, gradient`` of the objective that train_edge_model() minimises, at a model: 0 at its optimum alone."""
    weights = class_weights(rows).first()
    weight = F.when(F.col("label") == 1, weights.positive_weight).otherwise(weights.negative_weight)
    error = weight * (sigmoid_score([F.col(f) for f in FEATURES], model) - F.col("label"))
    mean = rows.agg(*[(F.sum(error * x) / F.sum(weight)).alias(n) for n, x in [*((f, F.col(f)) for f in FEATURES), ("intercept", F.lit(1.0))]])
    parts = [F.struct(F.lit(n).alias("feature"), (F.col(n) + l2 * c).alias("gradient")) for n, c in zip([*FEATURES, "intercept"], [*model.coef, 0.0], strict=True)]
    return mean.select(F.inline(F.array(*parts)))


def confusion_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts of hits and errors at a threshold, and the rates made of them."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    n = scored.agg(*[F.count_if(c).cast("double").alias(k) for k, c in (("tp", p & y), ("fp", p & ~y), ("tn", ~p & ~y), ("fn", ~p & y))])
    at_least = lambda c: F.greatest(c, F.lit(1.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = n.select("*", (tp / at_least(tp + fp)).alias("precision"), (tp / at_least(tp + fn)).alias("recall"), ((tp + tn) / at_least(tp + fp + tn + fn)).alias("accuracy"))
    return n.select("*", (2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))).alias("f1"))


def evaluate_fit(rows: DataFrame, model: Model) -> DataFrame:
    return confusion_metrics(rows.withColumn("score", sigmoid_score([F.col(f) for f in FEATURES], model)), model.threshold)
