"""Predictors: DataFrames of nodes in, predicted nodes and edges out. All rows of a predictor carry its name."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.operators.boxes import best_steps
from flowbench.operators.keys import KEY
from flowbench.operators.pairs import FEATURES, LARGE, by_size, image_extent, node_pairs, pair_features
from flowbench.sources.files import shared_dir

NODE_SCHEMA = "predictor string, dataset string, sample_id string, pos int, node_id string, x double, y double, w double, h double"
EDGE_SCHEMA = "predictor string, dataset string, sample_id string, pos int, source string, target string"
NODES = ["predictor", *KEY, "pos", "node_id", "x", "y", "w", "h"]
EDGES = ["predictor", *KEY, "pos", "source", "target"]


@dataclass(frozen=True)
class Model:
    """A learned edge model: a coefficient for each feature."""

    coef: tuple[float, ...]
    intercept: float = 0.0
    threshold: float = 0.5
    top_k: int = 2
    feature_names: tuple[str, ...] = FEATURES

    def __post_init__(self) -> None:
        if tuple(self.feature_names) != FEATURES:
            raise ValueError("the model's features are not those of the library")
        if len(self.coef) != len(FEATURES):
            raise ValueError("a coefficient for each feature is needed")


def named(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.withColumn("predictor", F.lit(name)).select(*NODES)


def predict_oracle(nodes: DataFrame, edges: DataFrame, name: str = "oracle") -> tuple[DataFrame, DataFrame]:
    """The ground truth itself."""
    return named(nodes, name), edges.withColumn("predictor", F.lit(name)).select(*EDGES)


def predict_naive(sizes: DataFrame, name: str = "naive") -> tuple[DataFrame, DataFrame]:
    """One node of 120 by 56 in the middle of each image, and no edge."""
    middle = lambda c, size: F.greatest(F.lit(0.0), F.floor((F.col(c).cast("long") - size) / 2).cast("double"))
    nodes = sizes.select(
        F.lit(name).alias("predictor"), *KEY, F.lit(0).alias("pos"), F.lit("0").alias("node_id"),
        middle("width", 120).alias("x"), middle("height", 56).alias("y"), F.lit(120.0).alias("w"), F.lit(56.0).alias("h"),
    )
    return nodes, nodes.limit(0).selectExpr("predictor", "dataset", "sample_id", "pos", "node_id AS source", "node_id AS target")


def heuristic_edges(nodes: DataFrame, large: int = LARGE) -> DataFrame:
    """Best step forward from each node, and the second best where it is close in score and apart in height.

    A target counts if it is 20 to the right or 30 further down; targets not to the right cost 80 more, targets over
    20 higher up 120. Samples of more than ``large`` nodes look at nearby nodes alone: a score is at least the distance.
    """
    few, many = by_size(nodes, large)
    pairs = node_pairs(few).where((F.col("dx") >= 20) | (F.col("dy") >= 30))
    score = F.col("euclidean") + F.when(F.col("dx") >= 20, 0.0).otherwise(80.0) + F.when(F.col("dy") < -20, 120.0).otherwise(0.0)
    own = W.partitionBy(*KEY, "src")
    order = own.orderBy("score", "rise", F.desc("dx"), "dst")
    ranked = pairs.select(*KEY, "src", "dst", "dx", score.alias("score"), F.abs("dy").alias("rise"))
    ranked = ranked.select("*", F.row_number().over(order).alias("place"), F.first(F.struct("score", "rise")).over(order).alias("best")).where("place <= 2")
    second = (F.col("score") <= F.col("best.score") + 80) & (F.abs(F.col("rise") - F.col("best.rise")) >= 40)
    plain = ranked.where((F.col("place") == 1) | second).select(*KEY, "src", "dst", "place", "score")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = (frame[a].to_numpy(float) + frame[b].to_numpy(float) / 2 for a, b in ("xw", "yh"))
        names = frame["node_id"].to_numpy()
        source, target, place, score, _ = best_steps(x, y, np.unique(names.astype(str), return_inverse=True)[1])
        key = {c: frame[c].iloc[0] for c in KEY}
        return pd.DataFrame(key | {"src": names[source], "dst": names[target], "place": place.astype(np.int32), "score": score}, index=range(len(source)))

    found = many.select(*KEY, "node_id", "x", "y", "w", "h").groupBy(*KEY).applyInPandas(search, "dataset string, sample_id string, src string, dst string, place int, score double")
    return plain.unionByName(found)


def predict_heuristic(nodes: DataFrame, name: str = "heuristic") -> tuple[DataFrame, DataFrame]:
    """Ground-truth boxes with edges by geometric rules."""
    found = heuristic_edges(nodes)
    edges = found.select(F.lit(name).alias("predictor"), *KEY, F.col("place").alias("pos"), F.col("src").alias("source"), F.col("dst").alias("target"))
    return named(nodes, name), edges.dropDuplicates(["dataset", "sample_id", "source", "target"])


def sigmoid_score(features: list[Column], model: Model) -> Column:
    """Logistic of the weighted sum; a very negative sum gives 0, as exp() is then infinite."""
    terms = F.zip_with(F.array(*features), F.array(*map(F.lit, map(float, model.coef))), lambda f, c: f * c)
    z = F.aggregate(terms, F.lit(float(model.intercept)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-z))


def linear_score(features: str, model: Model) -> Column:
    """sigmoid_score() of a column that lists the features, by the same sum in the same order without a higher-order function."""
    z = F.lit(float(model.intercept))
    for k, c in enumerate(model.coef):
        z = z + F.get(features, F.lit(k)) * float(c)
    return 1 / (1 + F.exp(-z))


def learned_edges(scored: DataFrame, model: Model) -> DataFrame:
    """Of pairs with ``score`` the best of each source, as many as the model keeps, above its threshold."""
    order = W.partitionBy(*KEY, "src", "src_pos").orderBy(F.desc("score"), "dst_pos")
    # a threshold before the places would be moved below the scores, which are then computed twice; the best come first anyway
    return scored.withColumn("place", F.row_number().over(order)).where((F.col("place") <= model.top_k) & (F.col("score") >= model.threshold))


def predict_learned(nodes: DataFrame, model: Model, sizes: DataFrame | None = None, name: str = "learned") -> tuple[DataFrame, DataFrame]:
    """Ground-truth boxes with the edges that a model scores highest."""
    listed = pair_features(nodes, sizes).select(*KEY, "src", "dst", "src_pos", "dst_pos", F.array(*FEATURES).alias("features"))
    scored = listed.withColumn("score", linear_score("features", model)).drop("features")
    found = learned_edges(scored, model)
    edges = found.select(F.lit(name).alias("predictor"), *KEY, F.col("place").alias("pos"), F.col("src").alias("source"), F.col("dst").alias("target"))
    return named(nodes, name), edges.dropDuplicates(["dataset", "sample_id", "source", "target"])


RUN_SCHEMA = "predictor string, dataset string, sample_id string, runtime_s double, error string"


def python_runs(function: Callable[[dict], dict], graphs: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A Python function on one sample (a dict with its key and node list): its nodes, its edges, and a row a sample of how it went.

    graphs has a row a sample with ``nodes``, an array of structs; the function runs once a sample, in a worker, and gives a
    dict with ``nodes`` (id, bbox) and ``edges`` (source, target). The last table has ``predictor, dataset, sample_id, runtime_s,
    error``: the seconds of the call, and what it raised, or what is wrong with what it gave; such a sample has no nodes and
    no edges, and does not end the run. What the calls give is written to the folder that driver and executors share, so
    that neither a later step nor a lost executor calls the function again.
    """

    def call(sample: dict) -> tuple[list, list, float, str | None]:
        start = time.perf_counter()
        try:
            found = function(sample)
            seconds = time.perf_counter() - start
            nodes = [dict(zip(NODES[3:], (k, str(n["id"]), *map(float, n["bbox"])), strict=True)) for k, n in enumerate(found["nodes"])]
            return nodes, [dict(zip(EDGES[3:], (k, str(e["source"]), str(e["target"])), strict=True)) for k, e in enumerate(found["edges"])], seconds, None
        except Exception as error:  # noqa: BLE001  whatever a predictor raises becomes a row
            return [], [], time.perf_counter() - start, f"{type(error).__name__}: {error}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r["dataset"], r["sample_id"], *call(r)) for r in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*KEY, "nodes", "edges", "runtime_s", "error"])

    node, edge = (", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in schema.split(", ")[3:]) for schema in (NODE_SCHEMA, EDGE_SCHEMA))
    made = graphs.mapInPandas(run, f"dataset string, sample_id string, nodes array<struct<{node}>>, edges array<struct<{edge}>>, runtime_s double, error string")
    path = f"{shared_dir(graphs.sparkSession)}/predictions-{uuid.uuid4().hex}"
    made.write.parquet(path)
    made = graphs.sparkSession.read.schema(made.schema).parquet(path)
    each = lambda c: made.select(F.lit(name).alias("predictor"), *KEY, F.explode(c).alias("x")).select("predictor", *KEY, "x.*")
    return each("nodes"), each("edges"), made.select(F.lit(name).alias("predictor"), *KEY, "runtime_s", "error")


def python_predictor(function: Callable[[dict], dict], graphs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of python_runs(); a sample at which the function raises is an error."""
    nodes, edges, runs = python_runs(function, graphs, name)
    failed = runs.where(F.col("error").isNotNull()).first()
    if failed is not None:
        raise RuntimeError(f"{name} failed at {failed.dataset}/{failed.sample_id}: {failed.error}")
    return nodes, edges


PREDICTORS: dict[str, Callable] = {
    "oracle": predict_oracle, "naive": predict_naive, "heuristic": predict_heuristic, "learned": predict_learned,
}


def get_predictor(name: str) -> Callable:
    """The predictor of this name."""
    if name not in PREDICTORS:
        raise ValueError(f"no predictor {name!r}; there are {', '.join(sorted(PREDICTORS))}")
    return PREDICTORS[name]


def predict(name: str, nodes: DataFrame, edges: DataFrame, sizes: DataFrame | None = None, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions of the predictor of this name from the ground truth; sizes are those of the graphs unless given."""
    function = get_predictor(name)
    if name == "oracle":
        return function(nodes, edges)
    if name == "naive":
        return function(image_extent(nodes) if sizes is None else sizes)
    if name == "heuristic":
        return function(nodes)
    if model is None:
        raise ValueError("the learned predictor needs a model")
    return function(nodes, model, sizes)
