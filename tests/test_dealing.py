"""Tables that are dealt by the sample stay where they are: no step sends pairs or lists of a sample anew."""

from __future__ import annotations

import re

import numpy as np
import pytest

from flowbench.operators import metrics, pairs, predictors, training
from flowbench.plans import testdata as T
from flowbench.plans.evaluation import MODEL

NODE = "dataset string, sample_id string, pos int, node_id string, x double, y double, w double, h double"
EDGE = "dataset string, sample_id string, pos int, source string, target string"


@pytest.fixture(scope="module")
def graph(spark):  # noqa: ANN001, ANN201
    rng = np.random.default_rng(3)
    nodes = [("d", str(s), k, str(k), *map(float, rng.integers(1, 300, 4))) for s in range(6) for k in range(5)]
    edges = [("d", str(s), k, str(k), str(k + 1)) for s in range(6) for k in range(4)] + [("d", "0", 9, "0", "1"), ("d", "1", 9, "0", "none"), ("d", "2", 9, None, "1")]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def exchanges(df) -> list[str]:  # noqa: ANN001
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def rows_of(df):  # noqa: ANN001, ANN201
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_labels_before_ranks(spark, graph):
    nodes, edges = graph
    plain = pairs.label_pairs(pairs.pair_features(nodes), edges)
    found = pairs.labelled_features(nodes, edges)
    assert rows_of(found) == rows_of(plain.select(found.columns))
    assert found.where("label = 1").count() == 24
    assert not [e for e in exchanges(found) if "src" in e]


def test_stored_rows_and_newton(spark, graph):
    nodes, edges = graph
    samples = spark.createDataFrame([("d", str(s), "train" if s < 5 else "test") for s in range(6)], "dataset string, sample_id string, split string")
    plain = training.training_pairs(nodes, edges, samples)
    kept = training.stored_rows(training.chosen_pairs(nodes, edges, samples))
    assert rows_of(kept) == rows_of(plain.select(kept.columns))
    model = training.train_edge_model(kept)
    assert max(abs(r.gradient) for r in training.loss_gradient(kept, model).collect()) < 1e-6
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    assert not [e for e in exchanges(training.chosen_pairs(nodes, edges, samples)) if "src" in e]


def test_asked_features_join_no_pairs(spark, graph):
    nodes, edges = graph
    asked = edges.selectExpr("dataset", "sample_id", "source AS src", "target AS dst")
    found = pairs.asked_features(nodes, asked)
    plain = pairs.pair_features(nodes).join(asked.distinct(), ["dataset", "sample_id", "src", "dst"], "left_semi")
    assert rows_of(found.select(plain.columns)) == rows_of(plain)
    assert not [e for e in exchanges(found) if "src" in e and "dst" in e and "distinct" not in e and e.count("#") > 4]


def test_features_are_no_whole_stage_code(spark, graph):
    """As one method of whole-stage code the features are over 8000 bytes, which the JVM does not compile."""
    plan = pairs.pair_features(graph[0])._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


def test_scores_stay_with_their_sample(spark):
    d = "/root/testdata/sf0.001"
    found = metrics.sample_metrics(T.samples(spark, d), T.gt_nodes(spark, d), T.gt_edges(spark, d), T.pred_nodes(spark, d), T.pred_edges(spark, d), ["shifted"])
    sent = {re.sub(r"#\d+L?", "", e) for e in exchanges(found)}
    assert "dataset, sample_id, 4" in sent
    # the other two are of samples with over 200 nodes
    assert sent <= {"dataset, sample_id, 4", "predictor, dataset, sample_id, 4", "dataset, sample_id, level, across, down, 4"}
    assert found.count() > 0


def test_learned_scores_once(spark, graph):
    """Same edges as by the fold over features, and the score stands in the plan once."""
    nodes = graph[0]
    scored = pairs.pair_features(nodes).withColumn("score", predictors.sigmoid_score([pairs.F.col(f) for f in pairs.FEATURES], MODEL))
    plain = predictors.learned_edges(scored, MODEL).selectExpr("dataset", "sample_id", "src AS source", "dst AS target")
    edges = predictors.predict_learned(nodes, MODEL)[1]
    assert rows_of(edges.select(plain.columns)) == rows_of(plain)
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("EXP(") <= 1
