"""Known answers of matching, metrics and runs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbench.operators import matching, metrics
from flowbench.operators.evaluate import evaluate

NODE = "dataset string, sample_id string, pos int, node_id string, x double, y double, w double, h double"
EDGE = "dataset string, sample_id string, pos int, source string, target string"


def nodes(spark, rows, predictor=None):
    made = [((predictor,) if predictor else ()) + ("d", s, k, i, *map(float, b)) for k, (s, i, b) in enumerate(rows)]
    return spark.createDataFrame(made, ("predictor string, " if predictor else "") + NODE)


def edges(spark, rows, predictor=None):
    made = [((predictor,) if predictor else ()) + ("d", s, k, a, b) for k, (s, a, b) in enumerate(rows)]
    return spark.createDataFrame(made, ("predictor string, " if predictor else "") + EDGE)


def pairs(df):
    return {(r.pred_id, r.gt_id) for r in df.collect()}


@pytest.mark.parametrize(("gt", "pred", "alpha", "expected"), [
    ([("g1", (0, 0, 100, 100)), ("g2", (200, 0, 100, 100))], [("p1", (10, 10, 80, 80)), ("p2", (210, 10, 80, 80))], 0.3, {("p1", "g1"), ("p2", "g2")}),
    ([("g1", (0, 0, 100, 100))], [("p1", (500, 500, 50, 50))], 0.2, set()),
    ([("g1", (0, 0, 100, 100))], [("p1", (10, 10, 80, 80)), ("p2", (12, 12, 80, 80))], 0.5, {("p1", "g1")}),
])
def test_match(spark, gt, pred, alpha, expected):
    g, p = nodes(spark, [("s", *x) for x in gt]), nodes(spark, [("s", *x) for x in pred], "m")
    found = matching.match_candidates(g, p, alpha)
    assert pairs(matching.match_nodes(found)) == expected
    assert pairs(matching.match_nodes(found, helper_above=0)) == expected


def test_alpha_must_be_positive(spark):
    with pytest.raises(ValueError):
        matching.match_candidates(nodes(spark, []), nodes(spark, [], "m"), 0)


def test_ids_tie_as_strings(spark):
    g = nodes(spark, [("s", "g", (0, 0, 10, 10))])
    p = nodes(spark, [("s", "2", (0, 0, 10, 10)), ("s", "10", (0, 0, 10, 10))], "m")
    assert pairs(matching.match_nodes(matching.match_candidates(g, p, 0.5))) == {("10", "g")}


def run(spark, gt_n, gt_e, pred_n, pred_e, samples=("s",), alpha=0.2):
    table = spark.createDataFrame([("d", s, "test") for s in samples], "dataset string, sample_id string, split string")
    args = nodes(spark, gt_n), edges(spark, gt_e), nodes(spark, pred_n, "m"), edges(spark, pred_e, "m")
    return metrics.sample_metrics(table, *args, ["m"], alpha).collect(), evaluate(table, args[0], args[1], {"m": args[2:]}, alpha).first()


A, B = (50, 50, 50, 50), (200, 50, 50, 50)


def test_perfect_and_reversed(spark):
    gt, pred = [("s", "1", A), ("s", "2", B)], [("s", "p1", A), ("s", "p2", B)]
    (row,), total = run(spark, gt, [("s", "1", "2")], pred, [("s", "p1", "p2")])
    assert (row.node_f1, row.edge_f1, row.direction_accuracy, row.exact_match, total.num_samples) == (1, 1, 1, True, 1)
    (row,), _ = run(spark, gt, [("s", "1", "2")], pred, [("s", "p2", "p1")])
    assert (row.node_f1, row.edge_f1, row.direction_accuracy, row.exact_match) == (1, 0, 0, False)


def test_empty_graphs_keep_their_row(spark):
    (row,), total = run(spark, [], [], [], [])
    assert (row.node_f1, row.edge_f1, row.direction_accuracy, row.node_count_error, row.edge_count_error, row.exact_match) == (0, 0, 0, 0, 0, True)
    assert total.exact_match_rate == 1 and total.runtime_mean_s is None


def test_raw_and_distinct_counts(spark):
    gt, pred = [("s", "1", A), ("s", "2", B)], [("s", "p1", A), ("s", "p2", B)]
    (row,), _ = run(spark, gt, [("s", "1", "2"), ("s", "1", "2")], pred, [("s", "p1", "p2"), ("s", "p1", "px")])
    assert (row.edge_f1, row.edge_count_error) == (1, 1)


def test_edges_both_ways(spark):
    gt, pred = [("s", "1", A), ("s", "2", B)], [("s", "p1", A), ("s", "p2", B)]
    (row,), _ = run(spark, gt, [("s", "1", "2")], pred, [("s", "p1", "p2"), ("s", "p2", "p1")])
    assert (row.edge_precision, row.edge_recall, round(row.edge_f1, 6), row.direction_accuracy) == (0.5, 1, 0.666667, 0.5)


def test_half_the_nodes(spark):
    (row,), _ = run(spark, [("s", "1", A), ("s", "2", B)], [], [("s", "p1", A), ("s", "p2", (900, 900, 9, 9))], [])
    assert (row.node_precision, row.node_recall, row.node_f1) == (0.5, 0.5, 0.5)


def test_grid_and_helper_give_the_same_matches(spark):
    rng = random.Random(4)
    box = lambda: (rng.uniform(-300, 300), rng.uniform(-300, 300), rng.choice([0, 10, 30]), rng.choice([0, 20, 40]))
    gt = nodes(spark, [(s, f"g{k}", box()) for s in "ab" for k in range(150)] + [("c", "g", (5, 5, 0, 0))])
    pred = nodes(spark, [(s, f"p{k}", box()) for s in "ab" for k in range(150)] + [("c", "p", (5, 5, 0, 0))]).withColumn("predictor", F.lit("p"))
    plain = matching.match_candidates(gt, pred, 0.9)
    grid = matching.match_candidates(gt, pred, 0.9, grid=True)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, grid.collect())) and plain.count() > 200
    assert sorted(map(tuple, matching.match_nodes(plain).collect())) == sorted(map(tuple, matching.match_nodes(grid, 5).collect()))


def scattered(spark, n, predictor=None, seed=5, canvas=True):
    rng = random.Random(seed)
    side = 40 * n**0.5
    rows = [("big", f"{k}", (rng.randrange(int(side)), rng.randrange(int(side)), rng.choice([1, 20, 30, 60]), rng.choice([2, 20, 40]))) for k in range(n)]
    rows += [("big", "canvas", (0, 0, side, side))] * canvas + [(s, f"{k}", (k * 50, 0, 30, 30)) for s in ("a", "b") for k in range(4)]
    return nodes(spark, rows, predictor), rows


def test_sizes_decide_and_give_the_same(spark):
    gt, _ = scattered(spark, 400)
    pred, _ = scattered(spark, 400, "p", 5)
    pred = pred.withColumn("x", F.col("x") + F.pmod(F.hash("node_id"), F.lit(15)))
    want = sorted(map(tuple, matching.match_nodes(matching.match_candidates(gt, pred, 0.4, large=10**6)).collect()))
    assert sorted(map(tuple, matching.matched(gt, pred, 0.4, 100).collect())) == want == sorted(map(tuple, matching.matched(gt, pred, 0.4, 0).collect())) and len(want) > 300
    assert pairs(matching.matched(gt, pred, 0.4, 100)) == {(a, b) for *_, a, b in want}


def test_one_large_box_does_not_make_all_pairs(spark):
    """20,000 boxes and one of the whole canvas: candidates as by brute force, few joined rows a node."""
    gt, rows = scattered(spark, 20000)
    pred = gt.withColumn("x", F.col("x") + 3).withColumn("predictor", F.lit("p"))
    grid = matching.match_candidates(gt, pred, 0.35)
    found = {(r.pred_id, r.gt_id) for r in grid.where("sample_id = 'big'").collect()}
    box = np.array([b for s, _, b in rows if s == "big"], float)
    ids = [i for s, i, _ in rows if s == "big"]
    gx, gy, far = box[:, 0] + box[:, 2] / 2, box[:, 1] + box[:, 3] / 2, 0.35 * np.hypot(box[:, 2], box[:, 3])
    want = set()
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.hypot(gx - (gx[k] + 3), gy - gy[k]) <= far):
            want.add((i, ids[j]))
    assert found == want
    few, many = matching.split_by_size(matching.last_of_id(gt), matching.LARGE)
    joined = []
    inner, matching.within_reach = matching.within_reach, lambda pairs, alpha: joined.append(pairs) or inner(pairs, alpha)
    try:
        matching.grid_candidates(many, matching.last_of_id(pred), 0.35)
    finally:
        matching.within_reach = inner
    assert joined[0].count() < 50 * len(ids)
