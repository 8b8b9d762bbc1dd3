"""Samples with very many nodes go another way and give the same."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from flowbench.operators import boxes, contours, pairs, predictors

BOX = "dataset string, sample_id string, pos int, x int, y int, w int, h int"


def crowd(n, seed=3, side=400):
    rng = random.Random(seed)
    made = [(rng.randrange(side), rng.randrange(side), rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(n)]
    made += [(x + rng.randrange(3), y + rng.randrange(3), w, h) for x, y, w, h in made[: n // 2]]
    return [("d", s, k, *b) for s in ("a", "b") for k, b in enumerate(made if s == "a" else made[:9])]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("most", [0.3, 0.7, 1.0])
def test_suppression(spark, most):
    given = spark.createDataFrame(crowd(160), BOX)
    fold = rows(contours.dedupe_bboxes(given, most, large=10**6))
    assert rows(contours.dedupe_bboxes(given, most, large=20)) == fold == rows(contours.dedupe_bboxes(given, most, large=0)) and 100 < len(fold)


def test_suppression_of_20000(spark):
    given = spark.createDataFrame(crowd(14000, side=9000), BOX)
    kept = contours.dedupe_bboxes(given)
    start = time.time()
    assert 14000 < kept.count() < 21000 and time.time() - start < 60


def test_nearest_of_many(spark):
    nodes = spark.createDataFrame([(d, s, pos, *b) for d, s, pos, *b in crowd(120)], BOX.replace("pos", "node_id"))
    rng = random.Random(8)
    points = spark.createDataFrame([("d", s, k, rng.randrange(-30, 460), rng.randrange(-30, 460)) for s in "abc" for k in range(150)] * 2 + [("d", "a", 999, None, 3)], "dataset string, sample_id string, contour_pos int, px int, py int")
    plain = rows(contours.nearest_node(points.where("px IS NOT NULL"), nodes, large=10**6))
    assert rows(contours.nearest_node(points.where("px IS NOT NULL"), nodes, large=50)) == plain == rows(contours.nearest_node(points.where("px IS NOT NULL"), nodes, large=0)) and len(plain) == 300
    assert contours.nearest_node(points, nodes, large=50).count() == 301


def test_heuristic_of_many(spark):
    rng = random.Random(5)
    box = lambda: (float(rng.randrange(900)), float(rng.randrange(900)), rng.choice([20.0, 30.0]), 20.0)
    given = spark.createDataFrame([("d", s, k, f"n{k % 70}" if s == "a" else f"n{k}", *box()) for s in "abc" for k in range(80 if s != "c" else 3)], "dataset string, sample_id string, pos int, node_id string, x double, y double, w double, h double")
    plain = rows(predictors.heuristic_edges(given, large=10**6))
    assert rows(predictors.heuristic_edges(given, large=50)) == plain == rows(predictors.heuristic_edges(given, large=0)) and len(plain) > 150


def test_features_of_asked_pairs(spark):
    rng = random.Random(9)
    given = spark.createDataFrame([("d", s, k, f"n{k}", *(float(rng.randrange(9)) for _ in range(2)), 2.0, 1.0 + rng.randrange(3)) for s in "ab" for k in range(30)], "dataset string, sample_id string, pos int, node_id string, x double, y double, w double, h double")
    asked = spark.createDataFrame([("d", s, f"n{rng.randrange(32)}", f"n{rng.randrange(32)}") for s in "abc" for _ in range(60)], "dataset string, sample_id string, src string, dst string")
    every = pairs.pair_features(given)
    want = rows(every.join(asked.distinct(), ["dataset", "sample_id", "src", "dst"]).select(*every.columns))
    for large in (0, 500):
        assert rows(pairs.asked_features(given, asked, large=large).select(*every.columns)) == want and len(want) > 80


def test_heuristic_looks_at_a_bounded_number_of_pairs():
    rng, looked = np.random.default_rng(1), []
    for n in (2000, 20000):
        side = 60 * n**0.5
        source, _, place, _, pairs = boxes.best_steps(rng.uniform(0, side, n), rng.uniform(0, side, n), np.arange(n))
        looked.append(pairs / n)
        assert (place == 1).sum() == len(np.unique(source)) >= n - 3
    assert looked[1] < 1.3 * looked[0] < 400


def test_nearest_of_10000_points_and_boxes():
    rng = np.random.default_rng(2)
    b = np.column_stack([rng.integers(0, 20000, (10000, 2)), rng.integers(1, 400, (10000, 2))]).astype(float)
    b[0] = (0, 0, 10000, 10000)
    p = rng.integers(-50, 21000, (10000, 2)).astype(float)
    order = rng.permutation(10000)
    found = boxes.nearest_boxes(p, b, order)
    for k in rng.integers(0, 10000, 200):
        d = (np.maximum(np.maximum(b[:, :2] - p[k], p[k] - b[:, :2] - b[:, 2:]), 0) ** 2).sum(axis=1)
        assert found[k] == min(np.flatnonzero(d == d.min()), key=lambda j: order[j])
