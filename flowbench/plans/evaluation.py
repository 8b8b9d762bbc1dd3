"""Queries of matching, metrics, pairs, predictors and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.functions import geometry as G
from flowbench.operators import matching, metrics, pairs, predictors
from flowbench.operators.evaluate import evaluate as run_evaluate
from flowbench.operators.keys import KEY
from flowbench.plans import testdata as T
from flowbench.plans.testdata import MATCH_SQL, SQL

#: A model for the queries: fixed values that decide by direction, alignment and rank.
MODEL = predictors.Model(
    coef=(1.5, 1.2, -0.7, -0.9, -2.0, -0.5, 0.3, 0.2, 0.1, -0.1, 0.4, 0.2, 0.05, -0.05, 0.02, 0.8, -1.1, 0.6, -0.9, 0.7, 0.5, 0.4, 0.3, -1.2, -0.4, -0.3, 1.6, 1.4),
    intercept=-0.4, threshold=0.5, top_k=2,
)
WITH, RECURSIVE = f"WITH {SQL}", f"WITH RECURSIVE {SQL}, {MATCH_SQL}"
PRED = "predictor, dataset, sample_id"


def q_match_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = matching.match_candidates(T.gt_nodes(spark, d), T.pred_nodes(spark, d))
    return found.withColumn("distance", F.round("distance", 6))


def matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched(T.gt_nodes(spark, d), T.pred_nodes(spark, d))


def q_project_edges(spark: SparkSession, d: str) -> DataFrame:
    return matching.project_edges(T.pred_edges(spark, d), matches(spark, d))


def all_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sample_metrics(T.samples(spark, d), T.gt_nodes(spark, d), T.gt_edges(spark, d), T.pred_nodes(spark, d), T.pred_edges(spark, d), ["shifted"])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scores(*names: str):  # noqa: ANN201
    def query(spark: SparkSession, d: str) -> DataFrame:
        return rounded(all_scores(spark, d).select(*matching.PRED_KEY, *names))

    return query


def q_sample_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(all_scores(spark, d))


def q_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.run_metrics(all_scores(spark, d)))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return pairs.image_extent(T.gt_nodes(spark, d))


def q_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """Five predictors over all samples. The derived ground truth, which all of them read, is kept."""
    gt_n, gt_e = T.gt_nodes(spark, d).persist(), T.gt_edges(spark, d).persist()
    predictions = {
        "shifted": (T.pred_nodes(spark, d).select(*predictors.NODES), T.pred_edges(spark, d).select(*predictors.EDGES)),
        "oracle": predictors.predict_oracle(gt_n, gt_e),
        "naive": predictors.predict_naive(pairs.image_extent(gt_n)),
        "heuristic": predictors.predict_heuristic(gt_n),
        "learned": predictors.predict_learned(gt_n, MODEL),
    }
    return rounded(run_evaluate(T.samples(spark, d), gt_n, gt_e, predictions))


def q_node_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs.node_pairs(T.gt_nodes(spark, d)).select(*KEY, "src", "dst", "dx", "dy", "euclidean", "manhattan"))


def q_label_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.label_pairs(pairs.node_pairs(T.gt_nodes(spark, d)), T.gt_edges(spark, d)).select(*KEY, "src", "dst", "label")


def q_rank_features(spark: SparkSession, d: str) -> DataFrame:
    ranked = pairs.rank_features(pairs.node_pairs(T.gt_nodes(spark, d)))
    return ranked.select(*KEY, "src", "dst", *[F.col(c).cast("long").alias(c) for c in ("rank_distance", "rank_dx", "rank_dy", "candidates")])


def q_nearest_right_down(spark: SparkSession, d: str) -> DataFrame:
    return pairs.nearest_right_down(pairs.node_pairs(T.gt_nodes(spark, d))).select(*KEY, "src", "dst", "nearest_right", "nearest_down")


def q_pair_features(spark: SparkSession, d: str) -> DataFrame:
    """Ties at the sixth decimal are rounded up in both engines."""
    found = pairs.pair_features(T.gt_nodes(spark, d)).drop("src_pos", "dst_pos")
    return found.select(*[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def q_asked_features(spark: SparkSession, d: str) -> DataFrame:
    """The features of the true edges alone."""
    asked = T.gt_edges(spark, d).select(*KEY, F.col("source").alias("src"), F.col("target").alias("dst"))
    found = pairs.asked_features(T.gt_nodes(spark, d), asked).drop("src_pos", "dst_pos")
    return found.select(*[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def q_image_extent(spark: SparkSession, d: str) -> DataFrame:
    return sizes(spark, d)


def q_geometry(spark: SparkSession, d: str) -> DataFrame:
    """bbox_center, bbox_diag, bbox_area, bbox_iou, overlap_ratio, safe_log_ratio over pairs of nodes."""
    p = pairs.node_pairs(T.gt_nodes(spark, d))
    s, t = G.Box.of("s"), G.Box.of("t")
    cx, cy = G.bbox_center(s)
    return rounded(p.select(
        *KEY, "src", "dst", cx.alias("center_x"), cy.alias("center_y"), G.bbox_diag(s).alias("diag"), G.bbox_area(s).alias("area"), G.bbox_iou(s, t).alias("iou"),
        G.overlap_ratio(s.y, s.h, t.y, t.h).alias("vertical_overlap"), G.overlap_ratio(s.x, s.w, t.x, t.w).alias("horizontal_overlap"),
        G.safe_log_ratio(t.w, s.w).alias("log_w_ratio"),
    ))


def q_sigmoid_score(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.pair_features(T.gt_nodes(spark, d))
    return rounded(p.select(*KEY, "src", "dst", predictors.sigmoid_score([F.col(f) for f in pairs.FEATURES], MODEL).alias("score")))


def edges_of(p: tuple[DataFrame, DataFrame]) -> DataFrame:
    return p[1].select(*matching.PRED_KEY, "source", "target")


def nodes_of(p: tuple[DataFrame, DataFrame]) -> DataFrame:
    return p[0].select(*matching.PRED_KEY, "node_id", "x", "y", "w", "h")


def q_predict_learned(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with the number of edges that the model gives each as source and as target."""
    nodes, edges = predictors.predict_learned(T.gt_nodes(spark, d), MODEL)
    ends = edges.select(*matching.PRED_KEY, F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy(*matching.PRED_KEY, "e.node_id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return nodes.join(counts, [*matching.PRED_KEY, "node_id"], "left").select(*matching.PRED_KEY, "node_id", "x", "y", "w", "h", zero("n_out"), zero("n_in"))


QUERIES = {
    "match_candidates": q_match_candidates, "match_nodes": matches, "project_edges": q_project_edges,
    "node_metrics": scores("node_precision", "node_recall", "node_f1"), "edge_metrics": scores("edge_precision", "edge_recall", "edge_f1"),
    "direction_accuracy": scores("direction_accuracy"), "exact_match": scores("exact_match"),
    "count_errors": scores("node_count_error", "edge_count_error"), "sample_metrics": q_sample_metrics, "run_metrics": q_run_metrics,
    "evaluate": q_evaluate, "node_pairs": q_node_pairs, "label_pairs": q_label_pairs, "rank_features": q_rank_features,
    "nearest_right_down": q_nearest_right_down, "pair_features": q_pair_features, "asked_features": q_asked_features, "image_extent": q_image_extent, "bbox_geometry": q_geometry,
    "sigmoid_score": q_sigmoid_score,
    "heuristic_edges": lambda s, d: predictors.heuristic_edges(T.gt_nodes(s, d)).select(*KEY, "src", "dst", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score")),
    "predict_oracle": lambda s, d: edges_of(predictors.predict_oracle(T.gt_nodes(s, d), T.gt_edges(s, d))),
    "predict_naive": lambda s, d: nodes_of(predictors.predict_naive(sizes(s, d))),
    "predict_heuristic": lambda s, d: edges_of(predictors.predict_heuristic(T.gt_nodes(s, d))),
    "learned_edges": lambda s, d: edges_of(predictors.predict_learned(T.gt_nodes(s, d), MODEL)),
    "predict_learned": q_predict_learned,
}

PAIRS = """
np AS (SELECT a.dataset, a.sample_id, a.node_id AS src, b.node_id AS dst, a.pos AS src_pos, b.pos AS dst_pos, a.x AS sx, a.y AS sy, a.w AS sw, a.h AS sh,
    b.x AS tx, b.y AS ty, b.w AS tw, b.h AS th, (b.x + b.w / 2) - (a.x + a.w / 2) AS dx, (b.y + b.h / 2) - (a.y + a.h / 2) AS dy
  FROM gt_nodes a JOIN gt_nodes b USING (dataset, sample_id) WHERE a.node_id <> b.node_id),
pr AS (SELECT *, sqrt(dx * dx + dy * dy) AS euclidean, abs(dx) + abs(dy) AS manhattan FROM np),
ext AS (SELECT dataset, sample_id, greatest(max(x + w), 1.0) AS width, greatest(max(y + h), 1.0) AS height FROM gt_nodes GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset, sample_id, src ORDER BY euclidean, dst_pos) AS rank_distance,
    row_number() OVER (PARTITION BY dataset, sample_id, src ORDER BY abs(dx), dst_pos) AS rank_dx,
    row_number() OVER (PARTITION BY dataset, sample_id, src ORDER BY abs(dy), dst_pos) AS rank_dy,
    count(*) OVER (PARTITION BY dataset, sample_id, src) AS candidates,
    dx > 0 AND row_number() OVER (PARTITION BY dataset, sample_id, src ORDER BY CASE WHEN dx > 0 THEN 0 ELSE 1 END, euclidean, dst_pos) = 1 AS nearest_right,
    dy > 0 AND row_number() OVER (PARTITION BY dataset, sample_id, src ORDER BY CASE WHEN dy > 0 THEN 0 ELSE 1 END, euclidean, dst_pos) = 1 AS nearest_down
  FROM pr)
"""
_E = "1e-9"
_FEATURE_SQL = {
    "dx_norm": "dx / width", "dy_norm": "dy / height", "abs_dx_norm": "abs(dx) / width", "abs_dy_norm": "abs(dy) / height",
    "euclidean_norm": "euclidean / sqrt(width * width + height * height)", "manhattan_norm": "manhattan / (width + height)",
    "src_w_norm": "sw / width", "src_h_norm": "sh / height", "dst_w_norm": "tw / width", "dst_h_norm": "th / height",
    "src_area_norm": "sw * sh / (width * height)", "dst_area_norm": "tw * th / (width * height)", "log_w_ratio": f"ln((tw + {_E}) / (sw + {_E}))",
    "log_h_ratio": f"ln((th + {_E}) / (sh + {_E}))", "log_area_ratio": f"ln((tw * th + {_E}) / (sw * sh + {_E}))",
    "is_right_of": "CASE WHEN dx > 0 THEN 1.0 ELSE 0.0 END", "is_left_of": "CASE WHEN dx < 0 THEN 1.0 ELSE 0.0 END",
    "is_below": "CASE WHEN dy > 0 THEN 1.0 ELSE 0.0 END", "is_above": "CASE WHEN dy < 0 THEN 1.0 ELSE 0.0 END",
    "vertical_overlap_ratio": f"greatest(0.0, least(sy + sh, ty + th) - greatest(sy, ty)) / greatest(least(sh, th), {_E})",
    "horizontal_overlap_ratio": f"greatest(0.0, least(sx + sw, tx + tw) - greatest(sx, tx)) / greatest(least(sw, tw), {_E})",
    "same_row_like": "CASE WHEN abs(dy) / greatest(sh, th, 1.0) < 0.75 THEN 1.0 ELSE 0.0 END",
    "same_col_like": "CASE WHEN abs(dx) / greatest(sw, tw, 1.0) < 0.75 THEN 1.0 ELSE 0.0 END",
    "rank_by_distance_norm": "rank_distance / candidates", "rank_by_abs_dx_norm": "rank_dx / candidates", "rank_by_abs_dy_norm": "rank_dy / candidates",
    "is_nearest_right_neighbor": "CASE WHEN nearest_right THEN 1.0 ELSE 0.0 END", "is_nearest_down_neighbor": "CASE WHEN nearest_down THEN 1.0 ELSE 0.0 END",
}
_FEATURES = ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in _FEATURE_SQL.items())
_FEATURES_UP = ", ".join(f"floor(CAST({e} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS {n}" for n, e in _FEATURE_SQL.items())
_Z = " + ".join([f"({MODEL.intercept})", *(f"({c}) * CAST({e} AS DOUBLE)" for c, e in zip(MODEL.coef, _FEATURE_SQL.values(), strict=True))])
SCORED = f"sc AS (SELECT *, 1 / (1 + exp(-z)) AS score FROM (SELECT *, {_Z} AS z FROM rk JOIN ext USING (dataset, sample_id)))"
LEARNED = f"{SCORED}, le AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, sample_id, src ORDER BY score DESC, dst_pos) AS place FROM sc WHERE score >= 0.5) WHERE place <= 2)"
HEURISTIC = """
hs AS (SELECT *, abs(dy) AS rise, euclidean + CASE WHEN dx >= 20 THEN 0 ELSE 80 END + CASE WHEN dy < -20 THEN 120 ELSE 0 END AS score FROM pr WHERE dx >= 20 OR dy >= 30),
hr AS (SELECT *, row_number() OVER (PARTITION BY dataset, sample_id, src ORDER BY score, rise, dx DESC, dst) AS place FROM hs),
he AS (SELECT * FROM (SELECT *, first_value(score) OVER best AS s1, first_value(rise) OVER best AS r1 FROM hr WINDOW best AS (PARTITION BY dataset, sample_id, src ORDER BY place))
  WHERE place = 1 OR (place = 2 AND score <= s1 + 80 AND abs(rise - r1) >= 40))
"""


def metrics_sql(names: str = "'shifted'") -> str:
    """Scores of each sample from matches, projected edges and the tables."""
    return f"""
gn AS (SELECT dataset, sample_id, count(*) AS n, count(DISTINCT node_id) AS ids FROM gt_nodes GROUP BY ALL),
gl AS (SELECT dataset, sample_id, count(*) AS n FROM gt_edges GROUP BY ALL),
gs AS (SELECT DISTINCT dataset, sample_id, source, target FROM gt_edges),
gc AS (SELECT dataset, sample_id, count(*) AS n FROM gs GROUP BY ALL),
pn AS (SELECT {PRED}, count(*) AS n, count(DISTINCT node_id) AS ids FROM pred_nodes GROUP BY ALL),
mn AS (SELECT {PRED}, count(*) AS n FROM matches GROUP BY ALL),
pc AS (SELECT p.predictor, p.dataset, p.sample_id, count(*) AS n, count(f.source) AS hits, count(CASE WHEN f.source IS NULL THEN b.source END) AS back
  FROM projected p LEFT JOIN gs f ON f.dataset = p.dataset AND f.sample_id = p.sample_id AND f.source = p.source AND f.target = p.target
  LEFT JOIN gs b ON b.dataset = p.dataset AND b.sample_id = p.sample_id AND b.source = p.target AND b.target = p.source GROUP BY ALL),
base AS (SELECT s.*, k.predictor, coalesce(gn.n, 0) AS gt_n, coalesce(gn.ids, 0) AS gt_ids, coalesce(gl.n, 0) AS gt_list, coalesce(gc.n, 0) AS gt_set, coalesce(pn.n, 0) AS p_n,
    coalesce(pn.ids, 0) AS p_ids, coalesce(mn.n, 0) AS m, coalesce(pc.n, 0) AS pe, coalesce(pc.hits, 0) AS hits, coalesce(pc.back, 0) AS back
  FROM samples s CROSS JOIN (SELECT unnest([{names}]) AS predictor) k LEFT JOIN gn USING (dataset, sample_id) LEFT JOIN gl USING (dataset, sample_id) LEFT JOIN gc USING (dataset, sample_id)
  LEFT JOIN pn USING (dataset, sample_id, predictor) LEFT JOIN mn USING (dataset, sample_id, predictor) LEFT JOIN pc USING (dataset, sample_id, predictor)),
pr1 AS (SELECT *, CASE WHEN p_n > 0 THEN m / p_n ELSE 0.0 END AS np_, CASE WHEN gt_n > 0 THEN m / gt_n ELSE 0.0 END AS nr, CASE WHEN pe > 0 THEN hits / pe ELSE 0.0 END AS ep,
    CASE WHEN gt_set > 0 THEN hits / gt_set ELSE 0.0 END AS er FROM base),
sm AS (SELECT {PRED}, split, CAST(np_ AS DOUBLE) AS node_precision, CAST(nr AS DOUBLE) AS node_recall, CASE WHEN np_ + nr > 0 THEN 2 * np_ * nr / (np_ + nr) ELSE 0.0 END AS node_f1,
    CAST(ep AS DOUBLE) AS edge_precision, CAST(er AS DOUBLE) AS edge_recall, CASE WHEN ep + er > 0 THEN 2 * ep * er / (ep + er) ELSE 0.0 END AS edge_f1,
    CASE WHEN hits + back > 0 THEN hits / (hits + back) ELSE 0.0 END AS direction_accuracy, CAST(abs(p_n - gt_n) AS DOUBLE) AS node_count_error,
    CAST(abs(pe - gt_list) AS DOUBLE) AS edge_count_error, m = gt_ids AND m = p_ids AND hits = pe AND hits = gt_set AS exact_match FROM pr1)"""


SCORES = f"{RECURSIVE}, {metrics_sql()}"
_R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
_ALL = _R(*metrics.METRICS)
_RUN = ("SELECT dataset, split, predictor, count(*) AS num_samples, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)
        + ", round(avg(CASE WHEN exact_match THEN 1.0 ELSE 0.0 END), 6) AS exact_match_rate, CAST(NULL AS DOUBLE) AS runtime_mean_s FROM sm GROUP BY ALL")
#: All five predictors under one name each, for the flagship.
_FIVE = (
    SQL.replace("pred_nodes AS", "shifted_nodes AS").replace("pred_edges AS", "shifted_edges AS") + f""", {PAIRS}, {HEURISTIC}, {LEARNED},
pred_nodes AS (SELECT * FROM shifted_nodes
  UNION ALL SELECT u.name, dataset, sample_id, pos, node_id, x, y, w, h FROM gt_nodes CROSS JOIN (SELECT unnest(['oracle', 'heuristic', 'learned']) AS name) u
  UNION ALL SELECT 'naive', dataset, sample_id, 0, '0', greatest(0, floor((CAST(trunc(width) AS BIGINT) - 120) / 2.0)), greatest(0, floor((CAST(trunc(height) AS BIGINT) - 56) / 2.0)), 120.0, 56.0 FROM ext),
pred_edges AS (SELECT predictor, dataset, sample_id, source, target FROM shifted_edges
  UNION ALL SELECT 'oracle', dataset, sample_id, source, target FROM gt_edges
  UNION ALL SELECT 'heuristic', dataset, sample_id, src, dst FROM he UNION ALL SELECT 'learned', dataset, sample_id, src, dst FROM le)"""
)
P = f"{WITH}, {PAIRS}"
_K = "dataset, sample_id, src, dst"
SQLS = {
    "match_candidates": f"{RECURSIVE} SELECT {PRED}, round(distance, 6) AS distance, pred_id, gt_id FROM cand",
    "match_nodes": f"{RECURSIVE} SELECT * FROM matches", "project_edges": f"{RECURSIVE} SELECT * FROM projected",
    "node_metrics": f"{SCORES} SELECT {PRED}, {_R('node_precision', 'node_recall', 'node_f1')} FROM sm",
    "edge_metrics": f"{SCORES} SELECT {PRED}, {_R('edge_precision', 'edge_recall', 'edge_f1')} FROM sm",
    "direction_accuracy": f"{SCORES} SELECT {PRED}, {_R('direction_accuracy')} FROM sm", "exact_match": f"{SCORES} SELECT {PRED}, exact_match FROM sm",
    "count_errors": f"{SCORES} SELECT {PRED}, node_count_error, edge_count_error FROM sm",
    "sample_metrics": f"{SCORES} SELECT {PRED}, split, {_ALL}, exact_match FROM sm", "run_metrics": f"{SCORES} {_RUN}",
    "evaluate": f"WITH RECURSIVE {_FIVE}, {MATCH_SQL}, {metrics_sql(names=repr('shifted') + ', ' + ', '.join(map(repr, ('oracle', 'naive', 'heuristic', 'learned'))))} {_RUN}",
    "node_pairs": f"{P} SELECT {_K}, {_R('dx', 'dy', 'euclidean', 'manhattan')} FROM pr",
    "label_pairs": f"{P}, g AS (SELECT DISTINCT dataset, sample_id, source, target FROM gt_edges) SELECT p.dataset, p.sample_id, src, dst, CASE WHEN g.source IS NULL THEN 0 ELSE 1 END AS label FROM pr p LEFT JOIN g ON g.dataset = p.dataset AND g.sample_id = p.sample_id AND g.source = src AND g.target = dst",
    "rank_features": f"{P} SELECT {_K}, rank_distance, rank_dx, rank_dy, candidates FROM rk",
    "nearest_right_down": f"{P} SELECT {_K}, nearest_right, nearest_down FROM rk",
    "pair_features": f"{P} SELECT {_K}, {_FEATURES_UP} FROM rk JOIN ext USING (dataset, sample_id)",
    "asked_features": f"{P}, g AS (SELECT DISTINCT dataset, sample_id, source AS src, target AS dst FROM gt_edges) SELECT {_K}, {_FEATURES_UP} FROM rk JOIN ext USING (dataset, sample_id) JOIN g USING (dataset, sample_id, src, dst)",
    "image_extent": f"{P} SELECT * FROM ext",
    "bbox_geometry": f"""{P} SELECT {_K}, sx + sw / 2 AS center_x, sy + sh / 2 AS center_y, round(sqrt(sw * sw + sh * sh), 6) AS diag, sw * sh AS area,
        round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS iou, round({_FEATURE_SQL['vertical_overlap_ratio']}, 6) AS vertical_overlap,
        round({_FEATURE_SQL['horizontal_overlap_ratio']}, 6) AS horizontal_overlap, round({_FEATURE_SQL['log_w_ratio']}, 6) AS log_w_ratio
        FROM (SELECT *, sw * sh + tw * th - i AS u FROM (SELECT *, greatest(0.0, least(sx + sw, tx + tw) - greatest(sx, tx)) * greatest(0.0, least(sy + sh, ty + th) - greatest(sy, ty)) AS i FROM pr))""",
    "sigmoid_score": f"{P}, {SCORED} SELECT {_K}, round(score, 6) AS score FROM sc",
    "heuristic_edges": f"{P}, {HEURISTIC} SELECT {_K}, place, round(score, 6) AS score FROM he",
    "predict_oracle": f"{WITH} SELECT 'oracle' AS predictor, dataset, sample_id, source, target FROM gt_edges",
    "predict_naive": f"{P} SELECT 'naive' AS predictor, dataset, sample_id, '0' AS node_id, CAST(greatest(0, floor((CAST(trunc(width) AS BIGINT) - 120) / 2.0)) AS DOUBLE) AS x, CAST(greatest(0, floor((CAST(trunc(height) AS BIGINT) - 56) / 2.0)) AS DOUBLE) AS y, CAST(120 AS DOUBLE) AS w, CAST(56 AS DOUBLE) AS h FROM ext",
    "predict_heuristic": f"{P}, {HEURISTIC} SELECT 'heuristic' AS predictor, dataset, sample_id, src AS source, dst AS target FROM he",
    "learned_edges": f"{P}, {LEARNED} SELECT 'learned' AS predictor, dataset, sample_id, src AS source, dst AS target FROM le",
    "predict_learned": f"""{P}, {LEARNED} SELECT 'learned' AS predictor, g.dataset, g.sample_id, node_id, x, y, w, h, count(CASE WHEN src = node_id THEN 1 END) AS n_out, count(CASE WHEN dst = node_id THEN 1 END) AS n_in
        FROM gt_nodes g LEFT JOIN le ON le.dataset = g.dataset AND le.sample_id = g.sample_id AND node_id IN (src, dst) GROUP BY ALL""",
}
