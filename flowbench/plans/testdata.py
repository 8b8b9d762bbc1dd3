"""Diagrams derived from the given star-schema tables, for Spark and for DuckDB by the same arithmetic.

An order is a diagram and its lines are the nodes, numbered from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a sample with its lines in their order as ``li``, dealt by sample as all that follows wants them.

    Whatever is made of the lines reads this one exchange again: a list is sent whole, so plans that need other fields of
    it don't differ below the exchange.
    """
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    key = [F.concat(F.lit("ds_"), (F.col("l_orderkey") % 3).cast("string")).alias("dataset"), F.col("l_orderkey").cast("string").alias("sample_id")]
    return rows.select(*key, line.alias("line")).groupBy("dataset", "sample_id").agg(F.sort_array(F.collect_list("line")).alias("li"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their sample, dataset and number, and the number of the sample's last."""
    names = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = orders(spark, sf_dir).select("dataset", "sample_id", F.size("li").alias("last"), F.posexplode("li").alias("k", "line"))
    return rows.select("dataset", "sample_id", F.col("sample_id").cast("long").alias("l_orderkey"), *[f"line.{c}" for c in names], (F.col("k") + 1).alias("n"), "last")


def boxes(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*", (F.col("l_partkey") % 500).cast("double").alias("x"), (F.col("l_suppkey") * 37 % 400).cast("double").alias("y"),
        (40 + F.floor("l_quantity")).cast("double").alias("w"), (30 + F.round(F.col("l_discount") * 100)).cast("double").alias("h"),
    )


NODE = ["dataset", "sample_id", "pos", "node_id", "x", "y", "w", "h"]


def gt_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(lines(spark, sf_dir)).select("dataset", "sample_id", (F.col("n") - 1).alias("pos"), F.col("n").cast("string").alias("node_id"), "x", "y", "w", "h")


def pred_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(lines(spark, sf_dir)).where("l_partkey % 11 <> 0")
    return rows.select(
        F.lit("shifted").alias("predictor"), "dataset", "sample_id", (F.col("n") - 1).alias("pos"), F.concat(F.lit("p"), F.col("n").cast("string")).alias("node_id"),
        (F.col("x") + (F.col("l_suppkey") % 7) * 4).alias("x"), (F.col("y") + F.round(F.col("l_tax") * 100) * 4).alias("y"), "w", "h",
    )


def steps(rows: DataFrame, prefix: str, choices: list[tuple]) -> DataFrame:
    """Edges from each line by rules (condition, from, to) in terms of n, within the sample."""
    made = F.array(*[F.when(c, F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b"))) for k, (c, a, b) in enumerate(choices)])
    rows = rows.select("dataset", "sample_id", "n", "last", F.explode(made).alias("e")).where("e is not null and e.a <= last and e.b <= last")
    name = lambda c: F.concat(F.lit(prefix), c.cast("string"))
    return rows.select("dataset", "sample_id", (F.col("n") * 4 + F.col("e.k")).cast("int").alias("pos"), name(F.col("e.a")).alias("source"), name(F.col("e.b")).alias("target"))


def gt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, one = F.col("n"), F.lit(True)
    return steps(lines(spark, sf_dir), "", [(one, n, n + 1), (F.col("l_returnflag") == "R", n, n + 2), (F.col("l_partkey") % 13 == 0, n, n + 1)])


def pred_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    turned = (F.col("l_linestatus") == "O") & (F.col("l_partkey") % 5 == 0)
    made = steps(lines(spark, sf_dir), "p", [(~turned, n, n + 1), (turned, n + 1, n), (F.col("l_suppkey") % 4 == 0, n, n + 3)])
    return made.withColumn("predictor", F.lit("shifted"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("sample_id").cast("long") % 10
    return orders(spark, sf_dir).select("dataset", "sample_id", F.when(k <= 6, "train").when(k <= 8, "test").otherwise("all").alias("split"))


#: The same tables for DuckDB, as common table expressions.
SQL = """
li AS (SELECT 'ds_' || (l_orderkey % 3) AS dataset, CAST(l_orderkey AS VARCHAR) AS sample_id, l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem),
bx AS (SELECT *, max(n) OVER (PARTITION BY dataset, sample_id) AS last, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST((l_suppkey * 37) % 400 AS DOUBLE) AS y,
  CAST(40 + floor(l_quantity) AS DOUBLE) AS w, CAST(30 + round(l_discount * 100) AS DOUBLE) AS h FROM li),
gt_nodes AS (SELECT dataset, sample_id, n - 1 AS pos, CAST(n AS VARCHAR) AS node_id, x, y, w, h FROM bx),
pred_nodes AS (SELECT 'shifted' AS predictor, dataset, sample_id, n - 1 AS pos, 'p' || n AS node_id, x + (l_suppkey % 7) * 4 AS x,
  y + round(l_tax * 100) * 4 AS y, w, h FROM bx WHERE l_partkey % 11 <> 0),
gt_edges AS (SELECT dataset, sample_id, n * 4 AS pos, CAST(n AS VARCHAR) AS source, CAST(n + 1 AS VARCHAR) AS target FROM bx WHERE n + 1 <= last
  UNION ALL SELECT dataset, sample_id, n * 4 + 1, CAST(n AS VARCHAR), CAST(n + 2 AS VARCHAR) FROM bx WHERE l_returnflag = 'R' AND n + 2 <= last
  UNION ALL SELECT dataset, sample_id, n * 4 + 2, CAST(n AS VARCHAR), CAST(n + 1 AS VARCHAR) FROM bx WHERE l_partkey % 13 = 0 AND n + 1 <= last),
pred_edges AS (SELECT 'shifted' AS predictor, dataset, sample_id, CASE WHEN t THEN 'p' || (n + 1) ELSE 'p' || n END AS source,
    CASE WHEN t THEN 'p' || n ELSE 'p' || (n + 1) END AS target, n * 4 + CASE WHEN t THEN 1 ELSE 0 END AS pos
  FROM (SELECT *, l_linestatus = 'O' AND l_partkey % 5 = 0 AS t FROM bx) WHERE n + 1 <= last
  UNION ALL SELECT 'shifted', dataset, sample_id, 'p' || n, 'p' || (n + 3), n * 4 + 2 FROM bx WHERE l_suppkey % 4 = 0 AND n + 3 <= last),
samples AS (SELECT DISTINCT dataset, sample_id, CASE WHEN l_orderkey % 10 <= 6 THEN 'train' WHEN l_orderkey % 10 <= 8 THEN 'test' ELSE 'all' END AS split FROM li)
"""

#: Candidates and greedy matches; the fold carries the used ids of both sides.
MATCH_SQL = """
cand AS (SELECT predictor, p.dataset, p.sample_id, sqrt(power(p.x + p.w / 2 - g.x - g.w / 2, 2) + power(p.y + p.h / 2 - g.y - g.h / 2, 2)) AS distance,
    p.node_id AS pred_id, g.node_id AS gt_id
  FROM pred_nodes p JOIN gt_nodes g USING (dataset, sample_id)
  WHERE sqrt(power(p.x + p.w / 2 - g.x - g.w / 2, 2) + power(p.y + p.h / 2 - g.y - g.h / 2, 2)) <= 0.35 * sqrt(g.w * g.w + g.h * g.h)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY predictor, dataset, sample_id ORDER BY distance, pred_id, gt_id) AS r FROM cand),
fold AS (
  SELECT predictor, dataset, sample_id, r, pred_id, gt_id, true AS hit, [pred_id] AS ps, [gt_id] AS gs FROM ranked WHERE r = 1
  UNION ALL
  SELECT c.predictor, c.dataset, c.sample_id, c.r, c.pred_id, c.gt_id, NOT (list_contains(ps, c.pred_id) OR list_contains(gs, c.gt_id)),
    CASE WHEN list_contains(ps, c.pred_id) OR list_contains(gs, c.gt_id) THEN ps ELSE list_append(ps, c.pred_id) END,
    CASE WHEN list_contains(ps, c.pred_id) OR list_contains(gs, c.gt_id) THEN gs ELSE list_append(gs, c.gt_id) END
  FROM fold f JOIN ranked c ON c.predictor = f.predictor AND c.dataset = f.dataset AND c.sample_id = f.sample_id AND c.r = f.r + 1),
matches AS (SELECT predictor, dataset, sample_id, pred_id, gt_id FROM fold WHERE hit),
projected AS (SELECT DISTINCT e.predictor, e.dataset, e.sample_id, a.gt_id AS source, b.gt_id AS target FROM pred_edges e
  JOIN matches a ON a.predictor = e.predictor AND a.dataset = e.dataset AND a.sample_id = e.sample_id AND a.pred_id = e.source
  JOIN matches b ON b.predictor = e.predictor AND b.dataset = e.dataset AND b.sample_id = e.sample_id AND b.pred_id = e.target)
"""
