"""Queries of readers, writers, checks, samples, results, conversion, graphs, contours, training and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.functions import text as X
from flowbench.functions.canonical import canonical_json
from flowbench.functions.geometry import xyxy_to_xywh
from flowbench.operators import contours as C
from flowbench.operators import convert, generate, graphs, manifest, normalize, predictors, results, training, validate
from flowbench.operators import samples as S
from flowbench.operators.keys import KEY
from flowbench.operators.pairs import FEATURES, labelled_features
from flowbench.plans import testdata as T
from flowbench.plans.evaluation import _FEATURES, LEARNED, MODEL, PAIRS, SCORED, rounded  # noqa: F401
from flowbench.plans.testdata import SQL
from flowbench.sources import files, readers, writers
from flowbench.sources.files import shared_dir

WITH = f"WITH {SQL}"
K = "dataset, sample_id"


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# --- documents -------------------------------------------------------------------------------------------------------


def graph_docs(spark: SparkSession, d: str, ends: tuple[str, str] = ("source", "target")) -> DataFrame:
    return writers.graph_documents(T.gt_nodes(spark, d), T.gt_edges(spark, d), ends).withColumnRenamed("graph", "value")


def q_read_graphs(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse_nodes(graph_docs(spark, d), KEY).select(*KEY, *long("pos"), "node_id", "x", "y", "w", "h")


def q_normalize_edges(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalize_edges(graph_docs(spark, d, ("u", "v"))).select(*KEY, *long("pos"), "source", "target", "problem")


def q_normalize_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of three numbers where the node's line has no discount."""
    docs = graph_docs(spark, d).withColumn("value", F.regexp_replace("value", r",30\]", "]"))
    return normalize.normalize_nodes(docs).select(*KEY, "node_id", "x", "y", "w", "h")


def q_infer_graph_shape(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("sample_id").cast("long") % 3
    docs = graph_docs(spark, d)
    value = F.when(k == 0, F.concat(F.lit('{"graph":'), "value", F.lit("}"))).when(k == 1, F.replace("value", F.lit('"edges"'), F.lit('"arrows"'))).otherwise(F.lit("[]"))
    return normalize.infer_graph_shape(docs.withColumn("value", value)).select(*KEY, *long("n_nodes", "n_edges"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", F.concat_ws(" - ", "p_brand", "p_name").alias("label"))
    rows = T.lines(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(*KEY, F.col("n").cast("int").alias("node_id"), "label")


LABELS = f"{WITH}, lb AS (SELECT dataset, sample_id, n, p_brand || ' - ' || p_name AS label FROM li JOIN part ON l_partkey = p_partkey)"


def q_read_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = labels(spark, d).groupBy(*KEY).agg(F.concat(F.lit("﻿"), F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("node_id").cast("string"), "label"))))).alias("value"))
    return readers.parse_labels(docs, KEY).select(*KEY, *long("node_id"), "label")


def q_node_display_label(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("node_id").cast("long")
    nodes = T.gt_nodes(spark, d).withColumn("label", F.when(n % 3 == 0, F.lit("own")).when(n % 3 == 1, F.lit(" ")))
    given = labels(spark, d).where("node_id % 2 = 0")
    return normalize.node_display_label(nodes, given)


def q_to_identifier(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    label = F.when(F.col("p_size") % 5 == 0, F.concat(F.col("p_size").cast("string"), "p_name")).when(F.col("p_size") % 7 == 0, "###").when(F.col("p_size") % 7 == 1, F.concat(F.lit("\t \n"), F.col("p_name"), F.lit("\u00a0"))).otherwise(F.concat_ws(" -_ ", "p_brand", "p_name"))
    return p.select("p_partkey", X.to_identifier(label, F.lit("node")).alias("identifier"))


def q_resolve_labels(spark: SparkSession, d: str) -> DataFrame:
    rows, k = labels(spark, d), F.col("sample_id").cast("long") % 3
    found = {"explicit": rows.where((k == 0) & (F.col("node_id") == 1)), "export": rows.where(k <= 1), "ocr": rows}
    return graphs.resolve_labels(found).select(*KEY, *long("node_id"), "label", "source")


# --- files -----------------------------------------------------------------------------------------------------------


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def q_graph_files(spark: SparkSession, d: str) -> DataFrame:
    """write_graphs and read_graphs: every diagram in a file of its own, and read again."""
    path = folder(spark)
    writers.write_graphs(T.gt_nodes(spark, d), T.gt_edges(spark, d), path)
    nodes, edges = readers.read_graphs(spark, path)
    ends = edges.select(*KEY, *long("pos"), F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("name"), F.lit(None).cast("double").alias("x"))
    return nodes.select(*KEY, *long("pos"), F.lit("node").alias("kind"), F.col("node_id").alias("name"), "x").unionByName(ends)


def q_dataset_files(spark: SparkSession, d: str) -> DataFrame:
    """write_dataset_meta and read_dataset_meta."""
    path = folder(spark)
    writers.write_dataset_meta(T.samples(spark, d), path)
    return readers.read_dataset_meta(spark, path)[1].select("dataset", "split", *long("ord"), "sample_id")


def q_result_files(spark: SparkSession, d: str) -> DataFrame:
    """write_results and read_results."""
    path = folder(spark)
    writers.write_results(runs(spark, d).drop("k"), {"timestamp_utc": F.lit("2026-01-01T00:00:00Z")}, path)
    metric = lambda n: F.col("metrics")[n].alias(n)
    return readers.read_results(spark, path)[0].select("dataset", "split", "predictor", "num_samples", metric("edge_f1"), metric("node_f1"), F.col("run")["timestamp_utc"].alias("timestamp_utc"))


def q_record_files(spark: SparkSession, d: str) -> DataFrame:
    """read_split_records over list files, many tasks a file."""
    path = folder(spark)
    lists = record_lists(spark, d).withColumn("value", F.replace("value", F.lit('{"file"'), F.lit(' {\n"note":"[,\\"]}", "file"')))
    files.write_documents(lists.select(F.format_string("list-%d.json", F.col("list_id")).alias("path"), "value"), path)
    found = readers.read_split_records(spark, path)
    return found.select(F.regexp_extract("path", r"list-(\d+)\.json$", 1).cast("long").alias("list_id"), *long("rec_pos"), *[F.get_json_object("record", f"$.{n}").alias(n) for n in ("file", "note")])


def text_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, and rows ``dataset, k, path, location`` of where they are; every 17th is not written."""
    root, k = folder(spark), F.col("doc_id")
    name = F.concat("source", F.lit("/"), k.cast("string"), F.lit(".txt"))
    rows = read(spark, d, "documents").select(F.col("source").alias("dataset"), k.alias("k"), name.alias("path"), F.concat(F.lit(f"{root}/"), name).alias("location"), "text")
    files.write_documents(rows.where("k % 17 <> 0").select("path", F.col("text").alias("value")), root)
    return rows, rows.drop("text")


def q_manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """write_manifest of files that are hashed as streams, and read_manifests."""
    path, where = folder(spark), text_files(spark, d)[1]
    writers.write_manifest(where.select("dataset", F.concat(F.lit("https://host.test/"), "path").alias("url"), F.col("path").alias("local_path"), F.col("location").alias("path")), "set", "1", path)
    return readers.read_manifests(spark, path).select("name", "version", "url", "sha256", "bytes", "local_path")


def q_verify_manifest_files(spark: SparkSession, d: str) -> DataFrame:
    """verify_manifest_deep over files."""
    rows, where = text_files(spark, d)
    listed = rows.select("dataset", F.col("path").alias("local_path"), F.when(F.col("k") % 10 == 0, "0").otherwise(F.sha2("text", 256)).alias("sha256"))
    return manifest.verify_manifest_deep(listed, where)


# --- checks ----------------------------------------------------------------------------------------------------------


def q_validate_graphs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("sample_id").cast("long")
    value = F.when(n % 7 == 0, "{not-json").when(n % 7 == 1, '{"foo":1}').when(n % 7 == 2, F.replace("value", F.lit('"target"'), F.lit('"t"'))).when(n % 7 == 3, F.regexp_replace("value", '"id":"([0-9]+)"', '"id":$1')).otherwise(F.col("value"))
    return validate.validate_graphs(graph_docs(spark, d).withColumn("value", value)).select(*KEY, "code", *long("item_pos"))


def q_validate_graphs_typed(spark: SparkSession, d: str) -> DataFrame:
    """Whole-number ids and ends; every kind of sample has a fault of its own."""
    k, doc = F.col("sample_id").cast("long") % 8, F.regexp_replace("value", '"(id|from|to)":"([0-9]+)"', '"$1":$2')
    swap = lambda a, b: F.replace(doc, F.lit(a), F.lit(b))
    value = (
        F.when(k == 0, F.col("value")).when(k == 1, F.regexp_replace(doc, r",(\d+)\]", ",-$1]")).when(k == 2, swap('"bbox"', '"box"')).when(k == 3, swap('"to"', '"t"'))
        .when(k == 4, swap('"bbox":[', '"bbox":[0.5,')).when(k == 5, F.regexp_replace(doc, r"(\d+)\]", "$1.0]")).when(k == 6, swap('"id":2,', '"id":1,')).otherwise(F.substring(doc, 2, 1 << 30))
    )
    return validate.validate_graphs_typed(graph_docs(spark, d, ("from", "to")).withColumn("value", value)).select(*KEY, "code", *long("item_pos"))


def bad_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = T.boxes(T.lines(spark, d))
    nodes = rows.select(*KEY, (F.col("n") - 1).alias("pos"), F.col("l_linenumber").cast("string").alias("node_id"), "x", "y", "w", F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("h")).alias("h"))
    to = F.when(F.col("l_tax") == 0, F.col("l_linenumber")).otherwise(F.col("l_linenumber") + 1)
    return nodes, rows.select(*KEY, F.col("n").alias("pos"), F.col("l_linenumber").cast("string").alias("source"), to.cast("string").alias("target"))


BAD = f"""{WITH}, bn AS (SELECT dataset, sample_id, CAST(l_linenumber AS VARCHAR) AS node_id, l_discount = 0 AS flat FROM li),
be AS (SELECT dataset, sample_id, CAST(l_linenumber AS VARCHAR) AS source, CAST(CASE WHEN l_tax = 0 THEN l_linenumber ELSE l_linenumber + 1 END AS VARCHAR) AS target FROM li),
bi AS (SELECT dataset, sample_id, node_id, count(*) AS n, bool_or(flat) AS flat FROM bn GROUP BY ALL)"""


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return T.samples(spark, d).select(*KEY, F.lit(520).alias("width"), F.lit(400).alias("height"))


def meta_docs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 7
    good = F.format_string('{"schema_version":"1.0","name":"%s","version":"0.1","splits":{"test":["a","b"],"x":3},"note":{"k":%d}}', F.col("s_name"), F.col("s_suppkey"))
    value = (
        F.when(k == 0, "[]").when(k == 1, '{"name":"a"}').when(k == 2, '{"schema_version":1.0,"name":"a"}').when(k == 3, '{"schema_version":"9.9","name":3}').when(k == 4, "{").otherwise(good)
    )
    return read(spark, d, "supplier").select("s_suppkey", value.alias("value"))


def manifest_docs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 6
    good = F.format_string('{"schema_version":1,"name":"%s","version":"1","artifacts":[{"url":"u%d","sha256":"s","bytes":%d,"local_path":"p"},{"url":"v","sha256":"t","bytes":2,"local_path":"q"}]}', F.col("s_name"), F.col("s_suppkey"), F.col("s_suppkey"))
    value = F.when(k == 0, F.replace(good, F.lit('"schema_version":1'), F.lit('"schema_version":999'))).when(k == 1, '{"schema_version":1,"name":"a","version":"1"}').when(k == 2, F.replace(good, F.lit('"bytes":2,"local_path":"q"'), F.lit('"local_path":"q"'))).otherwise(good)
    return read(spark, d, "supplier").select("s_suppkey", value.alias("value"))


# --- samples ---------------------------------------------------------------------------------------------------------


def order_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = read(spark, d, "orders").select("o_orderkey")
    key = [F.concat(F.lit("ds_"), (F.col("o_orderkey") % 3).cast("string")).alias("dataset"), F.col("o_orderkey").cast("string").alias("sample_id")]
    images = o.where("o_orderkey % 11 <> 0").select(*key, F.concat(F.lit("images/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"))
    docs = o.where("o_orderkey % 13 <> 0").select(*key, F.concat(F.lit("graphs/"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("path"))
    one = o.where("o_orderkey % 10 < 7").select(*key, F.lit("train").alias("split"), F.lit(0).alias("split_ord"))
    two = o.where("o_orderkey % 10 IN (6, 7, 8)").select(*key, F.lit("test").alias("split"), F.lit(1).alias("split_ord"))
    return images, docs, one.unionByName(two)


FILES = """WITH o AS (SELECT o_orderkey AS k, 'ds_' || (o_orderkey % 3) AS dataset, CAST(o_orderkey AS VARCHAR) AS sample_id FROM orders),
im AS (SELECT * FROM o WHERE k % 11 <> 0), gr AS (SELECT * FROM o WHERE k % 13 <> 0),
sp AS (SELECT dataset, sample_id, 'train' AS split, 0 AS ord FROM o WHERE k % 10 < 7 UNION ALL SELECT dataset, sample_id, 'test', 1 FROM o WHERE k % 10 IN (6, 7, 8))"""


# --- results ---------------------------------------------------------------------------------------------------------


def runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda m: F.round((k % m) / m, 4)
    return read(spark, d, "customer").select(
        F.concat(F.lit("ds_"), (k % 3).cast("string")).alias("dataset"), F.when(k % 2 == 0, "test").otherwise("train").alias("split"), F.concat_ws("|", "c_mktsegment", k.cast("string")).alias("predictor"),
        (F.when(k % 23 == 0, -1).otherwise(F.col("c_nationkey"))).cast("int").alias("num_samples"), F.when(k % 11 != 0, part(7)).alias("exact_match_rate"), part(5).alias("edge_f1"), F.when(k % 29 != 0, part(3)).alias("node_f1"),
        part(9).alias("direction_accuracy"), (F.col("c_nationkey") / 10).alias("node_count_error"), F.when(k % 13 != 0, F.round(k % 4 / 4, 4)).alias("edge_count_error"), k.alias("k"),
    )


RUNS = """WITH r AS (SELECT 'ds_' || (c_custkey % 3) AS dataset, CASE WHEN c_custkey % 2 = 0 THEN 'test' ELSE 'train' END AS split, c_mktsegment || '|' || c_custkey AS predictor,
CAST(CASE WHEN c_custkey % 23 = 0 THEN -1 ELSE c_nationkey END AS INTEGER) AS num_samples, CASE WHEN c_custkey % 11 <> 0 THEN round((c_custkey % 7) / 7, 4) END AS exact_match_rate,
round((c_custkey % 5) / 5, 4) AS edge_f1, CASE WHEN c_custkey % 29 <> 0 THEN round((c_custkey % 3) / 3, 4) END AS node_f1, round((c_custkey % 9) / 9, 4) AS direction_accuracy,
c_nationkey / 10 AS node_count_error, CASE WHEN c_custkey % 13 <> 0 THEN round(c_custkey % 4 / 4, 4) END AS edge_count_error, c_custkey AS k FROM customer)"""


def run_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = runs(spark, d)
    docs = writers.result_documents(rows, {"timestamp_utc": F.lit("2026-01-01T00:00:00Z")})
    n = F.element_at(F.split("predictor", r"\|"), -1).cast("long")
    value = F.when(n % 17 == 0, "{").when(n % 17 == 1, '{"dataset":"a"}').when(n % 17 == 2, F.replace("document", F.lit('"schema_version":"1.1"'), F.lit('"schema_version":"1"'))).when(n % 17 == 3, F.replace("document", F.lit('"split"'), F.lit('"extra":1,"split"'))).otherwise(F.col("document"))
    return docs.select(F.col("predictor").alias("path"), value.alias("value"))


def valid(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse_results(run_docs(spark, d)).where("problem IS NULL")


BOARD = """, v AS (SELECT *, '2026-01-01T00:00:00Z' AS timestamp_utc, '1.1' AS schema_version, CAST(NULL AS DOUBLE) AS runtime_mean_s, CAST(NULL AS VARCHAR) AS software_version, CAST(NULL AS VARCHAR) AS git_sha,
CAST(NULL AS VARCHAR) AS platform, CAST(NULL AS VARCHAR) AS python FROM r WHERE k % 17 > 3)"""
_BOARD = ", ".join(results.LEADERBOARD)


# --- conversion ------------------------------------------------------------------------------------------------------


def records(spark: SparkSession, d: str) -> DataFrame:
    """A raw record an order; every fifth has its edges in links only."""
    rows = T.gt_nodes(spark, d)
    entry = F.format_string('"%d":{"x0":%.1f,"y0":%.1f,"x1":%.1f,"y1":%.1f,"text":"t","mermaid_entity_i":%s}', F.col("pos").cast("int"), F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.col("node_id"))
    text = rows.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda s: s["e"]), ",").alias("text"))
    edges = T.gt_edges(spark, d)
    arrow = F.concat_ws(" --> ", F.concat(F.lit("entity"), "source"), F.concat(F.lit("entity"), "target"))
    link = F.format_string('"%d":{"start_text_i":"%d","end_text_i":"%d"}', F.col("pos"), F.col("source").cast("int") - 1, F.col("target").cast("int") - 1)
    join = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("e")))), lambda s: s["e"]), sep)
    drawn = edges.groupBy(*KEY).agg(join(arrow, "\\n").alias("drawn"), join(link, ",").alias("links"))
    k = F.col("sample_id").cast("long") % 5 == 0
    body = F.concat(
        F.lit('{"file":"'), F.col("sample_id"), F.lit('.jpeg","mermaid":"flowchart '), F.when(k, "").otherwise(F.coalesce("drawn", F.lit(""))), F.lit('","meta":{"text":{'), F.col("text"), F.lit('},"links":{'), F.when(k, F.coalesce("links", F.lit(""))).otherwise(""), F.lit("}}}")
    )
    return text.join(drawn, KEY, "left").select("dataset", F.col("sample_id").alias("order_id"), body.alias("record"))


def record_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of the records of up to a hundred orders."""
    k = F.col("order_id").cast("long")
    rows = records(spark, d).select(F.floor(k / 100).alias("list_id"), F.struct(k.alias("k"), "record").alias("r"))
    return rows.groupBy("list_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["record"]), ","), F.lit("]")).alias("value"))


def converted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return convert.convert_flowcharts(records(spark, d), ["dataset"])


def q_convert_minimal(spark: SparkSession, d: str) -> DataFrame:
    docs = graph_docs(spark, d)
    n = F.col("sample_id").cast("long") % 4
    body = F.concat(F.lit('{"id":"'), "sample_id", F.lit('","image":'), F.when(n == 0, "3").otherwise('"a.png"'), F.lit(","), F.expr("substring(value, 2)"))
    body = F.when(n == 1, F.replace(body, F.lit('"source"'), F.lit('"from"'))).otherwise(body)
    out = convert.convert_minimal(docs.select("dataset", body.alias("record")), ["dataset"])
    return out.select("dataset", "sample_id", *long("n_nodes", "n_edges"), "problem")


# --- graphs ----------------------------------------------------------------------------------------------------------


def crossed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges against the order of ids, some of which close cycles: the skips are turned, of the steps those from odd nodes stay."""
    turned = F.col("pos") % 4 == 1
    edges = T.gt_edges(spark, d).where("pos % 4 > 0 OR floor(pos / 4) % 2 = 1")
    return edges.select(*KEY, "pos", F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"))


#: The smallest node that is ready, again and again; what is left waits for itself.
TOPO = f"""WITH RECURSIVE {SQL}, se AS (SELECT dataset, sample_id, CAST(CASE WHEN pos % 4 = 1 THEN target ELSE source END AS BIGINT) AS a, CAST(CASE WHEN pos % 4 = 1 THEN source ELSE target END AS BIGINT) AS b
  FROM gt_edges WHERE pos % 4 > 0 OR (pos // 4) % 2 = 1),
ns AS (SELECT {K}, list(CAST(node_id AS BIGINT) ORDER BY CAST(node_id AS BIGINT)) AS ids FROM gt_nodes GROUP BY ALL), es AS (SELECT {K}, list([a, b]) AS ab FROM se GROUP BY ALL),
st AS (SELECT {K}, ids, coalesce(ab, []) AS ab, CAST([] AS BIGINT[]) AS placed, CAST(NULL AS BIGINT) AS node FROM ns LEFT JOIN es USING ({K})
  UNION ALL SELECT {K}, ids, ab, list_append(placed, nx), nx FROM (SELECT *, list_min(list_filter(ids, lambda i: NOT list_contains(placed, i) AND len(list_filter(ab, lambda e: e[2] = i AND NOT list_contains(placed, e[1]))) = 0)) AS nx FROM st) WHERE nx IS NOT NULL),
dg AS (SELECT {K}, max(len(placed)) = any_value(len(ids)) AS is_dag FROM st GROUP BY ALL),
tp AS (SELECT {K}, node AS node_id, len(placed) - 1 AS ord, true AS is_dag FROM st JOIN dg USING ({K}) WHERE is_dag AND node IS NOT NULL
  UNION ALL SELECT {K}, CAST(node_id AS BIGINT), pos, false FROM gt_nodes JOIN dg USING ({K}) WHERE NOT is_dag)"""


# --- contours --------------------------------------------------------------------------------------------------------


def contours(spark: SparkSession, d: str) -> DataFrame:
    rows = T.lines(spark, d)
    return rows.select(
        *KEY, F.col("n").cast("int").alias("pos"), (F.col("l_quantity") * 50).alias("area"), (3 + F.col("l_suppkey") % 3).cast("int").alias("n_vertices"), (F.col("l_partkey") % 30).cast("int").alias("n_points"),
        (F.col("l_partkey") % 60).cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y"), (15 + F.col("l_partkey") % 90).cast("int").alias("w"), (15 + F.col("l_suppkey") * 7 % 80).cast("int").alias("h"),
    )


CONTOURS = f"""{SQL}, ct AS (SELECT dataset, sample_id, n AS pos, l_quantity * 50 AS area, 3 + l_suppkey % 3 AS n_vertices, l_partkey % 30 AS n_points, l_partkey % 60 AS x, l_suppkey % 40 AS y,
15 + l_partkey % 90 AS w, 15 + (l_suppkey * 7) % 80 AS h FROM li)"""


def endpoints(spark: SparkSession, d: str) -> DataFrame:
    rows = T.boxes(T.lines(spark, d))
    whole = lambda c: F.col(c).cast("int")
    return rows.select(
        *KEY, F.col("n").cast("int").alias("contour_pos"), (whole("x") + (F.col("l_partkey") % 50).cast("int")).alias("tail_x"), (whole("y") + (F.col("l_suppkey") % 30).cast("int")).alias("tail_y"),
        ((whole("x") * 7 + 90) % 560).alias("head_x"), ((whole("y") * 3 + 50) % 430).alias("head_y"),
    )


def whole_nodes(spark: SparkSession, d: str) -> DataFrame:
    return T.gt_nodes(spark, d).select(*KEY, F.col("node_id").cast("int").alias("node_id"), *[F.col(c).cast("int").alias(c) for c in "xywh"])


def near_sql(point: str, name: str) -> str:
    return f"""(SELECT dataset, sample_id, contour_pos, node_id AS {name} FROM (SELECT ep.dataset, ep.sample_id, contour_pos, CAST(node_id AS INTEGER) AS node_id, row_number() OVER (PARTITION BY ep.dataset, ep.sample_id, contour_pos ORDER BY
 power(greatest(x - {point}_x, 0, {point}_x - x - w), 2) + power(greatest(y - {point}_y, 0, {point}_y - y - h), 2), CAST(node_id AS INTEGER)) AS r FROM ep JOIN gt_nodes USING (dataset, sample_id)) WHERE r = 1)"""


ENDS = f"""{WITH}, ep AS (SELECT dataset, sample_id, n AS contour_pos, x + l_partkey % 50 AS tail_x, y + l_suppkey % 30 AS tail_y, (x * 7 + 90) % 560 AS head_x, (y * 3 + 50) % 430 AS head_y FROM bx)"""


# --- training --------------------------------------------------------------------------------------------------------


def train_rows(spark: SparkSession, d: str) -> DataFrame:
    return training.training_pairs(T.gt_nodes(spark, d), T.gt_edges(spark, d), T.samples(spark, d))


def q_train_edge_model(spark: SparkSession, d: str) -> DataFrame:
    """The gradient of the objective at the fitted model, which only the optimum has at 0."""
    rows = training.stored_rows(training.chosen_pairs(T.gt_nodes(spark, d), T.gt_edges(spark, d), T.samples(spark, d)))
    found = training.loss_gradient(rows, training.train_edge_model(rows))
    return found.select("feature", F.abs(F.round("gradient", 3)).alias("gradient"))


def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled_features(T.gt_nodes(spark, d), T.gt_edges(spark, d))
    return rounded(training.evaluate_fit(rows, MODEL))


TRAIN = f"""{WITH}, {PAIRS}, gold AS (SELECT DISTINCT dataset, sample_id, source, target FROM gt_edges),
lp AS (SELECT rk.*, {_FEATURES}, CASE WHEN gold.source IS NULL THEN 0 ELSE 1 END AS label FROM rk JOIN ext USING (dataset, sample_id)
  JOIN samples ON samples.dataset = rk.dataset AND samples.sample_id = rk.sample_id AND split = 'train'
  LEFT JOIN gold ON gold.dataset = rk.dataset AND gold.sample_id = rk.sample_id AND gold.source = src AND gold.target = dst),
hn AS (SELECT *, sum(label) OVER (PARTITION BY dataset, sample_id) AS positives, row_number() OVER (PARTITION BY dataset, sample_id, label ORDER BY
  CASE WHEN same_row_like > 0.5 OR same_col_like > 0.5 OR nearest_right OR nearest_down THEN 0 ELSE 1 END, rank_distance / candidates, src_pos, dst_pos) AS place FROM lp),
tr AS (SELECT * FROM hn WHERE label = 1 OR place <= 3 * positives)"""


# --- manifests -------------------------------------------------------------------------------------------------------


def artifacts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("doc_id")
    rows = read(spark, d, "documents").select(F.col("source").alias("dataset"), k, "text", F.concat(F.lit("https://host.test/"), k.cast("string"), F.lit(".txt")).alias("url"))
    have = rows.where("doc_id % 17 <> 0").select("dataset", "url", F.sha2("text", 256).alias("sha256"))
    want = rows.select("dataset", "url", F.when(k % 10 == 0, "0").when(k % 10 != 1, F.sha2("text", 256)).alias("sha256"))
    return want, have


def q_verify_manifest_deep(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = read(spark, d, "documents").select(F.col("source").alias("dataset"), k, F.concat(k.cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    listed = rows.select("dataset", F.col("path").alias("local_path"), F.when(k % 10 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"))
    return manifest.verify_manifest_deep(listed, rows.where("doc_id % 17 <> 0"))


def q_assign_snapshot_splits(spark: SparkSession, d: str) -> DataFrame:
    snap = F.when(F.col("o_orderkey") % 4 == 3, "bare").when(F.col("o_orderkey") % 4 == 2, "train only").otherwise("both").alias("dataset")
    o = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("b"), (F.col("o_orderkey") % 8).cast("string")).alias("subset"), snap)
    images = o.select("dataset", "subset", F.concat(F.lit("x/i"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path"))
    name = F.concat(F.lit('"i'), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, '.png"').otherwise('"'))
    # names of fields name no image; strings are decoded; a list in another subset counts too
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('{"i'), (F.col("o_orderkey") + 1).cast("string"), F.lit('.png": ['), F.replace(name, F.lit("i"), F.lit("\\u0069")), F.lit(', "no such", 7, null]}'))).otherwise(name)
    part = lambda split, c: o.where(c).groupBy("dataset", F.lit("b0").alias("subset"), F.floor(F.col("o_orderkey") / 50).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(name), ","), F.lit("]")).alias("value")).select("dataset", "subset", F.lit(split).alias("split"), "value")
    broken = o.select("dataset", "subset", F.lit("test").alias("split"), F.concat(F.lit('["i'), F.col("o_orderkey").cast("string"), F.lit('.png",')).alias("value"))
    splits = part("train", "o_orderkey % 4 < 3 AND o_orderkey % 7 < 4").unionByName(part("test", "o_orderkey % 4 = 0 AND o_orderkey % 7 > 2")).unionByName(broken)
    return manifest.assign_snapshot_splits(images, splits).select("dataset", "subset", "sample_id", "split")


def q_file_names(spark: SparkSession, d: str) -> DataFrame:
    """file_stem, artifact_filename, parse_snapshot_url, format_bytes, content_sha256."""
    k = F.col("c_custkey")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://h.test/a/"), F.translate("c_name", "#", "-"), F.lit(".tar.gz?x=1"))).when(k % 4 == 1, "https://h.test/").when(k % 4 == 2, F.concat(F.lit("hf://datasets/org/n"), k.cast("string"), F.lit("@v1"))).otherwise("")
    snap = X.parse_snapshot_url(url)
    size = F.when(k % 5 == 0, None).otherwise(F.pow(F.lit(10.0), k % 14).cast("long"))
    return read(spark, d, "customer").select(
        "c_custkey", X.artifact_filename(url).alias("artifact"), X.file_stem(F.concat(F.lit("a/b."), "c_name", F.lit(".png"))).alias("stem"), snap["repo_id"].alias("repo_id"), snap["revision"].alias("revision"),
        X.format_bytes(size).alias("size"), X.content_sha256(F.col("c_name")).alias("digest"),
    )


def order_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("i")).distinct()


def generated(which: int, *columns: str):  # noqa: ANN201
    maker = {0: generate.generate_synthflow, 1: generate.generate_realworld_like, 2: generate.generate_synthetic_basic, 3: generate.generate_synthetic_legacy}[which]
    return lambda s, d: maker(order_ids(s, d))[1 if which < 2 else 0].select(*columns)


def patterns_sql(patterns: tuple[generate.Pattern, ...]) -> str:
    rows = [f"({k}, '{p.name}', {p.canvas[0]}, {p.canvas[1]}, {pos}, '{b[0]}', {', '.join(map(str, b[1:]))})" for k, p in enumerate(patterns) for pos, b in enumerate(p.boxes)]
    return f"pt AS (SELECT * FROM (VALUES {', '.join(rows)}) t(k, name, cw, ch, pos, node_id, bx, by_, bw, bh)), ids AS (SELECT DISTINCT o_orderkey AS i FROM orders)"


def bits_sql(key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


def generated_sql(dataset: str, patterns: tuple[generate.Pattern, ...], move: int, gw: int, gh: int, lw: int, lh: int) -> str:
    shift = lambda part, most: f"({bits_sql(f'0 || chr(58) || i || chr(58) || pos || chr(58) || {part!r}')} % {2 * most + 1} - {most})"
    return f"""WITH {patterns_sql(patterns)}, ch AS (SELECT i, {bits_sql("0 || chr(58) || i || ':pattern'")} % {len(patterns)} AS k FROM ids),
sz AS (SELECT *, greatest({lw}, bw + {shift('w', gw)}) AS w, greatest({lh}, bh + {shift('h', gh)}) AS h FROM ch JOIN pt USING (k))
SELECT '{dataset}' AS dataset, '{dataset}-' || CASE WHEN length(CAST(i AS VARCHAR)) < 4 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END AS sample_id, CAST(pos AS INTEGER) AS pos, node_id,
CAST(greatest(10, least(cw - w - 10, bx + {shift('x', move)})) AS DOUBLE) AS x, CAST(greatest(10, least(ch.ch_ - h - 10, by_ + {shift('y', move)})) AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM sz""".replace("ch.ch_", "ch")


_NODE = ("dataset", "sample_id", "pos", "node_id", "x", "y", "w", "h")
QUERIES = {
    "read_graphs": q_read_graphs, "normalize_edges": q_normalize_edges, "normalize_nodes": q_normalize_nodes, "infer_graph_shape": q_infer_graph_shape,
    "write_graphs": lambda s, d: graph_docs(s, d), "canonical_json": lambda s, d: graph_docs(s, d).select(*KEY, canonical_json(F.col("value")).alias("value")),
    "write_dataset_meta": lambda s, d: writers.dataset_documents(T.samples(s, d)),
    "read_dataset_meta": lambda s, d: readers.parse_splits(writers.dataset_documents(T.samples(s, d)).withColumnRenamed("document", "value"), ["dataset"]).select("dataset", "split", *long("ord"), "sample_id"),
    "graph_files": q_graph_files, "record_files": q_record_files, "dataset_files": q_dataset_files, "result_files": q_result_files, "manifest_files": q_manifest_files, "verify_manifest_files": q_verify_manifest_files,
    "list_files": lambda s, d: readers.listed(read(s, d, "documents").select(F.concat(F.lit("raw/"), "source", F.lit("/img_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PNG").when(F.col("doc_id") % 3 == 1, ".jpg").otherwise(".txt")).alias("path"), F.col("n_chars").alias("length"))),
    "read_labels": q_read_labels, "node_display_label": q_node_display_label, "to_identifier": q_to_identifier, "resolve_labels": q_resolve_labels,
    "labels_template": lambda s, d: graphs.labels_template(T.gt_nodes(s, d)),
    "validate_graphs": q_validate_graphs, "validate_graphs_strict": lambda s, d: validate.validate_graphs_strict(*bad_graph(s, d)).select(*KEY, "code", "item"),
    "validate_graphs_typed": q_validate_graphs_typed,
    "validate_bbox_bounds": lambda s, d: validate.validate_bbox_bounds(T.gt_nodes(s, d), sizes(s, d)),
    "validate_dataset_meta": lambda s, d: validate.validate_dataset_meta(meta_docs(s, d), ["s_suppkey"]),
    "validate_manifest": lambda s, d: validate.validate_manifest(manifest_docs(s, d), ["s_suppkey"]),
    "read_manifests": lambda s, d: readers.parse_manifests(manifest_docs(s, d), ["s_suppkey"]).fillna(-1, ["bytes"]),
    "drop_invalid": lambda s, d: validate.drop_invalid(T.samples(s, d), q_validate_graphs(s, d))[0],
    "dangling_edges": lambda s, d: S.dangling_edges(bad_graph(s, d)[1], bad_graph(s, d)[0]),
    "resolve_samples": lambda s, d: S.resolve_samples(*order_files(s, d)), "validate_pairs": lambda s, d: S.validate_pairs(*order_files(s, d)[:2]),
    "validate_splits": lambda s, d: S.validate_splits(order_files(s, d)[2], S.resolve_samples(*order_files(s, d))),
    "select_split": lambda s, d: S.select_split(T.samples(s, d), limit=20),
    "images_dir_rule": lambda s, d: S.images_dir_rule(S.resolve_samples(*order_files(s, d)), order_files(s, d)[0].where("dataset <> 'ds_1'").select("dataset", "path")),
    "raw_only_guard": lambda s, d: S.raw_only_guard(read(s, d, "documents").select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 3).cast("string")).alias("dataset"), F.when(F.length("text") % 3 == 0, "dataset.json").when(F.length("text") % 3 == 1, "readme.txt").otherwise(F.concat(F.lit("raw/"), F.col("doc_id").cast("string"))).alias("path"))),
    "read_results": lambda s, d: readers.parse_results(run_docs(s, d)).where("problem IS NOT NULL").select("path", "problem"),
    "write_results": lambda s, d: writers.result_documents(runs(s, d).drop("k"), {"timestamp_utc": F.lit("2026-01-01T00:00:00Z"), "git_sha": F.lit(None)}),
    "leaderboard": lambda s, d: results.leaderboard(valid(s, d)), "leaderboard_markdown": lambda s, d: results.leaderboard_markdown(results.leaderboard(valid(s, d))),
    "result_summary": lambda s, d: results.result_summary(valid(s, d)).select("schema_version", "dataset", "split", "predictor", "num_samples", F.size("metrics").cast("long").alias("n_metrics"), F.element_at("run", "timestamp_utc").alias("timestamp_utc")),
    "validate_results": lambda s, d: results.validate_results(valid(s, d)),
    "read_split_records": lambda s, d: readers.parse_records(record_lists(s, d), ["list_id"]).select("list_id", *long("rec_pos"), F.get_json_object("record", "$.file").alias("file")),
    "has_graph_supervision": lambda s, d: validate.has_graph_supervision(readers.parse_records(record_lists(s, d).withColumn("value", F.when(F.col("list_id") % 3 == 0, F.replace("value", F.lit("flowchart"), F.lit("drawing"))).otherwise(F.col("value"))), ["list_id"]), ["list_id"]),
    "convert_simflowchart": lambda s, d: converted(s, d)[0].select(*KEY, *long("pos"), "node_id", *long("x", "y", "w", "h")),
    "parse_mermaid_edges": lambda s, d: converted(s, d)[1].select(*KEY, *long("pos"), "source", "target"),
    "links_to_edges": lambda s, d: convert.convert_flowcharts(records(s, d).where(F.size(X.parse_mermaid_edges(F.get_json_object("record", "$.mermaid"))) == 0), ["dataset"])[1].select(*KEY, "source", "target"),
    "convert_skipped": lambda s, d: converted(s, d)[2], "convert_minimal": q_convert_minimal,
    "xyxy_to_xywh": lambda s, d: read(s, d, "lineitem").select("l_orderkey", *[c.alias(n) for n, c in xyxy_to_xywh(F.col("l_quantity") / 2, F.col("l_partkey") / 4, F.col("l_quantity") / 2 + F.col("l_suppkey") / 4 - 5, F.col("l_partkey") / 2).items()]),
    "topo_order": lambda s, d: graphs.topo_order(T.gt_nodes(s, d), crossed_edges(s, d)).select(*KEY, "node_id", *long("ord"), "is_dag"),
    "topo_layers": lambda s, d: graphs.topo_layers(T.gt_nodes(s, d), crossed_edges(s, d)).select(*KEY, "node_id", *long("layer"), "x", "y"),
    "program_text": lambda s, d: graphs.program_text(T.gt_nodes(s, d), crossed_edges(s, d), labels(s, d)),
    "graph_summary": lambda s, d: graphs.graph_summary(T.gt_nodes(s, d), T.gt_edges(s, d)), "graph_extent": lambda s, d: graphs.graph_extent(T.gt_nodes(s, d)),
    "reading_order": lambda s, d: graphs.reading_order(T.gt_nodes(s, d)).select(*KEY, "node_id", *long("place")),
    "dedupe_edges": lambda s, d: graphs.dedupe_edges(T.gt_edges(s, d)).select(*KEY, "source", "target", *long("pos")),
    "filter_rect_contours": lambda s, d: C.filter_rect_contours(contours(s, d)).select(*KEY, *long("pos")), "filter_arrow_contours": lambda s, d: C.filter_arrow_contours(contours(s, d)).select(*KEY, *long("pos")),
    "dedupe_bboxes": lambda s, d: C.dedupe_bboxes(contours(s, d)).select(*KEY, *long("pos")), "assign_node_ids": lambda s, d: C.assign_node_ids(contours(s, d)).select(*KEY, *long("pos", "node_id")),
    "nearest_node": lambda s, d: C.nearest_node(endpoints(s, d).select(*KEY, "contour_pos", F.col("tail_x").alias("px"), F.col("tail_y").alias("py")), whole_nodes(s, d)).select(*KEY, *long("contour_pos", "node_id")),
    "edges_from_endpoints": lambda s, d: C.edges_from_endpoints(endpoints(s, d), whole_nodes(s, d)).select(*KEY, *long("source", "target")),
    "training_pairs": lambda s, d: rounded(train_rows(s, d).select(*KEY, "src", "dst", "label", "euclidean_norm", "rank_by_distance_norm")),
    "select_hard_negatives": lambda s, d: train_rows(s, d).where("label = 0").select(*KEY, "src", "dst"),
    "label_counts": lambda s, d: training.label_counts(train_rows(s, d)), "class_weights": lambda s, d: rounded(training.class_weights(train_rows(s, d))),
    "train_edge_model": q_train_edge_model, "confusion_metrics": q_confusion, "evaluate_fit": q_confusion,
    "union_datasets": lambda s, d: training.union_datasets([T.samples(s, d).where(f"dataset = 'ds_{k}'") for k in range(3)]),
    "verify_manifest": lambda s, d: manifest.verify_manifest(*artifacts(s, d)), "verify_manifest_deep": q_verify_manifest_deep,
    "snapshot_totals": lambda s, d: manifest.snapshot_totals(read(s, d, "documents").select(F.col("source").alias("dataset"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("length"))),
    "write_manifest": lambda s, d: writers.manifest_documents(read(s, d, "supplier").select(F.concat(F.lit("d"), (F.col("s_suppkey") % 9).cast("string")).alias("dataset"), F.concat(F.lit("u"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("url"), F.col("s_name").alias("local_path"), F.col("s_name").cast("binary").alias("content")), "set", "1"),
    "assign_snapshot_splits": q_assign_snapshot_splits, "file_names": q_file_names,
    "generate_synthflow": generated(0, *_NODE), "generate_realworld_like": generated(1, *_NODE), "generate_synthetic_basic": generated(2, *_NODE), "generate_synthetic_legacy": generated(3, "sample_id", *_NODE[2:]),
}

_DOC = """'{"nodes":[' || (SELECT string_agg('{"id":"' || node_id || '","bbox":[' || CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) || ',' || CAST(w AS BIGINT) || ',' || CAST(h AS BIGINT) || ']}', ',' ORDER BY pos) FROM gt_nodes g WHERE g.dataset = s.dataset AND g.sample_id = s.sample_id)
 || '],"edges":[' || coalesce((SELECT string_agg('{"source":"' || source || '","target":"' || target || '"}', ',' ORDER BY pos) FROM gt_edges g WHERE g.dataset = s.dataset AND g.sample_id = s.sample_id), '') || ']}'"""
_EDGE = f"(SELECT *, row_number() OVER (PARTITION BY dataset, sample_id ORDER BY pos) - 1 AS idx FROM gt_edges)"
_IDENT = "regexp_replace(regexp_replace(translate(trim({0}), ' -', '__'), '[^0-9A-Za-z_]', '', 'g'), '_+', '_', 'g')"


def ident(label: str, fallback: str) -> str:
    s = _IDENT.format(label)
    return f"(CASE WHEN {label} IS NULL OR {s} = '' THEN {fallback} WHEN regexp_matches({s}, '^[0-9]') THEN '_' || {s} ELSE {s} END)"


_METRIC_JSON = " || ".join(f"""coalesce('"{m}":' || CAST({m} AS VARCHAR) || ',', '')""" for m in ("exact_match_rate", "edge_f1", "node_f1", "direction_accuracy", "node_count_error", "edge_count_error"))
SQLS = {
    "read_graphs": f"{WITH} SELECT {K}, pos, node_id, x, y, w, h FROM gt_nodes", "normalize_edges": f"{WITH} SELECT {K}, idx AS pos, source, target, CAST(NULL AS VARCHAR) AS problem FROM {_EDGE}",
    "normalize_nodes": f"{WITH} SELECT {K}, node_id, {', '.join(f'CASE WHEN h = 30 THEN 0.0 ELSE {c} END AS {c}' for c in 'xywh')} FROM gt_nodes",
    "infer_graph_shape": f"{WITH} SELECT {K}, CASE WHEN k = 2 THEN 0 ELSE n END AS n_nodes, CASE WHEN k = 2 THEN 0 ELSE coalesce(m, 0) END AS n_edges FROM (SELECT {K}, CAST(sample_id AS BIGINT) % 3 AS k, count(*) AS n FROM gt_nodes GROUP BY ALL) LEFT JOIN (SELECT {K}, count(*) AS m FROM gt_edges GROUP BY ALL) USING ({K})",
    "write_graphs": f"{WITH} SELECT {K}, {_DOC} AS value FROM samples s",
    "canonical_json": f"""{WITH} SELECT {K}, '{{"edges":[' || coalesce((SELECT string_agg('{{"source":"' || source || '","target":"' || target || '"}}', ',' ORDER BY source, target) FROM gt_edges g WHERE g.dataset = s.dataset AND g.sample_id = s.sample_id), '') || '],"nodes":[' ||
 (SELECT string_agg('{{"bbox":[' || CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) || ',' || CAST(w AS BIGINT) || ',' || CAST(h AS BIGINT) || '],"id":"' || node_id || '"}}', ',' ORDER BY node_id) FROM gt_nodes g WHERE g.dataset = s.dataset AND g.sample_id = s.sample_id) || ']}}' AS value FROM samples s""",
    "write_dataset_meta": f"""{WITH}, l AS (SELECT dataset, split, '"' || split || '":[' || string_agg('"' || sample_id || '"', ',' ORDER BY sample_id) || ']' AS e FROM samples GROUP BY dataset, split)
 SELECT dataset, '{{"schema_version":"1.0","name":"' || dataset || '","version":"0.1","splits":{{' || string_agg(e, ',' ORDER BY e) || '}}}}' AS document FROM l GROUP BY dataset""",
    "read_dataset_meta": f"{WITH} SELECT dataset, split, row_number() OVER (PARTITION BY dataset, split ORDER BY sample_id) - 1 AS ord, sample_id FROM samples",
    "graph_files": f"{WITH} SELECT {K}, pos, 'node' AS kind, node_id AS name, x FROM gt_nodes UNION ALL SELECT {K}, idx, 'edge', source || '>' || target, NULL FROM {_EDGE}",
    "record_files": """SELECT l_orderkey // 100 AS list_id, r AS rec_pos, l_orderkey || '.jpeg' AS file, '[,"]}' AS note FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey) - 1 AS r FROM (SELECT DISTINCT l_orderkey FROM lineitem))""",
    "dataset_files": f"{WITH} SELECT dataset, split, row_number() OVER (PARTITION BY dataset, split ORDER BY sample_id) - 1 AS ord, sample_id FROM samples",
    "result_files": f"{RUNS} SELECT dataset, split, predictor, num_samples, edge_f1, node_f1, '2026-01-01T00:00:00Z' AS timestamp_utc FROM r",
    "manifest_files": "SELECT 'set' AS name, '1' AS version, 'https://host.test/' || source || '/' || doc_id || '.txt' AS url, sha256(text) AS sha256, strlen(text) AS bytes, source || '/' || doc_id || '.txt' AS local_path FROM documents WHERE doc_id % 17 <> 0",
    "verify_manifest_files": "SELECT source AS dataset, source || '/' || doc_id || '.txt' AS local_path, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'sha_mismatch' ELSE 'ok' END AS status FROM documents",
    "list_files": "SELECT 'raw/' || source || '/img_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.PNG' ELSE '.jpg' END AS path, 'img_' || doc_id AS sample_id, CASE doc_id % 3 WHEN 0 THEN 'png' ELSE 'jpg' END AS suffix, n_chars AS length FROM documents WHERE doc_id % 3 < 2",
    "read_labels": f"{LABELS} SELECT {K}, n AS node_id, label FROM lb",
    "node_display_label": f"""{LABELS} SELECT {K}, node_id, CASE WHEN n % 3 = 0 THEN 'own' WHEN n % 2 = 0 THEN coalesce(label, node_id) ELSE node_id END AS label,
 CASE WHEN n % 3 = 0 THEN 'own' || chr(10) || '[' || node_id || ']' WHEN n % 2 = 0 AND label IS NOT NULL THEN label || chr(10) || '[' || node_id || ']' ELSE node_id END AS shown FROM (SELECT *, pos + 1 AS n FROM gt_nodes) LEFT JOIN lb USING ({K}, n)""",
    "to_identifier": f"SELECT p_partkey, {ident('label', repr('node'))} AS identifier FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_size || p_name WHEN p_size % 7 = 0 THEN '###' WHEN p_size % 7 = 1 THEN p_name ELSE p_brand || ' -_ ' || p_name END AS label FROM part)",
    "resolve_labels": f"{LABELS}, q AS (SELECT *, CAST(sample_id AS BIGINT) % 3 AS k FROM lb) SELECT {K}, n AS node_id, label, CASE WHEN k = 0 AND has THEN 'explicit' WHEN k <= 1 THEN 'export' ELSE 'ocr' END AS source FROM (SELECT *, bool_or(n = 1) OVER (PARTITION BY {K}) AS has FROM q) WHERE NOT (k = 0 AND has AND n <> 1)",
    "labels_template": f"""{WITH} SELECT {K}, '{{' || string_agg('"' || node_id || '":""', ',' ORDER BY pos) || '}}' AS template FROM gt_nodes GROUP BY ALL""",
    "validate_graphs": f"""{WITH}, q AS (SELECT *, CAST(sample_id AS BIGINT) % 7 AS k FROM samples) SELECT {K}, 'invalid_json' AS code, CAST(-1 AS BIGINT) AS item_pos FROM q WHERE k = 0 UNION ALL SELECT {K}, unnest(['nodes_missing', 'edges_missing']), -1 FROM q WHERE k = 1
 UNION ALL SELECT {K}, 'edges_target', idx FROM {_EDGE} WHERE CAST(sample_id AS BIGINT) % 7 = 2 UNION ALL SELECT {K}, 'nodes_id', pos FROM gt_nodes WHERE CAST(sample_id AS BIGINT) % 7 = 3""",
    "validate_graphs_strict": f"{BAD} SELECT {K}, 'duplicate_id' AS code, node_id AS item FROM bi WHERE n > 1 UNION ALL SELECT {K}, 'empty_box', node_id FROM bi WHERE flat UNION ALL SELECT DISTINCT {K}, 'self_loop', source FROM be WHERE source = target UNION ALL SELECT DISTINCT {K}, 'unknown_node', target FROM be WHERE ({K}, target) NOT IN (SELECT ({K}, node_id) FROM bi)",
    "validate_graphs_typed": f"""{WITH}, e AS (SELECT *, CAST(sample_id AS BIGINT) % 8 AS k FROM {_EDGE}), n AS (SELECT *, CAST(sample_id AS BIGINT) % 8 AS k FROM gt_nodes)
 SELECT {K}, ['node_id_type', 'node_bbox_size', 'node_bbox_missing', '', 'node_bbox_shape', 'node_bbox_type', 'duplicate_id', ''][k + 1] AS code, pos AS item_pos FROM n WHERE k IN (0, 1, 2, 4, 5) OR (k = 6 AND node_id = '2')
 UNION ALL SELECT {K}, CASE k WHEN 0 THEN 'edge_end_type' WHEN 3 THEN 'edge_end_missing' ELSE 'unknown_node' END, idx FROM e WHERE k IN (0, 3) OR (k = 6 AND '2' IN (source, target))
 UNION ALL SELECT {K}, 'not_object', -1 FROM samples WHERE CAST(sample_id AS BIGINT) % 8 = 7""",
    "validate_bbox_bounds": f"{WITH} SELECT {K}, node_id FROM gt_nodes WHERE x < 0 OR y < 0 OR x + w > 520 OR y + h > 400",
    "validate_dataset_meta": "SELECT s_suppkey, unnest(CASE s_suppkey % 7 WHEN 0 THEN ['not_object'] WHEN 1 THEN ['schema_version_missing'] WHEN 2 THEN ['schema_version_type'] WHEN 3 THEN ['schema_version_unsupported', 'name_type'] WHEN 4 THEN ['not_object'] ELSE [] END) AS code FROM supplier",
    "validate_manifest": "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'schema_version' WHEN 1 THEN 'missing_key' ELSE 'artifact_key' END AS code FROM supplier WHERE s_suppkey % 6 < 3",
    "read_manifests": "SELECT s_suppkey, s_name AS name, '1' AS version, 'u' || s_suppkey AS url, 's' AS sha256, s_suppkey AS bytes, 'p' AS local_path FROM supplier WHERE s_suppkey % 6 <> 1 UNION ALL SELECT s_suppkey, s_name, '1', 'v', 't', CASE WHEN s_suppkey % 6 <> 2 THEN 2 ELSE -1 END, 'q' FROM supplier WHERE s_suppkey % 6 <> 1",
    "drop_invalid": f"{WITH} SELECT * FROM samples WHERE CAST(sample_id AS BIGINT) % 7 > 3 OR CAST(sample_id AS BIGINT) % 7 = 2 AND ({K}) NOT IN (SELECT ({K}) FROM gt_edges)",
    "dangling_edges": f"{BAD} SELECT DISTINCT {K}, source, target FROM be WHERE ({K}, target) NOT IN (SELECT ({K}, node_id) FROM bi)",
    "resolve_samples": f"{FILES} SELECT im.dataset, im.sample_id, 'images/' || im.k || '.png' AS image_path, 'graphs/' || im.k || '.json' AS graph_path, coalesce((SELECT arg_max(split, ord) FROM sp WHERE sp.sample_id = im.sample_id), 'all') AS split FROM im JOIN gr USING (k)",
    "validate_pairs": f"{FILES} SELECT {K}, CASE WHEN k % 13 = 0 THEN 'missing_graph' ELSE 'missing_image' END AS code FROM o WHERE (k % 11 = 0) <> (k % 13 = 0)",
    "validate_splits": f"{FILES} SELECT {K}, 'unknown_sample' AS code FROM o WHERE k % 10 < 9 AND (k % 11 = 0 OR k % 13 = 0) UNION ALL SELECT {K}, 'several_splits' FROM o WHERE k % 10 = 6",
    "select_split": f"{WITH} SELECT {K}, split FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY sample_id) AS r FROM samples WHERE split = 'test') WHERE r <= 20",
    "images_dir_rule": "SELECT DISTINCT 'ds_1' AS dataset FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0",
    "raw_only_guard": "SELECT 'd' || (doc_id // 3) AS dataset FROM documents GROUP BY doc_id // 3 HAVING bool_or(coalesce(length(text) % 3, 2) = 2) AND NOT bool_or(coalesce(length(text) % 3, 2) = 0)",
    "read_results": f"{RUNS} SELECT predictor AS path, CASE k % 17 WHEN 0 THEN 'no object' WHEN 1 THEN 'missing keys' WHEN 2 THEN 'schema version' ELSE 'unknown keys' END AS problem FROM r WHERE k % 17 < 4",
    "write_results": f"""{RUNS} SELECT dataset, split, predictor, '{{"schema_version":"1.1","dataset":"' || dataset || '","split":"' || split || '","predictor":"' || predictor || '","num_samples":' || num_samples || ',"metrics":{{' || rtrim({_METRIC_JSON}, ',') || '}},"run":{{"timestamp_utc":"2026-01-01T00:00:00Z"}}}}' AS document FROM r""",
    "leaderboard": f"{RUNS}{BOARD} SELECT {_BOARD} FROM v",
    "leaderboard_markdown": f"{RUNS}{BOARD} SELECT '| ' || " + " || ' | ' || ".join(f"coalesce(replace(CAST({c} AS VARCHAR), '|', '\\|'), '')" for c in results.LEADERBOARD) + " || ' |' AS line FROM v",
    "result_summary": f"{RUNS}{BOARD} SELECT schema_version, dataset, split, predictor, CAST(num_samples AS VARCHAR) AS num_samples, CAST((exact_match_rate IS NOT NULL)::INT + 3 + (node_f1 IS NOT NULL)::INT + (edge_count_error IS NOT NULL)::INT AS BIGINT) AS n_metrics, timestamp_utc FROM v",
    "validate_results": f"{RUNS}{BOARD} SELECT dataset, split, predictor, 'missing_metric' AS code FROM v WHERE exact_match_rate IS NULL OR node_f1 IS NULL UNION ALL SELECT dataset, split, predictor, 'num_samples' FROM v WHERE num_samples < 0",
    "read_split_records": "SELECT l_orderkey // 100 AS list_id, r AS rec_pos, l_orderkey || '.jpeg' AS file FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey) - 1 AS r FROM (SELECT DISTINCT l_orderkey FROM lineitem))",
    "has_graph_supervision": "SELECT DISTINCT l_orderkey // 100 AS list_id, (l_orderkey // 100) % 3 <> 0 AS supervised FROM lineitem",
    "convert_simflowchart": f"{WITH} SELECT {K}, pos, node_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM gt_nodes SEMI JOIN gt_edges USING ({K})",
    "parse_mermaid_edges": f"{WITH} SELECT {K}, idx AS pos, source, target FROM {_EDGE}", "links_to_edges": f"{WITH} SELECT {K}, source, target FROM gt_edges WHERE CAST(sample_id AS BIGINT) % 5 = 0",
    "convert_skipped": f"{WITH} SELECT dataset, sample_id || '.jpeg' AS file, 'no_edges' AS problem FROM samples ANTI JOIN gt_edges USING ({K})",
    "convert_minimal": f"{WITH} SELECT {K}, n AS n_nodes, coalesce(m, 0) AS n_edges, CASE WHEN CAST(sample_id AS BIGINT) % 4 = 0 THEN 'image' WHEN CAST(sample_id AS BIGINT) % 4 = 1 AND m > 0 THEN 'edge' END AS problem FROM (SELECT {K}, count(*) AS n FROM gt_nodes GROUP BY ALL) LEFT JOIN (SELECT {K}, count(*) AS m FROM gt_edges GROUP BY ALL) USING ({K})",
    "xyxy_to_xywh": "SELECT l_orderkey, CAST(a AS BIGINT) AS x, CAST(b AS BIGINT) AS y, CAST(greatest(0, c - a) AS BIGINT) AS w, CAST(greatest(0, e - b) AS BIGINT) AS h FROM (SELECT l_orderkey, round_even(l_quantity / 2, 0) AS a, round_even(l_partkey / 4, 0) AS b, round_even(l_quantity / 2 + l_suppkey / 4 - 5, 0) AS c, round_even(l_partkey / 2, 0) AS e FROM lineitem)",
    "topo_order": f"{TOPO} SELECT {K}, node_id, CAST(ord AS BIGINT) AS ord, is_dag FROM tp",
    "topo_layers": f"""{TOPO}, wk AS (SELECT {K}, node_id, 0 AS layer FROM tp WHERE is_dag UNION SELECT se.dataset, se.sample_id, se.b, layer + 1 FROM wk JOIN se ON se.dataset = wk.dataset AND se.sample_id = wk.sample_id AND se.a = wk.node_id),
 ly AS (SELECT {K}, CAST(node_id AS BIGINT) AS node_id, max(layer) AS layer FROM wk GROUP BY ALL)
 SELECT {K}, node_id, CAST(layer AS BIGINT) AS layer, row_number() OVER (PARTITION BY {K}, layer ORDER BY node_id) - 1 - (count(*) OVER (PARTITION BY {K}, layer) - 1) / 2 AS x, -CAST(layer AS DOUBLE) AS y FROM ly""",
    "program_text": f"""{TOPO}, lb AS (SELECT dataset, sample_id, n, p_brand || ' - ' || p_name AS label FROM li JOIN part ON l_partkey = p_partkey),
 nm AS (SELECT tp.dataset, tp.sample_id, ord, {ident('label', "('node_' || node_id)")} AS name FROM tp LEFT JOIN lb ON lb.dataset = tp.dataset AND lb.sample_id = tp.sample_id AND lb.n = tp.node_id)
 SELECT {K}, '\"\"\"A program made from a diagram.\"\"\"' || repeat(chr(10), 2) || '# Every step gets the dict ctx, which all of them share.' || repeat(chr(10), 2) || string_agg('def ' || name || '(ctx):' || chr(10) || '    print(''' || name || ''')' || repeat(chr(10), 3), '' ORDER BY ord)
 || 'def main():' || chr(10) || '    ctx = {{}}' || chr(10) || string_agg('    ' || name || '(ctx)' || chr(10), '' ORDER BY ord) || repeat(chr(10), 2) || 'if __name__ == ''__main__'':' || chr(10) || '    main()' || chr(10) AS program FROM nm GROUP BY ALL""",
    "graph_summary": f"{WITH} SELECT {K}, n AS n_nodes, coalesce(m, 0) AS n_edges, coalesce(l, '') AS edge_list FROM (SELECT {K}, count(*) AS n FROM gt_nodes GROUP BY ALL) LEFT JOIN (SELECT {K}, count(*) AS m, string_agg(source || '->' || target, ',' ORDER BY source, target) AS l FROM gt_edges GROUP BY ALL) USING ({K})",
    "graph_extent": f'{WITH} SELECT {K}, min(x) - 30 AS "left", min(y) - 30 AS top, max(x + w) + 30 AS "right", max(y + h) + 30 AS bottom FROM gt_nodes GROUP BY ALL',
    "reading_order": f"{WITH} SELECT {K}, node_id, row_number() OVER (PARTITION BY {K} ORDER BY y + h / 2, x + w / 2, pos) - 1 AS place FROM gt_nodes",
    "dedupe_edges": f"{WITH} SELECT {K}, source, target, min(pos) AS pos FROM gt_edges GROUP BY ALL",
    "filter_rect_contours": f"WITH {CONTOURS} SELECT {K}, pos FROM ct WHERE area >= 800 AND n_vertices = 4 AND w >= 20 AND h >= 20 AND w / h BETWEEN 0.4 AND 2.5", "filter_arrow_contours": f"WITH {CONTOURS} SELECT {K}, pos FROM ct WHERE area BETWEEN 80 AND 20000 AND n_points >= 10",
    "dedupe_bboxes": f"""WITH RECURSIVE {CONTOURS}, rc AS (SELECT {K}, pos, {{'x': x, 'y': y, 'w': w, 'h': h}} AS b, row_number() OVER (PARTITION BY {K} ORDER BY -w * h, pos) AS r FROM ct),
 fd AS (SELECT {K}, r, pos, [b] AS kept, true AS hit FROM rc WHERE r = 1 UNION ALL SELECT c.dataset, c.sample_id, c.r, c.pos, CASE WHEN ok THEN list_append(kept, c.b) ELSE kept END, ok FROM
 (SELECT c.*, f.kept, len([1 for k in f.kept if greatest(0, least(k.x + k.w, c.b.x + c.b.w) - greatest(k.x, c.b.x)) * greatest(0, least(k.y + k.h, c.b.y + c.b.h) - greatest(k.y, c.b.y)) >=
  0.7 * (k.w * k.h + c.b.w * c.b.h - greatest(0, least(k.x + k.w, c.b.x + c.b.w) - greatest(k.x, c.b.x)) * greatest(0, least(k.y + k.h, c.b.y + c.b.h) - greatest(k.y, c.b.y)))]) = 0 AS ok
  FROM fd f JOIN rc c ON c.dataset = f.dataset AND c.sample_id = f.sample_id AND c.r = f.r + 1) c) SELECT {K}, pos FROM fd WHERE hit""",
    "assign_node_ids": f"WITH {CONTOURS} SELECT {K}, pos, row_number() OVER (PARTITION BY {K} ORDER BY x, y, pos) - 1 AS node_id FROM ct",
    "nearest_node": f"{ENDS} SELECT {K}, contour_pos, CAST(node_id AS BIGINT) AS node_id FROM {near_sql('tail', 'node_id')}",
    "edges_from_endpoints": f"{ENDS} SELECT DISTINCT {K}, CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target FROM {near_sql('tail', 'source')} JOIN {near_sql('head', 'target')} USING ({K}, contour_pos) WHERE source <> target",
    "training_pairs": f"{TRAIN} SELECT {K}, src, dst, label, euclidean_norm, rank_by_distance_norm FROM tr", "select_hard_negatives": f"{TRAIN} SELECT {K}, src, dst FROM tr WHERE label = 0",
    "label_counts": f"{TRAIN} SELECT count(*) AS examples, count(CASE WHEN label = 1 THEN 1 END) AS positives, count(CASE WHEN label = 0 THEN 1 END) AS negatives FROM tr",
    "class_weights": f"{TRAIN} SELECT round(count(*) / (2.0 * sum(label)), 6) AS positive_weight, round(count(*) / (2.0 * sum(1 - label)), 6) AS negative_weight FROM tr",
    "union_datasets": f"{WITH} SELECT * FROM samples",
    "verify_manifest": "SELECT source AS dataset, 'https://host.test/' || doc_id || '.txt' AS url, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'sha_mismatch' ELSE 'ok' END AS status FROM documents",
    "verify_manifest_deep": "SELECT source AS dataset, doc_id || '.txt' AS local_path, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'sha_mismatch' ELSE 'ok' END AS status FROM documents",
    "snapshot_totals": "SELECT source AS dataset, count(*) AS n_files, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN n_chars END) AS BIGINT) AS bytes FROM documents GROUP BY source",
    "write_manifest": """SELECT 'd' || (s_suppkey % 9) AS dataset, '{"schema_version":1,"name":"set","version":"1","artifacts":[' || string_agg('{"url":"u' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '","sha256":"' || sha256(s_name) || '","bytes":' || strlen(s_name) || ',"local_path":"' || s_name || '"}', ',' ORDER BY s_suppkey) || ']}' AS document FROM supplier GROUP BY s_suppkey % 9""",
    "assign_snapshot_splits": """WITH f AS (SELECT o_orderkey AS k, 'b' || (o_orderkey % 8) AS subset, CASE o_orderkey % 4 WHEN 3 THEN 'bare' WHEN 2 THEN 'train only' ELSE 'both' END AS dataset, o_orderkey % 4 < 3 AND o_orderkey % 7 < 4 AS tr, o_orderkey % 4 = 0 AND o_orderkey % 7 > 2 AS te FROM orders)
 SELECT dataset, subset, subset || ':i' || k AS sample_id, 'train' AS split FROM f WHERE tr UNION ALL SELECT dataset, subset, subset || ':i' || k, 'test' FROM f WHERE CASE dataset WHEN 'both' THEN te WHEN 'train only' THEN NOT tr ELSE true END""",
    "file_names": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', '-') || '.tar.gz' WHEN 2 THEN 'n' || c_custkey || '@v1' ELSE 'artifact.bin' END AS artifact, 'b.' || c_name AS stem, CASE WHEN c_custkey % 4 = 2 THEN 'org/n' || c_custkey END AS repo_id,
 CASE WHEN c_custkey % 4 = 2 THEN 'v1' END AS revision, CASE WHEN b IS NULL THEN 'unknown size' WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KiB', b / 1024) WHEN b < 1073741824 THEN printf('%.2f MiB', b / 1048576) WHEN b < 1099511627776 THEN printf('%.2f GiB', b / 1073741824)
 ELSE printf('%.2f TiB', b / 1099511627776) END AS size, sha256(c_name) AS digest FROM (SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN CAST(power(10, c_custkey % 14) AS BIGINT) END AS b FROM customer)""",
    "generate_synthflow": generated_sql("synthflow", generate.SYNTHFLOW, 8, 6, 4, 1, 1), "generate_realworld_like": generated_sql("realworld-like", generate.REALWORLD_LIKE, 10, 10, 6, 60, 35),
    "generate_synthetic_basic": f"""WITH {patterns_sql(generate.BASIC)} SELECT 'synthetic-basic' AS dataset, CASE WHEN length(CAST(i + 1 AS VARCHAR)) < 4 THEN lpad(CAST(i + 1 AS VARCHAR), 4, '0') ELSE CAST(i + 1 AS VARCHAR) END || '_' || name AS sample_id, CAST(pos AS INTEGER) AS pos, node_id,
 CAST(bx + {bits_sql("'0:' || i || ':x'")} % 21 - 10 AS DOUBLE) AS x, CAST(by_ + {bits_sql("'0:' || i || ':y'")} % 21 - 10 AS DOUBLE) AS y, CAST(bw AS DOUBLE) AS w, CAST(bh AS DOUBLE) AS h FROM ids JOIN pt ON k = i % 3""",
    "generate_synthetic_legacy": f"WITH {patterns_sql(generate.BASIC)} SELECT CASE WHEN length(CAST(i AS VARCHAR)) < 3 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END || '_' || name AS sample_id, CAST(pos AS INTEGER) AS pos, ascii(node_id) - 65 AS node_id, bx AS x, by_ AS y, bw AS w, bh AS h FROM ids JOIN pt ON k = i % 3",
}
_CONF = f"{WITH}, {PAIRS}, {SCORED}, g AS (SELECT DISTINCT dataset, sample_id, source, target FROM gt_edges), q AS (SELECT score >= 0.5 AS p, g.source IS NOT NULL AS y FROM sc LEFT JOIN g ON g.dataset = sc.dataset AND g.sample_id = sc.sample_id AND g.source = src AND g.target = dst), c AS (SELECT CAST(count(CASE WHEN p AND y THEN 1 END) AS DOUBLE) AS tp, CAST(count(CASE WHEN p AND NOT y THEN 1 END) AS DOUBLE) AS fp, CAST(count(CASE WHEN NOT p AND NOT y THEN 1 END) AS DOUBLE) AS tn, CAST(count(CASE WHEN NOT p AND y THEN 1 END) AS DOUBLE) AS fn FROM q), e AS (SELECT *, tp / greatest(tp + fp, 1) AS pre, tp / greatest(tp + fn, 1) AS rec FROM c) SELECT tp, fp, tn, fn, round(pre, 6) AS precision, round(rec, 6) AS recall, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(2 * pre * rec / greatest(pre + rec, 1e-12), 6) AS f1 FROM e"
SQLS |= {"confusion_metrics": _CONF, "evaluate_fit": _CONF, "train_edge_model": f"SELECT unnest([{', '.join(map(repr, (*FEATURES, 'intercept')))}]) AS feature, CAST(0 AS DOUBLE) AS gradient"}
