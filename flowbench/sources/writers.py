"""Documents made from tables, and their writers. The document functions return rows that any sink can take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowbench.operators.keys import KEY
from flowbench.operators.predictors import Model
from flowbench.operators.results import LEADERBOARD
from flowbench.sources.files import hash_files, write_documents
from flowbench.sources.readers import RESULT_VERSION


def quoted(text: Column) -> Column:
    """A text as JSON; null where it is null."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def plain_number(c: Column) -> Column:
    """A number as JSON, whole ones without a point."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.coalesce(F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string")), F.lit("null"))


def graph_documents(nodes: DataFrame, edges: DataFrame, ends: tuple[str, str] = ("source", "target")) -> DataFrame:
    """``dataset, sample_id, graph``: one JSON document a sample; pass ends=("from", "to") for the other dialect.

    Columns ``label`` of nodes and ``direction`` of edges are written where they are there and not null.
    """
    entry = lambda rows, name: F.concat(F.lit(f',"{name}":'), quoted(F.col(name))) if name in rows.columns else F.lit(None).cast("string")
    box = F.concat_ws(",", *[plain_number(F.col(c).cast("double")) for c in "xywh"])
    node = F.concat(F.lit('{"id":'), quoted(F.col("node_id")), F.lit(',"bbox":['), box, F.lit("]"), F.coalesce(entry(nodes, "label"), F.lit("")), F.lit("}"))
    edge = F.concat(F.lit(f'{{"{ends[0]}":'), quoted(F.col("source")), F.lit(f',"{ends[1]}":'), quoted(F.col("target")), F.coalesce(entry(edges, "direction"), F.lit("")), F.lit("}"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("v")))), lambda x: x["v"]), ",")
    n, e = nodes.groupBy(*KEY).agg(joined(node).alias("n")), edges.groupBy(*KEY).agg(joined(edge).alias("e"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return n.join(e, KEY, "full_outer").select(*KEY, F.concat(F.lit('{"nodes":['), text("n"), F.lit('],"edges":['), text("e"), F.lit("]}")).alias("graph"))


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str, ends: tuple[str, str] = ("source", "target"), mode: str = "append") -> None:
    """``<dataset>/graphs/<sample_id>.json`` below a folder, a file a sample, as read_graphs() reads them."""
    rows = graph_documents(nodes, edges, ends).select(F.concat("dataset", F.lit("/graphs/"), part("sample_id"), F.lit(".json")).alias("path"), F.col("graph").alias("value"))
    write_documents(rows, path, mode)


def part(name: str) -> Column:
    """A column that is one part of a path; an error where it has a slash."""
    return F.when(F.col(name).contains("/"), F.raise_error(F.concat(F.lit(f"a slash in {name}: "), F.col(name)))).otherwise(F.col(name))


def dataset_documents(samples: DataFrame, schema_version: str = "1.0", version: str = "0.1") -> DataFrame:
    """``dataset, document``: metadata with the sorted samples of each split."""
    lists = samples.groupBy("dataset", "split").agg(F.array_sort(F.collect_list("sample_id")).alias("ids"))
    entry = F.concat(F.to_json(F.array("split")).substr(F.lit(2), F.length(F.to_json(F.array("split"))) - 2), F.lit(":"), F.to_json("ids"))
    splits = F.array_join(F.array_sort(F.collect_list(entry)), ",")
    head = F.format_string(f'{{"schema_version":"{schema_version}","name":"%s","version":"{version}","splits":{{', F.col("dataset"))
    return lists.groupBy("dataset").agg(splits.alias("s")).select("dataset", F.concat(head, F.col("s"), F.lit("}}")).alias("document"))


def write_dataset_meta(samples: DataFrame, path: str, schema_version: str = "1.0", version: str = "0.1", mode: str = "append") -> None:
    """``<dataset>/dataset.json`` below a folder, as read_dataset_meta() reads them."""
    rows = dataset_documents(samples, schema_version, version)
    write_documents(rows.select(F.concat(part("dataset"), F.lit("/dataset.json")).alias("path"), F.col("document").alias("value")), path, mode)


def result_documents(runs: DataFrame, run: dict[str, Column]) -> DataFrame:
    """Result documents of run_metrics() rows; entries of ``run`` that are null go."""
    names = [c for c, t in runs.dtypes if t == "double"]
    entries = F.map_filter(F.create_map(*[x for k, v in run.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    metrics = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull())
    body = F.struct(F.lit(RESULT_VERSION).alias("schema_version"), "dataset", "split", "predictor", F.col("num_samples").cast("int").alias("num_samples"), metrics.alias("metrics"), entries.alias("run"))
    return runs.select("dataset", "split", "predictor", F.to_json(body).alias("document"))


def write_results(runs: DataFrame, run: dict[str, Column], path: str, mode: str = "append") -> None:
    """A file a run, called after its dataset, split and predictor and a checksum of them, as read_results() reads them."""
    names = F.to_json(F.struct("dataset", "split", "predictor"))
    clean = F.regexp_replace(F.concat_ws("-", "dataset", "split", "predictor"), "[^A-Za-z0-9-]+", "-")
    name = F.concat(F.lit("result-"), F.substring(clean, 1, 120), F.lit("-"), F.substring(F.sha2(names, 256), 1, 16), F.lit(".json"))
    write_documents(result_documents(runs, run).select(name.alias("path"), F.col("document").alias("value")), path, mode)


def write_leaderboard(board: DataFrame, path: str) -> None:
    """One CSV file with a header; missing values are empty."""
    board.select(*LEADERBOARD).coalesce(1).write.csv(path, header=True, nullValue="", emptyValue="")


def manifest_documents(files: DataFrame, name: str, version: str) -> DataFrame:
    """``dataset, document`` of manifests over rows ``dataset, url, local_path, content``."""
    return digest_documents(files.select("dataset", "url", "local_path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes")), name, version)


def digest_documents(artifacts: DataFrame, name: str, version: str) -> DataFrame:
    """manifest_documents() over rows ``dataset, url, local_path, sha256, bytes``."""
    each = artifacts.select("dataset", F.struct("url", "sha256", F.col("bytes").cast("long").alias("bytes"), "local_path").alias("a"))
    body = F.struct(F.lit(1).alias("schema_version"), F.lit(name).alias("name"), F.lit(version).alias("version"), F.array_sort(F.collect_list("a")).alias("artifacts"))
    return each.groupBy("dataset").agg(F.to_json(body).alias("document"))


def file_artifacts(files: DataFrame) -> DataFrame:
    """``dataset, url, local_path, sha256, bytes`` of rows ``dataset, url, local_path, path``; files are hashed as streams."""
    return files.join(hash_files(files), "path").where(F.col("sha256").isNotNull()).select("dataset", "url", "local_path", "sha256", "bytes")


def write_manifest(files: DataFrame, name: str, version: str, path: str, mode: str = "append") -> None:
    """``<dataset>/manifest.json`` below a folder, as read_manifests() reads them.

    files has ``dataset, url, local_path`` and either ``content``, or ``path``: the file, which may be of any size.
    """
    docs = manifest_documents(files, name, version) if "content" in files.columns else digest_documents(file_artifacts(files), name, version)
    write_documents(docs.select(F.concat(part("dataset"), F.lit("/manifest.json")).alias("path"), F.col("document").alias("value")), path, mode)


def write_model(spark, model: Model, path: str) -> None:  # noqa: ANN001
    """A model as one JSON row that read_model() reads; version and type are fixed values."""
    row = (1, "logistic_regression", list(model.feature_names), list(model.coef), model.intercept, model.threshold, model.top_k)
    schema = "schema_version int, model_type string, feature_names array<string>, coef array<double>, intercept double, threshold double, top_k int"
    spark.createDataFrame([row], schema).coalesce(1).write.json(path)
