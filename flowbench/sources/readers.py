"""Readers of documents in files, and the parsing of documents in a table.

``documents(spark, path, glob)`` reads whole files as rows ``path, value``; the parse functions take such rows, so that
they run over files, tables and streams alike. Types are checked on the raw JSON before values are cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.functions.text import file_name, file_stem
from flowbench.operators.predictors import Model
from flowbench.sources.arrays import read_array_records

#: Fixed suffixes of image files.
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "gif", "webp", "tif", "tiff")


def documents(spark: SparkSession, paths: str | list[str], glob: str = "*.json") -> DataFrame:
    """Whole files as rows ``path, value``, each path once; paths as the files are called, not as addresses escape them."""
    rows = spark.read.text(paths, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return rows.select(unescaped(F.col("_metadata.file_path")).alias("path"), "value").dropDuplicates(["path"])


def unescaped(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def json(value: Column) -> Column:
    """Parsed JSON, null where it is none."""
    return F.try_parse_json(value)


def kind(v: Column, path: str = "$") -> Column:
    """Type of a JSON value: OBJECT, ARRAY, STRING, BIGINT, ...; null where it is missing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def items(value: Column, path: str) -> Column:
    """The list at a path as array<variant>; null where there is none."""
    return F.try_variant_get(json(value), path, "array<variant>")


def number(v: Column, path: str) -> Column:
    """A number, also one in quotes."""
    return F.try_variant_get(v, path, "string").try_cast("double")


def parse_nodes(graphs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys, pos, node_id, x, y, w, h, label`` of graph documents in any dialect; a box that isn't four numbers is zeros."""
    v = json(F.col(value))
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$.nodes", "$.graph.nodes")]
    rows = graphs.select(*keys, F.posexplode(F.coalesce(*lists)).alias("pos", "n"))
    box = F.try_variant_get("n", "$.bbox", "array<variant>")
    four = F.size(box) == 4
    side = lambda k: F.when(four, F.coalesce(number(F.col("n"), f"$.bbox[{k}]"), F.lit(0.0))).otherwise(0.0)
    return rows.select(
        *keys, "pos", F.try_variant_get("n", "$.id", "string").alias("node_id"), *[side(k).alias(c) for k, c in enumerate("xywh")],
        F.try_variant_get("n", "$.label", "string").alias("label"),
    )


def parse_edges(graphs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``keys, pos, source, target, direction`` of graph documents; the ends by any pair of names, null where there are none."""
    v = json(F.col(value))
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$.edges", "$.arrows", "$.graph.edges", "$.graph.arrows")]
    rows = graphs.select(*keys, F.posexplode(F.coalesce(*lists)).alias("pos", "e"))
    text = lambda name: F.try_variant_get("e", f"$.{name}", "string")
    pairs = [(text(a), text(b)) for a, b in (("from", "to"), ("source", "target"), ("src", "dst"), ("u", "v"))]
    pick = lambda k: F.coalesce(*[F.when(p[0].isNotNull() & p[1].isNotNull(), p[k]) for p in pairs])
    return rows.select(*keys, "pos", pick(0).alias("source"), pick(1).alias("target"), text("direction").alias("direction"))


def read_graphs(spark: SparkSession, path: str, dataset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph files below a path; the sample is the file's stem.

    Without a name, the dataset is the folder that a file's folder is in (``<dataset>/graphs/<sample_id>.json``), and only
    files in folders called graphs count.
    """
    rows = documents(spark, path)
    own = F.lit(dataset) if dataset is not None else F.element_at(F.split("path", "/"), -3)
    rows = rows if dataset is not None else rows.where(F.element_at(F.split("path", "/"), -2) == "graphs")
    rows = rows.select(own.alias("dataset"), file_stem(F.col("path")).alias("sample_id"), "value")
    keys = ["dataset", "sample_id"]
    return parse_nodes(rows, keys), parse_edges(rows, keys)


def parse_dataset_meta(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, schema_version, name, version`` and ``extra`` (other entries as JSON by name)."""
    v = json(F.col("value"))
    known = ("schema_version", "name", "version", "splits")
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*known))
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string").alias(n)
    return rows.select(*keys, text("schema_version"), text("name"), text("version"), F.transform_values(rest, lambda _, x: F.to_json(x)).alias("extra"))


def parse_splits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, split, split_ord, ord, sample_id`` of the declared splits, in the order of the document; splits that are no lists go."""
    lists = F.map_entries(F.from_json(F.get_json_object("value", "$.splits"), "map<string,string>"))
    one = rows.select(*keys, F.posexplode(lists).alias("split_ord", "s")).select(*keys, "split_ord", F.col("s.key").alias("split"), F.col("s.value").alias("ids"))
    one = one.where(F.ltrim("ids").startswith("["))
    return one.select(*keys, "split", "split_ord", F.posexplode(F.from_json("ids", "array<string>")).alias("ord", "sample_id"))


def read_dataset_meta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and splits of dataset.json files; the dataset is the folder's name."""
    rows = documents(spark, path, "dataset.json").withColumn("dataset", F.element_at(F.split("path", "/"), -2))
    return parse_dataset_meta(rows, ["dataset"]), parse_splits(rows, ["dataset"])


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """``path, sample_id, suffix, length`` of files with these suffixes, in any case; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return listed(rows, suffixes)


def listed(rows: DataFrame, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """list_files() over rows ``path, length``."""
    suffix = F.lower(F.regexp_extract(file_name(F.col("path")), r".\.([^.]+)$", 1))
    return rows.select("path", file_stem(F.col("path")).alias("sample_id"), suffix.alias("suffix"), "length").where(F.col("suffix").isin(*suffixes))


def parse_records(rows: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """``keys, rec_pos, record`` (JSON text) of documents that are lists of records, or of the first ``limit``."""
    out = rows.select(*keys, F.posexplode(items(F.col("value"), "$")).alias("rec_pos", "r"))
    out = out if limit is None else out.where(F.col("rec_pos") < limit)
    return out.select(*keys, "rec_pos", F.to_json("r").alias("record"))


def read_split_records(spark: SparkSession, path: str, limit: int | None = None, glob: str = "*.json") -> DataFrame:
    """``path, rec_pos, record`` of list files of any size: many tasks read each; a record that is no JSON is null."""
    rows = read_array_records(spark, path, glob, limit)
    return rows.select(unescaped(F.col("path")).alias("path"), F.col("rec_pos").cast("int").alias("rec_pos"), F.to_json(json(F.col("record"))).alias("record"))


def parse_manifests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, name, version, url, sha256, bytes, local_path`` of manifests, a row an artifact."""
    v = json(F.col("value"))
    out = rows.select(*keys, *[F.try_variant_get(v, f"$.{n}", "string").alias(n) for n in ("name", "version")], F.explode(F.try_variant_get(v, "$.artifacts", "array<variant>")).alias("a"))
    text = lambda n: F.try_variant_get("a", f"$.{n}", "string").alias(n)
    return out.select(*keys, "name", "version", text("url"), text("sha256"), F.try_variant_get("a", "$.bytes", "bigint").alias("bytes"), text("local_path"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifests(documents(spark, path, "manifest.json"), ["path"])


def parse_labels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node_id, label`` of label objects; a byte order mark is passed over, keys that are no integers go."""
    entries = F.from_json(F.ltrim(F.col("value"), F.lit("\ufeff")), "map<string,string>")
    out = rows.select(*keys, F.explode(entries).alias("k", "label"))
    return out.select(*keys, F.trim("k").try_cast("int").alias("node_id"), "label").where("node_id IS NOT NULL")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return parse_labels(documents(spark, path), ["path"])


def read_model(spark: SparkSession, path: str) -> Model:
    """A model file, one row, checked: version and type are required; threshold 0.5 and top_k 2 unless given."""
    schema = "schema_version int, model_type string, feature_names array<string>, coef array<double>, intercept double, threshold double, top_k int"
    row = spark.read.schema(schema).json(path, multiLine=True).first()
    if row is None or row.coef is None or row.feature_names is None:
        raise ValueError("the model needs coef and feature_names")
    if row.schema_version is None or row.model_type is None:
        raise ValueError("the model needs schema_version and model_type")
    threshold, top_k = (0.5 if row.threshold is None else row.threshold), (2 if row.top_k is None else row.top_k)
    return Model(tuple(row.coef), row.intercept or 0.0, threshold, top_k, tuple(row.feature_names))


#: Fixed keys of a result document and the version that ranks.
RESULT_KEYS = ("schema_version", "dataset", "split", "predictor", "num_samples", "metrics", "run")
RESULT_VERSION = "1.1"


def parse_results(rows: DataFrame) -> DataFrame:
    """``path, schema_version, dataset, split, predictor, num_samples, metrics, run, problem`` of result documents.

    ``problem`` says why a document does not rank (null: it does): no JSON object, keys missing or unknown, or
    another version.
    """
    v = json(F.col("value"))
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    required = F.array(*map(F.lit, RESULT_KEYS[:-1]))
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string").alias(n)
    problem = (
        F.when(keys.isNull(), "no object").when(F.size(F.array_except(required, keys)) > 0, "missing keys")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, RESULT_KEYS)))) > 0, "unknown keys")
        .when(text("schema_version") != RESULT_VERSION, "schema version")
    )
    return rows.select(
        "path", *map(text, RESULT_KEYS[:4]), F.try_variant_get(v, "$.num_samples", "int").alias("num_samples"),
        F.try_variant_get(v, "$.metrics", "map<string,double>").alias("metrics"), F.try_variant_get(v, "$.run", "map<string,string>").alias("run"), problem.alias("problem"),
    )


def read_results(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Results that rank, and the files that don't with the reason; an error if none ranks."""
    rows = parse_results(documents(spark, paths))
    valid, skipped = rows.where("problem IS NULL").drop("problem"), rows.where("problem IS NOT NULL").select("path", "problem")
    if valid.isEmpty():
        raise ValueError("no valid result file")
    return valid, skipped
