"""Samples of datasets: pairing files, splits, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.operators.keys import KEY


def resolve_samples(images: DataFrame, graphs: DataFrame, splits: DataFrame) -> DataFrame:
    """``dataset, sample_id, image_path, graph_path, split`` of images with a graph; the last split counts, without one ``all``.

    images and graphs have ``dataset, sample_id, path``; splits ``dataset, sample_id, split, split_ord``.
    """
    last = splits.groupBy(*KEY).agg(F.max_by("split", "split_ord").alias("split"))
    rows = images.select(*KEY, F.col("path").alias("image_path")).join(graphs.select(*KEY, F.col("path").alias("graph_path")), KEY)
    return rows.join(last, KEY, "left").withColumn("split", F.coalesce("split", F.lit("all")))


def listed_samples(rows: DataFrame) -> DataFrame:
    """Samples of an explicit list: all in split ``all``, the graph by default at graphs/<id>.json; without id or image none."""
    path = F.coalesce("graph_path", F.concat(F.lit("graphs/"), F.col("sample_id"), F.lit(".json")))
    return rows.where("sample_id IS NOT NULL AND image_path IS NOT NULL").select(*KEY, "image_path", path.alias("graph_path"), F.lit("all").alias("split"))


def validate_pairs(images: DataFrame, graphs: DataFrame) -> DataFrame:
    """``dataset, sample_id, code`` of images without a graph and graphs without an image."""
    i = images.select(*KEY).distinct().withColumn("i", F.lit(1))
    g = graphs.select(*KEY).distinct().withColumn("g", F.lit(1))
    return i.join(g, KEY, "full_outer").where("i IS NULL OR g IS NULL").select(*KEY, F.when(F.col("g").isNull(), "missing_graph").otherwise("missing_image").alias("code"))


def validate_splits(splits: DataFrame, samples: DataFrame) -> DataFrame:
    """``dataset, sample_id, code`` of split ids that no sample has, and of ids in more than one split."""
    unknown = splits.join(samples.select(*KEY).distinct(), KEY, "left_anti").select(*KEY).distinct().withColumn("code", F.lit("unknown_sample"))
    twice = splits.groupBy(*KEY).agg(F.count_distinct("split").alias("n")).where("n > 1").select(*KEY, F.lit("several_splits").alias("code"))
    return unknown.unionByName(twice)


def select_split(samples: DataFrame, split: str | None = None, limit: int | None = None) -> DataFrame:
    """Samples of a split, each dataset's first ``limit`` by id. By default test where it is declared, else all, else the first by name."""
    own = W.partitionBy("dataset")
    rows = samples.withColumn("_test", F.max(F.col("split") == "test").over(own)).withColumn("_all", F.max(F.col("split") == "all").over(own)).withColumn("_first", F.min("split").over(own))
    default = F.when(F.col("_test"), "test").when(F.col("_all"), "all").otherwise(F.col("_first"))
    rows = rows.where(F.col("split") == (default if split is None else F.lit(split))).select(*samples.columns)
    if limit is None:
        return rows
    return rows.withColumn("_place", F.row_number().over(own.orderBy("sample_id"))).where(F.col("_place") <= limit).drop("_place")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node of their graph."""
    ids = nodes.select(*KEY, "node_id").distinct()
    start = edges.join(ids.withColumnRenamed("node_id", "source"), [*KEY, "source"], "left_anti")
    end = edges.join(ids.withColumnRenamed("node_id", "target"), [*KEY, "target"], "left_anti")
    columns = [*KEY, "source", "target"]
    return start.select(columns).unionByName(end.select(columns)).distinct()


def raw_only_guard(files: DataFrame) -> DataFrame:
    """``dataset`` of those with a raw folder and no dataset.json; files has ``dataset, path`` relative to it."""
    raw, meta = F.bool_or(F.col("path").startswith("raw/")), F.bool_or(F.col("path") == "dataset.json")
    return files.groupBy("dataset").agg(raw.alias("raw"), meta.alias("meta")).where("raw AND NOT meta").select("dataset")


def images_dir_rule(samples: DataFrame, files: DataFrame) -> DataFrame:
    """``dataset`` of those whose image paths all lie below images/ though there is no such folder."""
    inside = F.regexp_replace("image_path", r"^(\./)+", "").rlike("^images(/|$)")
    need = samples.groupBy("dataset").agg(F.bool_and(inside).alias("inside")).where("inside")
    return need.join(files.where(F.col("path").startswith("images/")).select("dataset").distinct(), "dataset", "left_anti").select("dataset")
