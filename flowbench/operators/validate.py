"""Checks of graph documents, metadata and manifests. Each returns a table of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.functions.text import stripped
from flowbench.operators.keys import KEY
from flowbench.sources.readers import json, kind


def found(rows: DataFrame, keys: list[str], codes: list[Column]) -> DataFrame:
    return rows.select(*keys, F.explode(F.array_compact(F.array(*codes))).alias("code"))


def validate_graphs(rows: DataFrame, keys: list[str] = KEY, value: str = "value") -> DataFrame:
    """``keys, code, item_pos``: what a strict graph document (string ids, source and target) violates; one pass over arrays."""
    v = json(F.col(value))
    is_object = kind(v) == "OBJECT"
    lists = {n: F.when(kind(v, f"$.{n}") == "ARRAY", F.try_variant_get(v, f"$.{n}", "array<variant>")) for n in ("nodes", "edges")}
    code = lambda name, pos: F.named_struct(F.lit("code"), F.lit(name), F.lit("pos"), pos)
    none = F.lit(-1)

    def bad(name: str, field: str) -> Column:
        spots = F.transform(lists[name], lambda n, i: F.when(F.coalesce((kind(n, f"$.{field}") == "STRING") & (stripped(F.try_variant_get(n, f"$.{field}", "string")) != ""), F.lit(False)), F.lit(None).cast("int")).otherwise(i))
        return F.transform(F.array_compact(spots), lambda i: code(f"{name}_{field}", i))

    whole = F.array_compact(F.array(
        F.when(v.isNull(), code("invalid_json", none)), F.when(~is_object, code("not_object", none)),
        F.when(is_object & lists["nodes"].isNull(), code("nodes_missing", none)), F.when(is_object & lists["edges"].isNull(), code("edges_missing", none)),
    ))
    empty = F.array().cast("array<struct<code:string,pos:int>>")
    parts = [whole, bad("nodes", "id"), bad("edges", "source"), bad("edges", "target")]
    every = F.concat(*[F.coalesce(p.cast("array<struct<code:string,pos:int>>"), empty) for p in parts])
    return rows.select(*keys, F.explode(every).alias("x")).select(*keys, "x.code", F.col("x.pos").alias("item_pos"))


def validate_graphs_strict(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``dataset, sample_id, code, item``: boxes without area, repeated ids, edges to unknown nodes, self-loops."""
    ids = nodes.groupBy(*KEY, "node_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("w") <= 0) | (F.col("h") <= 0)).alias("flat"))
    own = ids.select(*KEY, F.col("node_id").alias("item"), F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate_id"), F.when(F.col("flat") > 0, "empty_box")))).alias("code"))
    loops = edges.where(F.col("source") == F.col("target")).select(*KEY, F.col("source").alias("item"), F.lit("self_loop").alias("code"))
    ends = edges.select(*KEY, F.explode(F.array("source", "target")).alias("node_id")).distinct()
    unknown = ends.join(ids, [*KEY, "node_id"], "left_anti").select(*KEY, F.col("node_id").alias("item"), F.lit("unknown_node").alias("code"))
    return own.unionByName(loops.distinct()).unionByName(unknown)


def validate_graphs_typed(rows: DataFrame, keys: list[str] = KEY, value: str = "value") -> DataFrame:
    """``keys, code, item_pos``: what a document with whole-number ids, ends from and to, and boxes of four whole numbers violates.

    Types are those of the raw JSON: 1.0, "1" and true are no whole numbers. Each node and edge has its first fault; the
    document's own have position -1. Of nodes with one id all but the first are duplicates.
    """
    v = json(F.col(value))
    whole = lambda x, path: F.coalesce(kind(x, path) == "BIGINT", F.lit(False))
    there = lambda x, path: kind(x, path).isNotNull()
    is_list = {n: F.coalesce(kind(v, f"$.{n}") == "ARRAY", F.lit(False)) for n in ("nodes", "edges")}
    is_object = F.coalesce(kind(v) == "OBJECT", F.lit(False))
    own = rows.select(*keys, v.alias("_v"), is_object.alias("_object"), *[c.alias(f"_{n}") for n, c in is_list.items()])
    top = own.select(*keys, F.explode(F.array_compact(F.array(
        F.when(~F.col("_object"), "not_object"), *[F.when(F.col("_object") & ~F.col(f"_{n}"), f"{n}_missing") for n in ("nodes", "edges")],
    ))).alias("code"), F.lit(-1).alias("item_pos"))

    def items_of(name: str, fields: list[str]) -> DataFrame:
        found = own.where(f"_{name}").select(*keys, F.posexplode(F.try_variant_get("_v", f"$.{name}", "array<variant>")).alias("item_pos", "x"))
        return found.select("*", *[F.when(whole(F.col("x"), f"$.{f}"), F.try_variant_get("x", f"$.{f}", "bigint")).alias(f"_{f}") for f in fields])

    x, side = F.col("x"), lambda k: F.try_variant_get("x", f"$.bbox[{k}]", "bigint")
    box = F.try_variant_get("x", "$.bbox", "array<variant>")
    nodes = items_of("nodes", ["id"]).withColumn("_nth", F.when(F.col("_id").isNotNull(), F.row_number().over(W.partitionBy(*keys, "_id").orderBy("item_pos"))))
    node_code = (
        F.when(~F.coalesce(kind(x) == "OBJECT", F.lit(False)), "node_not_object").when(~there(x, "$.id"), "node_id_missing").when(~there(x, "$.bbox"), "node_bbox_missing")
        .when(F.col("_id").isNull(), "node_id_type").when(F.col("_nth") > 1, "duplicate_id").when(~F.coalesce((kind(x, "$.bbox") == "ARRAY") & (F.size(box) == 4), F.lit(False)), "node_bbox_shape")
        .when(~(whole(x, "$.bbox[0]") & whole(x, "$.bbox[1]") & whole(x, "$.bbox[2]") & whole(x, "$.bbox[3]")), "node_bbox_type").when((side(2) <= 0) | (side(3) <= 0), "node_bbox_size")
    )
    ids = nodes.where(F.col("_id").isNotNull()).select(*keys, F.col("_id").alias("_known")).distinct()
    edges = items_of("edges", ["from", "to"])
    for end in ("from", "to"):
        known = ids.withColumnRenamed("_known", f"_{end}").withColumn(f"_{end}_known", F.lit(True))
        edges = edges.join(known, [*keys, f"_{end}"], "left")
    edge_code = (
        F.when(~F.coalesce(kind(x) == "OBJECT", F.lit(False)), "edge_not_object").when(~there(x, "$.from") | ~there(x, "$.to"), "edge_end_missing")
        .when(F.col("_from").isNull() | F.col("_to").isNull(), "edge_end_type").when(F.col("_from_known").isNull() | F.col("_to_known").isNull(), "unknown_node").when(F.col("_from") == F.col("_to"), "self_loop")
    )
    each = lambda rows, code: rows.select(*keys, code.alias("code"), "item_pos").where(F.col("code").isNotNull())
    return top.unionByName(each(nodes, node_code)).unionByName(each(edges, edge_code))


def validate_bbox_bounds(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes whose box leaves the image."""
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height"))
    return nodes.join(sizes, KEY).where(out).select(*KEY, "node_id")


def validate_dataset_meta(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, code``: metadata that is no object, without a string schema_version 1.0, or with a name or version that is no string."""
    v = json(F.col("value"))
    version, given = F.try_variant_get(v, "$.schema_version", "string"), kind(v, "$.schema_version")
    other = lambda n: F.when(kind(v, f"$.{n}").isNotNull() & (kind(v, f"$.{n}") != "STRING"), f"{n}_type")
    is_object = F.coalesce(kind(v) == "OBJECT", F.lit(False))
    return found(rows, keys, [
        F.when(~is_object, "not_object"), F.when(is_object & given.isNull(), "schema_version_missing"), F.when(given.isNotNull() & (given != "STRING"), "schema_version_type"),
        F.when((given == "STRING") & (version != "1.0"), "schema_version_unsupported"), other("name"), other("version"),
    ])


def validate_manifest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, code``: manifests of another version, without required keys, or with artifacts that lack some."""
    v = json(F.col("value"))
    names = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))
    required = F.array(*map(F.lit, ("schema_version", "name", "version", "artifacts")))
    parts = F.try_variant_get(v, "$.artifacts", "array<map<string,variant>>")
    fields = F.array(*map(F.lit, ("url", "sha256", "bytes", "local_path")))
    return found(rows, keys, [
        F.when(F.size(F.array_except(required, names)) > 0, "missing_key"), F.when(F.coalesce(F.try_variant_get(v, "$.schema_version", "int") != 1, F.lit(False)), "schema_version"),
        F.when(F.array_contains(names, "artifacts") & parts.isNull(), "artifacts_type"), F.when(F.exists(parts, lambda a: F.size(F.array_except(fields, F.map_keys(a))) > 0), "artifact_key"),
    ])


def drop_invalid(samples: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples without violations, and the first 30 reports of the rest."""
    return samples.join(violations.select(*KEY).distinct(), KEY, "left_anti"), violations.orderBy(*KEY, "code").limit(30)


def raise_on_invalid(violations: DataFrame) -> None:
    """An error with up to 30 reports if anything is wrong."""
    first = violations.limit(30).collect()
    if first:
        raise ValueError("; ".join(str(r.asDict()) for r in first))


def has_graph_supervision(records: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, supervised``: whether any of a split's first 200 records has nodes, edges or diagram source; records: ``keys, rec_pos, record``."""
    v = json(F.col("record"))
    full = lambda n: F.coalesce(F.size(F.try_variant_get(v, f"$.{n}", "array<variant>")) > 0, F.lit(False))
    drawn = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", "string").rlike("graph TD|graph LR|flowchart"), F.lit(False))
    any_ = full("nodes") | full("edges") | drawn("mermaid") | drawn("mermaid_code") | drawn("flowchart_mermaid")
    return records.where("rec_pos < 200").groupBy(*keys).agg(F.bool_or(any_).alias("supervised"))


def check_sciflowchart(records: DataFrame, keys: list[str]) -> None:
    """Always an error: such records hold no graph, or one in a form that is not supported."""
    some = has_graph_supervision(records, keys).agg(F.bool_or("supervised")).first()[0]
    raise ValueError("graphs in this form are not supported" if some else "the records hold no graphs")
