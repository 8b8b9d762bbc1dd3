"""Conversion of raw flowchart records into graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbench.functions.geometry import xyxy_to_xywh
from flowbench.functions.text import file_stem, parse_mermaid_edges, stripped
from flowbench.sources.readers import json, kind

TEXT = "map<string,struct<x0:string,y0:string,x1:string,y1:string,mermaid_entity_i:string>>"
LINKS = "map<string,struct<start_text_i:string,end_text_i:string>>"
PAIRS = "array<struct<u:int,v:int>>"


def links_to_edges(links: Column, text: Column) -> Column:
    """Edges from links between text entries, for those whose both entries name an entity."""
    entity = lambda i: F.element_at(text, i)["mermaid_entity_i"].try_cast("int")
    pairs = F.transform(F.map_values(links), lambda k: F.struct(entity(k["start_text_i"]).alias("u"), entity(k["end_text_i"]).alias("v")))
    return F.filter(pairs, lambda p: p["u"].isNotNull() & p["v"].isNotNull())


def convert_records(records: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """``keys, sample_id, nodes, edges, problem`` of records with file, mermaid and meta; all expressions are narrow.

    Nodes come from meta.text, of several entries of an entity the last, by number; edges from the diagram source,
    or from meta.links where it gives none. ``problem`` is null for a sound record.
    """
    rows = records.select(
        *keys, F.from_json(record, f"file string, mermaid string, meta struct<text:{TEXT},links:{LINKS}>").alias("r")
    ).select(*keys, "r.file", "r.mermaid", "r.meta.text", "r.meta.links")
    entries = F.transform(F.map_entries("text"), lambda e, i: F.struct(e["value"]["mermaid_entity_i"].try_cast("int").alias("id"), i.alias("i"), e["value"].alias("v")))
    rows = rows.withColumn("entries", F.sort_array(F.filter(entries, lambda e: e["id"].isNotNull())))
    last = F.filter("entries", lambda e, k: ~F.coalesce(F.get("entries", k + 1)["id"] == e["id"], F.lit(False)))

    def node(e: Column) -> Column:
        box = xyxy_to_xywh(*[e["v"][c].try_cast("double") for c in ("x0", "y0", "x1", "y1")])
        return F.struct(e["id"].alias("id"), *[c.alias(n) for n, c in box.items()])

    none = F.array().cast(PAIRS)
    drawn = F.coalesce(parse_mermaid_edges(F.col("mermaid")).cast(PAIRS), none)
    linked = F.coalesce(links_to_edges(F.col("links"), F.col("text")).cast(PAIRS), none)
    rows = rows.select(*keys, "file", "mermaid", "text", F.array_sort(F.transform(last, node)).alias("nodes"), F.when(F.size(drawn) > 0, drawn).otherwise(linked).alias("edges"))
    ids = F.transform("nodes", lambda n: n["id"])
    problem = (
        F.when(F.coalesce(stripped(F.col("file")), F.lit("")) == "", "file_missing").when(F.col("text").isNull(), "text_missing").when(F.size("nodes") == 0, "no_nodes")
        .when(F.coalesce(stripped(F.col("mermaid")), F.lit("")) == "", "source_missing").when(F.size("edges") == 0, "no_edges")
        .when(F.exists("edges", lambda e: ~F.array_contains(ids, e["u"]) | ~F.array_contains(ids, e["v"])), "dangling_edge")
    )
    return rows.select(*keys, file_stem(F.col("file")).alias("sample_id"), "file", "nodes", "edges", problem.alias("problem"))


def convert_flowcharts(records: DataFrame, keys: list[str], images: DataFrame | None = None, strict: bool = False, split: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and skipped records; in strict mode the first bad record is an error. images has ``keys, file``.

    split keeps records of one ``split``, limit the first of each list of ``keys`` by ``rec_pos``.
    """
    if split is not None:
        records = records.where(F.col("split") == split)
    if limit is not None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("rec_pos"))
        records = records.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    # with a column that is not deterministic no filter moves below, where it would compute every record's graph again
    rows = convert_records(records, keys).withColumn("_part", F.spark_partition_id())
    if images is not None:
        there = images.select(*keys, "file").distinct().withColumn("_there", F.lit(True))
        rows = rows.join(there, [*keys, "file"], "left").withColumn("problem", F.coalesce("problem", F.when(F.col("_there").isNull(), "image_missing")))
    if strict and (bad := rows.where("problem IS NOT NULL").select("file", "problem").first()):
        raise ValueError(f"{bad.file}: {bad.problem}")
    good = rows.where("problem IS NULL AND _part >= 0")
    nodes = good.select(*keys, "sample_id", F.posexplode("nodes").alias("pos", "n")).select(*keys, "sample_id", "pos", F.col("n.id").cast("string").alias("node_id"), "n.x", "n.y", "n.w", "n.h")
    edges = good.select(*keys, "sample_id", F.posexplode("edges").alias("pos", "e")).select(*keys, "sample_id", "pos", F.col("e.u").cast("string").alias("source"), F.col("e.v").cast("string").alias("target"))
    return nodes, edges, rows.where("problem IS NOT NULL AND _part >= 0").select(*keys, "file", "problem")


def convert_minimal(records: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """``keys, sample_id, image, n_nodes, n_edges, problem`` of records with explicit id, image, nodes and edges, types checked."""
    v = json(F.col(record))
    lists = {n: F.try_variant_get(v, f"$.{n}", "array<variant>") for n in ("nodes", "edges")}
    is_text = lambda p: F.coalesce(kind(v, p) == "STRING", F.lit(False))
    box = lambda n: F.coalesce((F.size(F.try_variant_get(n, "$.bbox", "array<variant>")) == 4) & F.forall(F.try_variant_get(n, "$.bbox", "array<variant>"), lambda x: kind(x) == "BIGINT"), F.lit(False))
    ends = lambda e: F.coalesce((kind(e, "$.source") == "STRING") & (kind(e, "$.target") == "STRING"), F.lit(False))
    problem = (
        F.when(~is_text("$.id"), "id").when(~is_text("$.image"), "image").when(lists["nodes"].isNull(), "nodes").when(lists["edges"].isNull(), "edges")
        .when(~F.forall(lists["nodes"], lambda n: F.coalesce(kind(n, "$.id") == "STRING", F.lit(False)) & box(n)), "node").when(~F.forall(lists["edges"], ends), "edge")
    )
    text = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    return records.select(*keys, text("id").alias("sample_id"), text("image").alias("image"), *[F.coalesce(F.size(x), F.lit(0)).alias(f"n_{n}") for n, x in lists.items()], problem.alias("problem"))
