"""Graph tables in one form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbench.functions.text import stripped
from flowbench.operators.keys import KEY
from flowbench.sources.readers import parse_edges, parse_nodes


def normalize_nodes(graphs: DataFrame, value: str = "value") -> DataFrame:
    """Nodes of documents with string ids and boxes of four numbers."""
    return parse_nodes(graphs, KEY, value)


def normalize_edges(graphs: DataFrame, value: str = "value", drop: bool = False) -> DataFrame:
    """Edges of documents in any dialect with ``problem`` where an end is missing; such edges go with drop=True."""
    rows = parse_edges(graphs, KEY, value).withColumn("problem", F.when(F.col("source").isNull() | F.col("target").isNull(), "no_endpoints"))
    return rows.where("problem IS NULL").drop("problem") if drop else rows


def infer_graph_shape(graphs: DataFrame, value: str = "value") -> DataFrame:
    """Numbers of nodes and edges of documents in any layout; 0 where there are none."""
    n = parse_nodes(graphs, KEY, value).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_nodes"))
    e = parse_edges(graphs, KEY, value).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_edges"))
    rows = graphs.select(*KEY).join(n, KEY, "left").join(e, KEY, "left")
    return rows.select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_nodes", "n_edges")])


def node_display_label(nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``label`` of each node: its own, else that of the table, else its id, else ``node``; ``shown`` with the id below it."""
    own = F.nullif(stripped(F.col("label")), F.lit(""))
    rows = nodes.select(*KEY, "node_id", own.alias("own"))
    if labels is not None:
        rows = rows.join(labels.select(*KEY, F.col("node_id").cast("string").alias("node_id"), F.nullif(stripped(F.col("label")), F.lit("")).alias("given")), [*KEY, "node_id"], "left")
    else:
        rows = rows.withColumn("given", F.lit(None).cast("string"))
    label = F.coalesce("own", "given", F.nullif("node_id", F.lit("")), F.lit("node"))
    shown = F.when(label == F.col("node_id"), label).otherwise(F.concat(label, F.lit("\n["), F.col("node_id"), F.lit("]")))
    return rows.select(*KEY, "node_id", label.alias("label"), F.coalesce(shown, label).alias("shown"))
