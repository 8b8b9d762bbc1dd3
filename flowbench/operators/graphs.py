"""Order, layers, program text and labels of graphs."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.functions.text import to_identifier
from flowbench.operators.keys import KEY

TOPO_SCHEMA = "dataset string, sample_id string, node_id long, ord int, is_dag boolean, layer int, x double, y double"


def topo_graph(nodes: list[int], edges: list[tuple[int, int]]) -> list[tuple]:
    """Rows of one graph: always the smallest id that is ready; all ids by size where there is a cycle."""
    ids = sorted({*nodes, *(i for e in edges for i in e)})
    after, waits, layer = defaultdict(set), dict.fromkeys(ids, 0), dict.fromkeys(ids, 0)
    for a, b in edges:
        if b not in after[a]:
            after[a].add(b)
            waits[b] += 1
    ready, order = [i for i in ids if not waits[i]], []
    heapq.heapify(ready)
    while ready:
        i = heapq.heappop(ready)
        order.append(i)
        for j in sorted(after[i]):
            layer[j] = max(layer[j], layer[i] + 1)
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, j)
    if len(order) < len(ids):
        return [(i, k, False, None, None, None) for k, i in enumerate(ids)]
    wide: dict[int, int] = defaultdict(int)
    spots = {}
    for i in ids:
        spots[i] = wide[layer[i]]
        wide[layer[i]] += 1
    return [(i, k, True, layer[i], spots[i] - (wide[layer[i]] - 1) / 2, -float(layer[i])) for k, i in enumerate(order)]


def topo(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Order, layer and place of every node. A graph is one row of lists: graphs are small, and their number is what grows.

    Ids must be integers. Ends that are no nodes are ordered too. A cyclic graph has its ids in order, and no layers.
    """
    whole = lambda c: F.col(c).cast("long").alias(c)
    n = nodes.select(*KEY, whole("node_id")).groupBy(*KEY).agg(F.collect_list("node_id").alias("n"))
    e = edges.select(*KEY, F.struct(whole("source"), whole("target")).alias("e")).groupBy(*KEY).agg(F.collect_list("e").alias("e"))
    none = F.array().cast("array<bigint>")
    ends = lambda k: F.coalesce(F.transform("e", lambda x: x[k]), none).alias(k)
    rows = n.join(e, KEY, "full_outer").select(*KEY, F.coalesce("n", none).alias("n"), ends("source"), ends("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dataset", pa.string()), ("sample_id", pa.string()), ("node_id", pa.int64()), ("ord", pa.int32()), ("is_dag", pa.bool_()), ("layer", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])
        for b in batches:
            out = [(d, s, *r) for d, s, ids, u, v in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in topo_graph(ids, list(zip(u, v, strict=True)))]
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, TOPO_SCHEMA)


def topo_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return topo(nodes, edges).select(*KEY, "node_id", "ord", "is_dag")


def topo_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Layer (longest path from a source) and place of the nodes of acyclic graphs."""
    return topo(nodes, edges).where("is_dag").select(*KEY, "node_id", "layer", "x", "y")


def program_text(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """A runnable program a graph: a function for each node in order, and a main that calls them."""
    ordered = topo_order(nodes, edges).join(labels.select(*KEY, F.col("node_id").cast("long").alias("node_id"), "label"), [*KEY, "node_id"], "left")
    plain = F.concat(F.lit("node_"), F.col("node_id").cast("string"))
    ordered = ordered.select(*KEY, "ord", to_identifier(F.coalesce("label", plain), plain).alias("name"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"])
    rows = ordered.groupBy(*KEY).agg(names.alias("names"))
    head = '"""A program made from a diagram."""\n\n# Every step gets the dict ctx, which all of them share.\n\n'
    steps = F.array_join(F.transform("names", lambda n: F.concat(F.lit("def "), n, F.lit("(ctx):\n    print('"), n, F.lit("')\n\n\n"))), "")
    calls = F.array_join(F.transform("names", lambda n: F.concat(F.lit("    "), n, F.lit("(ctx)\n"))), "")
    main = F.concat(F.lit("def main():\n    ctx = {}\n"), calls, F.lit("\n\nif __name__ == '__main__':\n    main()\n"))
    return rows.select(*KEY, F.concat(F.lit(head), steps, main).alias("program"))


def resolve_labels(sources: dict[str, DataFrame]) -> DataFrame:
    """Labels of each graph's first source, in the given order, with ``source``: a source counts whole, however few nodes it names.

    A row with a null node_id says that the source is there though it names none.
    """
    parts = [df.select(*KEY, "node_id", "label", F.lit(name).alias("source"), F.lit(k).alias("_rank")) for k, (name, df) in enumerate(sources.items())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = F.min("_rank").over(W.partitionBy(*KEY))
    return rows.withColumn("_first", first).where("_rank = _first AND node_id IS NOT NULL").drop("_rank", "_first")


def labels_template(nodes: DataFrame) -> DataFrame:
    """A JSON object a graph with an empty label for every node."""
    entries = F.transform(F.array_sort(F.collect_set(F.col("node_id").cast("int"))), lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('":""')))
    return nodes.groupBy(*KEY).agg(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("template"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers of nodes and edges, and the edges as text, by id."""
    n = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_nodes"))
    arrows = F.transform(F.array_sort(F.collect_list(F.struct("source", "target"))), lambda e: F.concat_ws("->", e["source"], e["target"]))
    e = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(arrows, ",").alias("edge_list"))
    return n.join(e, KEY, "full_outer").select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_nodes", "n_edges")], F.coalesce("edge_list", F.lit("")).alias("edge_list"))


def graph_extent(nodes: DataFrame, padding: float = 30.0) -> DataFrame:
    """The box around all boxes of a graph, with padding."""
    return nodes.groupBy(*KEY).agg(
        (F.min("x") - padding).alias("left"), (F.min("y") - padding).alias("top"),
        (F.max(F.col("x") + F.col("w")) + padding).alias("right"), (F.max(F.col("y") + F.col("h")) + padding).alias("bottom"),
    )


def reading_order(nodes: DataFrame) -> DataFrame:
    """Place of each node from the top to the bottom by its centre, then from the left; ties as listed."""
    order = W.partitionBy(*KEY).orderBy(F.col("y") + F.col("h") / 2, F.col("x") + F.col("w") / 2, "pos")
    return nodes.withColumn("place", F.row_number().over(order) - 1)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """The first of each edge."""
    return edges.groupBy(*KEY, "source", "target").agg(F.min("pos").alias("pos"))
