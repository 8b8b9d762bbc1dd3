"""Diagram parts from a table of contours: boxes, arrows and the edges they draw."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowbench.operators.boxes import nearest_boxes, suppressed
from flowbench.operators.keys import KEY


def filter_rect_contours(contours: DataFrame) -> DataFrame:
    """Contours that may be boxes: large enough, of four corners and not too long."""
    aspect = F.col("w") / F.col("h")
    return contours.where((F.col("area") >= 800) & (F.col("n_vertices") == 4) & (F.col("w") >= 20) & (F.col("h") >= 20) & aspect.between(0.4, 2.5))


def filter_arrow_contours(contours: DataFrame) -> DataFrame:
    return contours.where(F.col("area").between(80, 20000) & (F.col("n_points") >= 10))


def iou(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(zero, F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - wide * high
    return F.when(union > 0, wide * high / union).otherwise(0.0)


#: Boxes beyond which a sample goes to a helper with an index.
LARGE = 500


def dedupe_bboxes(boxes: DataFrame, most: float = 0.7, large: int = LARGE) -> DataFrame:
    """Boxes without those that overlap a larger kept one by ``most``: the largest first, of equal ones as listed.

    A fold over a sample's boxes; one of more than ``large`` goes to a helper that looks at nearby kept boxes alone.
    """
    item = F.struct(*[(-F.col("w") * F.col("h")).cast("double").alias("order"), F.col("pos").cast("int").alias("pos"), *[F.col(c).cast("double").alias(c) for c in "xywh"]])
    rows = boxes.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("c"))
    kind = "array<struct<order:double,pos:int,x:double,y:double,w:double,h:double>>"
    small = F.col("c") if most <= 0 else F.when(F.size("c") <= large, F.col("c")).otherwise(F.array().cast(kind))
    # the size is asked inside the fold: a filter before it may be planned behind it
    kept = rows.select(*KEY, F.aggregate(small, F.array().cast(kind), lambda acc, b: F.when(F.forall(acc, lambda k: iou(k, b) < most), F.concat(acc, F.array(b))).otherwise(acc)).alias("c"))
    if most > 0:
        def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = []
                for row in batch.column("c"):
                    sides = np.column_stack([row.values.field(c).to_numpy(zero_copy_only=False) for c in "xywh"])
                    lists.append(row.values.filter(pa.array(suppressed(sides, most))))
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(lists) if lists else batch.column("c").values)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=batch.schema.names)

        kept = kept.unionByName(rows.where(F.size("c") > large).mapInArrow(indexed, f"dataset string, sample_id string, c {kind}"))
    return kept.select(*KEY, F.explode("c").alias("b")).select(*KEY, "b.pos", "b.x", "b.y", "b.w", "b.h")


def assign_node_ids(boxes: DataFrame) -> DataFrame:
    """Ids from 0 from the left to the right, then down."""
    return boxes.withColumn("node_id", F.row_number().over(W.partitionBy(*KEY).orderBy("x", "y", "pos")) - 1)


def nearest_node(points: DataFrame, nodes: DataFrame, large: int = LARGE) -> DataFrame:
    """The node whose box is nearest to each point (columns px, py); of equal ones the smallest id.

    Points meet all nodes of their sample; where those are more than ``large``, a tree of boxes finds the nearest instead.
    """
    sized = nodes.select(*KEY, "node_id", "x", "y", "w", "h", F.count(F.lit(1)).over(W.partitionBy(*KEY)).alias("_n"))
    few, many = (sized.where(c).drop("_n") for c in (F.col("_n") <= large, F.col("_n") > large))
    zero = F.lit(0)
    dx = F.greatest(F.col("x") - F.col("px"), zero, F.col("px") - F.col("x") - F.col("w"))
    dy = F.greatest(F.col("y") - F.col("py"), zero, F.col("py") - F.col("y") - F.col("h"))
    plain = points.join(few, KEY).groupBy(*points.columns).agg(F.min_by("node_id", F.struct((dx * dx + dy * dy).alias("d2"), "node_id")).alias("node_id"))

    def near(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        order = np.empty(len(found), np.int64)
        order[np.argsort(found["node_id"].to_numpy(), kind="stable")] = np.arange(len(found))
        at, where = np.full(len(own), order.argmin() if len(order) else 0), own[["px", "py"]].to_numpy(float)
        known = ~np.isnan(where).any(axis=1)
        at[known] = nearest_boxes(where[known], found[["x", "y", "w", "h"]].to_numpy(float), order)
        return own.assign(node_id=found["node_id"].to_numpy()[at])

    far = points.distinct().join(many.select(*KEY).distinct(), KEY, "left_semi").select(*points.columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in (*points.dtypes, ("node_id", dict(nodes.dtypes)["node_id"])))
    return plain.unionByName(far.groupBy(*KEY).cogroup(many.groupBy(*KEY)).applyInPandas(near, schema))


def edges_from_endpoints(arrows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes nearest to each arrow's tail and head; none from a node to itself."""
    end = lambda p, name: nearest_node(arrows.select(*KEY, "contour_pos", F.col(f"{p}_x").alias("px"), F.col(f"{p}_y").alias("py")), nodes).select(*KEY, "contour_pos", F.col("node_id").alias(name))
    return end("tail", "source").join(end("head", "target"), [*KEY, "contour_pos"]).where(F.col("source") != F.col("target")).select(*KEY, "source", "target").distinct()
