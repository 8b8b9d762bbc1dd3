"""Documents in one order: keys sorted, lists of objects by their id."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed keys that order a list of objects, by precedence.
ORDER_KEYS = ("id", "node_id", "edge_id", "label", "src_id", "dst_id")


def place(item: dict) -> tuple:
    """Where an object stands among others: by the text of its own first order key, those without one last, by all they hold."""
    for key in ORDER_KEYS:
        if key in item:
            return 0, str(item[key]), []
    return 1, "", sorted((k, str(v)) for k, v in item.items())


def ordered(value: object) -> object:
    """The value with all its objects and lists of objects in order."""
    if isinstance(value, dict):
        return {k: ordered(value[k]) for k in sorted(value)}
    if not isinstance(value, list):
        return value
    items = sorted(value, key=place) if all(isinstance(v, dict) for v in value) else value
    return [ordered(v) for v in items]


def canonical_text(text: str | None) -> str | None:
    """JSON in one order and without spaces; null where a text is no JSON."""
    try:
        return None if text is None else json.dumps(ordered(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def canonical_json(value: Column) -> Column:
    """Free-form JSON in one order, by a vectorised helper."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(canonical_text)

    return run(value)


def canonical_graph(nodes: Column, edges: Column) -> Column:
    """A typed graph in one order, with column expressions alone."""
    return F.to_json(F.struct(F.array_sort(nodes).alias("nodes"), F.array_sort(edges).alias("edges")))
