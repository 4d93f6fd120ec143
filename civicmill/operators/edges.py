"""Edges seen from either end: joins on "from or to" become equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doubled(edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """Each edge once per end, as ``node`` and ``other`` beside its other columns; a loop counts once.

    An OR in a join condition is planned as a nested loop over all pairs; this frame joins on ``node`` instead. Edges are
    read once, both ends of a row at a time.
    """
    rest = [c for c in edges.columns if c not in (a, b)]
    end = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("other"))
    ends = F.when(F.col(a) != F.col(b), F.array(end(a, b), end(b, a))).otherwise(F.array(end(a, b)))
    return edges.select(*rest, F.inline(ends))


def degrees(edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """(node, degree) by distinct edge ids."""
    return doubled(edges, a, b).groupBy("node").agg(F.count("id").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """Edges with both ends among ``nodes`` (node)."""
    n = nodes.select("node")
    return edges.join(n, edges[a] == n["node"], "left_semi").join(n, F.col(b) == F.col("node"), "left_semi")
