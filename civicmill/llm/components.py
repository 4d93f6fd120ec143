"""Connected components of a link table, by alternating large-star and small-star contractions.

Each round is a grouped minimum and a join, written to the shared folder, so lineage stays one round long. A hub's
links are spread by the join's skew handling and its minimum is combined before the shuffle; no group of links is ever
collected. The rounds needed grow with the logarithm of the longest chain.

Before the first round, blocks of links are thinned to stars, which join the same nodes: a dense group sends about as
many links through the joins as it has nodes, not as it has pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import saved


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. ``links`` run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    joined = links.join(least, F.col("a") == F.col("k"))
    moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))


def _thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each node of a block to the smallest node that the block's links reach."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    out = pd.DataFrame({"a": np.array(nodes, np.int64), "b": np.array([root(x) for x in nodes], np.int64)})
    yield out[out["a"] != out["b"]]


def _settled(links: DataFrame) -> bool:
    """Whether each node has one link at most, to a node that has none: links are stars then. They run from larger to smaller."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(links: DataFrame, most_rounds: int = 60, block: int = 250_000) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node of its component.

    ``block``: about how many links a task thins at a time, and a file holds later on, since rounds never add links.
    ``links`` are read twice, so a dear frame comes as a table.
    """
    once = links.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    blocks = max(8, -(-once.count() // block))
    now = saved(once.repartition(blocks).mapInPandas(_thinned, "a long, b long"), "stars")
    for _ in range(most_rounds):
        if _settled(now):
            break
        now = saved(_small_star(_large_star(now).distinct()).distinct().coalesce(blocks), "links")
    else:
        raise RuntimeError("components have not settled")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
