"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(scale * x). Queries and candidates are dealt as tiles, a block of candidates against a
block of queries, so that no task holds more than two blocks however many queries there are. Every round scores all
tiles and refines one global histogram of scores per query: the bin that holds the k-th value is cut into finer bins
until it is one score wide. A last pass keeps what scores above that value and the smallest ids among its ties.

A tile counts only bins from the one of its own k-th value up: lower ones can't hold the global k-th value. Counts meet
as sums per query and bin, combined before the shuffle.

Edge cases: vectors that are null, empty of an id, or that hold null or non-finite components take no part; shorter
vectors count as padded with zeros; rows with the query's own id are not its candidates; of rows that repeat a query's
id the smallest vector asks; other repeated rows are candidates each; with fewer than k candidates all are returned;
an empty table gives an empty result. Scores are exact (floating point below 2**53, 64-bit integers above); vectors so
large that an inner product could pass 2**61 are refused with an ArithmeticError before anything is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.llm.common import saved

#: Bins per round.
BINS = 1024


def quantised(vectors: DataFrame, scale: int = 64, *more: str) -> DataFrame:
    """(vec_id, v array<long>, columns ``more``) of the vectors that take part."""
    x = F.col("embedding")
    fit = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = float(1 << 62)  # beyond it ``top_k`` refuses anyway
    whole = lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * scale)))
    return vectors.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"), *more)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) of a column of lists, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == dim).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def _scored(queries: pa.Table, candidates: pa.Table, rows: int = 256) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(queries, scores, whether the candidate isn't the query itself) of a tile, some queries at a time."""
    dim = max((int(np.diff(np.asarray(t["v"].combine_chunks().offsets)).max(initial=0)) for t in (queries, candidates)), default=0)
    q, c = matrix(queries["v"], dim), matrix(candidates["v"], dim)
    ids, own = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    exact = dim * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**53
    if exact:
        q, c = q.astype(np.float64), c.astype(np.float64)
    for i in range(0, len(q), rows):
        part = slice(i, min(i + rows, len(q)))
        yield part, (q[part] @ c.T).astype(np.int64), ids[None, :] != own[part, None]


def _histogram(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(candidates):
            own, low, high, width = (queries[c].to_numpy() for c in ("vec_id", "low", "high", "width"))
            for part, scores, other in _scored(queries, candidates):
                for i, (row, use) in enumerate(zip(scores, other, strict=True), part.start):
                    bins = (row[use & (row >= low[i]) & (row < high[i])] - low[i]) // width[i]
                    if len(bins) > k:
                        bins = bins[bins >= np.partition(bins, len(bins) - k)[len(bins) - k]]
                    found, n = np.unique(bins, return_counts=True)
                    out.append((np.full(len(found), own[i]), found, n))
        cat = lambda j: np.concatenate([x[j] for x in out]) if out else np.empty(0, np.int64)
        return pa.table({"query_id": pa.array(cat(0), pa.int64()), "bin": pa.array(cat(1), pa.int64()), "n": pa.array(cat(2), pa.int64())})

    return run


def _selected(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(candidates):
            own, kth, ids = queries["vec_id"].to_numpy(), queries["low"].to_numpy(), candidates["vec_id"].to_numpy()
            for part, scores, other in _scored(queries, candidates):
                for i, (row, use) in enumerate(zip(scores, other, strict=True), part.start):
                    above = np.nonzero(use & (row > kth[i]))[0]
                    ties = np.nonzero(use & (row == kth[i]))[0]
                    ties = ties[np.argsort(ids[ties], kind="stable")[:k]]
                    at = np.concatenate([above, ties])
                    out.append((np.full(len(at), own[i]), ids[at], row[at]))
        cat = lambda j: np.concatenate([x[j] for x in out]) if out else np.empty(0, np.int64)
        return pa.table({"query_id": pa.array(cat(0), pa.int64()), "vec_id": pa.array(cat(1), pa.int64()), "score": pa.array(cat(2), pa.int64())})

    return run


def _tiles(queries: DataFrame, candidates: DataFrame, n_query_blocks: int, n_blocks: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on each tile: every block of candidates meets every block of queries once."""
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qb", dealt("vec_id", n_query_blocks)).withColumn("cb", spread(n_blocks))
    c = candidates.withColumn("cb", dealt("row", n_blocks)).withColumn("qb", spread(n_query_blocks))
    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(work, schema)


def _kth_bin(counts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries with the bin of their k-th value as new bounds; where there are fewer than k scores left, the lowest."""
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    summed = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    running = summed.withColumn("through", F.sum("n").over(down)).join(queries.select(F.col("vec_id").alias("query_id"), "need"), "query_id")
    found = running.where(F.col("through") >= F.col("need")).groupBy("query_id").agg(F.max_by(F.struct("bin", (F.col("through") - F.col("n")).alias("above")), "bin").alias("at"))
    joined = queries.join(found.select(F.col("query_id").alias("vec_id"), "at"), "vec_id", "left")
    fine = F.greatest(F.lit(1), F.ceil(F.col("width") / BINS)).cast("long")
    low = F.col("low") + F.coalesce(F.col("at.bin"), F.lit(0)) * F.col("width")
    return joined.select(
        "vec_id", "v",
        low.alias("low"),
        (low + F.col("width")).alias("high"),
        F.when(F.col("at").isNull(), 1).otherwise(fine).cast("long").alias("width"),
        F.when(F.col("at").isNull(), F.col("need")).otherwise(F.col("need") - F.col("at.above")).alias("need"),
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest integer inner products, ties to smaller ids."""
    # dealt by row, as many rows may share an id
    candidates = saved(quantised(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "candidates")
    size = candidates.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    reach = int(size[1] or 0) * int(size[2] or 0) ** 2 + 1
    if reach > 1 << 61:
        raise ArithmeticError(f"vectors of up to {size[1]} components as large as {size[2]}: their inner products do not fit 64-bit integers")
    width = -(-2 * reach // BINS)
    start = candidates.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = saved(start.select("vec_id", "v", F.lit(-reach).cast("long").alias("low"), F.lit(reach).cast("long").alias("high"), F.lit(width).cast("long").alias("width"), F.lit(k).cast("long").alias("need")), "queries")
    n_blocks, n_query_blocks = max(1, -(-size[0] // block_rows)), max(1, -(-queries.count() // block_rows))
    while True:
        counts = _tiles(queries, candidates, n_query_blocks, n_blocks, _histogram(k), "query_id long, bin long, n long")
        queries = saved(_kth_bin(counts, queries, k), "queries")
        if width == 1:
            break
        width = -(-width // BINS)
    found = _tiles(queries, candidates, n_query_blocks, n_blocks, _selected(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
