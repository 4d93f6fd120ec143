"""Hard negatives: for each anchor and positive, the best rows of other labels whose score lies in a window below it.

Vectors become integers, floor(scale * x). Product quantisation cuts them into parts of ``PART`` components, each known
by the nearest of up to 256 centroids; with the codes every row stores the norm of what each part lacks. An anchor's
table of products with all centroids then gives any row's score up to a bound: by Cauchy-Schwarz the parts that the
codes lack add at most the sum of (norm of the anchor's part) x (stored norm). Bounds are rigorous, so filtering by them
loses nothing: a row is dropped only if its upper bound is under k lower bounds, or if its interval misses the window.
What is left is scored exactly, as integers, and completes each window. Centroids are fitted on the ``sample`` rows
whose ids have the smallest hashes; every row is encoded, and the result doesn't hang on the fit.

Anchors and rows are dealt as tiles, a block of rows against a block of anchors, so no task holds more than two blocks
whatever the labels are; a tile gives at most k rows a window, which then meet in a ranking. There are two passes over
the tiles: the first finds each anchor's positives, the second the negatives of the windows they open.

Edge cases: rows with a null id, label or vector or with null or non-finite components take no part; shorter vectors
count as padded with zeros; rows with the anchor's own id are neither its positives nor its negatives; of rows that
repeat an anchor's id the smallest by label and vector is the anchor; other repeated rows are rows each, so a repeated
positive opens a window for each of its rows; a positive with a negative score has no window, as 0.8 of it is above it; with fewer rows than
asked all are returned; an empty table gives an empty result. Vectors whose products could pass 2**61 are refused with an
ArithmeticError before anything is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.llm.common import saved
from civicmill.llm.topk import matrix, quantised

#: Components of a part and centroids of each; a code is one byte.
PART, CENTROIDS, ROUNDS = 4, 256, 8
#: Rows scored at once inside a tile.
AT_ONCE = 4096

FOUND = "anchor_id long, positive_id long, positive_row long, vec_id long, row long, positive_score long, score long"


def codebook(vectors: np.ndarray) -> np.ndarray:
    """(parts, centroids, PART): k-means of each part's rows, the same at every run."""
    rows, dim = vectors.shape
    n_parts = -(-dim // PART)
    padded = np.zeros((rows, n_parts * PART))
    padded[:, :dim] = vectors
    k = max(1, min(CENTROIDS, rows))
    out = np.zeros((n_parts, k, PART))
    for m in range(n_parts):
        points = padded[:, m * PART : (m + 1) * PART]
        centres = points[np.linspace(0, max(rows - 1, 0), k).astype(int)] if rows else out[m]
        for _ in range(ROUNDS if rows else 0):
            near = _nearest(points, centres)
            n = np.bincount(near, minlength=k)
            sums = np.stack([np.bincount(near, points[:, j], k) for j in range(PART)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        out[m] = centres
    return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)


def _parts(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(parts, rows, PART) of vectors that may be shorter than the codebook's."""
    out = np.zeros((len(vectors), book.shape[0] * PART))
    out[:, : vectors.shape[1]] = vectors
    return out.reshape(len(vectors), book.shape[0], PART).transpose(1, 0, 2)


def _encoder(book: np.ndarray, dim: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _parts(matrix(batch["v"], dim), book)
            codes = np.stack([_nearest(p, c) for p, c in zip(parts, book, strict=True)], axis=1).astype(np.uint8).reshape(batch.num_rows, len(book))
            lacks = np.stack([np.linalg.norm(p - c[k], axis=1) for p, c, k in zip(parts, book, codes.T, strict=True)], axis=1)
            norms = np.nextafter((lacks * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))  # never under the true norm
            blob = lambda x: pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, blob(codes), blob(norms)], names=[*batch.schema.names, "codes", "norms"])

    return run


class Block:
    """A tile's rows with their codes, and scores of anchors against them."""

    def __init__(self, rows: pa.Table, book: np.ndarray, dim: int) -> None:
        self.ids, self.labels, self.rows = (rows[c].to_numpy() for c in ("vec_id", "label", "row"))
        self.vectors = matrix(rows["v"], dim)
        joined = lambda c, kind: np.frombuffer(b"".join(rows[c].to_pylist()), kind).reshape(len(self.ids), len(book))
        self.codes, self.book = joined("codes", np.uint8), book
        known = np.take_along_axis(np.linalg.norm(book, axis=2), self.codes.T.astype(np.int64), axis=1).T
        self.norms = joined("norms", np.float32) + 1e-9 * known  # the second term covers rounding of the sums

    def bounded(self, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, lower bounds, upper bounds of its scores with all rows)."""
        step = max(1, (AT_ONCE << 8) // max(1, len(self.ids)))
        for i in range(0, len(anchors), step):
            parts = _parts(anchors[i : i + step], self.book)
            score = np.zeros((len(self.ids), parts.shape[1]))
            for m, part in enumerate(parts):
                score += (self.book[m] @ part.T)[self.codes[:, m]]
            reach = self.norms @ np.linalg.norm(parts, axis=2)
            for j in range(parts.shape[1]):
                yield i + j, score[:, j] - reach[:, j] - 1e-3, score[:, j] + reach[:, j] + 1e-3

    def exact(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.vectors[at] @ anchor

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Of rows ``at`` the places of the ``k`` best: highest score, smallest id."""
        return np.lexsort((self.rows[at], self.ids[at], -scores))[:k]


def kept(low: np.ndarray, high: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """Which rows may be among the ``k`` best, if those that are ``sure`` take part for certain."""
    if len(bounds := low[sure]) > k:
        return high >= np.partition(bounds, len(bounds) - k)[len(bounds) - k]
    return np.ones(len(low), bool)


def _positives(book: np.ndarray, dim: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            block, own, label = Block(rows, book, dim), anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
            vectors = matrix(anchors["v"], dim)
            for i, low, high in block.bounded(vectors):
                same = np.nonzero((block.labels == label[i]) & (block.ids != own[i]))[0]
                at = same[kept(low[same], high[same], np.ones(len(same), bool), k)]
                scores = block.exact(at, vectors[i])
                out += [(own[i], block.ids[at[j]], block.rows[at[j]], block.ids[at[j]], block.rows[at[j]], scores[j], scores[j]) for j in block.best(at, scores, k)]
        return _found(out)

    return run


def _negatives(book: np.ndarray, dim: int, k: int, least: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            block, own, label = Block(rows, book, dim), anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
            vectors, windows = matrix(anchors["v"], dim), anchors["windows"].to_pylist()
            for i, low, high in block.bounded(vectors):
                other = (block.labels != label[i]) & (block.ids != own[i])
                for w in windows[i]:
                    top = w["positive_score"]
                    bottom = -(-least * top // 100)  # the least whole score with 100 * score >= least * top
                    at = np.nonzero(other & (high >= bottom) & (low <= top))[0]
                    at = at[kept(low[at], high[at], (low[at] >= bottom) & (high[at] <= top), k)]
                    scores = block.exact(at, vectors[i])
                    inside = (scores >= bottom) & (scores <= top)
                    at, scores = at[inside], scores[inside]
                    out += [(own[i], w["positive_id"], w["positive_row"], block.ids[at[j]], block.rows[at[j]], top, scores[j]) for j in block.best(at, scores, k)]
        return _found(out)

    return run


def _found(rows: list[tuple]) -> pa.Table:
    names = [field.split()[0] for field in FOUND.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({name: pa.array([int(x) for x in column], pa.int64()) for name, column in zip(names, columns, strict=True)})


def _tiles(anchors: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_blocks: int, work: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    a = anchors.withColumn("ab", dealt("vec_id", n_anchor_blocks)).withColumn("rb", spread(n_blocks))
    r = rows.withColumn("rb", dealt("row", n_blocks)).withColumn("ab", spread(n_anchor_blocks))
    return a.groupBy("ab", "rb").cogroup(r.groupBy("ab", "rb")).applyInArrow(work, FOUND)


def hard_negatives(
    vectors: DataFrame, label: Column, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, least: int = 80,
    sample: int = 8192, block_rows: int = 8192, anchor_rows: int = 1024,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A window takes scores from ``least`` percent of the positive's up to the positive's own. ``label`` and ``is_anchor``
    are conditions on the columns of ``vectors``.
    """
    labelled = vectors.withColumn("label", label.cast("long")).where(F.col("label").isNotNull())
    plain = saved(quantised(labelled, scale, "label"), "vectors")
    size = plain.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    dim = max(1, int(size[1] or 0))
    if dim * int(size[2] or 0) ** 2 > 1 << 61:
        raise ArithmeticError(f"vectors of up to {dim} components as large as {size[2]}: their inner products do not fit 64-bit integers")
    some = plain.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(sample).select("v").toArrow()
    book = codebook(matrix(some["v"], dim).astype(np.float64))
    index = plain.withColumn("row", F.monotonically_increasing_id())
    kinds = ", ".join(f"{name} {kind}" for name, kind in index.dtypes)
    index = saved(index.mapInArrow(_encoder(book, dim), f"{kinds}, codes binary, norms binary"), "index")
    anchors = saved(plain.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*"), "anchors")
    n_blocks, n_anchor_blocks = max(1, -(-size[0] // block_rows)), max(1, -(-anchors.count() // anchor_rows))

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id", "row")
    found = _tiles(anchors, index, n_anchor_blocks, n_blocks, _positives(book, dim, positives))
    windows = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    opened = windows.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_row", "positive_score")).alias("windows"))
    asking = saved(anchors.join(opened.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "windows")

    best = Window.partitionBy("anchor_id", "positive_row").orderBy(F.desc("score"), "vec_id", "row")
    mined = _tiles(asking, index, n_anchor_blocks, n_blocks, _negatives(book, dim, negatives, least))
    ranked = mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
