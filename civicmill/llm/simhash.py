"""SimHash near-duplicates: vantage-point trees over Hamming distance.

A document's fingerprint has a bit for each hash bit that is set in over half of its shingles' XXH64 values. Equal
fingerprints are one node. Nodes within ``radius`` differing bits are linked, exactly:

1. Vantage-point trees are grown on a bounded hash sample of the distinct fingerprints. Each inner node holds a vantage
   fingerprint and a distance; nearer fingerprints go left, others right. By the triangle inequality two linked
   fingerprints can part only if the nearer one lies within the tree's radius of the boundary, so those go right as
   well. A tree measures Hamming distance over one band of the bits: of ``bands`` bands, one at least holds no more than
   ``radius // bands`` of a pair's differing bits, so each tree prunes at that smaller radius and few fingerprints lie
   near a boundary. Each linked pair thus meets in at least one shard of one tree, whatever the sample was.
2. Every fingerprint walks the trees in Arrow batches and is shuffled to its shards. A shard that the tree could not
   thin out (a dense knot of near copies) is dealt as pairs of blocks, so no task holds more than its share.
3. A shard grows the same kind of tree over its own members, compares what is left by pop-count, and returns a spanning
   forest of the links, never all pairs.
4. Components are contracted over all shards' forests (``components``).

Edge cases: null and blank texts have fingerprint zero and are linked like any other; a text of fewer words than a
shingle is one shingle; repeated rows each get a row; null ``doc_id`` rows take part, and a component of such rows only
has a null id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import saved, small_batches, words_of
from civicmill.llm.components import components


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits of a whole text; shingles count as often as they occur."""
    import xxhash

    words = words_of(text)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    begins = (ends - sizes)[: len(last)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(last), 1 << 16):
        hashes = np.array([digest(joined[b:e], 42) for b, e in zip(begins[i : i + (1 << 16)].tolist(), last[i : i + (1 << 16)].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"key": batch["key"], "known": batch["known"], "fp": bits})

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, computed once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.col("doc_id").isNotNull().alias("known"), "text")
    out = rows.mapInPandas(_fingerprints(shingle), "key long, known boolean, fp long")
    return saved(out.select(F.when(F.col("known"), F.col("key")).alias("doc_id"), "fp"), "fingerprints")


#: All 64 bits.
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)


def band_masks(bands: int) -> list[np.uint64]:
    """The bits of each band; bands part the 64 bits."""
    edges = [64 * k // bands for k in range(bands + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:], strict=False)]


class Node:
    """A shard (``left`` is None) with its number of blocks, or a vantage fingerprint with a boundary distance."""

    def __init__(self, shard: int = -1, blocks: int = 1):
        self.shard, self.blocks, self.vantage, self.bound, self.left, self.right = shard, blocks, np.uint64(0), 0, None, None


def _split(points: np.ndarray, radius: int, mask: np.uint64 = WHOLE, tries: int = 4) -> tuple[np.uint64, int, np.ndarray, np.ndarray] | None:
    """The vantage point, of a few, and the boundary that leave the smallest larger half; None if none thins them out."""
    best, found = 0.8 * len(points), None
    for k in range(tries):
        distance = np.bitwise_count((points ^ points[(k * len(points)) // tries]) & mask)
        within = np.cumsum(np.bincount(distance, minlength=65))
        beyond = len(points) - np.concatenate([np.zeros(radius, np.int64), within[:-radius]]) if radius else len(points) - within
        bound = int(np.argmin(np.maximum(within, beyond)))
        if max(within[bound], beyond[bound]) < best:
            best, found = max(within[bound], beyond[bound]), (points[(k * len(points)) // tries], bound, distance <= bound, distance.astype(np.int64) > bound - radius)
    return found


def grow(sample: np.ndarray, radius: int, share: float, mask: np.uint64 = WHOLE, fewest: int = 16) -> Node:
    """A tree whose shards hold about ``share`` points of the sample each, or ``fewest``, which tell how to split."""
    shards = 0

    def build(points: np.ndarray) -> Node:
        nonlocal shards
        cut = _split(points, radius, mask) if len(points) > max(share, fewest) else None
        if cut is None:
            shards += 1
            return Node(shards - 1, max(1, int(np.ceil(len(points) / max(share, 1e-9) - 0.5))))
        node = Node()
        node.vantage, node.bound = cut[0], cut[1]
        node.left, node.right = build(points[cut[2]]), build(points[cut[3]])
        return node

    return build(sample)


def route(node: Node, points: np.ndarray, at: np.ndarray, radius: int, mask: np.uint64 = WHOLE) -> Iterator[tuple[Node, np.ndarray]]:
    """(shard, positions of the points that belong to it)."""
    if not len(at):
        return
    if node.left is None:
        yield node, at
        return
    distance = np.bitwise_count((points[at] ^ node.vantage) & mask).astype(np.int64)
    yield from route(node.left, points, at[distance <= node.bound], radius, mask)
    yield from route(node.right, points, at[distance > node.bound - radius], radius, mask)


def _joined(batches: Iterator[pd.DataFrame], rows: int = 1 << 16) -> Iterator[pd.DataFrame]:
    """Many Arrow batches at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def _routed(trees: list[tuple[int, np.uint64, Node]], radius: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _joined(batches):
            points, nodes, tab = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["node"].to_numpy(np.int64), rows["tab"].to_numpy()
            tabs, shards, parts, members = [], [], [], []
            for t, (own, mask, tree) in enumerate(trees):
                for node, at in route(tree, points, np.nonzero(tab == own)[0], radius, mask):
                    block = (points[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % node.blocks
                    for other in range(node.blocks):  # a pair of blocks meets where either one's row has the other
                        tabs.append(np.full(len(at), t, np.int32))
                        shards.append(np.full(len(at), node.shard, np.int32))
                        parts.append((np.minimum(block, other) * node.blocks + np.maximum(block, other)).astype(np.int32))
                        members.append(at)
            at = np.concatenate(members)
            yield pd.DataFrame({"tab": np.concatenate(tabs), "shard": np.concatenate(shards), "part": np.concatenate(parts), "fp": points[at].view(np.int64), "node": nodes[at]})

    return run


class Forest:
    """Component labels of positions, and the links that joined two components."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def join(self, i: int, others: np.ndarray) -> None:
        """Links position ``i`` with ``others``, as far as they are not joined yet."""
        while len(others := others[self.label[others] != self.label[i]]):
            self.links.append((i, int(others[0])))
            self.label[self.label == self.label[others[0]]] = self.label[i]


def _compare(points: np.ndarray, at: np.ndarray, radius: int, forest: Forest, block: int = 1024) -> None:
    for i in range(0, len(at), block):
        mine = at[i : i + block]
        for j in range(i, len(at), block):
            other = at[j : j + block]
            near = np.bitwise_count(points[mine][:, None] ^ points[other][None, :]) <= radius
            for p in np.nonzero(near.sum(1) > (i == j))[0]:
                forest.join(int(mine[p]), other[near[p]])


def forest_within(points: np.ndarray, radius: int, leaf: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``points``, as positions."""
    forest, todo = Forest(len(points)), [np.arange(len(points))]
    while todo:
        at = todo.pop()
        cut = _split(points[at], radius) if len(at) > leaf else None
        if cut is None:
            _compare(points, at, radius, forest)
        else:
            todo += [at[cut[2]], at[cut[3]]]
    return forest.links


def _linked(radius: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        nodes, points = group["node"].to_numpy(np.int64), group["fp"].to_numpy(np.int64).view(np.uint64)
        links = forest_within(points, radius)
        a, b = (nodes[[x[k] for x in links]] if links else np.empty(0, np.int64) for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    return run


def near_links(points: DataFrame, radius: int = 3, tables: int = 1, bands: int = 2, sample: int = 16384, most_sample: int = 1 << 18, shard_rows: int = 24576) -> DataFrame:
    """Links (a, b) that span the components of ``points`` (node, tab, fp) under ``radius`` bits, table by table.

    ``sample``: fingerprints per table, chosen by hash, on which the driver grows the trees that deal out the shards; it
    grows with the table to ``most_sample``, two megabytes. What is copied over boundaries grows with the depth of the
    trees, so a shard is as large as a task holds with ease and is split further inside its task. A shard in which more
    than ``shard_rows`` are expected is dealt as pairs of blocks, so groups stay bounded however long the table is.
    """
    n = -(-points.count() // tables)
    sample = min(most_sample, max(sample, n // 512))
    picked = points if n <= sample else points.where(F.pmod(F.xxhash64("node", "fp"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    drawn = picked.select("tab", "fp").limit(2 * tables * sample).toPandas().sort_values(["tab", "fp"])
    trees = []
    for t in range(tables):
        mine = drawn["fp"][drawn["tab"] == t].to_numpy(np.int64).view(np.uint64)
        share = len(mine) * shard_rows / max(n, 1)  # as many of the sample stand for ``shard_rows``
        mine = np.random.default_rng(0).permutation(mine)
        trees += [(t, mask, grow(mine, radius // bands, share, mask)) for mask in band_masks(bands)]
    routed = points.select("node", "tab", "fp").mapInPandas(_routed(trees, radius // bands), "tab int, shard int, part int, fp long, node long")
    return routed.groupBy("tab", "shard", "part").applyInPandas(_linked(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row: the component's id is the smallest ``doc_id`` reachable over links."""
    prints = fingerprints(docs, shingle)
    points = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    links = saved(near_links(points.select(F.col("fp").alias("node"), F.lit(0).alias("tab"), "fp"), radius), "links")
    roots = components(links).withColumnsRenamed({"node": "fp"})
    joined = points.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = saved(joined.join(ids, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
