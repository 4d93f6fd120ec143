"""Groups of similar texts: fingerprint trees first, then every pair that they missed.

Texts are sets of word shingles; two are linked at a Jaccard similarity of ``least`` or more, and a group is what links
reach. Texts that are equal up to case of A-Z and white space are one node from the start.

1. SimHash fingerprints of the set of words, dealt by vantage-point trees (``simhash``), give links within ``radius``
   bits. Verified against the shingle sets they join most of a large group at once, but are a part of all links only.
2. What they miss is found exactly. Two sets of similarity ``least`` share one of the rarest ``1 - least`` of each one's
   shingles, its prefix. Nodes that have such a shingle in common form a list. In each list neighbours by size and by
   hash that are still apart are verified first, then all pairs that are still apart, whatever the list's length. A
   pair is left out where sizes, places in the prefix, or the parity bits of both sets already bound its similarity
   below ``least``: the sets differ in at least as many shingles as their parity bits differ, so no link is lost. List
   rows carry a few such bits; before whole sets travel, a pair meets the bits of both, as many as its sets are large.
3. Components are contracted after each pass (``components``). Links are verified before anything is thinned.

Lists longer than ``list_rows`` are dealt as pairs of blocks; a task holds two blocks at a time. Shingles that are
common in a sample need not be counted to know that they are shared, so no count groups a common one.

Edge cases: null and blank texts are equal to each other; a text of fewer words than a shingle is one shingle; rows
without a ``doc_id`` take part; repeated rows each get a row; an empty table gives an empty result; other columns are
not looked at. Nodes and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.llm.common import saved, small_batches, words_of
from civicmill.llm.components import components
from civicmill.llm.simhash import near_links

#: Parity bits that list rows carry.
BITS = 256


def word_set_prints(words: set[bytes], tables: int, memo: dict[bytes, bytes]) -> np.ndarray:
    """``tables`` fingerprints of a set of words, 64 bits each. ``memo``: digests of words, bounded."""
    import xxhash

    wide = (tables + 1) // 2
    if len(memo) > 200_000:
        memo.clear()
    for w in (w for w in words if w not in memo):
        memo[w] = b"".join(xxhash.xxh3_128_digest(w, k) for k in range(wide))
    bits = np.unpackbits(np.frombuffer(b"".join(map(memo.__getitem__, words)), np.uint8).reshape(len(words), 16 * wide), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int32) > len(words)).view(np.int64)[:tables]


def hashes_of(words: list[bytes], size: int, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words. ``memo``: hashes of words, bounded."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    if len(memo) > 300_000:
        memo.clear()
    for w in (w for w in words if w not in memo):
        memo[w] = xxhash.xxh3_64_intdigest(w)
    hashes, size = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return np.unique(out)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle."""
    return hashes_of(words_of(text), size, {})


def node_of(words: list[bytes]) -> int:
    """A number for each text, the same for texts that are equal up to case of A-Z and white space."""
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words))


def parity_bits(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which of ``bits`` classes of shingles (a power of two) hold an odd number; mixed, as shingles need not be uniform."""
    mixed = (shingles ^ shingles >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    odd = np.bincount((mixed >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def sketch_bits(n: int) -> int:
    """Parity bits for a set of ``n`` shingles: unrelated sets then differ in more of them than similar ones may."""
    return max(2 * BITS, 1 << max(2 * n - 1, 1).bit_length())


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Parity bits in fewer classes: each takes in those that the next bits of the mixed shingle tell apart."""
    bits = np.unpackbits(sketch)
    return np.bitwise_xor.reduce(bits.reshape(size, -1), axis=1)


def _counted(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            found, n = np.unique(np.concatenate([hashes_of(words_of(t), size, memo) for t in batch["text"]]), return_counts=True)
            yield pd.DataFrame({"token": found.view(np.int64), "n": n})

    return run


def common_shingles(texts: DataFrame, size: int, n: int, sample: int = 8_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that are common in a hash sample of the ``n`` texts, and how often each occurs there.

    They only settle the order in which prefixes are filled; any order finds every pair, this one with few candidates.
    """
    drawn = texts if n <= sample else texts.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    counts = drawn.select("text").mapInPandas(_counted(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where("n > 2").orderBy(F.desc("n"), "token").limit(most).toPandas()
    tokens, n_found = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n_found[order]


def prefix_of(shingles: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The rarest shingles of a set, rarest first, and how many of them are not among the common ones.

    Sets of similarity ``least`` or more share one of these at least.
    """
    if not len(shingles):
        return shingles, 0
    counts = np.zeros(len(shingles), np.int64)
    if len(common[0]):
        place = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        counts = np.where(common[0][place] == shingles, common[1][place], 0)
    kept = len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1
    order = np.lexsort((shingles, counts))[:kept]
    return shingles[order], int(np.count_nonzero(counts[order] == 0))


def _described(size: int, least: float, tables: int, common: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes: dict[bytes, int] = {}
        digests: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                shingles = hashes_of(words, size, hashes)
                prefix, rare = prefix_of(shingles, least, common)
                out.append((node_of(words), word_set_prints(set(words), tables, digests), len(shingles), parity_bits(shingles, sketch_bits(len(shingles))).tobytes(), parity_bits(shingles).tobytes(), prefix.view(np.int64), rare))
            node, prints, sizes, sketch, bits, prefix, rare = zip(*out, strict=True) if out else ([],) * 7
            found = {"node": np.array(node, np.uint64).view(np.int64), "prints": list(prints), "size": np.array(sizes, np.int32), "sketch": sketch, "bits": bits, "prefix": list(prefix), "rare": np.array(rare, np.int32)}
            yield pd.DataFrame({"key": batch["key"], "known": batch["known"], "digest": batch["digest"]} | found)

    return run


def _shingled(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            words = [words_of(t) for t in batch["text"]]
            yield pd.DataFrame({"node": np.array([node_of(w) for w in words], np.uint64).view(np.int64), "shingles": [hashes_of(w, size, memo).tobytes() for w in words]})

    return run


def _similar(least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= least * (len(a) + len(b) - both) - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    return run


def could_reach(x: np.ndarray, y: np.ndarray, differing: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of ``x`` and ``y`` shingles whose parity bits differ in ``differing`` places can be that similar."""
    return (np.minimum(x, y) >= least * np.maximum(x, y) - 1e-9) & (differing * (1 + least) <= (1 - least) * (x + y) + 1e-9)


def long_list_pairs(side: np.ndarray, root: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of one long list whose roots differ, about ``block`` pairs at a time.

    Pairs inside the list's largest component need no link any more and are left out. Rows of two blocks (``side`` 0 and
    1) meet across the blocks only.
    """
    names, counts = np.unique(root, return_counts=True)
    outside = np.nonzero(root != names[np.argmax(counts)])[0]
    split, step = side.min() != side.max(), max(1, block // len(root))
    for i in range(0, len(outside), step):
        a = outside[i : i + step]
        apart = root[a][:, None] != root[None, :]
        if split:
            apart &= side[a][:, None] != side[None, :]
        p, q = np.nonzero(apart)
        yield a[p], q


def short_list_pairs(begins: np.ndarray, ends: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows of many short lists, some lists at a time."""
    n = ends - begins
    upto = np.cumsum(n * (n - 1) // 2)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + block)))
        rows = np.concatenate([np.arange(b, e) for b, e in zip(begins[at:stop].tolist(), ends[at:stop].tolist(), strict=True)])
        later = np.repeat(ends[at:stop], n[at:stop]) - rows - 1
        p = np.repeat(rows, later)
        yield p, p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(later) - later, later)
        at = stop


def crossing_pairs(rows: pd.DataFrame, least: float, every: bool, block: int = 1 << 20, short: int = 256) -> Iterator[np.ndarray]:
    """Pairs of nodes in the same list whose roots differ and that can be similar: all, or neighbours only.

    ``rows`` holds whole lists, sorted by (token, part). Neighbours, by size and by hash, are at most two links a row.
    """
    token, part, node, root, size, at, side = (rows[c].to_numpy(np.int64) for c in ("token", "part", "node", "root", "size", "at", "side"))
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(len(rows), BITS // 64)
    begins = np.concatenate([[0], np.nonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1]))[0] + 1])
    ends = np.append(begins[1:], len(rows))
    which = np.repeat(np.arange(len(begins)), ends - begins)

    def kept(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        fit = root[p] != root[q]
        p, q = p[fit], q[fit]
        left = 1 + np.minimum(size[p] - at[p] - 1, size[q] - at[q] - 1)  # shingles in common, if this is their first one
        fit = (left * (1 + least) >= least * (size[p] + size[q]) - 1e-9) | (not every)
        p, q = p[fit], q[fit]
        near = could_reach(size[p], size[q], np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64), least)
        return np.sort(np.stack([node[p[near]], node[q[near]]], axis=1), axis=1)

    if not every:
        for key in (size, node):
            order = np.lexsort((node, key, which))
            p, q = order[:-1], order[1:]
            same = which[p] == which[q]
            yield kept(p[same], q[same])
        return
    small = (ends - begins <= short) & (np.minimum.reduceat(side, begins) == np.maximum.reduceat(side, begins))
    for p, q in short_list_pairs(begins[small], ends[small], block):
        yield kept(p, q)
    for b, e in zip(begins[~small].tolist(), ends[~small].tolist(), strict=True):
        for p, q in long_list_pairs(side[b:e], root[b:e], block):
            yield kept(b + p, b + q)


def whole_lists(batches: Iterator[pd.DataFrame], rows: int = 1 << 15) -> Iterator[pd.DataFrame]:
    """The rows of a partition, sorted by (token, part), many lists at a time and none of them cut."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        joined = pd.concat(held)
        token, part = joined["token"].to_numpy(), joined["part"].to_numpy()
        open_from = int(np.argmax((token == token[-1]) & (part == part[-1])))
        if open_from:
            yield joined.iloc[:open_from]
        held = [joined.iloc[open_from:]]
    if held and len(joined := pd.concat(held)):
        yield joined


def _crossing(least: float, every: bool, most: int = 1 << 18) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, 2), np.int64)
        for rows in whole_lists(batches):
            for found in crossing_pairs(rows, least, every):
                held = np.unique(np.concatenate([held, found]), axis=0)
                if len(held) >= most:
                    yield pd.DataFrame({"a": held[:, 0], "b": held[:, 1]})
                    held = held[:0]
        yield pd.DataFrame({"a": held[:, 0], "b": held[:, 1]})

    return run


def _possible(least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            differing = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = 8 * min(len(x), len(y))
                differing.append(int(np.count_nonzero(folded(x, size) != folded(y, size))))
            yield batch.loc[could_reach(batch["m"].to_numpy(np.int64), batch["n"].to_numpy(np.int64), np.array(differing, np.int64), least), ["a", "b"]]

    return run


def list_rows_of(nodes: DataFrame) -> DataFrame:
    """(token, node, size, at, bits) of the prefix shingles that more than one node has, or that a sample says are common."""
    places = nodes.select("node", F.posexplode("prefix").alias("at", "token"), "rare")
    common = places.where("at >= rare").select("token", "node", "at")
    rare = places.where("at < rare").withColumn("n", F.count("*").over(Window.partitionBy("token"))).where("n > 1").select("token", "node", "at")
    return rare.union(common).join(nodes.select("node", "size", "bits"), "node").select("token", "node", "size", "at", "bits")


def candidates(lists: DataFrame, roots: DataFrame, least: float, every: bool, list_rows: int, parts: int) -> DataFrame:
    """Pairs (a, b) of the lists (token, node, size, at, bits) that are still apart and can be similar."""
    placed = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).repartition(parts, "token")
    of_token = Window.partitionBy("token")
    placed = placed.withColumns({"n": F.count("*").over(of_token), "x": F.min("root").over(of_token), "y": F.max("root").over(of_token)}).where("x != y")
    rows = ("token", "part", "side", "node", "root", "size", "at", "bits")
    short = placed.where(F.col("n") <= list_rows).withColumns({"part": F.lit(0), "side": F.lit(0)}).select(*rows)
    # A pair of blocks of a long list meets where either one's row has the other.
    blocks = F.ceil(F.col("n") / list_rows).cast("int")
    dealt = placed.where(F.col("n") > list_rows).withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    long = dealt.withColumns({"part": part, "side": F.when(F.col("block") > F.col("other"), 1).otherwise(0)}).select(*rows).repartition(parts, "token", "part")
    found = [x.sortWithinPartitions("token", "part").mapInPandas(_crossing(least, every), "a long, b long") for x in (short, long)]
    return found[0].union(found[1])


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, least: float, shingle: int, task_rows: int = 2_000) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets are similar. ``texts``: (digest, text); ``nodes``: (node, digest, size, sketch).

    What a join looks up is a written table, so Spark knows its size and broadcasts it only below its own threshold.
    Python works on tasks of ``task_rows`` texts or pairs, as far as the shuffles before it are no coarser.
    """
    pairs = saved(pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    side = lambda node, size, bits: nodes.select(F.col("node").alias(node), F.col("size").alias(size), F.col("sketch").alias(bits))
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")
    pairs = saved(both.mapInPandas(_possible(least), "a long, b long"), "possible")
    tasks = max(8, -(-pairs.count() // task_rows))
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().coalesce(tasks), "wanted")
    owners = saved(nodes.select("node", "digest").join(wanted, "node", "left_semi").select("digest"), "owners")
    once = texts.join(owners, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")).select("text")
    once = once.coalesce(max(8, -(-wanted.count() // task_rows)))
    sets = once.mapInPandas(_shingled(shingle), "node long, shingles binary")
    sides = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(pairs, "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return saved(sides.select("a", "b", "x", "y").coalesce(tasks).mapInPandas(_similar(least), "a long, b long"), "verified")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def similar_texts(docs: DataFrame, least: float = 0.8, shingle: int = 5, tables: int = 2, radius: int = 3, list_rows: int = 50_000, part_rows: int = 400_000) -> DataFrame:
    """(doc_id, digest, root) of every row: texts of one ``root`` are linked by similarity; ``digest`` is the text's SHA-256."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    common = common_shingles(rows, shingle, rows.count())
    keyed = rows.select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNotNull().alias("known"), "digest", "text")
    schema = "key long, known boolean, digest binary, node long, prints array<long>, size int, sketch binary, bits binary, prefix array<long>, rare int"
    described = saved(keyed.mapInPandas(_described(shingle, least, tables, common), schema), "described")
    same = ("prints", "size", "sketch", "bits", "prefix", "rare")  # functions of the node
    nodes = saved(described.groupBy("node").agg(F.min("digest").alias("digest"), *[F.first(c).alias(c) for c in same]), "nodes")

    texts = rows.select("digest", "text")
    points = nodes.select("node", F.posexplode("prints").alias("tab", "fp"))
    links = verified(near_links(points, radius, tables), texts, nodes, least, shingle)
    roots = saved(components(links), "roots")
    lists = saved(list_rows_of(nodes), "lists")
    parts = max(8, -(-lists.count() // part_rows))
    for every in (False, True):
        links = links.union(verified(candidates(lists, roots, least, every, list_rows, parts), texts, nodes, least, shingle))
        roots = saved(components(links), "roots")
    doc_id = F.when(F.col("known"), F.col("key")).alias("doc_id")
    return described.select(doc_id, "digest", "node").join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def similar_groups(docs: DataFrame, least: float = 0.8, shingle: int = 5, tables: int = 2, radius: int = 3) -> DataFrame:
    """(doc_id, group) of documents whose word shingles have a Jaccard similarity of at least ``least``, over links.

    ``group`` is the smallest ``doc_id`` of a group, null if none of its rows has one.
    """
    found = saved(similar_texts(docs, least, shingle, tables, radius), "texts")
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("group")), "root").select("doc_id", "group")
