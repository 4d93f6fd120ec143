"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become word sequences. A pair is a candidate if it shares seeds, ``seed_words`` words in
a row, found by their Karp-Rabin hashes. Candidate pairs are tiled by running Karp-Rabin: search lengths descend; at
each, windows without a marked word are hashed, equal ones are extended as far as they go, and the longest matches that
do not overlap are marked first. No tile is shorter than ``tile_words``; the share of the item's words under tiles is
its coverage, so a passage counts however its parts are ordered. A pair from ``least`` on is contamination, and so is a
pair with one tile of ``long_tile`` words or more, which a long item may hold besides much else.

A tile of n words holds n + 1 - ``seed_words`` seeds of the item, so a pair needs a certain number of the item's seeds
to reach either bound; pairs with fewer, such as those that share a common phrase, are dropped without being tiled.

While the benchmark has at most ``most_seeds`` seeds and ``most_bytes`` of text, which is counted first, it is broadcast
and documents are tiled where they are read: no text is shuffled. Larger benchmarks meet the documents' windows in a
shuffled join, and texts travel only for the pairs that have seeds enough.

Edge cases: null and empty texts share nothing; items of fewer words than a seed can't be told from ordinary text and
match nothing; repeated rows and items each give a row; null ids are kept; an empty table on either side gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import saved, small_batches

WORD = re.compile(r"[^\W_]+")
#: Multiplier and word hash seed of the rolling hash.
BASE = 0x9E3779B97F4A7C15


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``size`` words, modulo 2**64."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(BASE) + hashes[k : k + n]
    return out


def codes_of(item: list[str], text: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences as numbers: equal words, equal numbers; words of the text that the item lacks are -1."""
    known: dict[str, int] = {}
    a = np.array([known.setdefault(w, len(known)) for w in item], np.int64)
    return a, np.fromiter((known.get(w, -1) for w in text), np.int64, len(text))


class Sequence:
    """Word numbers with marks and prefix hashes."""

    def __init__(self, codes: np.ndarray, edge: int):
        self.codes, self.edge, self.marked = codes, edge, np.zeros(len(codes), bool)
        powers = _power(np.arange(len(codes)))
        mixed = (codes.astype(np.uint64) + np.uint64(2)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers, dtype=np.uint64)])
        self.refresh()

    def refresh(self) -> None:
        """How many unmarked words stand from each place on, and the word before, ``edge`` where that can't be matched."""
        n = len(self.codes)
        stops = np.append(np.nonzero(self.marked)[0], n)
        self.free = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
        self.before = np.where(np.append(True, self.marked[:-1]), self.edge, np.append(self.edge, self.codes[:-1]))[:n]

    def hashes(self, at: np.ndarray, size: np.ndarray | int, top: int) -> np.ndarray:
        """Of the ``size`` words from each place on, scaled alike: by the powers up to ``top``."""
        return (self.sums[at + size] - self.sums[at]) * _power(top - at)

    def mark(self, at: int, size: int) -> None:
        self.marked[at : at + size] = True


def _power(exponents: np.ndarray) -> np.ndarray:
    """BASE to the power of each exponent, modulo 2**64."""
    out, factor, left = np.ones(len(exponents), np.uint64), BASE, exponents.astype(np.int64).copy()
    while left.any():
        out = np.where(left & 1, out * np.uint64(factor), out)
        factor, left = factor * factor & (1 << 64) - 1, left >> 1
    return out


def _spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for every place from ``begins`` to ``ends`` of each row."""
    n = np.maximum(ends - begins, 0)
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)


def maximal_matches(item: Sequence, text: Sequence, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the item, place in the text, length) of the matches of ``size`` or more unmarked words that can't be longer."""
    top = max(len(item.codes), len(text.codes))
    i, t = np.nonzero(item.free >= size)[0], np.nonzero((text.free >= size) & (text.codes >= 0))[0]
    empty = np.empty(0, np.int64)
    if not len(i) or not len(t):
        return empty, empty, empty
    hi, ht = item.hashes(i, size, top), text.hashes(t, size, top)
    near = np.isin(ht, hi)
    t, ht = t[near], ht[near]
    if not len(t):
        return empty, empty, empty
    # Longer to the left are the pairs with the same word before, so each window meets its equals less those.
    _, number = np.unique(np.concatenate([hi, ht]), return_inverse=True)
    wide = len(item.codes) + 4
    key = number[len(hi) :] * wide + text.before[t] + 3
    order = np.argsort(key, kind="stable")
    t, key, own = t[order], key[order], number[: len(hi)] * wide
    low, high = np.searchsorted(key, own), np.searchsorted(key, own + wide)
    same_low, same_high = (np.searchsorted(key, own + item.before[i] + 3, side) for side in ("left", "right"))
    rows, places = (np.concatenate(x) for x in zip(_spread(low, same_low), _spread(same_high, high), strict=True))
    p, q = i[rows], t[places]
    shortest, longest = np.full(len(p), size), np.minimum(item.free[p], text.free[q])
    while (shortest < longest).any():  # how far both go on alike, by halving
        middle = (shortest + longest + 1) // 2
        alike = item.hashes(p, middle, top) == text.hashes(q, middle, top)
        shortest, longest = np.where(alike, middle, shortest), np.where(alike, longest, middle - 1)
    return p, q, shortest


def unmarked_runs(i: int, t: int, n: int, item: Sequence, text: Sequence, least: int) -> Iterator[tuple[int, int, int]]:
    """What tiles have left of a match, as far as it is ``least`` words long."""
    busy = np.concatenate([[True], item.marked[i : i + n] | text.marked[t : t + n], [True]])
    edges = np.flatnonzero(busy[1:] != busy[:-1])
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - begin >= least:
            yield i + begin, t + begin, end - begin


def mark_longest(item: Sequence, text: Sequence, size: int) -> Iterator[tuple[int, int, int]]:
    """The tiles of ``size`` words or more, longest first, of equal ones the first in the text; they are marked."""
    i, t, n = maximal_matches(item, text, size)
    order = np.argsort(-n, kind="stable")
    i, t, n = i[order], t[order], n[order]
    pieces: dict[int, list[tuple[int, int]]] = {}
    at, length = 0, int(n[0]) if len(n) else 0
    while length >= size:
        stop = int(np.searchsorted(-n, -length, "right"))
        mine = np.concatenate([np.stack([t[at:stop], i[at:stop]], axis=1), np.array(pieces.pop(length, []), np.int64).reshape(-1, 2)])
        at = stop
        mine = mine[np.lexsort((mine[:, 1], mine[:, 0]))]
        open_ = mine[_free(item, text, mine, length) == length]
        for y, x in open_.tolist():
            if not item.marked[x : x + length].any() and not text.marked[y : y + length].any():
                item.mark(x, length)
                text.mark(y, length)
                yield x, y, length
        for y, x in mine[_free(item, text, mine, length) >= size].tolist():
            for a, b, k in unmarked_runs(x, y, length, item, text, size):
                pieces.setdefault(k, []).append((b, a))
        length = max([int(n[at]) if at < len(n) else 0, *pieces])


def _free(item: Sequence, text: Sequence, places: np.ndarray, length: int) -> np.ndarray:
    """Words that are unmarked on both sides, at most, of the matches at ``places`` (text, item)."""
    if not len(places):
        return np.empty(0, np.int64)
    busy = [np.append(0, np.cumsum(s.marked)) for s in (text, item)]
    return length - np.maximum(*(b[places[:, k] + length] - b[places[:, k]] for k, b in enumerate(busy)))


def tiles(item: list[str], text: list[str], shortest: int) -> list[tuple[int, int, int]]:
    """(place in the item, place in the text, length), greedily the longest first; no word is in two tiles."""
    if len(item) < shortest or len(text) < shortest:
        return []
    a, b = (Sequence(codes, edge) for codes, edge in zip(codes_of(item, text), (-2, -3), strict=True))
    out, size = [], shortest
    while 2 * size <= len(item):
        size *= 2
    while True:
        out += mark_longest(a, b, size)
        if size == shortest:
            return out
        size = max(shortest, size // 2)
        a.refresh()
        b.refresh()


class Memo:
    """Hashes of words that were seen before, bounded."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > self.most:
            self.known = {}
        for w in (w for w in words if w not in self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


class Bounds:
    """When a pair is contamination."""

    def __init__(self, seed_words: int, tile_words: int, least: float, long_tile: int):
        self.seed_words, self.tile_words, self.least, self.long_tile = seed_words, tile_words, least, long_tile

    def seeds_needed(self, words: int) -> int:
        """Of an item's seeds so many at least stand in a text that reaches a bound: a word is in ``seed_words`` of them, no tile is shorter than a seed."""
        share = -(-self.least * words // max(self.tile_words, self.seed_words)) if self.tile_words >= self.seed_words else 1
        return max(1, min(int(share), self.long_tile + 1 - self.seed_words))

    def judged(self, item: list[str], text: list[str]) -> tuple[float, int] | None:
        """(coverage, number of tiles) of a contaminated pair."""
        found = tiles(item, text, self.tile_words)
        coverage = sum(n for _, _, n in found) / len(item)
        if coverage >= self.least or max((n for _, _, n in found), default=0) >= self.long_tile:
            return coverage, len(found)
        return None


def _item_seeds(bounds: Bounds) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item"].tolist(), batch["text"], strict=True):
                words = words_in(text)
                seeds, places = np.unique(rolling(word_hashes(words), bounds.seed_words).view(np.int64), return_counts=True)
                yield pd.DataFrame({"seed": seeds, "item": item, "places": places, "needed": bounds.seeds_needed(len(words))})

    return run


def _judged_in_place(items: dict[int, list[str]], seeds: np.ndarray, owners: list[list[tuple[int, int]]], bounds: Bounds, keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Contaminated rows. A window can only be a seed if all of its words occur in the benchmark."""
    size = bounds.seed_words
    needed = {item: bounds.seeds_needed(len(words)) for item, words in items.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = list({w for words in items.values() for w in words})
        hashed = dict(zip(vocabulary, word_hashes(vocabulary).tolist(), strict=True))
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch["text"]):
                words = words_in(text)
                codes = np.array([hashed.get(w, 0) for w in words], np.uint64)
                if len(codes) < size:
                    continue
                shared = np.concatenate([[0], np.cumsum(codes != 0)])
                full = np.nonzero(shared[size:] - shared[:-size] == size)[0]
                if not len(full):
                    continue
                windows = np.zeros(len(full), np.uint64)
                for k in range(size):
                    windows = windows * np.uint64(BASE) + codes[full + k]
                place = np.searchsorted(seeds, windows)
                met = Counter()
                for p in np.unique(place[seeds[np.minimum(place, len(seeds) - 1)] == windows]).tolist():
                    met.update(dict(owners[p]))
                for item in sorted(i for i, n in met.items() if n >= needed[i]):
                    if judged := bounds.judged(items[item], words):
                        rows.append(row)
                        found.append((item, *judged))
            if rows:
                item, coverage, n_tiles = zip(*found, strict=True)
                yield batch.iloc[rows][keys].assign(item=np.array(item, np.int64), coverage=coverage, n_tiles=np.array(n_tiles, np.int32))

    return run


def _windows(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo()
        for batch in batches:
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                found = np.unique(rolling(memo.hashes(words_in(text)), size)).view(np.int64)
                yield pd.DataFrame({"digest": digest, "seed": found})

    return run


def _judged_pairs(bounds: Bounds, keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [bounds.judged(words_in(i), words_in(t)) for i, t in zip(batch["item_text"], batch["text"], strict=True)]
            keep = [f is not None for f in found]
            yield batch.loc[keep, [*keys, "item"]].assign(coverage=[f[0] for f in found if f], n_tiles=np.array([f[1] for f in found if f], np.int32))

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, seed_words: int = 4, tile_words: int = 4, least: float = 0.5, long_tile: int = 30, most_seeds: int = 500_000, most_bytes: int = 16 << 20, keys: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) of every pair whose coverage reaches ``least`` or that has a tile of ``long_tile`` words.

    ``keys``: columns of ``docs`` that are carried along.
    """
    small_batches(docs.sparkSession)
    bounds = Bounds(seed_words, tile_words, least, long_tile)
    items = saved(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"]), "items")
    seeds = saved(items.select("item", "text").mapInPandas(_item_seeds(bounds), "seed long, item long, places int, needed int"), "seeds")
    n, n_bytes = seeds.count(), items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    carried = [f"carried{k}" for k in range(len(keys))]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.col("doc_id").isNotNull().alias("known"), "text", *[F.col(k).alias(c) for k, c in zip(keys, carried, strict=True)])
    kept = ["key", "known", *carried]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", item long, coverage double, n_tiles int"
    if n <= most_seeds and n_bytes <= most_bytes:
        by_seed: dict[int, list[tuple[int, int]]] = {}
        for r in seeds.select("seed", "item", "places").collect():
            by_seed.setdefault(r["seed"] & (1 << 64) - 1, []).append((r["item"], r["places"]))
        words = {r["item"]: words_in(r["text"]) for r in items.select("item", "text").collect()}
        found = rows.mapInPandas(_judged_in_place(words, np.array(sorted(by_seed), np.uint64), [by_seed[s] for s in sorted(by_seed)], bounds, kept), schema) if n else rows.where("false").select(*kept, F.lit(0).cast("long").alias("item"), F.lit(0.0).alias("coverage"), F.lit(0).alias("n_tiles"))
    else:
        digested = rows.withColumn("digest", F.sha2("text", 256))
        windows = digested.select("digest", "text").mapInPandas(_windows(seed_words), "digest string, seed long").distinct()
        met = windows.join(seeds, "seed").groupBy("digest", "item").agg(F.sum("places").alias("met"), F.first("needed").alias("needed"))
        pairs = saved(met.where("met >= needed").select("digest", "item"), "pairs")
        texts = digested.join(pairs, "digest").join(items.select("item", F.col("text").alias("item_text")), "item")
        found = texts.select(*kept, "item", "text", "item_text").mapInPandas(_judged_pairs(bounds, kept), schema)
    named = found.join(items.select("item", "item_id"), "item")
    return named.select(F.when(F.col("known"), F.col("key")).alias("doc_id"), "item_id", "coverage", "n_tiles", *[F.col(c).alias(k) for k, c in zip(keys, carried, strict=True)])


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, coverage, items): one row per contaminated document, with its largest coverage and its items as text."""
    found = contaminated(docs, benchmark, **settings)
    listed = F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda i: i.cast("string")), ",")
    return found.groupBy("doc_id").agg(F.max("coverage").alias("coverage"), listed.alias("items"))
