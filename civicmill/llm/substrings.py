"""Substring dedup by hashing units of text.

A text is cut into lines and those into sentences; a passage that was pasted into the middle of a paragraph still
shares its inner sentences. Units are normalised (lower case, punctuation at word edges and white space dropped). They
are every line, of any length; every sentence of at least ``min_words`` words; and every shorter sentence together with
as many of those after it, and with as many of those before it, in its line as make up ``min_words``, so that any
repeated run of sentences of that length is covered. Units are digested to 128 bits with their offsets in the original
text; of equal ones that overlap in a text the first counts. Digests are grouped over all documents: the occurrence with the smallest (doc_id, offset) is kept, all others are removed.

The group's keeper is a grouped minimum, combined before the shuffle, and meets the units in a join that splits hot
keys, so a line that a third of the rows share needs no group in one task.

Edge cases: null and empty texts, and lines without a letter or digit beside punctuation, have no units; null ids rank last; rows that share a ``doc_id`` count as one document
and lose nothing to each other; repeats inside a document go after its first one; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import saved, small_batches

LINE = re.compile(r"[^\n]+")
UNIT = re.compile(r"[^.!?\n]+[.!?]*")
EDGES = ".,;:!?\"'()[]«»“”*#%&$-"
LAST = (1 << 63) - 1
#: Name of a column that stands beside a table's own for a while.
SPANS = "_substring_spans"
#: Name of a column that names a row while documents are cut.
ROW = "_substrings_row"


def _spans(line: str, offset: int, min_words: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised unit) of a line and of its sentences, not sorted."""
    pieces = []
    for m in UNIT.finditer(line):
        raw = m.group()
        if words := [w for w in (x.strip(EDGES) for x in raw.split()) if w]:
            body = raw.strip()
            start = offset + m.start() + raw.index(body[0])
            pieces.append((start, start + len(body), " ".join(words).lower(), len(words)))
    body = line.strip()
    if not (whole := " ".join(w for w in (x.strip(EDGES) for x in body.split()) if w).lower()):
        return
    start = offset + line.index(body[0])
    yield start, start + len(body), whole
    for i, (start, end, unit, n) in enumerate(pieces):
        if n >= min_words:
            yield start, end, unit
            continue
        for step in (1, -1):
            k, total = i, n
            while total < min_words and 0 <= k + step < len(pieces):
                k += step
                total += pieces[k][3]
            if total >= min_words:
                run = pieces[min(i, k) : max(i, k) + 1]
                yield run[0][0], run[-1][1], " ".join(p[2] for p in run)


def units(text: str, min_words: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised unit), offsets in code points of the original text, blanks at its ends left out."""
    ends: dict[str, int] = {}
    for m in LINE.finditer(text):
        for start, end, unit in sorted(_spans(m.group(), m.start(), min_words), key=lambda u: (u[0], -u[1])):
            if start >= ends.get(unit, 0):
                ends[unit] = end
                yield start, end, unit


def _digested(min_words: int, row: bool = False) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            hashes, keys, starts, sizes, again, rows = [], [], [], [], [], []
            for key, text, own in zip(batch["key"].tolist(), batch["text"], batch[ROW if row else "key"].tolist(), strict=True):
                seen: set[bytes] = set()
                for start, end, unit in units(text, min_words):
                    h = digest(unit.encode("utf-8", "replace"))
                    hashes.append(h)
                    keys.append(key)
                    rows.append(own)
                    starts.append(start)
                    sizes.append(end - start)
                    again.append(h in seen)
                    seen.add(h)
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"h1": halves[:, 0], "h2": halves[:, 1], "key": np.array(keys, np.int64), "start": np.array(starts, np.int32), "size": np.array(sizes, np.int32), "again": np.array(again, bool)} | ({ROW: np.array(rows, np.int64)} if row else {}))

    return run


def _gone(docs: DataFrame, min_words: int, *row: str) -> DataFrame:
    """(key, start, size, kept, and ``row`` if given) of the units that go."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), "text", *row)
    schema = "h1 long, h2 long, key long, start int, size int, again boolean" + "".join(f", {r} long" for r in row)
    found = saved(rows.mapInPandas(_digested(min_words, bool(row)), schema), "units")
    keepers = found.groupBy("h1", "h2").agg(F.min("key").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.join(keepers, ["h1", "h2"]).where(F.col("again") | (F.col("key") > F.col("kept")))


def repeated_units(docs: DataFrame, min_words: int = 6) -> DataFrame:
    """(doc_id, start, end, kept_doc_id) of every unit that goes; ``start`` and ``end`` are offsets in the text."""
    gone = _gone(docs, min_words)
    named = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return gone.select(named("key").alias("doc_id"), F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("end"), named("kept").alias("kept_doc_id"))


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` less its ``spans``."""
    if text is None:
        return None
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans = [[] if s is None else [(x["start"], x["end"]) for x in s] for s in batch[SPANS]]
        yield batch.drop(columns=SPANS).assign(text=[without_spans(t, s) for t, s in zip(batch["text"], spans, strict=True)])


def deduplicated(docs: DataFrame, min_words: int = 6) -> DataFrame:
    """The documents without the units that go; all columns stay.

    Each row loses what repeats in its own text: rows get a key, under which their spans come back, so rows that share an
    id don't lose each other's spans, and rows without one lose what an identified row has.
    """
    keyed = saved(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    spans = _gone(keyed, min_words, ROW).groupBy(ROW).agg(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias(SPANS))
    return keyed.join(spans, ROW, "left").select(*docs.columns, SPANS).mapInPandas(_cut, docs.schema)
