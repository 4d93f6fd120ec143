"""Full-text search: an inverted index, prefix conjunction, BM25, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.functions.text import normalise


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf, length): one row per distinct token of a document."""
    words = docs.select(key, F.filter(F.split(normalise(F.col(text)), " "), lambda w: w != "").alias("words"))
    tokens = words.select(key, F.size("words").alias("length"), F.explode("words").alias("token"))
    return tokens.groupBy("token", key, "length").agg(F.count("*").alias("tf"))


def query_tokens(search: str, most: int = 8, shortest: int = 2) -> list[str]:
    """Distinct prefixes of a search string, at most ``most``."""
    import re
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", search.lower()) if not unicodedata.combining(c))
    return list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", bare) if len(t) >= shortest))[:most]


def search(docs: DataFrame, key: str, text: str, wanted: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents that hold a word for each prefix, scored by BM25.

    Statistics cover all documents; only words under a prefix are shuffled, as counts per document.
    """
    prefixes = query_tokens(wanted)
    # An exploded array of one keeps filters on counts from being pushed below, where each would normalise the text again.
    plain = docs.select(key, F.explode(F.array(normalise(F.coalesce(F.col(text), F.lit(""))))).alias("plain"))
    blanks = F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit("")))
    counts = [F.regexp_count(F.concat(F.lit(" "), "plain"), F.lit(f" {p}")).alias(f"tf{i}") for i, p in enumerate(prefixes)]
    hits = plain.select(key, F.when(F.col("plain") == "", 0).otherwise(blanks + 1).alias("length"), *counts)
    known = hits.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(prefixes))])
    rows = hits.where(" AND ".join(f"tf{i} > 0" for i in range(len(prefixes))) or "false").join(F.broadcast(known))  # one row
    score: Column = F.lit(0.0)
    for i in range(len(prefixes)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return rows.select(key, F.round(score, 6).alias("score"))


def snippet(text: Column, word: str, before: int = 40, after: int = 80) -> Column:
    """The surroundings of a word's first place, with the word marked."""
    at = F.locate(word, F.lower(text))
    begin = F.greatest(at - before, F.lit(1))
    head, hit, tail = F.substring(text, begin, at - begin), F.substring(text, at, F.lit(len(word))), F.substring(text, at + len(word), F.lit(after))
    return F.when(at > 0, F.concat(F.lit("…"), head, F.lit("<mark>"), hit, F.lit("</mark>"), tail, F.lit("…")))
