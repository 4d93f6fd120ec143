"""License scans with a positional rare-token index, in DataFrame functions throughout.

The index holds, for each template, the positions of its highest-IDF words, its anchors; document frequencies are
counted over all documents. All of a file's words that the index has are looked up in it. Every hit votes for a relative
position (place in the file minus place in the template); the votes' IDF weight, over the weight of all the template's
anchors, is how much of the template stands there in order. A template counts if that share reaches ``least`` and its
mandatory key phrase stands in the file. Beside it, base phrases are counted wherever their words stand in a row.

Only files that hold a key word at all, some per cent in ordinary text, are cut into words with positions.

Edge cases: null and empty texts have no words and no labels; places of base phrases are counted each; repeated rows
each get a row; null ids are kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of common licence notices, as words, and the phrase without which the label does not hold.
TEMPLATES = {
    "agpl-3.0": ("this program is free software licensed under the gnu affero general public license version 3", "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    "cc-by-4.0": ("this work is licensed under cc by 4 0", "cc by 4 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-sa-4.0": ("this work is licensed under cc by sa 4 0", "cc by sa 4 0"),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", "general public license version 2"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    "lgpl": ("licensed under the gnu lesser general public license", "lesser general public license"),
    "mit-notice": ("released under the mit license", "released under the mit license"),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "reserved": ("all rights reserved", "all rights reserved"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released into the public domain"),
}

#: A key word for every base phrase and key phrase: a file without any of them cannot hold one.
KEY_WORDS = ("license", "cc", "redistribution", "permission", "rights", "domain")

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
VOCABULARY = sorted({w for text, _ in TEMPLATES.values() for w in text.split()})


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` differs on other letters, which no key word holds, but for two that it makes ASCII."""
    turned = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.contains("İ") | text.contains("K"), turned).otherwise(F.lower(text))


def words_in(lowered: Column) -> Column:
    """The words of a lower-cased text, in order."""
    spaced = F.trim(F.regexp_replace(lowered, SEPARATORS, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the templates. At most a row per word comes back."""
    found = F.array_intersect(F.array(*map(F.lit, VOCABULARY)), words_in(ascii_lower(F.coalesce("text", F.lit("")))))
    rows = docs.select(F.explode_outer(found).alias("word")).groupBy("word").count().collect()
    return docs.count(), {r["word"]: r["count"] for r in rows if r["word"] is not None}


def weights(n: int, frequencies: dict[str, int]) -> dict[str, float]:
    """Smoothed IDF of each word of the templates, above zero also for words that every document holds."""
    return {w: 1 + math.log((1 + n) / (1 + frequencies.get(w, 0))) for w in VOCABULARY}


def rarest(words: set[str], idf: dict[str, float], n: int) -> list[str]:
    return sorted(words, key=lambda w: (-idf[w], w))[:n]


def postings(idf: dict[str, float], anchors: int) -> list[tuple[str, str, int, float, float]]:
    """(word, label, position, weight, weight of all the template's anchors)."""
    out = []
    for label, (text, _) in TEMPLATES.items():
        words = text.split()
        chosen = set(rarest(set(words), idf, anchors))
        whole = sum(idf[w] for w in words if w in chosen)
        out += [(w, label, i, idf[w], whole) for i, w in enumerate(words) if w in chosen]
    return out


def starts(words: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand in a row."""
    first, *rest = phrase.split()

    def here(w: Column, i: Column) -> Column:
        met = w == first
        for k, other in enumerate(rest, 1):
            met &= F.get(words, i + k) == other
        return F.when(met, i.cast("long"))

    return F.array_compact(F.transform(words, here))


def license_scan(docs: DataFrame, least: float = 0.75, anchors: int = 6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``anchors``: index words per template. ``score`` is the largest share of a verified template that stands in order,
    0 without one.
    """
    spark = docs.sparkSession
    n, frequencies = document_frequencies(docs)
    idf = weights(n, frequencies)
    index = F.broadcast(spark.createDataFrame(postings(idf, anchors), "word string, label string, place int, weight double, whole double"))  # of fixed size
    indexed = sorted({p[0] for p in postings(idf, anchors)})

    text = F.coalesce("text", F.lit(""))
    lowered = docs.select("doc_id", text.alias("text"), ascii_lower(text).alias("lowered"))
    keyed = F.lit(False)
    for word in KEY_WORDS:
        keyed |= F.col("lowered").contains(word)
    rows = lowered.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(keyed, F.sha2("text", 256)).alias("digest"), F.when(keyed, words_in(F.col("lowered"))).alias("words"))
    for label, phrase in zip(BASE_PHRASES.values(), BASE_PHRASES, strict=True):
        rows = rows.withColumn(label, F.when(F.col("words").isNotNull(), starts(F.col("words"), phrase)))

    files = lowered.where(keyed).select(F.sha2("text", 256).alias("digest"), words_in(F.col("lowered")).alias("words"))
    rare = F.array_intersect(F.array(*map(F.lit, indexed)), "words")
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    verified = F.array_compact(F.array(*[F.when(joined.contains(f" {phrase} "), F.lit(label)) for label, (_, phrase) in TEMPLATES.items()]))
    files = files.withColumns({"rare": rare, "verified": verified}).where((F.size("rare") > 0) & (F.size("verified") > 0)).dropDuplicates(["digest"])
    hits = files.select("digest", "rare", "verified", F.posexplode("words").alias("pos", "word")).where(F.array_contains("rare", F.col("word")))
    votes = hits.join(index, "word").where(F.array_contains("verified", F.col("label")))
    aligned = votes.groupBy("digest", "label", (F.col("pos") - F.col("place")).alias("shift")).agg((F.sum("weight") / F.first("whole")).alias("share"))
    best = aligned.groupBy("digest", "label").agg(F.max(F.least(F.round("share", 6), F.lit(1.0))).alias("share")).where(F.col("share") >= least)
    found = best.groupBy("digest").agg(F.collect_set("label").alias("found"), F.max("share").alias("score"))

    every = F.concat(*BASE_PHRASES.values())
    base = F.array_compact(F.array(*[F.when(F.size(label) > 0, F.lit(label)) for label in BASE_PHRASES.values()]))
    none = F.array().cast("array<string>")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    rows = rows.withColumn("digest", F.coalesce("digest", F.xxhash64("doc_id", "n_words").cast("string")))  # no heap of null keys
    out = rows.select("doc_id", "n_words", "digest", every.alias("every"), base.alias("base")).join(found, "digest", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("every"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("every").alias("first_word"),
        F.array_max("every").alias("last_word"),
        listed(F.coalesce("base", none)).alias("base_labels"),
        listed(F.concat(F.coalesce("base", none), F.coalesce("found", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
