"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: how densely it uses an insult list and a lexicon mined from labelled training rows, how near
those words stand to a second person, capitals, punctuation, and obfuscated spellings. The lexicon holds words and word
beginnings whose log-odds between toxic and other labelled documents stand out. While the trees are fitted, a training
document's features use the lexicon of the other folds, so the trees never see a lexicon that its label helped to
choose; every row is then scored with the whole lexicon, so equal texts have equal scores, labelled or not.

The model is fitted on at most ``sample`` labelled rows, chosen by hash; everything else covers every row. Trees and
calibration are Spark ML's; the mined lexicon has at most ``lexicon`` entries. Features take time in proportion to the
text, whatever it holds: the patterns never try a run of letters twice.

Edge cases: null and empty texts have all features 0 and are scored like any other; null labels and null ids teach
nothing; of several labels of a document the largest counts, of several texts the smallest teaches; without both labels among the training rows every score is
the share of label 1; repeated rows each get a row; an empty table gives an empty result; other columns are not looked
at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.llm.common import saved, small_batches

#: Common insults, English first.
INSULTS = frozenset(
    "idiot idiots moron morons stupid scum loser losers trash clown pathetic worthless disgusting dumb fool garbage filth vermin imbecile "
    "cretin jerk freak pig rat coward creep degenerate hate kill ugly retard bastard crap damn hell suck sucks screw shut liar "
    "connard imbécile crétin ordure salaud débile abruti raclure trottel dummkopf abschaum versager drecksau widerlich "
    "estúpido imbécil basura escoria inútil asqueroso patético".split()
)
#: Second persons in four languages.
SECOND_PERSONS = frozenset("you your yours yourself u ur tu toi te ton ta vous votre du dich dir dein deine euch ihr usted ustedes tú vos".split())
#: What digits and signs stand for in disguised words.
LEET = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?:[*@$!#%&0-9]++[A-Za-z]++)++")
SHOUT = re.compile(r"[!?]{2,}")
FEATURES = ("log_words", "insults", "insult_rate", "mined", "mined_rate", "mined_weight", "mined_most", "mined_kinds", "near_you", "near_you_rate", "you_rate", "capitals", "shouted_words", "exclaims", "questions", "signs", "digits", "runs", "disguised", "disguised_hits")
PREFIXES = (4, 5)


def tokens_of(words: set[str]) -> set[str]:
    """Words and word beginnings under which a lexicon can list them."""
    out = set(words)
    for n in PREFIXES:
        out |= {f"{w[:n]}*" for w in words if len(w) > n}
    return out


def weight_of(word: str, lexicon: dict[str, float]) -> float:
    found = lexicon.get(word, 0.0)
    for n in PREFIXES:
        if len(word) > n:
            found = max(found, lexicon.get(f"{word[:n]}*", 0.0))
    return found


def features(text: str | None, lexicon: dict[str, float], known: dict[str, float]) -> list[float]:
    """``known``: a bounded memo of words' lexicon weights."""
    if not text:
        return [0.0] * len(FEATURES)
    words = WORD.findall(text.lower())
    n, counts = len(words) or 1, Counter(words)
    for w in counts:
        if w not in known:
            known[w] = weight_of(w, lexicon)
    hits = {w: known[w] for w in counts if known[w] > 0}
    insults = sum(counts[w] for w in INSULTS & counts.keys())
    mined = sum(counts[w] for w in hits)
    marked = hits.keys() | (INSULTS & counts.keys())
    near, persons = 0, sum(counts[w] for w in SECOND_PERSONS & counts.keys())
    if marked and persons:
        at = np.array([-6, *(i for i, w in enumerate(words) if w in SECOND_PERSONS), len(words) + 6])
        places = np.array([i for i, w in enumerate(words) if w in marked])
        after = np.searchsorted(at, places)
        near = int(np.sum((at[after] - places <= 5) | (places - at[after - 1] <= 5)))
    octets = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)
    size = int(octets.sum())
    letters = int(octets[65:91].sum() + octets[97:123].sum()) or 1
    disguised = DISGUISED.findall(text)
    plain = Counter()
    for d, k in Counter(disguised).items():
        plain[re.sub(r"[^a-z]", "", d.lower().translate(LEET))] += k
    return [
        math.log1p(len(words)),
        insults,
        insults / n,
        mined,
        mined / n,
        sum(counts[w] * x for w, x in hits.items()) / n,
        max(hits.values(), default=0.0),
        len(hits),
        near,
        near / n,
        persons / n,
        int(octets[65:91].sum()) / letters,
        sum(1 for w in re.findall(r"\b[A-Z]{3,}\b", text)) / n,
        int(octets[33]) / size,
        int(octets[63]) / size,
        int(octets[[35, 36, 37, 38, 42, 64]].sum()) / size,
        int(octets[48:58].sum()) / size,
        len(SHOUT.findall(text)) / n,
        len(disguised) / n,
        sum(k for w, k in plain.items() if w in INSULTS or weight_of(w, lexicon) > 0),
    ]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels teach nothing."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def training_sample(labels: DataFrame, sample: int, folds: int) -> DataFrame:
    """(labelled_id, toxic, fold) of at most about ``sample`` labelled training rows, chosen by hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = F.pmod(F.xxhash64("labelled_id", F.lit("sample")), F.lit(1 << 53)) < int(min(1.0, sample / max(n, 1)) * (1 << 53))
    return saved(known.where(share).withColumn("fold", F.pmod(F.xxhash64("labelled_id", F.lit("fold")), F.lit(folds)).cast("int")), "labelled")


def _mined_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found: dict[tuple[str, int], list[int]] = {}
        for text, toxic, fold in zip(batch["text"], batch["toxic"].tolist(), batch["fold"].tolist(), strict=True):
            for token in tokens_of(set(WORD.findall((text or "").lower()))):
                found.setdefault((token, fold), [0, 0])[toxic != 1] += 1
        yield pd.DataFrame([(t, fold, p, q) for (t, fold), (p, q) in found.items()], columns=["token", "fold", "p", "q"])


def mined_lexicons(texts: DataFrame, n: dict[int, tuple[int, int]], lexicon: int, least_log_odds: float = 2.0, z: float = 2.5) -> dict[int, dict[str, float]]:
    """fold -> lexicon from all other folds; -1 -> from all. ``n``: fold -> (label 1, label 0) documents."""
    counts = texts.mapInPandas(_mined_tokens, "token string, fold int, p long, q long").groupBy("token", "fold").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    by_token = counts.groupBy("token").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.collect_list(F.struct("fold", "p", "q")).alias("folds")).where("p >= 4")
    ahead = F.log((F.col("p") + 0.5) / (F.col("q") + 0.5))
    top = by_token.orderBy(ahead.desc(), F.col("p").desc(), "token").limit(lexicon).collect()
    out: dict[int, dict[str, float]] = {}
    for fold in (-1, *n):
        toxic = sum(a for k, (a, _) in n.items() if k != fold)
        clean = sum(b for k, (_, b) in n.items() if k != fold)
        found = out[fold] = {}
        for row in top:
            own = next(((f["p"], f["q"]) for f in row["folds"] if f["fold"] == fold), (0, 0))
            p, q = row["p"] - own[0], row["q"] - own[1]
            odds = math.log((p + 0.5) / (toxic - p + 0.5)) - math.log((q + 0.5) / (clean - q + 0.5))
            if p >= 3 and odds >= least_log_odds and odds >= z * math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)):
                found[row["token"]] = odds
    return out


def _featured(lexicons: dict[int, dict[str, float]], keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, dict[str, float]] = {k: {} for k in lexicons}
        for batch in batches:
            rows = []
            for text, fold in zip(batch["text"], batch["fold"], strict=True):
                if len(known[fold]) > 200_000:
                    known[fold].clear()
                rows.append(features(text, lexicons[fold], known[fold]))
            yield batch[keys].assign(features=rows)

    return run


def untaught(docs: DataFrame, share: float, keys: tuple[str, ...]) -> DataFrame:
    """The same score for every row, where the labels can't teach a difference."""
    score = F.lit(float(share))
    return docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), *keys)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = 12_000, lexicon: int = 4000, folds: int = 4, trees: int = 24, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. ``keys``: columns of ``docs`` that are carried along."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = training_sample(labels, sample, folds)
    n = {r["fold"]: (int(r["p"]), int(r["n"] - r["p"])) for r in chosen.groupBy("fold").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).collect()}
    toxic, clean = sum(p for p, _ in n.values()), sum(q for _, q in n.values())
    if not (toxic and clean):
        return untaught(docs, toxic / (toxic + clean) if n else 0.0, keys)
    labelled = docs.select(F.col("doc_id").cast("long").alias("labelled_id"), "text").join(F.broadcast(chosen), "labelled_id")  # at most ``sample`` rows
    labelled = saved(labelled.groupBy("labelled_id", "toxic", "fold").agg(F.min("text").alias("text")), "training")
    kinds = {r["toxic"] for r in labelled.select("toxic").distinct().collect()}
    if len(kinds) < 2:  # of the labelled rows none, or of one label only, are among the documents
        return untaught(docs, max(kinds, default=0.0), keys)
    lexicons = mined_lexicons(labelled.select("text", "toxic", "fold"), n, lexicon)

    rows = labelled.mapInPandas(_featured(lexicons, ["labelled_id", "toxic"]), "labelled_id long, toxic int, features array<double>")
    taught = rows.select(array_to_vector("features").alias("vector"), F.col("toxic").cast("double").alias("toxic"), (F.pmod(F.xxhash64("labelled_id", F.lit("calibrate")), F.lit(4)) == 0).alias("calibrates"))
    taught = saved(taught.coalesce(4), "taught")
    fit = taught.where(~F.col("calibrates"))
    if fit.select("toxic").distinct().count() < 2:
        fit = taught
    model = GBTClassifier(featuresCol="vector", labelCol="toxic", maxIter=trees, maxDepth=4, stepSize=0.2, minInstancesPerNode=4, seed=7).setProbabilityCol("chances").fit(fit)
    raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("chances")[1])
    judged = raw(taught.where("calibrates")).select("raw", "toxic")
    if judged.select("toxic").distinct().count() < 2:
        judged = raw(taught).select("raw", "toxic")
    assemble = VectorAssembler(inputCols=["raw"], outputCol="raw_vector")
    calibration = IsotonicRegression(featuresCol="raw_vector", labelCol="toxic", predictionCol="calibrated").fit(assemble.transform(judged))

    carried = [f"carried{k}" for k in range(len(keys))]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.col("doc_id").isNotNull().alias("known"), F.lit(-1).alias("fold"), "text", *[F.col(k).alias(c) for k, c in zip(keys, carried, strict=True)])
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("key", "known", *carried)) + ", features array<double>"
    table = saved(rows.mapInPandas(_featured({-1: lexicons[-1]}, ["key", "known", *carried]), schema), "features")
    scored = calibration.transform(assemble.transform(raw(table.withColumn("vector", array_to_vector("features")))))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("raw")))  # the raw share orders equal steps
    doc_id = F.when(F.col("known"), F.col("key"))
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), *[F.col(c).alias(k) for k, c in zip(keys, carried, strict=True)])
