"""The pipeline on a made corpus: every stage against brute force on what the stage before it kept."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from civicmill.llm.toxicity import toxicity_scores
from tests.llm.test_operators import greedy, shares

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of the smallest tables, copies with added and cut tails, passages of items, turned ones, and odd rows."""
    folder = tmp_path_factory.mktemp("corpus")
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    rows = docs.collect()
    long = [r for r in rows if r["text"] and 80 < len(r["text"].split()) < 400][:12]
    made = []
    for k, r in enumerate(long):
        words = r["text"].split()
        made.append((5000 + k, " ".join([*words, *(f"tail{k}x{j}" for j in range((k % 4) * len(words) // 14))]), "en", f"copies{k % 2}", 1))
        made.append((5100 + k, " ".join(words[: len(words) * (9 - k % 3) // 9]), "en", None, 1))
    for k, item in enumerate(items[:6]):
        words = item["text"].split()
        half = len(words) // 2
        made.append((6000 + k, " ".join([f"own{k}x{j}" for j in range(30)] + words[half:] + ["between"] + words[:half]), "en", "leaks", 1))
        made.append((6100 + k, " ".join([f"more{k}x{j}" for j in range(60)] + words[: len(words) // 4]), "en", "leaks", 1))
    made += [(7000, None, "en", None, 1), (7001, "", "en", None, 1), (7002, " \n", "en", "a", 1), (7003, "One short text.", "en", "a", 1), (7004, "one  short text.", "en", "a", 1)]
    docs.unionByName(spark.createDataFrame(made, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def similar_groups(texts: dict) -> dict:
    """Smallest id of each group of texts whose sets of five-word shingles share 0.8 or more."""
    def shingles(text):
        words = (text or "").encode("utf-8", "replace").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in root}


def leaks(text, items) -> bool:
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    own = words(text)
    near = {tuple(own[k : k + 4]) for k in range(len(own) - 3)}
    for item in map(words, items):
        if any(tuple(item[k : k + 4]) in near for k in range(len(item) - 3)):
            places = [k for k in range(len(own) - 3) if tuple(own[k : k + 4]) in {tuple(item[j : j + 4]) for j in range(len(item) - 3)}]
            around = own[max(0, places[0] - 100) : places[-1] + 100] if places[-1] - places[0] < 300 else own
            found = greedy(item, around, 4)
            if sum(n for *_, n in found) >= 0.5 * len(item) or any(n >= 30 for *_, n in found):
                return True
    return False


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    before = docs
    for name in ("toxicity", "near_duplicates", "decontamination", "mixing"):
        rows = stages[name](spark, before, corpus).collect()
        kept[name], before = rows, spark.createDataFrame(rows, docs.schema)
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}

    everything = {r["doc_id"]: r["text"] for r in docs.collect()}
    rejected = {r["doc_id"] for r in toxicity_scores(docs, spark.read.parquet(f"{corpus}/labels.parquet")).where("predicted = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{corpus}/labels.parquet").where("toxic = 0").collect()}
    assert ids["toxicity"] == set(everything) - rejected and rejected and len(rejected & clean) < len(clean) / 10  # few labels to learn from

    groups = similar_groups({i: everything[i] for i in ids["toxicity"]})
    assert ids["near_duplicates"] == set(groups.values()) and len(kept["near_duplicates"]) == len(ids["near_duplicates"])
    assert max(Counter(groups.values()).values()) >= 3

    items = [r["text"] for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    assert ids["decontamination"] == {i for i in ids["near_duplicates"] if not leaks(everything[i], items)}
    assert ids["near_duplicates"] - ids["decontamination"] >= {6000 + k for k in range(6)} & ids["near_duplicates"]

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in kept["decontamination"]:
        sizes[r["source"]] += size(r["text"])
    for r in kept["mixing"]:
        taken[r["source"]] += size(r["text"])
    assert ids["mixing"] <= ids["decontamination"] and max(Counter(r["doc_id"] for r in kept["mixing"]).values()) <= 3
    assert all(abs(taken[s] - want) <= max((size(r["text"]) for r in kept["decontamination"] if r["source"] == s), default=0) for s, want in shares(sizes).items())

    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(kept["mixing"], key=lambda r: r["doc_id"]):
        tokens = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(tokens), zlib.crc32(tokens.tobytes())))
        start += len(tokens)
    assert sorted(tuple(r) for r in stages["records"](spark, before, corpus).collect()) == sorted(want)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, corpus).collect()) == sorted(want)
