"""Hard negatives against scoring everything, and the bounds of the product quantisation."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicmill.llm import hard_negatives as hn
from civicmill.llm import queries

KIND = "vec_id long, embedding array<float>, label int, row string, v string"


def brute(rows, is_anchor, scale, k=5, least=80):
    fit = []
    for vec_id, x, label in rows:
        if None in (vec_id, x, label) or any(c is None or not math.isfinite(c) for c in x):
            continue
        fit.append((vec_id, label, [math.floor(scale * float(np.float32(c))) for c in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    anchors: dict = {}
    for vec_id, label, v in fit:
        if is_anchor(vec_id):
            anchors[vec_id] = min(anchors.get(vec_id, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        others = [(-dot(v, w), i, other) for i, other, w in fit if i != a]
        for s, p, _ in sorted(x for x in others if x[2] == label)[:k]:
            inside = [x for x in others if x[2] != label and least * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(sorted(inside)[:k], 1)]
    return sorted(out)


def mined(spark, rows, scale=256, **more):
    frame = spark.createDataFrame([(*r, "r", "v") for r in rows], KIND)
    found = hn.hard_negatives(frame, F.col("label"), F.col("vec_id") % 10 == 0, scale, **more)
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(10)] for _ in range(4)]
    made = [(i, [c + rng.gauss(0, 0.5) for c in centres[i % 4]], i % 4 if rng.random() < 0.8 else 0) for i in range(400)]
    made += [(1000 + i, made[0][1], 7) for i in range(120)]  # a vector that many rows share, ties
    return made + [(10, made[3][1], 2), (13, made[5][1], 1), (13, made[5][1], 1), (None, [1.0] * 10, 1), (20, None, 1), (21, [1.0, None] * 5, 1), (22, [float("nan")] * 10, 1), (23, [float("inf")] * 10, 1), (24, [1.0] * 10, None), (25, [], 1), (2000, [0.5, -0.5], 3)]


def test_as_scoring_everything(spark, rows):
    want = brute(rows, lambda i: i % 10 == 0, 256)
    assert len(want) > 500
    assert mined(spark, rows) == want
    assert mined(spark, rows, block_rows=150, anchor_rows=20, sample=40) == want


def test_small_and_empty(spark, rows):
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, [-1.0, 0.0], 2), (4, [0.1, 0.0], 3)]
    assert mined(spark, few, 10) == brute(few, lambda i: i % 10 == 0, 10) == [(0, 1, 1, 2, 100, 80)]
    assert mined(spark, rows[:0]) == [] and mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(ArithmeticError):
        mined(spark, [(0, [1e30], 1)])


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-2000, 2000, (300, 10))
    book = hn.codebook(x[:50].astype(float))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"vec_id": np.arange(300), "label": np.zeros(300, int), "row": np.arange(300), "v": list(x)})
    block = hn.Block(pa.Table.from_batches(hn._encoder(book, 10)([batch])), book, 10)
    for i, low, high in block.bounded(x):
        scores = x @ x[i]
        assert (low <= scores).all() and (scores <= high).all()
    assert (high - low).mean() < 4 * np.abs(scores).max()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, sf).collect()) == brute(rows, lambda i: i % 100 == 0, 256)
