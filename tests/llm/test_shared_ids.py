"""Rows that share an id, rows without one, and files that stay short."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from civicmill.llm.substrings import deduplicated
from civicmill.llm.topk import top_k
from civicmill.llm.warc import archived


def test_documents_lose_their_own_repeats_only(spark):
    shared = "this very line of words is found in many places."
    other = "A text of its own that stands under the same number as another one does."
    rows = [(1, shared), (7, f"Opening words of number seven are here. {shared}"), (7, other), (7, None), (None, f"{shared} Words that nobody else has said before now."), (None, other), (8, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = sorted(((r["doc_id"], r["text"], r["spans"]) for r in deduplicated(docs).collect()), key=str)
    cut = [(1, shared), (7, "Opening words of number seven are here. "), (7, other), (7, None), (None, " Words that nobody else has said before now."), (None, ""), (8, "")]
    assert got == sorted(((i, t, "x") for i, t in cut), key=str)
    assert deduplicated(docs.limit(0)).count() == 0


def test_blocks_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(2)
    rows = [(7 if i % 4 else i, rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(2000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(table, F.col("vec_id") % 400 == 0, k=6, scale=1, block_rows=128).collect()]
    want = []
    for q, v in rows:
        if q % 400 == 0:
            best = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:6]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want) and len(got) == 30
    dealt = spark.createDataFrame([(7,)] * 4000, "vec_id long").withColumn("row", F.monotonically_increasing_id())
    sizes = dealt.groupBy(F.pmod(F.xxhash64("row"), F.lit(16)).alias("b")).count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 2 * 4000 / 16


def test_archives_stay_short_on_both_sides(spark, tmp_path):
    """Also where decisions are too many to broadcast, and whole files are shuffled to them."""
    pages = spark.createDataFrame([(k if k % 9 else None, "http://a", ("é" * 900_000 if k == 5 else f"page {k % 40} ") * (1 if k == 5 else 50)) for k in range(600)], "page_id long, url string, html string").coalesce(2)
    small = pages.where("page_id IS NULL OR page_id <> 5")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(archived(small, path=f"file://{tmp_path}/a", archive_bytes=1 << 14).collect()) == 599
        arc, warc = (sorted(f.stat().st_size for f in tmp_path.glob(f"a/{side}/*.gz")) for side in ("arc", "warc"))
        assert len(warc) > 20 and warc[-1] < 8 * arc[-1]
        got = archived(pages, path=f"file://{tmp_path}/b", archive_bytes=1 << 16).collect()
        assert len(got) == 600 and max(r["payload_bytes"] for r in got) == 1_800_000
        assert sum(r["page_id"] is None for r in got) == 67
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archived(empty).count() == 0
