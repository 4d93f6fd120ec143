"""Values that are used often are computed once, and slices leave a task in bounded batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from civicmill.functions.text import flow_label
from civicmill.operators import approvals, budgets, extract
from civicmill.plans.details import normal_forms


def uses(df, what: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_labels_are_split_once_a_dash(spark):
    df = spark.range(1).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("label")).select(flow_label(F.col("label"), F.lit("ACTOR"), F.col("label")).alias("x"))
    assert uses(df, "split(") <= 12


def test_sums_and_owners_are_read_once(spark):
    text = spark.createDataFrame([("1 000,50 | 2 000,00 3",)], "t string")
    assert text.select(budgets.last_amount(F.col("t"))).first()[0] == 2000.0
    assert uses(text.repartition(1).select(budgets.last_amount(F.col("t")).alias("x")), "regexp_extract(") == 3
    assert uses(text.repartition(1).select(approvals.owner(F.col("t")).alias("x")), "regexp_extract_all(") == 1


def test_texts_are_folded_once(spark, tmp_path):
    spark.createDataFrame([(1, "Éa ﬀ œ"), (2, "plain's"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = normal_forms(spark, str(tmp_path))
    assert uses(df, "translate(") == 1
    assert sorted((r["doc_id"], r["hyphened"]) for r in df.collect()) == [(1, "ea oe"), (2, "plain's"), (3, None)]


def test_slices_leave_in_bounded_batches():
    texts = ["x" * 3_000_000] * 3 + [None, "a\nb"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["id", "text"])
    out = list(extract._chunked(iter([batch]), "id", 2000, 200))
    assert len(out) > 2 and all(sum(map(len, b["chunk"].to_pylist())) < extract.HELD + 2000 for b in out)
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(k, n, begin, part) for k, t in enumerate(texts) for n, (begin, part) in enumerate(extract.chunks(t or "", 2000, 200))]
