"""The paged source: every record once, in batch and as a stream, also after restarts."""

from __future__ import annotations

import tempfile
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from civicmill.plans import sources as plan
from civicmill.sources.paged import FolderService, PagedSource, publish, windows

SCHEMA = "id long, label string, worth double"


def folder() -> str:
    return tempfile.mkdtemp(prefix="spark-paged-", dir="/tmp")


def published(spark, path, days, each=7, first=0):
    rows = [(first + 1000 * d + i, f"é{i}" if i % 3 else None, i / 4, datetime(2021, 12, 20) + timedelta(days=d)) for d in days for i in range(each)]
    publish(spark.createDataFrame(rows, "id long, label string, worth double, at timestamp"), "at", path)
    return sorted(r[:3] for r in rows)


def test_windows():
    per_day = {date(2020, 1, 1) + timedelta(days=i): i % 5 for i in range(900)}
    per_day[date(2021, 3, 4)] = 5000
    count = lambda a, b: sum(n for d, n in per_day.items() if a <= d < b)
    found = list(windows(count, date(2019, 1, 1), date(2024, 1, 1), 100))
    assert sum(count(w.start, w.end) for w in found) == sum(per_day.values())
    assert all(count(w.start, w.end) <= 100 or (w.end - w.start).days == 1 for w in found) and all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))
    assert list(windows(count, date(2030, 1, 1), date(2031, 1, 1), 100)) == []


def test_pages_follow_their_cursor(spark):
    path = folder()
    want = published(spark, path, range(5))
    service, cursor, seen = FolderService(f"file://{path}", 4), None, []
    while True:
        records, cursor = service.page(date(2021, 12, 20), date(2022, 1, 1), cursor)
        assert len(records) <= 4
        seen += [r["id"] for r in records]
        if cursor is None:
            break
    assert sorted(seen) == [r[0] for r in want]


def test_batch(spark):
    spark.dataSource.register(PagedSource)
    path = folder()
    want = published(spark, path, range(40))
    read = lambda **more: spark.read.format("paged").schema(SCHEMA).options(path=path, pageSize=3, cap=20, **more).load()
    assert sorted(tuple(r) for r in read().collect()) == want and read().rdd.getNumPartitions() > 10
    part = read(start="2021-12-30", end="2022-01-02")
    assert sorted(r["id"] for r in part.collect()) == [r[0] for r in want if 10_000 <= r[0] < 13_000]
    assert spark.read.format("paged").schema(SCHEMA).options(path=folder()).load().count() == 0


def test_stream_goes_on_after_restarts(spark):
    spark.dataSource.register(PagedSource)
    path, out, checkpoint = folder(), folder(), folder()

    def run():
        stream = spark.readStream.format("paged").schema(SCHEMA).options(path=path, pageSize=3, cap=20, start="2021-01-01").load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start(out)
        query.processAllAvailable()
        query.stop()
        return sorted(tuple(r) for r in spark.read.schema(SCHEMA).parquet(out).collect()), query.lastProgress

    want = published(spark, path, range(10))
    assert run()[0] == want
    assert run()[0] == want  # nothing new
    want = sorted(want + published(spark, path, range(10, 14)))
    got, progress = run()
    assert got == want and progress["batchId"] >= 2


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = plan.paged_events(spark, sf)
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    assert sorted(map(str, got.collect())) == sorted(map(str, events.collect()))
