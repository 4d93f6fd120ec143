"""Incremental loads with Structured Streaming: what is new since the checkpoint, merged idempotently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the rows of files that arrive in ``folder``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def load_available(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> None:
    """Everything that is there now, batch by batch, then stop; a batch that runs twice must merge to the same state."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_new(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A merge that appends rows with unseen keys, as files of the batch's own folder, so that a rerun overwrites them."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        if number:
            seen = spark.read.parquet(path).where(F.col("batch") < number)
            rows = rows.join(seen.select(*keys), keys, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def high_water(rows: DataFrame, keys: list[str], date: str, start: str) -> DataFrame:
    """(keys, since): where to go on from, per key."""
    return rows.groupBy(*keys).agg(F.coalesce(F.max(date).cast("string"), F.lit(start)).alias("since"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window and key; the same plan over a stream (with its watermark) and over a table."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per key: events with less than ``gap`` between them."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    return events.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def listed(pages: DataFrame) -> DataFrame:
    """Rows (source, page, key) of paged listings as a reader takes them that stops at the first page without a new key.

    Pages count from 1; a key counts on the first page that shows it. A page that is not there ends the listing too.
    """
    first = pages.groupBy("source", "key").agg(F.min("page").alias("page"))
    news = first.select("source", "page").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("page")))
    return first.join(news.where("page = nth").select("source", "page"), ["source", "page"]).select("source", "page", "key")
