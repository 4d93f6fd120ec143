"""Event-time windows and incremental loads over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.plans.base import query
from civicmill.sources.tables import table
from civicmill.streaming import incremental


@query("X01_high_water", "SELECT user_id, event_type, coalesce(CAST(CAST(max(ts) AS DATE) AS VARCHAR), '2010-01-01') AS since FROM events GROUP BY ALL")
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return incremental.high_water(days, ["user_id", "event_type"], "day", "2010-01-01")


@query("X02_processed_difference", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) AND url IS NOT NULL)")
def processed_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"))
    done = pages.join(users, "page_id", "left_semi").select("url")
    return pages.where("url IS NOT NULL").join(done, "url", "left_anti").select("page_id")


@query("X06_buckets", "SELECT date_trunc('month', ts)::TIMESTAMP AS month, event_type, ts > TIMESTAMP '2024-01-20' AS upcoming, count(*) AS n FROM events GROUP BY ALL")
def buckets(spark: SparkSession, sf_dir: str, as_of: str = "2024-01-20") -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), "event_type", (F.col("ts") > F.lit(as_of).cast("timestamp_ntz")).alias("upcoming")).agg(F.count("*").alias("n"))


@query("EXT_tumbling_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: hourly windows of event time."""
    return incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query("EXT_session_windows", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_session FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, n_session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: sessions of a user."""
    return incremental.sessions(table(spark, sf_dir, "events"), "ts", "user_id")
