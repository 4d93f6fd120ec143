"""Window-style operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicmill.operators import windows as w
from civicmill.plans.base import query
from civicmill.sources.tables import table

EURO = "decimal(18,2)"


@query("W01_latest_order", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return w.first_per_key(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("W02_latest_value", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS last_value, max(ts) AS last_ts FROM events GROUP BY ALL")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.max("ts").alias("last_ts"))


@query("W03_first_by_priority", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "5-LOW", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    return w.first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], rank, F.col("o_orderkey"))


@query("W04_top_parts_per_supplier", """SELECT l_suppkey, l_partkey, total, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY total DESC, l_partkey) AS rank
    FROM (SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY ALL)) WHERE rank <= 5""")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_extendedprice").cast(EURO)).cast("double").alias("total"))
    return w.top_per_key(sums, ["l_suppkey"], 5, F.desc("total"), F.col("l_partkey"))


@query("A25_pareto", """WITH s AS (SELECT l_returnflag, l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS t FROM lineitem GROUP BY ALL),
    r AS (SELECT *, sum(t) OVER d AS run, row_number() OVER d AS n, sum(t) OVER (PARTITION BY l_returnflag) AS total FROM s WINDOW d AS (PARTITION BY l_returnflag ORDER BY t DESC, l_suppkey ROWS UNBOUNDED PRECEDING))
    SELECT l_returnflag, count(*) AS n_keys, CAST(min(CASE WHEN run * 2 >= total THEN n END) AS INTEGER) AS k50, CAST(min(CASE WHEN run * 5 >= total * 4 THEN n END) AS INTEGER) AS k80 FROM r GROUP BY l_returnflag""")
def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast(EURO)).alias("amount"))
    return w.pareto(sums, ["l_returnflag"], "l_suppkey", "amount")


@query("W05_running_total", "SELECT o_custkey, o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum(F.col("o_totalprice").cast(EURO)).over(over).cast("double").alias("running"))


@query("W06_same_day_as_previous", "SELECT user_id, event_id, coalesce(CAST(ts AS DATE) = lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS same_day FROM events")
def same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce(day == F.lag(day).over(over), F.lit(False)).alias("same_day"))


@query("W07_longest_runs", """WITH d AS (SELECT DISTINCT user_id, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM d),
    g AS (SELECT user_id, CAST(min(day) AS INTEGER) AS start, CAST(max(day) AS INTEGER) AS "end", count(*) AS length FROM i GROUP BY user_id, island)
    SELECT user_id, start, "end", length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start DESC) AS n FROM g) WHERE n = 1""")
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", F.unix_date(F.to_date("ts")).alias("day"))
    return w.longest_run(days, ["user_id"], "day")


@query("W08_median_gap", "SELECT user_id, median(gap) AS median_gap FROM (SELECT user_id, CAST(datediff('day', CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE), CAST(ts AS DATE)) AS DOUBLE) AS gap FROM events) WHERE gap IS NOT NULL GROUP BY user_id")
def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gaps = table(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.to_date(F.lag("ts").over(over))).cast("double").alias("gap"))
    return gaps.where("gap IS NOT NULL").groupBy("user_id").agg(F.median("gap").alias("median_gap"))


@query("W09_last_three", "SELECT user_id, count(*) FILTER (event_type = 'error') = 3 AS all_errors FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3 GROUP BY user_id")
def last_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = w.top_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], 3, F.desc("ts"), F.desc("event_id"))
    return last.groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") == 3).alias("all_errors"))


@query("W10_carry_forward", """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return rows.select("user_id", "event_id", w.carried("bought", ["user_id"], F.col("ts"), F.col("event_id")).alias("last_purchase"))


@query("W12_best_of_near", """WITH RECURSIVE r AS (
    SELECT o_orderkey, o_custkey % 200 AS amount, o_orderdate AS day, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_totalprice DESC, o_orderkey) AS nth
    FROM (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 200 > 0 THEN CAST(o_orderdate AS DATE) END AS o_orderdate FROM orders)
), walk AS (
    SELECT amount, CAST(0 AS BIGINT) AS nth, CAST([] AS STRUCT(o_orderkey BIGINT, day DATE)[]) AS kept FROM (SELECT DISTINCT amount FROM r)
    UNION ALL
    SELECT w.amount, r.nth, CASE WHEN len(list_filter(w.kept, lambda k: k.day IS NULL OR r.day IS NULL OR abs(datediff('day', k.day, r.day)) <= 200)) = 0 THEN list_append(w.kept, {'o_orderkey': r.o_orderkey, 'day': r.day}) ELSE w.kept END
    FROM walk w JOIN r ON r.amount = w.amount AND r.nth = w.nth + 1
)
SELECT amount, unnest(arg_max(kept, nth)).o_orderkey AS o_orderkey FROM walk GROUP BY amount""")
def best_of_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of orders of one amount within 200 days the dearest one stays; some orders have no date."""
    day = F.when(F.col("o_orderkey") % 200 > 0, F.to_date("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("amount"), day.alias("day"), "o_totalprice")
    return w.best_of_near_repeats(rows, ["amount"], "day", 200, F.desc("o_totalprice"), F.col("o_orderkey")).select("amount", "o_orderkey")


@query("W12_near_repeats", """WITH RECURSIVE r AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
    g AS (SELECT o_orderkey, o_custkey, o_orderpriority, n, day AS last, true AS stays FROM r WHERE n = 1 UNION ALL SELECT r.o_orderkey, r.o_custkey, r.o_orderpriority, r.n, CASE WHEN r.day - g.last > 200 THEN r.day ELSE g.last END, r.day - g.last > 200
    FROM r JOIN g ON r.o_custkey = g.o_custkey AND r.o_orderpriority = g.o_orderpriority AND r.n = g.n + 1) SELECT o_orderkey FROM g WHERE stays""")
def near_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.without_near_repeats(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", 200, "o_orderkey").select("o_orderkey")


@query("W13_ranked_within", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def ranked_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("o_orderstatus", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(over).alias("rank"))


@query("J25_densified", """WITH s AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT k.l_suppkey, y.year, s.n FROM (SELECT DISTINCT l_suppkey FROM s) k CROSS JOIN (SELECT DISTINCT year FROM s) y LEFT JOIN s ON s.l_suppkey = k.l_suppkey AND s.year = y.year""")
def densified(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    return w.densified(counts, "l_suppkey", "year")


@query("A28_yearly_evolution", """WITH y AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL)
    SELECT o_orderpriority, year, total, round(100 * (total - lag(total) OVER w) / nullif(lag(total) OVER w, 0), 2) AS change FROM y WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year)""")
def evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast(EURO)).cast("double").alias("total"))
    before = F.lag("total").over(Window.partitionBy("o_orderpriority").orderBy("year"))
    return totals.withColumn("change", F.round(100 * (F.col("total") - before) / F.nullif(before, F.lit(0.0)), 2))
