"""Aggregations over the driver's tables. Money is summed as decimals, so sums do not hang on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.operators.edges import degrees
from civicmill.plans.base import query
from civicmill.sources.civic import CIVIC_SQL, civic
from civicmill.sources.tables import table


def money(c: str | Column) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


@query("A01_counts", "SELECT (SELECT count(*) FROM customer) AS n_customers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_closed, (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("n_customers"))
    orders = table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_closed"), F.count("*").alias("n_orders"))
    errors = table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "error").alias("n_errors"))
    return customers.join(F.broadcast(orders)).join(F.broadcast(errors))  # one row each


@query("A04_awardees", """SELECT l_suppkey, s_name, count(*) AS n_contracts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, min(l_shipdate) AS first_contract, max(l_shipdate) AS last_contract,
    string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS kinds FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, s_name""")
def awardees(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_contracts"), money("l_extendedprice").alias("total"), F.min("l_shipdate").alias("first_contract"), F.max("l_shipdate").alias("last_contract"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("kinds"))
    names = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return sums.join(names, F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("s_suppkey")


@query("A06_shared_names", "SELECT p_name, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part WHERE p_name IS NOT NULL AND p_name <> '' GROUP BY p_name HAVING count(*) >= 2")
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").where("p_name IS NOT NULL AND p_name <> ''")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda i: i.cast("string")), ",")
    return named.groupBy("p_name").agg(F.count("*").alias("n"), ids.alias("ids")).where("n >= 2")


@query("A08_degrees", CIVIC_SQL + "SELECT node, count(DISTINCT id) AS degree FROM ends GROUP BY node HAVING count(DISTINCT id) >= 5")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(civic(spark, sf_dir).relations).where("degree >= 5")


@query("A09_histogram", CIVIC_SQL + "SELECT coalesce(perimetre, 'non_classe') AS scope, confidence, count(*) AS n FROM entities GROUP BY ALL")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return civic(spark, sf_dir).entities.groupBy(F.coalesce("perimetre", F.lit("non_classe")).alias("scope"), "confidence").agg(F.count("*").alias("n"))


@query("A10_series", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value), 3) AS mean, min(value) AS low, max(value) AS high, max(ts) AS last FROM events GROUP BY ALL")
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(money("value") / F.count("value"), 3).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("ts").alias("last"))


@query("A11_coverage", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT CASE WHEN value > 10 THEN user_id END) AS n_positive FROM events GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (day, user) first: one narrow shuffle, where distinct counts would expand every row."""
    users = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("rows"), F.coalesce(F.bool_or(F.col("value") > 10), F.lit(False)).alias("positive"))
    return users.groupBy("day").agg(F.sum("rows").alias("n"), F.count("user_id").alias("n_users"), F.count_if(F.col("positive") & F.col("user_id").isNotNull()).alias("n_positive"))


@query("A12_two_keys", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("A13_pivot", "SELECT l_suppkey, max(l_tax) FILTER (l_returnflag = 'A') AS a, max(l_tax) FILTER (l_returnflag = 'N') AS n, max(l_tax) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_suppkey")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_tax")).withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query("A15_prefix_rollup", "SELECT coalesce(CASE WHEN p_type LIKE 'ECO%' THEN 'eco' WHEN p_type LIKE 'S%' THEN 's' WHEN p_type LIKE 'P%' THEN 'p' ELSE 'autre' END, 'total') AS category, count(*) AS n, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM part GROUP BY ROLLUP (CASE WHEN p_type LIKE 'ECO%' THEN 'eco' WHEN p_type LIKE 'S%' THEN 's' WHEN p_type LIKE 'P%' THEN 'p' ELSE 'autre' END)")
def prefix_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching prefix, with a total row (A-16)."""
    kind = F.when(F.col("p_type").startswith("ECO"), "eco").when(F.col("p_type").startswith("S"), "s").when(F.col("p_type").startswith("P"), "p").otherwise("autre")
    return table(spark, sf_dir, "part").select(kind.alias("category"), "p_retailprice").rollup("category").agg(F.count("*").alias("n"), money("p_retailprice").alias("total")).withColumn("category", F.coalesce("category", F.lit("total")))


@query("A17_overlap_total", """SELECT o_custkey, coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), CAST(sum(CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DECIMAL(28,2)), 0)::DOUBLE AS total FROM orders GROUP BY o_custkey""")
def overlap_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    whole = F.max(F.when(F.col("o_orderpriority") == "1-URGENT", price))
    parts = F.sum(F.when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), price))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(whole.cast("double"), parts.cast("double"), F.lit(0.0)).alias("total"))


@query("A18_mandate_span", CIVIC_SQL + "SELECT e.node AS person_id, min(since) AS first_start, max(until) AS last_end, count(until) AS n_closed, count(*) AS n FROM ends e JOIN relations r ON r.id = e.id GROUP BY e.node")
def mandate_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicmill.operators.edges import doubled

    ends = doubled(civic(spark, sf_dir).relations.select("id", "since", "until", "from_id", "to_id"))
    return ends.groupBy(F.col("node").alias("person_id")).agg(F.min("since").alias("first_start"), F.max("until").alias("last_end"), F.count("until").alias("n_closed"), F.count("*").alias("n"))


@query("A20_source_coverage", "SELECT source, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, count(text) AS n_with_text, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.count("text").alias("n_with_text"), F.count_distinct("lang").alias("n_langs"))


@query("A21_status_of_latest", "SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority, max(o_orderdate) AS last_date FROM orders GROUP BY o_custkey")
def status_of_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_priority"), F.max("o_orderdate").alias("last_date"))


@query("A24_median_price", "SELECT p_brand, round(median(p_retailprice / p_size), 2) AS median_price, count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part WHERE p_size > 0 GROUP BY p_brand HAVING count(*) >= 5")
def median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 0").groupBy("p_brand").agg(F.round(F.median(F.col("p_retailprice") / F.col("p_size")), 2).alias("median_price"), F.count("*").alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high")).where("n >= 5")


@query("A26_recurrent", "SELECT count(*) AS n_recurrent, CAST(sum(n) AS BIGINT) AS n_orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1)")
def recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_recurrent"), F.sum("n").alias("n_orders"))


@query("A27_first_last_trough", """WITH y AS (SELECT o_orderpriority AS k, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY ALL)
    SELECT k, arg_min(n, year) AS first_n, arg_max(n, year) AS last_n, min(n) AS trough, CAST(arg_min(year, (n, year)) AS INTEGER) AS trough_year, round(100.0 * (arg_max(n, year) - min(n)) / min(n), 2) AS recovery FROM y GROUP BY k""")
def trough(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return years.groupBy("k").agg(F.min_by("n", "year").alias("first_n"), F.max_by("n", "year").alias("last_n"), F.min("n").alias("trough"), F.min_by("year", F.struct("n", "year")).alias("trough_year")).withColumn("recovery", F.round(100.0 * (F.col("last_n") - F.col("trough")) / F.col("trough"), 2))


@query("A29_unknown_last", "SELECT coalesce(source, 'inconnu') AS source, count(*) AS n, source IS NULL AS unknown FROM documents GROUP BY source")
def unknown_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("inconnu")).alias("source"), "n", F.col("source").isNull().alias("unknown"))


@query("A30_flows_by_year", """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS inflow,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS outflow, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS third FROM lineitem GROUP BY 1""")
def flows_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda flag: money(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")).otherwise(0))
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(part("A").alias("inflow"), part("N").alias("outflow"), part("R").alias("third"))


@query("A31_decisions", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS body, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_unanimous, count(*) FILTER (o_orderstatus <> 'F') AS n_divided FROM orders GROUP BY ALL")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("body")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_unanimous"), F.count_if(F.col("o_orderstatus") != "F").alias("n_divided"))


@query("A34_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("A35_coalesced_sums", "SELECT c_custkey, coalesce((SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_custkey = c_custkey), 0) AS total FROM customer")
def coalesced_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(money("o_totalprice").alias("total"))
    return table(spark, sf_dir, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("total", F.lit(0.0)).alias("total"))


@query("A36_seats", "SELECT n_nationkey, n_name, count(DISTINCT c_custkey) AS seats, round(CAST(count(o_orderkey) AS DOUBLE) / count(DISTINCT c_custkey), 2) AS per_seat FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("seats"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name", "seats", F.round(F.col("n") / F.col("seats"), 2).alias("per_seat"))


@query("A37_share_of_whole", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, n, round(100.0 * n / sum(n) OVER (PARTITION BY source), 2) AS share FROM c")
def share_of_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    counted = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("source")), 2))


@query("A41_rate_change", "SELECT l_suppkey, round(100 * (arg_max(l_tax, (l_shipdate, l_orderkey, l_linenumber, l_tax)) - arg_min(l_tax, (l_shipdate, l_orderkey, l_linenumber, l_tax))) / nullif(arg_min(l_tax, (l_shipdate, l_orderkey, l_linenumber, l_tax)), 0), 2) AS change FROM lineitem GROUP BY l_suppkey")
def rate_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_tax")
    ends = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_tax", place).alias("last"), F.min_by("l_tax", place).alias("first"))
    return ends.select("l_suppkey", F.round(100 * (F.col("last") - F.col("first")) / F.nullif("first", F.lit(0.0)), 2).alias("change"))


@query("A42_dormant", "SELECT user_id, max(ts) AS last, datediff('day', CAST(max(ts) AS DATE), DATE '2024-03-01') > 45 AS dormant FROM events GROUP BY user_id")
def dormant(spark: SparkSession, sf_dir: str, as_of: str = "2024-03-01") -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.withColumn("dormant", F.datediff(F.lit(as_of).cast("date"), F.to_date("last")) > 45)


@query("A45_merged_mandates", "SELECT o_custkey, bool_or(o_orderstatus = 'O') AS any_open, arg_min(o_orderpriority, (CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def merged_mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "3-MEDIUM", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"), F.min_by("o_orderpriority", F.struct(rank, "o_orderkey")).alias("best"))


@query("A46_mode", "SELECT k, m FROM (SELECT o_orderpriority AS k, CAST(year(o_orderdate) AS INTEGER) AS m, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, year(o_orderdate)) AS n FROM orders GROUP BY o_orderpriority, year(o_orderdate)) WHERE n = 1")
def mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent year, the earliest of several."""
    counted = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    return counted.groupBy("k").agg(F.max_by("m", F.struct("n", -F.col("m"))).alias("m"))


@query("A38_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: every sub-total of two keys."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_quantity").alias("quantity"), F.grouping_id().alias("level"))
