"""Projections, filters, joins, sorts and set operations over the driver's tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.operators.edges import doubled
from civicmill.plans.base import query
from civicmill.sources.tables import table


def every(*filters: Column | None) -> Column:
    """The conjunction of the filters that are set."""
    return reduce(and_, [f for f in filters if f is not None], F.lit(True))


@query("J01_facets", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    wide = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, F.col("c_nationkey") == nation.n_nationkey, "left").join(region, F.col("n_regionkey") == region.r_regionkey, "left")
    return wide.select("o_orderkey", "c_name", "n_name", "r_name")


@query("J02_edge_ends", "SELECT l_orderkey, l_linenumber, s_name, p_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey")
def edge_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, supplier, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(part, lines.l_partkey == part.p_partkey).select("l_orderkey", "l_linenumber", "s_name", "p_name")


@query("J04_either_end", "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e WHERE a <> b")
def either_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    return doubled(edges, "a", "b").select("node", "other")


@query("J08_filtered_right_side", "SELECT c_custkey, count(o_orderkey) AS n_urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def filtered_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    return customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_urgent"))


@query("J10_parcels", "SELECT p_partkey, count(*) AS n_sales, min(l_shipdate) AS first_sale, max(l_shipdate) AS last_sale, max(l_extendedprice) AS best_price FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n_sales"), F.min("l_shipdate").alias("first_sale"), F.max("l_shipdate").alias("last_sale"), F.max("l_extendedprice").alias("best_price"))
    part = table(spark, sf_dir, "part").select("p_partkey")
    return part.join(sales, F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey")


@query("J12_with_orders", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("J13_without_urgent_orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("J15_pairs_on_key", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def pairs_on_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    other = s.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("k"))
    return s.join(other, (F.col("s_nationkey") == F.col("k")) & (F.col("s_suppkey") < F.col("b"))).select(F.col("s_suppkey").alias("a"), "b")


@query("J20_lookup_cascade", """SELECT event_id, coalesce(c.c_name, s.s_name, 'inconnu') AS actor FROM events LEFT JOIN customer c ON c.c_custkey = user_id AND c.c_mktsegment = 'BUILDING' LEFT JOIN supplier s ON s.s_suppkey = user_id""")
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    second = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id").join(first, F.col("user_id") == F.col("c_custkey"), "left").join(second, F.col("user_id") == F.col("s_suppkey"), "left")
    return rows.select("event_id", F.coalesce("c_name", "s_name", F.lit("inconnu")).alias("actor"))


@query("P03_optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 200000")
def optional_filters(spark: SparkSession, sf_dir: str, status: str | None = "O", priority: str | None = None, least: float | None = 1000, most: float | None = 200_000) -> DataFrame:
    c = F.col
    kept = every(c("o_orderstatus") == status if status else None, c("o_orderpriority") == priority if priority else None, c("o_totalprice") >= least if least is not None else None, c("o_totalprice") <= most if most is not None else None)
    return table(spark, sf_dir, "orders").where(kept).select("o_orderkey")


@query("P06_equal_or_contains", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' OR p_name ILIKE '%widget%'")
def equal_or_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where((F.col("p_brand") == "Brand#2") | F.col("p_name").ilike("%widget%")).select("p_partkey")


@query("P07_year_prefix", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997")
def year_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range on the column itself, which reaches the scan, in place of a function of it."""
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where((date >= F.lit("1997-01-01").cast("timestamp_ntz")) & (date < F.lit("1998-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("P10_valid_at", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' OR l_shipdate > TIMESTAMP '1999-06-30'")
def valid_at(spark: SparkSession, sf_dir: str, as_of: str = "1999-06-30") -> DataFrame:
    return table(spark, sf_dir, "lineitem").where((F.col("l_linestatus") == "O") | (F.col("l_shipdate") > F.lit(as_of).cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber")


@query("P16_reasons", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'type_exclu' WHEN value IS NULL THEN 'sans_valeur' WHEN value < 1 THEN 'trop_petit' ELSE 'public' END AS reason FROM events")
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("event_type") == "error", "type_exclu").when(F.col("value").isNull(), "sans_valeur").when(F.col("value") < 1, "trop_petit").otherwise("public")
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query("S02_search_index", """SELECT 'acteur' AS kind, c_custkey AS id, c_name AS title, 1000 + count(o_orderkey) AS weight FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
    UNION ALL SELECT 'acte', o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 700 ELSE 500 END FROM orders
    UNION ALL SELECT 'marché', p_partkey, p_name, 600 FROM part UNION ALL SELECT 'versement', s_suppkey, s_name, 400 FROM supplier""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicmill.sources.sinks import search_index as index

    orders = table(spark, sf_dir, "orders")
    links = orders.groupBy("o_custkey").agg(F.count("*").alias("links"))
    customer = table(spark, sf_dir, "customer").join(links, F.col("c_custkey") == F.col("o_custkey"), "left")
    actors = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.coalesce("links", F.lit(0)).alias("links"))
    acts = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), (F.col("o_orderstatus") == "F").alias("decision"))
    return index(actors, acts, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")))


@query("S03_custom_order_top", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 100")
def custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the first 100 are taken by a bounded heap per task, then numbered."""
    from pyspark.sql import Window

    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    top = table(spark, sf_dir, "orders").select("o_orderkey", rank.alias("rank"), "o_totalprice").orderBy("rank", F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("rank", F.col("o_totalprice").desc_nulls_last(), "o_orderkey")).alias("place"))


@query("U01_union_of_ids", "SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events")
def union_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return ids.union(table(spark, sf_dir, "orders").select("o_custkey")).union(table(spark, sf_dir, "events").select("user_id")).distinct()


@query("U02_set_algebra", "SELECT user_id AS id FROM events INTERSECT SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return users.intersect(table(spark, sf_dir, "customer").select("c_custkey")).exceptAll(urgent.distinct())


@query("U04_feed", """SELECT 'marche' AS kind, o_orderkey AS id, o_orderdate AS ts, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS title FROM orders
    UNION ALL SELECT 'acte', event_id, ts, NULL, event_type FROM events UNION ALL SELECT 'note', conv_id, NULL, NULL, role FROM conversations""")
def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.lit("marche").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"))
    events = table(spark, sf_dir, "events").select(F.lit("acte").alias("kind"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("title"))
    notes = table(spark, sf_dir, "conversations").select(F.lit("note").alias("kind"), F.col("conv_id").alias("id"), F.col("role").alias("title"))
    return orders.unionByName(events, allowMissingColumns=True).unionByName(notes, allowMissingColumns=True)


@query("U05_dedup_across_union", """WITH u AS (SELECT 0 AS p, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier UNION ALL SELECT 2, p_partkey, p_name FROM part)
    SELECT id, p AS priority, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, name) AS n FROM u) WHERE n = 1""")
def dedup_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicmill.operators.windows import first_per_key

    one = lambda name, k, key, title: table(spark, sf_dir, name).select(F.col(key).alias("id"), F.lit(k).alias("priority"), F.col(title).alias("name"))
    rows = one("customer", 0, "c_custkey", "c_name").union(one("supplier", 1, "s_suppkey", "s_name")).union(one("part", 2, "p_partkey", "p_name"))
    return first_per_key(rows, ["id"], F.col("priority"), F.col("name"))


@query("SRC15_content_archive", "SELECT sha256(text) AS sha256, count(*) AS n_seen, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return docs.groupBy("sha256").agg(F.count("*").alias("n_seen"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
