"""Merges and incremental loads: the events, cut into an earlier and a later batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.operators import merge
from civicmill.operators.windows import first_per_key
from civicmill.plans.base import query
from civicmill.sources.tables import table

CUT = "2024-01-15"
BATCHES = f"WITH a AS (SELECT user_id, event_type, max(value) AS value, min(event_id) AS event_id FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY ALL), b AS (SELECT user_id, event_type, max(value) AS value, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '{CUT}' GROUP BY ALL)"


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    cut = F.lit(CUT).cast("timestamp_ntz")
    state = lambda df: df.groupBy("user_id", "event_type").agg(F.max("value").alias("value"), F.min("event_id").alias("event_id"))
    return state(events.where(F.col("ts") < cut)), state(events.where(F.col("ts") >= cut))


KEYS = ["user_id", "event_type"]


@query("M01_insert_or_ignore", BATCHES + "SELECT * FROM a UNION ALL SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type)")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.inserted(*_batches(spark, sf_dir), KEYS, F.col("event_id"))


@query("M02_replace", BATCHES + "SELECT * FROM b UNION ALL SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND a.event_type = b.event_type)")
def replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.replaced(*_batches(spark, sf_dir), KEYS)


@query("M03_upsert", BATCHES + "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(b.value, a.value) AS value, coalesce(a.event_id, b.event_id) AS event_id FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upserted(*_batches(spark, sf_dir), KEYS, ["value"])


@query("M04_human_rows_win", BATCHES + "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.event_type = 'purchase' THEN a.value ELSE coalesce(b.value, a.value) END AS value, coalesce(a.event_id, b.event_id) AS event_id FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def human_rows_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _batches(spark, sf_dir)
    return merge.upserted(old, new, KEYS, ["value"], keep=(F.col("event_type") == "purchase") & F.col("_there"))


@query("R02_fill_nulls", BATCHES + "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(CASE WHEN a.value > 5 THEN a.value END, b.value) AS value, coalesce(a.event_id, b.event_id) AS event_id FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _batches(spark, sf_dir)
    return merge.upserted(old.withColumn("value", F.when(F.col("value") > 5, F.col("value"))), new, KEYS, ["value"], fill_only=True)


@query("M07_sweep", BATCHES + "SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.user_id = b.user_id AND a.event_type = b.event_type) OR a.user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _batches(spark, sf_dir)
    building = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    attached = old.join(building, F.col("user_id") == F.col("c_custkey"), "left_semi")
    return merge.swept(old, new, KEYS, attached)


@query("M09_rename", "SELECT p_partkey, p_name AS target, CASE WHEN p_partkey = min(p_partkey) OVER (PARTITION BY p_name) THEN 'renamed' ELSE 'collision' END AS outcome FROM part")
def rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.renamed(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("target")), "p_partkey", "target")


@query("M10_replay", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("withdrawn"))
    return merge.replayed(entries, "user_id", "event_id", "withdrawn").drop("withdrawn")


@query("M11_audit", "WITH n AS (SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer) SELECT c.c_custkey, 'c_name' AS field, c.c_name AS old, n.c_name AS new FROM customer c JOIN n USING (c_custkey) WHERE c.c_name <> n.c_name UNION ALL SELECT c.c_custkey, 'c_nationkey', CAST(c.c_nationkey AS VARCHAR), CAST(n.c_nationkey AS VARCHAR) FROM customer c JOIN n USING (c_custkey) WHERE c.c_nationkey <> n.c_nationkey")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    after = before.withColumns({"c_name": F.upper("c_name"), "c_nationkey": F.when(F.col("c_acctbal") < 0, 0).otherwise(F.col("c_nationkey"))})
    return merge.audit(before, after, "c_custkey", ["c_name", "c_nationkey"])


@query("K02_decisions", BATCHES + ", m AS (SELECT user_id, max(value) AS v FROM a GROUP BY 1), d AS (SELECT user_id, max(value) AS v FROM b GROUP BY 1) SELECT d.user_id, CASE WHEN m.user_id IS NULL THEN 'unknown' WHEN m.v IS NULL THEN 'applied' WHEN m.v = d.v THEN 'up_to_date' ELSE 'disagreement' END AS outcome FROM d LEFT JOIN m USING (user_id)")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine, theirs = (df.groupBy("user_id").agg(F.max("value").alias("v")) for df in _batches(spark, sf_dir))
    return merge.decided(mine, theirs, "user_id", "v")


OPTIMISTIC_SQL = """WITH base AS (
    SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, CAST(c_custkey % 3 AS BIGINT) AS version, CASE WHEN c_custkey % 50 = 0 THEN 'b1' END AS batch FROM customer
), told AS (
    SELECT ['b1', 'b2', 'b3'][1 + o_orderkey % 3] AS batch, o_custkey + CASE WHEN o_orderkey % 20 = 0 THEN 1000000 ELSE 0 END AS id, o_orderkey % 4 AS seen, o_totalprice AS balance, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority END AS segment, o_orderkey FROM orders
), changes AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY batch, id ORDER BY o_orderkey) = 1
), judged AS (
    SELECT c.*, CASE WHEN b.id IS NULL THEN 'unknown' WHEN b.batch = c.batch THEN 'repeated' WHEN b.version <> c.seen THEN 'stale' WHEN row_number() OVER (PARTITION BY c.id, b.version = c.seen AND b.batch IS DISTINCT FROM c.batch ORDER BY c.batch) = 1 THEN 'applied' ELSE 'stale' END AS outcome
    FROM changes c LEFT JOIN base b ON b.id = c.id
)"""


def _optimistic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 3).alias("version"), F.when(F.col("c_custkey") % 50 == 0, "b1").alias("batch"))
    n = F.col("o_orderkey")
    told = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("b"), (1 + n % 3).cast("string")).alias("batch"), (F.col("o_custkey") + F.when(n % 20 == 0, 1_000_000).otherwise(0)).alias("id"), (n % 4).alias("seen"),
        F.col("o_totalprice").alias("balance"), F.when(n % 7 == 0, F.col("o_orderpriority")).alias("segment"), n,
    )
    return merge.applied_if_unchanged(base, first_per_key(told, ["batch", "id"], n).drop("o_orderkey"), "id", ["balance", "segment"])


@query("M14_optimistic_rows", OPTIMISTIC_SQL + """ SELECT b.id, coalesce(j.balance, b.balance) AS balance, coalesce(j.segment, b.segment) AS segment, b.version + CASE WHEN j.id IS NULL THEN 0 ELSE 1 END AS version, coalesce(j.batch, b.batch) AS batch
    FROM base b LEFT JOIN (SELECT * FROM judged WHERE outcome = 'applied') j ON j.id = b.id""")
def optimistic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _optimistic(spark, sf_dir)[0]


@query("M14_optimistic_outcomes", OPTIMISTIC_SQL + " SELECT batch, id, outcome FROM judged")
def optimistic_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _optimistic(spark, sf_dir)[1]
