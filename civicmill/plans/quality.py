"""Data-quality and publication-invariant rules over the civic frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.operators import quality as q
from civicmill.plans.base import query
from civicmill.sources.civic import CIVIC_SQL, civic
from civicmill.sources.tables import table


@query("Q01_orphans", "SELECT 'orphan_event' AS \"check\", 'error' AS severity, CAST(event_id AS VARCHAR) AS ref FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) UNION ALL SELECT 'orphan_label', 'error', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_nationkey < 20")
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    first = q.orphans(table(spark, sf_dir, "events"), known, "user_id", "c_custkey", "orphan_event", F.col("event_id"))
    return first.unionByName(q.orphans(table(spark, sf_dir, "labels"), english, "doc_id", "doc_id", "orphan_label", F.col("doc_id")))


@query("Q08_duplicate_names", CIVIC_SQL + "SELECT 'duplicate_name' AS \"check\", 'warn' AS severity, type || ':' || trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS ref FROM entities WHERE type <> 'person' GROUP BY 3 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.duplicate_names(civic(spark, sf_dir).entities)


@query("Q_all_rules", CIVIC_SQL + """, mandates AS (SELECT unnest([from_id, to_id]) AS person, until FROM relations WHERE relation_type IN ('élu_cm', 'élu_cc', 'adjoint', 'maire', 'délégué_cm', 'délégué_cc'))
    SELECT 'bad_confidence' AS "check", 'error' AS severity, CAST(id AS VARCHAR) AS ref FROM entities WHERE confidence NOT IN ('verified', 'confirmed', 'probable') OR confidence IS NULL
    UNION ALL SELECT 'never_closed', 'warn', CAST(id AS VARCHAR) FROM relations WHERE since < '1998-01-01' AND until IS NULL AND list_contains(['élu_cm', 'élu_cc', 'adjoint', 'maire', 'délégué_cm', 'délégué_cc'], relation_type)
    UNION ALL SELECT 'self_loop', 'error', CAST(id AS VARCHAR) FROM relations WHERE from_id = to_id
    UNION ALL SELECT 'stale_seat', 'error', CAST(s.id AS VARCHAR) FROM (SELECT r.id, unnest([from_id, to_id]) AS person FROM relations r
        WHERE relation_type IN ('membre_commission', 'adjoint', 'délégué_cm', 'responsable') AND coalesce(until, '9999') > '1995-06-30') s
    WHERE EXISTS (SELECT 1 FROM entities p WHERE p.id = s.person AND p.type = 'person')
        AND EXISTS (SELECT 1 FROM mandates m WHERE m.person = s.person AND m.until <= '1995-06-30')
        AND NOT EXISTS (SELECT 1 FROM mandates m WHERE m.person = s.person AND coalesce(m.until, '9999') > '1995-06-30')""")
def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return q.run_checks({
        "bad_confidence": lambda: q.bad_domain(c.entities, "confidence", ("verified", "confirmed", "probable"), "bad_confidence"),
        "never_closed": lambda: q.never_closed(c.relations, "1998-01-01"),
        "self_loop": lambda: q.self_loops(c.relations),
        "stale_seats": lambda: q.stale_seats(c.relations, c.entities, "1995-06-30"),
    })


@query("Q12_stale_sources", "SELECT event_type AS source, datediff('day', CAST(max(ts) AS DATE), DATE '2024-03-01') AS age, CASE WHEN datediff('day', CAST(max(ts) AS DATE), DATE '2024-03-01') > 3 * length(event_type) THEN 'error' WHEN datediff('day', CAST(max(ts) AS DATE), DATE '2024-03-01') > 1.5 * length(event_type) THEN 'warn' ELSE 'ok' END AS severity FROM events GROUP BY event_type")
def stale_sources(spark: SparkSession, sf_dir: str, as_of: str = "2024-03-01") -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.lit("ok").alias("status"), F.col("ts").alias("started"))
    ttl = runs.select("source").distinct().withColumn("ttl", F.length("source"))
    return q.stale(runs, ttl, F.lit(as_of).cast("date"))


@query("I04_home_share", CIVIC_SQL + "SELECT type, count(*) AS n, round(100.0 * count(*) FILTER (commune = 'N1') / count(*), 2) AS share, arg_max(commune, (k, commune)) AS most_common FROM (SELECT *, count(*) OVER (PARTITION BY type, commune) AS k FROM entities) GROUP BY type")
def home_share(spark: SparkSession, sf_dir: str, home: str = "N1") -> DataFrame:
    counted = civic(spark, sf_dir).entities.groupBy("type", "commune").agg(F.count("*").alias("k"))
    at_home = F.sum(F.when(F.col("commune") == home, F.col("k")).otherwise(0))
    return counted.groupBy("type").agg(F.sum("k").alias("n"), F.round(100.0 * at_home / F.sum("k"), 2).alias("share"), F.max_by("commune", F.struct("k", "commune")).alias("most_common"))


@query("I05_dangling_ids", CIVIC_SQL + "SELECT to_id AS entity_id, count(*) AS n_uses FROM flows WHERE to_id NOT IN (SELECT id FROM entities WHERE confidence IN ('verified', 'confirmed')) GROUP BY to_id")
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    shown = c.entities.where(F.col("confidence").isin("verified", "confirmed")).select("id")
    uses = c.flows.groupBy(F.col("to_id").alias("entity_id")).agg(F.count("*").alias("n_uses"))
    return uses.join(shown, F.col("entity_id") == F.col("id"), "left_anti")


@query("Q16_until_clean", "SELECT p_partkey, CAST(CASE WHEN p_size = 0 THEN 0 ELSE p_size / least(p_size & -p_size, 8) END AS INTEGER) AS size FROM part")
def until_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even sizes are halved until none is left, three times at the most."""
    even = (F.col("size") % 2 == 0) & (F.col("size") > 0)
    sizes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"))
    halved = F.when(even, (F.col("size") / 2).cast("int")).otherwise(F.col("size"))
    return q.until_clean(sizes, lambda rows: rows.where(even), lambda rows: rows.withColumn("size", halved), most=3)
