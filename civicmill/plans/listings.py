"""Filters, ordered listings, feeds, reports and reloads over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicmill.functions import places
from civicmill.operators import merge, resolve
from civicmill.operators.civic_views import sorted_list
from civicmill.operators.windows import top_per_key
from civicmill.plans.base import query
from civicmill.sources.civic import CIVIC_SQL, civic
from civicmill.sources.tables import table

SCOPES = ("C1", "C2", "C3", "lien", "hors")


@query("P04_scopes", CIVIC_SQL + "SELECT id, perimetre FROM entities WHERE perimetre IN ('C1', 'lien')")
def scopes(spark: SparkSession, sf_dir: str, wanted: str = "C1, lien,C9") -> DataFrame:
    """Unknown values are dropped; if none is left that is an error, not everything."""
    known = [s for s in map(str.strip, wanted.split(",")) if s in SCOPES]
    if not known:
        raise ValueError(f"none of {wanted!r} is a scope")
    return civic(spark, sf_dir).entities.where(F.col("perimetre").isin(known)).select("id", "perimetre")


@query("P05_bounding_box", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900.5 AND 950")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(places.in_box(F.col("p_size"), F.col("p_retailprice"), (10, 900.5, 20, 950))).select("p_partkey")


@query("P11_without_codes", "WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[ND] ' WHEN 1 THEN '30140 ' WHEN 2 THEN '3014 ' ELSE '' END || p_name AS name FROM part) SELECT p_partkey, name FROM n WHERE name NOT LIKE '%[ND]%' AND NOT (name GLOB '[0-9][0-9][0-9][0-9][0-9] *') AND name NOT LIKE 'small%'")
def without_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") % 4
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(key == 0, "[ND] ").when(key == 1, "30140 ").when(key == 2, "3014 ").otherwise(""), "p_name").alias("name"))
    return named.where(~F.col("name").contains("[ND]") & ~F.col("name").rlike("^[0-9]{5} ") & ~F.col("name").startswith("small"))


@query("P12_keywords", "SELECT doc_id FROM documents WHERE contains(text, 'License') OR contains(text, 'license') OR contains(text, '@')")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("License|license|@")).select("doc_id")


@query("P19_newest_matches", "SELECT event_id, ts FROM events WHERE regexp_matches(event_type, '^(error|purch)') OR regexp_matches(props, '9}$') ORDER BY ts DESC, event_id LIMIT 40")
def newest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of 40 rows; each task sends its own 40 only."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").rlike("^(error|purch)") | F.col("props").rlike("9}$"))
    return rows.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(40)


@query("J11_using_key", "WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), s AS (SELECT s_suppkey AS k, s_name FROM supplier) SELECT k, s_name, n FROM s LEFT JOIN a USING (k)")
def using_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyses = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name").join(analyses, "k", "left")


@query("J18_names_within", """WITH n AS (SELECT DISTINCT p_name AS name FROM part), m AS (SELECT DISTINCT lower(p_type) || ' ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' small blue' ELSE '' END AS mention FROM part)
    SELECT name, mention FROM n JOIN m ON list_has_all(string_split(mention, ' '), string_split(name, ' '))""")
def names_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    mention = F.concat_ws(" ", F.lower("p_type"), "p_name", F.when(F.col("p_size") % 2 == 0, "small blue"))
    return resolve.names_within(part.select(F.col("p_name").alias("name")), part.select(mention.alias("mention")), "name", "mention")


@query("J24_without_results", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL AND l_quantity > 48 AND l_returnflag = 'R')")
def without_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").where("l_quantity > 48 AND l_returnflag = 'R'").select("l_suppkey")
    return table(spark, sf_dir, "supplier").join(results, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti").select("s_suppkey", "s_name")


@query("J26_council_mandates", CIVIC_SQL + """, el AS (SELECT x.node AS person, min(r.since) AS elected FROM relations r JOIN ends x ON x.id = r.id JOIN entities e ON e.id = x.node AND e.type = 'person' WHERE r.relation_type = 'élu_cm' GROUP BY 1),
    cc AS (SELECT x.node AS person, min(r.since) AS council FROM relations r JOIN ends x ON x.id = r.id WHERE r.relation_type = 'élu_cc' GROUP BY 1), co AS (SELECT x.node AS person, string_agg(DISTINCT CAST(x.other AS VARCHAR), ',' ORDER BY CAST(x.other AS VARCHAR)) AS committees FROM relations r JOIN ends x ON x.id = r.id WHERE r.relation_type = 'membre_commission' GROUP BY 1)
    SELECT el.person, elected, cc.person IS NOT NULL AS sits, council, committees FROM el LEFT JOIN cc USING (person) LEFT JOIN co USING (person)""")
def council_mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elected persons, since when they sit on the inter-municipal council, and their committees, from either end."""
    from civicmill.operators.edges import doubled

    c = civic(spark, sf_dir)
    ends = doubled(c.relations)
    of = lambda kind: ends.where(F.col("relation_type") == kind).groupBy(F.col("node").alias("person"))
    persons = c.entities.where("type = 'person'").select(F.col("id").alias("person"))
    elected = of("élu_cm").agg(F.min("since").alias("elected")).join(persons, "person", "left_semi")
    council = of("élu_cc").agg(F.min("since").alias("council"), F.lit(True).alias("sits"))
    committees = of("membre_commission").agg(sorted_list(F.col("other").cast("string")).alias("committees"))
    joined = elected.join(council, "person", "left").join(committees, "person", "left")
    return joined.select("person", "elected", F.coalesce("sits", F.lit(False)).alias("sits"), "council", "committees")


@query("A32_unresolved", "SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS contexts FROM events WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id) GROUP BY user_id")
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").join(table(spark, sf_dir, "supplier"), F.col("user_id") == F.col("s_suppkey"), "left_anti")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), sorted_list(F.col("event_type")).alias("contexts"))


@query("A33_grouped_listing", "SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority, min(o_orderkey) AS first_act FROM orders GROUP BY ALL")
def grouped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"), "o_orderpriority").agg(F.min("o_orderkey").alias("first_act"))


@query("A39_nested_budget", """WITH y AS (SELECT l_suppkey, year(l_shipdate) AS year, sum(CASE WHEN l_returnflag IN ('A', 'N') THEN CAST(l_extendedprice AS DECIMAL(18, 2)) END) AS kept, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, string_agg(year || ':' || coalesce(CAST(kept AS VARCHAR), '-') || '/' || n, ' ' ORDER BY year) AS years FROM y GROUP BY 1""")
def nested_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure, then years in order, each with its picked lines: the years' rows are few, so lists are short."""
    picked = F.when(F.col("l_returnflag").rlike("^[AN]$"), F.col("l_extendedprice").cast("decimal(18,2)"))
    years = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum(picked).alias("kept"), F.count("*").alias("n"))
    one = F.concat(F.col("year").cast("string"), F.lit(":"), F.coalesce(F.col("kept").cast("string"), F.lit("-")), F.lit("/"), F.col("n").cast("string"))
    return years.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list(one)), " ").alias("years"))


@query("A40_places_per_risk", "SELECT p_type, count(DISTINCT p_brand) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY p_type ORDER BY n DESC, p_type")
def places_per_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    return once.groupBy("p_type").agg(F.count("p_brand").alias("n"), sorted_list(F.col("p_brand")).alias("brands")).orderBy(F.desc("n"), "p_type")


@query("A43_by_status", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS place, count(*) AS n FROM orders GROUP BY ALL ORDER BY place, o_orderstatus")
def by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", place.alias("place")).agg(F.count("*").alias("n")).orderBy("place", "o_orderstatus")


@query("A44_money_totals", CIVIC_SQL + """, l AS (SELECT max(year) AS y FROM flows) SELECT count(DISTINCT to_id) AS beneficiaries, CAST(sum(CASE WHEN NOT ends_with(type, '_demande') THEN amount END) AS BIGINT) AS granted,
    CAST(coalesce(sum(CASE WHEN year = y THEN amount END), 0) AS BIGINT) AS latest, min(year) AS first_year, max(year) AS last_year FROM flows, l""")
def money_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums a year and beneficiaries first, so that neither scans the flows again."""
    flows = civic(spark, sf_dir).flows
    granted = F.sum(F.when(~F.col("type").endswith("_demande"), F.col("amount")))
    parts = flows.groupBy("to_id", "year").agg(granted.alias("granted"), F.sum("amount").alias("amount"))
    years = parts.groupBy("to_id").agg(F.sum("granted").alias("granted"), F.min("year").alias("y0"), F.max(F.struct("year", "amount")).alias("last"))
    last = years.groupBy(F.col("last.year").alias("year")).agg(F.count("*").alias("n"), F.sum("granted").alias("granted"), F.sum("last.amount").alias("amount"), F.min("y0").alias("y0"))
    whole = last.agg(F.sum("n").alias("beneficiaries"), F.sum("granted").alias("granted"), F.max(F.struct("year", "amount")).alias("top"), F.min("y0").alias("first_year"))
    return whole.select("beneficiaries", "granted", F.coalesce("top.amount", F.lit(0)).alias("latest"), "first_year", F.col("top.year").alias("last_year"))


@query("S01_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page(spark: SparkSession, sf_dir: str, size: int = 25, number: int = 2) -> DataFrame:
    """A page of a listing; the unique key ends the order, so pages never overlap."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(size * number).limit(size)


@query("S05_subjects_first", CIVIC_SQL + "SELECT event_id, entity_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY role <> 'sujet', entity_id) AS INTEGER) AS place FROM event_entities")
def subjects_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("event_id").orderBy(F.col("role") != "sujet", "entity_id")
    return civic(spark, sf_dir).event_entities.select("event_id", "entity_id", F.row_number().over(order).alias("place"))


@query("S06_capped_dates", "SELECT l_orderkey, l_linenumber, l_partkey, least(l_shipdate, TIMESTAMP '1999-06-30') AS shown FROM lineitem ORDER BY shown DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice LIMIT 200")
def capped_dates(spark: SparkSession, sf_dir: str, today: str = "1999-06-30") -> DataFrame:
    """Approximate dates in the future count as today."""
    shown = F.least("l_shipdate", F.lit(today).cast("timestamp_ntz"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", shown.alias("shown"))
    return rows.orderBy(F.desc("shown"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").limit(200).drop("l_extendedprice")


@query("S07_to_mend_first", """WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 1000 THEN 1 ELSE 2 END AS status, count(o_orderkey) AS exposure FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_custkey, status, exposure FROM s ORDER BY status, exposure DESC, c_custkey LIMIT 100""")
def to_mend_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("c_acctbal") < 0, 0).when(F.col("c_acctbal") < 1000, 1).otherwise(2)
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", status.alias("status"), F.coalesce("n", F.lit(0)).alias("exposure"))
    return rows.orderBy("status", F.desc("exposure"), "c_custkey").limit(100)


@query("S11_capped_feeds", """SELECT * FROM (SELECT 'marche' AS kind, o_orderkey AS id, o_orderdate AS ts FROM orders ORDER BY ts DESC, id LIMIT 400) UNION ALL SELECT * FROM (SELECT 'acte', event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 150)
    UNION ALL SELECT * FROM (SELECT 'alerte', event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 60)""")
def capped_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feed's newest rows, as many as the page shows of it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    newest = lambda kind, rows, key, ts, n: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(ts).alias("ts")).orderBy(F.desc("ts"), "id").limit(n)
    return newest("marche", orders, "o_orderkey", "o_orderdate", 400).union(newest("acte", events, "event_id", "ts", 150)).union(newest("alerte", events.where("event_type = 'error'"), "event_id", "ts", 60))


@query("W11_top_by_total", "WITH t AS (SELECT p_type, l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) SELECT p_type, l_partkey, CAST(total AS DOUBLE) AS total FROM t QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY total DESC, l_partkey) <= 12")
def top_by_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("total"))
    rows = totals.join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("p_type", "l_partkey", "total")
    return top_per_key(rows, ["p_type"], 12, F.desc("total"), F.col("l_partkey")).select("p_type", "l_partkey", F.col("total").cast("double").alias("total"))


@query("Q11_unplaced", CIVIC_SQL + "SELECT id FROM entities WHERE confidence IN ('verified', 'confirmed') AND perimetre = 'C1' AND siren IS NULL")
def unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishable rows of the commune that lack what places them; here the register's number stands for coordinates."""
    return civic(spark, sf_dir).entities.where(F.col("confidence").isin("verified", "confirmed") & (F.col("perimetre") == "C1") & F.col("siren").isNull()).select("id")


@query("Q14_without_evidence", CIVIC_SQL + "SELECT id FROM entities WHERE perimetre = 'C1' EXCEPT (SELECT node FROM ends UNION SELECT entity_id FROM event_entities UNION SELECT from_id FROM flows)")
def without_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities tagged with the commune that no relation, event or payment mentions."""
    c = civic(spark, sf_dir)
    evidence = c.relations.select(F.explode(F.array("from_id", "to_id")).alias("id")).union(c.event_entities.select("entity_id")).union(c.flows.select("from_id"))
    return c.entities.where("perimetre = 'C1'").select("id").join(evidence, "id", "left_anti")


WEEKS = "WITH a AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, value FROM events WHERE event_id % 5 <> 0), b AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, value + 1 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type <> 'click') "


def _weeks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), "value", "ts")
    late = events.where((F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("event_type") != "click"))
    return events.where("event_id % 5 <> 0").drop("ts"), late.withColumn("value", F.col("value") + 1).drop("ts")


@query("M06_reloaded", WEEKS + "SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.day = a.day AND b.event_type = a.event_type) UNION ALL SELECT * FROM b")
def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.reloaded(*_weeks(spark, sf_dir), ["day", "event_type"])


@query("M13_accepted", """WITH r AS (SELECT l_orderkey AS f, l_suppkey AS t, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), c AS (SELECT l_orderkey AS f, l_suppkey AS t, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O' GROUP BY ALL)
    SELECT * FROM r UNION ALL SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.f = c.f AND r.t = c.t)""")
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that a review accepted become relations, unless they are there."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = lambda rows: rows.groupBy(F.col("l_orderkey").alias("f"), F.col("l_suppkey").alias("t")).agg(F.min("l_linenumber").alias("n"))
    candidates = lines.where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"))
    return merge.inserted(pairs(lines.where("l_returnflag = 'R'")), pairs(candidates), ["f", "t"], F.col("n"))


@query("V02_event_chunks", CIVIC_SQL + "SELECT d.id, 'Acte du ' || d.date || ' ; acteurs : ' || string_agg(e.name, ', ' ORDER BY e.name) AS chunk FROM acts_dated d JOIN event_entities x ON x.event_id = d.id AND x.role = 'acteur' JOIN entities e ON e.id = x.entity_id GROUP BY d.id, d.date")
def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    actors = c.event_entities.where("role = 'acteur'").join(c.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    names = actors.groupBy(F.col("event_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return c.events.join(names, "id").select("id", F.concat(F.lit("Acte du "), "date", F.lit(" ; acteurs : "), "names").alias("chunk"))


@query("V03_not_embedded", "SELECT 'documents' AS source_table, doc_id AS source_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL AND vec_id % 3 <> 0)")
def not_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental run still has to embed."""
    done = table(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0").select(F.lit("documents").alias("source_table"), F.col("vec_id").alias("source_id"))
    wanted = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("source_id"))
    return wanted.join(done, ["source_table", "source_id"], "left_anti")


@query("X04_journal", WEEKS + "SELECT event_type, coalesce(x, 0) AS before, coalesce(y, 0) AS after, coalesce(y, 0) - coalesce(x, 0) AS added, CASE WHEN coalesce(y, 0) > coalesce(x, 0) THEN 'ok' ELSE 'empty' END AS status FROM (SELECT event_type, count(*) AS x FROM b GROUP BY 1) FULL JOIN (SELECT event_type, count(*) AS y FROM a GROUP BY 1) USING (event_type)")
def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    after, before = _weeks(spark, sf_dir)
    return merge.journalled(before, after, "event_type")
