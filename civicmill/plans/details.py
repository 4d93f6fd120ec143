"""Rules that larger operators are made of, each on its own over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.functions import classify, jsons, text
from civicmill.operators import merge, resolve
from civicmill.operators.edges import degrees, doubled, induced
from civicmill.plans.base import query
from civicmill.plans.scalars import FOLD_SQL
from civicmill.sources.civic import CIVIC_SQL, civic
from civicmill.sources.tables import table


@query("P08_default_status", "SELECT o_orderkey FROM orders WHERE coalesce(CASE o_orderstatus WHEN 'O' THEN 'demande' WHEN 'F' THEN 'realise' END, 'realise') = 'realise'")
def default_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "demande").when(F.col("o_orderstatus") == "F", "realise")
    return table(spark, sf_dir, "orders").where(classify.or_default(status, "realise") == "realise").select("o_orderkey")


@query("P09_null_bucket", CIVIC_SQL + "SELECT id AS entity_id, perimetre IS NULL AS unclassified FROM entities WHERE perimetre IS NULL OR perimetre = 'C3'")
def null_bucket(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = ("C3", "non-classe")) -> DataFrame:
    entities = civic(spark, sf_dir).entities
    return entities.where(classify.in_buckets(F.col("perimetre"), wanted)).select(F.col("id").alias("entity_id"), F.col("perimetre").isNull().alias("unclassified"))


@query("P18_periods", "SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_shipdate AS DATE) + CASE WHEN l_linenumber % 2 = 0 THEN 30 ELSE 0 END < DATE '1995-06-17' THEN 'past' WHEN l_linenumber < 7 THEN 'current' ELSE 'current' END AS period FROM lineitem")
def periods(spark: SparkSession, sf_dir: str, as_of: str = "1995-06-17") -> DataFrame:
    """Every second line lasts a month."""
    day = F.to_date("l_shipdate")
    end = F.when(F.col("l_linenumber") % 2 == 0, F.date_add(day, 30))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", classify.period(day, end, F.lit(as_of).cast("date")).alias("period"))


@query("S09_ranked_roles", """WITH r AS (SELECT c_custkey, [' Maire ', '3ème adjointe', 'Adjoint aux finances', 'conseillère', '', 'Maire-adjoint', '12e Adjoint', NULL][1 + c_custkey % 8] AS role FROM customer)
    SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 40 WHEN 5 THEN 0 WHEN 6 THEN 12 ELSE 50 END AS rank FROM r""")
def ranked_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.lit(r) for r in (" Maire ", "3ème adjointe", "Adjoint aux finances", "conseillère", "", "Maire-adjoint", "12e Adjoint", None)])
    return table(spark, sf_dir, "customer").select("c_custkey", classify.role_rank(F.element_at(said, (1 + F.col("c_custkey") % 8).cast("int"))).alias("rank"))


@query("J06_actors_of_events", CIVIC_SQL + "SELECT v.event_id, v.role, e.id AS entity_id, e.name, a.date FROM event_entities v JOIN entities e ON e.id = v.entity_id JOIN acts_dated a ON a.id = v.event_id")
def actors_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    named = c.event_entities.join(c.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return named.join(c.events.select(F.col("id").alias("event_id"), "date"), "event_id").select("event_id", "role", "entity_id", "name", "date")


@query("J21_by_register_number", CIVIC_SQL + ", told AS (SELECT o_orderkey AS mention_id, lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS siren FROM orders) SELECT mention_id, e.id AS entity_id FROM told LEFT JOIN entities e ON e.siren = told.siren")
def by_register_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = civic(spark, sf_dir).entities.where("siren IS NOT NULL").select(F.col("id").alias("entity_id"), "siren")
    told = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mention_id"), F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("siren"))
    return told.join(known, "siren", "left").select("mention_id", "entity_id")


@query("R06_mandates_to_record", CIVIC_SQL + """, register AS (SELECT DISTINCT o_custkey * 3 AS person_id, ['élu_cm', 'adjoint', 'maire'][1 + o_custkey % 3] AS relation_type, strftime(min(o_orderdate), '%Y-%m-%d') AS since FROM orders GROUP BY o_custkey),
    held AS (SELECT e.node AS person_id, r.relation_type, r.since FROM ends e JOIN relations r ON r.id = e.id WHERE r.until IS NULL)
    SELECT g.person_id, g.relation_type, g.since, CASE WHEN h.n IS NULL THEN 'insert' ELSE 'divergent' END AS finding FROM register g
    LEFT JOIN (SELECT person_id, relation_type, count(*) AS n, list(coalesce(since, '')) AS starts FROM held GROUP BY ALL) h ON h.person_id = g.person_id AND h.relation_type = g.relation_type WHERE h.n IS NULL OR NOT list_contains(h.starts, g.since)""")
def mandates_to_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register's mandates are those of customers, from their first order on."""
    kinds = F.array(*map(F.lit, ("élu_cm", "adjoint", "maire")))
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    register = first.select((F.col("o_custkey") * 3).alias("person_id"), F.element_at(kinds, (1 + F.col("o_custkey") % 3).cast("int")).alias("relation_type"), F.date_format("first", "yyyy-MM-dd").alias("since"))
    held = doubled(civic(spark, sf_dir).relations.select("id", "relation_type", "since", "until", "from_id", "to_id")).withColumnRenamed("node", "person_id")
    return resolve.mandates_to_record(register, held)


@query("M05_inserted_by_member", """WITH e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts FROM events)
    SELECT k, min(event_id) AS event_id FROM e WHERE k % 3 = 0 GROUP BY k
    UNION ALL SELECT k, min(event_id) FROM e WHERE k IS NOT NULL AND k % 3 > 0 GROUP BY k""")
def inserted_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events come in unless one with their member k is there; the first of several comes."""
    keyed = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")
    there = keyed.where("k % 3 = 0").groupBy("k").agg(F.min("event_id").alias("event_id"))
    return merge.inserted(there, keyed.where("k IS NOT NULL"), ["k"], F.col("event_id"))


@query("M08_guarded_purge", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def guarded_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt go, but for those that an open case is attached to."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    cases = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return merge.swept(customers, customers.where("c_acctbal >= 0"), ["c_custkey"], cases).select("c_custkey")


@query("G05_active_graph", CIVIC_SQL + """, active AS (SELECT id, from_id, to_id FROM relations WHERE until IS NULL AND relation_type IN ('dirigeant', 'président')),
    d AS (SELECT node FROM (SELECT from_id AS node, id FROM active UNION SELECT to_id, id FROM active) GROUP BY node HAVING count(*) >= 2)
    SELECT id AS relation_id FROM active WHERE from_id IN (FROM d) AND to_id IN (FROM d)""")
def active_graph(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Open relations of the groups that a reader chose, between nodes that have enough of them."""
    active = civic(spark, sf_dir).relations.where("until IS NULL AND relation_type IN ('dirigeant', 'président')").select("id", "from_id", "to_id")
    nodes = degrees(active).where(F.col("degree") >= least)
    return induced(active, nodes).select(F.col("id").alias("relation_id"))


@query("F44_top_amounts", """WITH a AS (SELECT user_id, list(CAST(value AS DOUBLE) ORDER BY event_id) AS v FROM events GROUP BY user_id)
    SELECT user_id, array_to_string(list_transform(list_sort(list_filter(v, lambda x: x BETWEEN 10 AND 50000000), 'DESC')[:5], lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS cents FROM a""")
def top_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of a user's events under either generation of keys, as one JSON text."""
    one = F.when(F.col("event_id") % 2 == 0, F.struct(F.col("value").alias("value"), F.lit(None).cast("double").alias("montant"))).otherwise(F.struct(F.lit(None).cast("double").alias("value"), F.col("value").alias("montant")))
    metadata = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(one).alias("montants"))).alias("metadata"))  # a user's events, some dozens
    cents = F.transform(jsons.top_amounts(F.col("metadata")), lambda v: F.round(v * 100).cast("long").cast("string"))
    return metadata.select("user_id", F.array_join(cents, ",").alias("cents"))


@query("F03_normal_forms", f"""WITH t AS (SELECT doc_id, {FOLD_SQL.format(x="text")} AS f FROM documents)
    SELECT doc_id, trim(regexp_replace(upper(replace(f, 'ß', 'SS')), '[^a-zA-Z0-9]+', ' ', 'g')) AS upper_form, regexp_replace(lower(f), '[^a-zA-Z0-9]+', '', 'g') AS tight, trim(regexp_replace(lower(f), '[^a-zA-Z0-9''-]+', ' ', 'g')) AS hyphened, coalesce(regexp_matches(text, '\\p{{L}}'), FALSE) AS lettered FROM t JOIN documents USING (doc_id)""")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms that collectors compare names by."""
    name, folded = F.col("text"), F.col("folded")
    form = lambda **how: text.normalise(folded, folded=True, **how)
    forms = (form(case="upper").alias("upper_form"), form(separator="").alias("tight"), form(keep="'-").alias("hyphened"), text.has_letter(name).alias("lettered"))
    return text.once(table(spark, sf_dir, "documents"), "folded", text.fold(name)).select("doc_id", *forms)


@query("F34_geocoded", """WITH a AS (
    SELECT o_custkey AS id, ['ign', 'ign', 'ign', 'ban', 'ban', 'osm'][1 + o_orderkey % 6] AS service, ['housenumber', 'locality', 'free', 'address', 'commune', 'free'][1 + o_orderkey % 6] AS kind, CASE WHEN o_orderkey % 6 = 3 AND o_orderkey % 2 = 1 THEN 1 ELSE 1 + o_orderkey % 2 END AS rank,
        CASE WHEN o_orderkey % 35 > 0 THEN o_totalprice END AS lat, o_orderkey * 1.0 AS lng, (o_orderkey % 21) / 20e0 AS score FROM orders
), g AS (
    SELECT *, CASE WHEN service = 'ign' AND kind = 'housenumber' AND score >= 0.5 THEN 0 WHEN service = 'ign' AND kind = 'locality' AND score >= 0.4 THEN 1 WHEN service = 'ign' AND kind = 'free' AND score >= 0.35 THEN 2
        WHEN service = 'ban' AND kind = 'address' AND score > 0.5 THEN 3 WHEN service = 'ban' AND kind = 'commune' AND score > 0.4 THEN 4 END AS step FROM a WHERE rank = 1 AND lat IS NOT NULL
), best AS (SELECT id, arg_min(score, (step, -score)) AS score, arg_min(service, (step, -score)) AS source, min(step) AS step FROM g WHERE step IS NOT NULL GROUP BY id)
SELECT c_custkey AS id, CASE WHEN c_custkey % 12 > 0 THEN score END AS score, CASE WHEN c_custkey % 12 > 0 THEN source END AS source, CASE WHEN c_custkey % 12 > 0 THEN step END AS step FROM customer LEFT JOIN best ON best.id = c_custkey""")
def geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers of services about their customers' addresses; some addresses are blank or unknown."""
    n = F.col("o_orderkey")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (1 + n % 6).cast("int"))
    rank = F.when((n % 6 == 3) & (n % 2 == 1), 1).otherwise(1 + n % 2)
    answers = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), pick("ign", "ign", "ign", "ban", "ban", "osm").alias("service"), pick("housenumber", "locality", "free", "address", "commune", "free").alias("kind"), rank.alias("rank"),
        F.when(n % 35 > 0, F.col("o_totalprice")).alias("lat"), n.cast("double").alias("lng"), ((n % 21) / 20).alias("score"),
    )
    address = F.when(F.col("c_custkey") % 24 == 0, " ").when(F.col("c_custkey") % 12 > 0, F.concat(F.lit("Rue "), "c_name"))
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), address.alias("address"))
    return resolve.geocoded(places, answers, "id").select("id", "score", "source", "step")
