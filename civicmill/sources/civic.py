"""A civic data set, as actors, relations, money flows and acts, over the driver's star schema.

Customers stand for persons, suppliers for businesses, parts for associations and public services; each order is a relation between its
customer and the part of its largest line, and a money flow from that line's supplier to that part; shipped orders are
dated acts. The operators take frames of this shape wherever they come from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.sources.tables import shared_folder, table

#: Relation and flow types by order priority; a third of the deputies sit on the shared council instead.
RELATION_TYPES = {"1-URGENT": "élu_cm", "2-HIGH": "adjoint", "3-MEDIUM": "dirigeant", "4-NOT SPECIFIED": "président", "5-LOW": "membre_commission"}
FLOW_TYPES = {"1-URGENT": "subvention", "2-HIGH": "marche_public", "3-MEDIUM": "subvention_region", "4-NOT SPECIFIED": "bail", "5-LOW": "DETR_demande"}
SOURCES = {"F": "ofgl", "O": "decp", "P": "cm"}


@dataclass
class Civic:
    """entities(id, type, name, commune, address, siren, confidence, perimetre, balance) · relations(id, from_id, to_id,
    relation_type, since, until, source, confidence) · flows(id, type, year, amount, from_id, to_id, event_id, source) ·
    events(id, date) · event_entities(event_id, entity_id, role)"""

    entities: DataFrame
    relations: DataFrame
    flows: DataFrame
    events: DataFrame
    event_entities: DataFrame


def _named(key: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _graded(key: Column) -> tuple[Column, Column]:
    """(confidence, perimetre) of a key."""
    confidence = F.when(key % 5 == 0, "probable").when(key % 5 == 1, "hypothesis").when(key % 5 == 2, "confirmed").otherwise("verified")
    scope = F.when(key % 6 == 1, "C1").when(key % 6 == 2, "C2").when(key % 6 == 3, "C3").when(key % 6 == 4, "lien").when(key % 6 == 5, "hors")
    return confidence, scope


#: (application, folder) -> where its acts are written.
_WRITTEN: dict[tuple[str, str], str] = {}


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their largest line: relations, flows and events alike come from them.

    The join is written once a session, for each folder of tables, which are taken not to change meanwhile; each frame of
    each query then reads the columns it needs.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        line = F.max(F.struct("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey"))
        main = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(line.alias("line"), F.max("l_shipdate").alias("shipped"))
        acts = table(spark, sf_dir, "orders").join(main, F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 3).alias("person"), (F.col("line.l_partkey") * 3 + 2).alias("association"), (F.col("line.l_suppkey") * 3 + 1).alias("business"),
            "o_orderpriority", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), F.date_format("shipped", "yyyy-MM-dd").alias("shipped"), F.year("o_orderdate").alias("year"),
        )
        path = shared_folder(spark, "acts")
        acts.write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def civic(spark: SparkSession, sf_dir: str) -> Civic:
    read = lambda name: table(spark, sf_dir, name)
    place = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    person = read("customer").select(
        (F.col("c_custkey") * 3).alias("id"), F.lit("person").alias("type"), F.col("c_name").alias("name"), place("c_nationkey").alias("commune"),
        F.concat(F.lit("Rue "), "c_mktsegment", F.lit(" "), place("c_nationkey")).alias("address"), F.lit(None).cast("string").alias("siren"), F.col("c_acctbal").alias("balance"),
    )
    business = read("supplier").select(
        (F.col("s_suppkey") * 3 + 1).alias("id"), F.lit("business").alias("type"), F.col("s_name").alias("name"), place("s_nationkey").alias("commune"),
        F.concat(F.lit("Place "), place("s_nationkey")).alias("address"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("siren"), F.col("s_acctbal").alias("balance"),
    )
    association = read("part").select(
        (F.col("p_partkey") * 3 + 2).alias("id"), F.when(F.col("p_partkey") % 7 == 0, "service").otherwise("association").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("commune"),
        F.concat(F.lit("Rue "), F.col("p_size").cast("string"), F.lit(" "), "p_brand").alias("address"), F.lit(None).cast("string").alias("siren"), F.col("p_retailprice").alias("balance"),
    )
    confidence, scope = _graded(F.col("id"))
    entities = person.union(business).union(association).withColumns({"confidence": confidence, "perimetre": scope})

    acts = _acts(spark, sf_dir)
    swapped, source = F.col("id") % 2 == 1, _named(F.col("o_orderstatus"), SOURCES)
    relations = acts.select(
        "id", F.when(swapped, F.col("association")).otherwise(F.col("person")).alias("from_id"), F.when(swapped, F.col("person")).otherwise(F.col("association")).alias("to_id"),
        F.when((F.col("o_orderpriority") == "2-HIGH") & (F.col("id") % 3 == 0), "élu_cc").otherwise(_named(F.col("o_orderpriority"), RELATION_TYPES)).alias("relation_type"), F.when(F.col("o_orderstatus") != "P", F.col("ordered")).alias("since"),
        F.when(F.col("o_orderstatus") == "F", F.col("shipped")).alias("until"), source.alias("source"), confidence.alias("confidence"),
    )
    dated = F.col("o_orderstatus") == "F"
    flows = acts.select("id", _named(F.col("o_orderpriority"), FLOW_TYPES).alias("type"), "year", F.round("o_totalprice").cast("long").alias("amount"), F.col("business").alias("from_id"), F.col("association").alias("to_id"), F.when(dated, F.col("id")).alias("event_id"), source.alias("source"))
    events = acts.where(dated).select("id", F.col("shipped").alias("date"))
    lines = read("lineitem")
    subject = lines.select(F.col("l_orderkey").alias("event_id"), (F.col("l_partkey") * 3 + 2).alias("entity_id"), F.lit("sujet").alias("role"))
    actor = lines.select(F.col("l_orderkey").alias("event_id"), (F.col("l_suppkey") * 3 + 1).alias("entity_id"), F.lit("acteur").alias("role"))
    return Civic(entities, relations, flows, events, subject.union(actor).distinct())


#: The same frames for DuckDB, as common table expressions; queries follow.
CIVIC_SQL = """
WITH graded AS (
    SELECT c_custkey * 3 AS id, 'person' AS type, c_name AS name, 'N' || c_nationkey AS commune, 'Rue ' || c_mktsegment || ' N' || c_nationkey AS address,
        CAST(NULL AS VARCHAR) AS siren, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey * 3 + 1, 'business', s_name, 'N' || s_nationkey, 'Place N' || s_nationkey, lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), s_acctbal FROM supplier
    UNION ALL SELECT p_partkey * 3 + 2, CASE WHEN p_partkey % 7 = 0 THEN 'service' ELSE 'association' END, p_name, p_brand, 'Rue ' || p_size || ' ' || p_brand, NULL, p_retailprice FROM part
), entities AS (
    SELECT *, CASE id % 5 WHEN 0 THEN 'probable' WHEN 1 THEN 'hypothesis' WHEN 2 THEN 'confirmed' ELSE 'verified' END AS confidence,
        CASE id % 6 WHEN 1 THEN 'C1' WHEN 2 THEN 'C2' WHEN 3 THEN 'C3' WHEN 4 THEN 'lien' WHEN 5 THEN 'hors' END AS perimetre FROM graded
), main AS (
    SELECT l_orderkey, max({'a': l_extendedprice, 'b': l_linenumber, 'part': l_partkey, 'supp': l_suppkey}) AS line, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey
), acts AS (
    SELECT o_orderkey AS id, o_custkey * 3 AS person, line.part * 3 + 2 AS association, line.supp * 3 + 1 AS business, o_orderpriority, o_orderstatus, o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d') AS ordered, strftime(shipped, '%Y-%m-%d') AS shipped, CAST(year(o_orderdate) AS INTEGER) AS year,
        CASE o_orderstatus WHEN 'F' THEN 'ofgl' WHEN 'O' THEN 'decp' WHEN 'P' THEN 'cm' END AS source
    FROM orders JOIN main ON o_orderkey = l_orderkey
), relations AS (
    SELECT id, CASE WHEN id % 2 = 1 THEN association ELSE person END AS from_id, CASE WHEN id % 2 = 1 THEN person ELSE association END AS to_id,
        CASE WHEN o_orderpriority = '2-HIGH' AND id % 3 = 0 THEN 'élu_cc' WHEN o_orderpriority = '1-URGENT' THEN 'élu_cm' WHEN o_orderpriority = '2-HIGH' THEN 'adjoint' WHEN o_orderpriority = '3-MEDIUM' THEN 'dirigeant' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'président' WHEN o_orderpriority = '5-LOW' THEN 'membre_commission' END AS relation_type,
        CASE WHEN o_orderstatus <> 'P' THEN ordered END AS since, CASE WHEN o_orderstatus = 'F' THEN shipped END AS until, source,
        CASE id % 5 WHEN 0 THEN 'probable' WHEN 1 THEN 'hypothesis' WHEN 2 THEN 'confirmed' ELSE 'verified' END AS confidence
    FROM acts
), flows AS (
    SELECT id, CASE o_orderpriority WHEN '1-URGENT' THEN 'subvention' WHEN '2-HIGH' THEN 'marche_public' WHEN '3-MEDIUM' THEN 'subvention_region' WHEN '4-NOT SPECIFIED' THEN 'bail' WHEN '5-LOW' THEN 'DETR_demande' END AS type,
        year, CAST(round(o_totalprice) AS BIGINT) AS amount, business AS from_id, association AS to_id, CASE WHEN o_orderstatus = 'F' THEN id END AS event_id, source
    FROM acts
), acts_dated AS (
    SELECT id, shipped AS date FROM acts WHERE o_orderstatus = 'F'
), event_entities AS (
    SELECT l_orderkey AS event_id, l_partkey * 3 + 2 AS entity_id, 'sujet' AS role FROM lineitem UNION SELECT l_orderkey, l_suppkey * 3 + 1, 'acteur' FROM lineitem
), ends AS (
    SELECT id, from_id AS node, to_id AS other FROM relations UNION ALL SELECT id, to_id, from_id FROM relations WHERE from_id <> to_id
)
"""
