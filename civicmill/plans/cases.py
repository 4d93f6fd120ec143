"""Cases, reviews, extraction in context, coordinates and listings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicmill.functions import chronology, classify, jsons, numbers, text
from civicmill.operators import civic_views, extract, merge, publish, resolve, search, vector
from civicmill.plans.base import query
from civicmill.plans.labels import LAT_SQL, LNG_SQL
from civicmill.sources import sinks
from civicmill.sources.civic import CIVIC_SQL, civic
from civicmill.sources.tables import table
from civicmill.streaming import incremental


@query("C02_case_status", """WITH c AS (SELECT o_orderkey, o_orderstatus <> 'P' AS paid, o_orderkey % 7 = 0 AS recused, o_custkey % 2 = 0 AS closed, o_orderkey % 6 AS first, o_custkey % 6 AS second FROM orders),
    o AS (SELECT *, CASE least(first, second) WHEN 0 THEN 'contemporain' WHEN 1 THEN 'chevauchement_annee' WHEN 2 THEN 'anterieur_mandat' WHEN 3 THEN 'hors_mandat' WHEN 4 THEN 'dates_manquantes' ELSE 'lien_sans_flux' END AS outcome FROM c)
    SELECT o_orderkey, outcome, CASE WHEN NOT paid THEN 'lien_sans_versement' WHEN recused THEN 'deport_constate' WHEN outcome = 'hors_mandat' THEN 'hors_mandat'
    WHEN outcome = 'anterieur_mandat' AND closed THEN 'hors_mandat' WHEN outcome = 'anterieur_mandat' THEN 'chronologie_incertaine' ELSE 'deport_non_trouve' END AS status FROM o""")
def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, chronology.OUTCOMES))
    both = F.array(*[F.element_at(names, (F.col(c) % 6 + 1).cast("int")) for c in ("o_orderkey", "o_custkey")])
    rows = table(spark, sf_dir, "orders").withColumn("outcome", chronology.best_outcome(both))
    status = chronology.case_status(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 7 == 0, F.col("outcome"), F.col("o_custkey") % 2 == 0)
    return rows.select("o_orderkey", "outcome", status.alias("status"))


@query("J19_recusals", """WITH cases AS (SELECT c_custkey AS case_id, 'c' || c_custkey % 500 AS who, CASE WHEN c_custkey % 5 <> 0 THEN lower(c_mktsegment) END AS about, CASE WHEN c_custkey % 7 <> 0 THEN CAST(1995 + c_custkey % 7 AS VARCHAR) END AS year FROM customer),
    acts AS (SELECT o_orderkey AS act_id, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, 'c' || o_custkey % 500 AS who, CASE o_orderkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE 'furniture' END AS about FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT case_id, act_id FROM cases c JOIN acts a ON c.who = a.who WHERE (c.about IS NULL OR c.about = a.about) AND (c.year IS NULL OR a.date IS NULL OR contains(a.date, c.year)) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY a.date NULLS LAST, act_id) = 1""")
def recusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    cases = table(spark, sf_dir, "customer").select(
        key.alias("case_id"), F.array(F.concat(F.lit("c"), key % 500), F.lit("case")).alias("who"), F.when(key % 5 != 0, F.array(F.lower("c_mktsegment"))).alias("about"), F.when(key % 7 != 0, (1995 + key % 7).cast("int")).alias("year"),
    )
    act, about = F.col("o_orderkey"), F.array(*map(F.lit, ("building", "machinery", "furniture")))
    acts = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        act.alias("act_id"), F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.array(F.lit("act"), F.concat(F.lit("c"), F.col("o_custkey") % 500)).alias("who"), F.array(F.element_at(about, (act % 3 + 1).cast("int"))).alias("about"),
    )
    return resolve.first_overlap(cases, acts)


@query("J14_contained_names", "SELECT s_suppkey AS name_id, c_custkey AS text_id FROM supplier, customer WHERE contains(c_name || ' ' || lower(c_mktsegment), CASE WHEN s_suppkey % 9 = 0 THEN right(s_name, 2) WHEN s_suppkey % 9 <> 1 THEN right(s_name, 4) END)")
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    names = table(spark, sf_dir, "supplier").select(key.alias("name_id"), F.when(key % 9 == 0, F.right("s_name", F.lit(2))).when(key % 9 == 1, "").otherwise(F.right("s_name", F.lit(4))).alias("name"))
    return resolve.contained_pairs(names, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("text_id"), F.concat_ws(" ", "c_name", F.lower("c_mktsegment")).alias("text")))


@query("J22_reviewed_facts", """WITH f AS (SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS amount, CAST(year(o_orderdate) AS INTEGER) AS year, 'probable' AS confidence, o_orderpriority = '5-LOW' AS noted, o_orderkey % 5 AS k FROM orders)
    SELECT id, CASE WHEN noted AND k = 1 THEN 1000 ELSE amount END AS amount, CASE WHEN noted AND k = 2 THEN 1999 ELSE year END AS year, CASE WHEN noted AND k = 3 THEN 'verified' ELSE confidence END AS confidence,
    CASE WHEN noted AND k = 1 AND amount <> 1000 THEN 'amount' WHEN noted AND k = 2 AND year <> 1999 THEN 'year' END AS corrected, CASE WHEN noted AND k = 3 THEN 'seen' END AS review_note FROM f WHERE NOT (noted AND k = 0)""")
def reviewed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    facts = orders.select(F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("long").alias("amount"), F.year("o_orderdate").alias("year"), F.lit("probable").alias("confidence"))
    fixes = F.when(k == 1, F.create_map(F.lit("amount"), F.lit("1000"), F.lit("year"), F.lit("soon"))).when(k == 2, F.create_map(F.lit("year"), F.lit("1999")))
    notes = orders.where("o_orderpriority = '5-LOW'").select(
        F.col("o_orderkey").alias("object_id"), F.when(k == 0, "rejected").otherwise("confirmed").alias("review_status"), F.when(k == 3, "verified").alias("confidence"), F.when(k == 3, " seen ").otherwise(" ").alias("note"), fixes.alias("corrections"),
    )
    return publish.reviewed(facts, notes, ["amount", "year"]).withColumn("corrected", F.array_join("corrected", ","))


@query("J27_lists_of_contests", """WITH l AS (SELECT l_suppkey, l_returnflag, l_linestatus, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS votes FROM lineitem GROUP BY ALL), c AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS booths FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
    SELECT l_suppkey, l_returnflag, l_linestatus, l_partkey, votes, booths, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY votes DESC, l_partkey) AS place FROM l JOIN c USING (l_suppkey, l_returnflag, l_linestatus)""")
def lists_of_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of each contest (place, ballot, round), most votes first; contests without a result have none."""
    contest = ["l_suppkey", "l_returnflag", "l_linestatus"]
    lines = table(spark, sf_dir, "lineitem")
    lists = lines.groupBy(*contest, "l_partkey").agg(F.sum("l_quantity").cast("long").alias("votes"))
    contests = lines.where("l_returnflag <> 'N'").groupBy(*contest).agg(F.count("*").alias("booths"))
    place = F.row_number().over(Window.partitionBy(*contest).orderBy(F.desc("votes"), "l_partkey"))
    return lists.join(contests, contest).withColumn("place", place)


@query("J28_entourage", CIVIC_SQL + """, leads AS (SELECT DISTINCT node AS id, other, relation_type FROM ends JOIN relations USING (id) JOIN entities e ON e.id = node WHERE relation_type IN ('dirigeant', 'gérant', 'président', 'associé') AND e.type = 'person'),
    doors AS (SELECT id AS other, 'association' AS reason FROM entities WHERE type = 'association' UNION ALL SELECT DISTINCT to_id, 'money' FROM flows WHERE to_id IS NOT NULL), elected AS (SELECT node FROM ends JOIN relations USING (id) WHERE relation_type IN ('élu_cm', 'élu_cc', 'adjoint', 'maire', 'candidat'))
    SELECT l.id, string_agg(other || ':' || relation_type || ':' || reason, ',' ORDER BY other, relation_type, reason) AS roles FROM leads l JOIN doors USING (other) WHERE l.id NOT IN (SELECT node FROM elected) GROUP BY l.id""")
def entourage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    found = civic_views.entourage(c.entities, c.relations, c.flows)
    return found.select("id", F.array_join(F.transform("roles", lambda r: F.concat_ws(":", r["other"].cast("string"), r["relation_type"], r["reason"])), ",").alias("roles"))


@query("F16_snippets", "WITH d AS (SELECT doc_id, text, CAST(instr(lower(text), 'license') AS INTEGER) AS pos FROM documents) SELECT doc_id, '…' || substr(text, greatest(pos - 40, 1), pos - greatest(pos - 40, 1)) || '<mark>' || substr(text, pos, 7) || '</mark>' || substr(text, pos + 7, 80) || '…' AS snippet FROM d WHERE pos > 0")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", search.snippet(F.col("text"), "license").alias("snippet")).where("snippet IS NOT NULL")


@query("F21_prices_per_m2", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber = 4 THEN 0 ELSE l_quantity * 16 END, 0), 1) AS by_land, round(l_extendedprice / 64, 1) AS by_built FROM lineitem WHERE l_linenumber % 3 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, round(l_extendedprice / 64, 1), round(l_extendedprice / 64, 1) FROM lineitem WHERE l_linenumber % 3 = 0")
def prices_per_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    land = F.when(line % 3 == 0, None).when(line == 4, 0.0).otherwise(F.col("l_quantity") * 16)
    nothing, built = F.lit(None).cast("double"), F.lit(64.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.price_per_m2(price, land, built).alias("by_land"), numbers.price_per_m2(price, nothing, built).alias("by_built"))


@query("F25_roman_numerals", "SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS value FROM part")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tens, ones = F.split(F.lit(" X XX XXX XL L"), " "), F.split(F.lit(" I II III IV V VI VII VIII IX"), " ")
    text = F.concat(F.get(tens, F.expr("p_size div 10").cast("int")), F.lower(F.get(ones, F.col("p_size") % 10)))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.roman(F.when(F.col("p_partkey") % 10 == 0, F.col("p_type")).otherwise(text)).alias("value"))


@query("F27_event_dates", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS p, o_orderkey % 6 AS k FROM orders), d AS (SELECT *, CASE k WHEN 0 THEN make_date(year(p) + CASE WHEN 3 < month(p) - 1 THEN 1 ELSE 0 END, 3, 14) WHEN 1 THEN make_date(year(p) + 1, 2, 5) WHEN 2 THEN NULL
    WHEN 3 THEN make_date(year(p) + CASE WHEN 8 < month(p) - 1 THEN 1 ELSE 0 END, 8, 1) END AS found FROM o) SELECT o_orderkey, coalesce(found, p) AS date, CASE WHEN found IS NULL THEN 'publication' ELSE 'texte' END AS origin FROM d""")
def event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    published, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    title = F.when(k == 0, "Concert du 14 mars").when(k == 1, F.concat(F.lit("Loto le 05/02/"), F.year(published) + 1)).when(k == 2, F.concat(F.lit("Souvenir du 3 juin "), F.year(published) - 2)).when(k == 4, "Bal du 31 février")
    found = numbers.event_date(title, F.when(k == 3, "Rendez-vous le 1er août, salle des fêtes"), published)
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("found")).select("o_orderkey", "found.*")


@query("F29_placeholder_dates", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN FALSE ELSE strftime(o_orderdate, '%m-%d') IN ('12-25', '01-01') OR o_custkey % 50 = 0 END AS placeholder FROM orders")
def placeholder_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_custkey") % 50 == 0, "1900-05-06").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.placeholder_date(date).alias("placeholder"))


PROJECTION_SQL = """{0}, p AS (SELECT *, radians(lat) AS phi, 0.08181919106 * sin(radians(lat)) AS es FROM {1}), q AS (SELECT *, 11754255.426096 * exp(-0.7256077650532670 * ln(tan(pi() / 4 + phi / 2) * pow((1 - es) / (1 + es), 0.08181919106 / 2))) AS r, 0.7256077650532670 * (radians(lng) - radians(3)) AS turn FROM p)"""


@query("F31_projections", PROJECTION_SQL.format(CIVIC_SQL + f", g AS (SELECT id, {LAT_SQL} AS lat, {LNG_SQL} AS lng FROM entities)", "g") + " SELECT id, round(700000 + r * sin(turn), 3) AS x, round(12655612.049876 - r * cos(turn), 3) AS y, round(lat, 6) AS lat, CASE WHEN lat IS NOT NULL THEN round(lng, 6) END AS lng FROM q")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected metres, and the degrees that they give back."""
    x, y = numbers.lambert93(F.expr(LAT_SQL), F.expr(LNG_SQL))
    placed = civic(spark, sf_dir).entities.select("id", x.alias("x"), y.alias("y"))
    lat, lng = numbers.wgs84(F.col("x"), F.col("y"))
    return placed.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


@query("M15_placed_by_hand", PROJECTION_SQL.format("WITH m AS (SELECT s_suppkey, s_nationkey, 44 + (s_suppkey % 40) / 20e0 AS lat, 3 + s_nationkey / 15e0 AS lng FROM supplier WHERE s_acctbal > 5000)", "m") + """ SELECT s.s_suppkey AS id, coalesce(q.lat, 45e0) AS lat, coalesce(q.lng, 3e0) AS lng,
    CASE WHEN q.lat IS NULL THEN 'ban' ELSE 'manual' END AS geo_source, CASE WHEN q.lat IS NULL THEN 0.4 ELSE 1.0 END AS geo_score, coalesce(round(700000 + r * sin(turn), 3), 0e0) AS x, coalesce(round(12655612.049876 - r * cos(turn), 3), 0e0) AS y FROM supplier s LEFT JOIN q USING (s_suppkey)""")
def placed_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    rows = suppliers.select(F.col("s_suppkey").alias("id"), *[F.lit(v).alias(c) for c, v in {"lat": 45.0, "lng": 3.0, "geo_source": "ban", "geo_score": 0.4, "x": 0.0, "y": 0.0}.items()])
    lat = F.when(F.col("s_acctbal") > 5000, 44 + (F.col("s_suppkey") % 40) / 20.0)
    moved = merge.placed_by_hand(rows, suppliers.select(F.col("s_suppkey").alias("id"), lat.alias("lat"), (3 + F.col("s_nationkey") / 15.0).alias("lng")))
    return moved.withColumns({c: F.round(c, 3) for c in ("x", "y")})


@query("F42_changed_members", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS seen, FALSE AS still FROM events")
def changed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("json", jsons.with_member(jsons.with_member(F.col("props"), "seen", F.lit("no")), "seen", F.col("event_type")))
    still = F.get_json_object(jsons.without_member(F.col("json"), "k"), "$.k").isNotNull()
    return rows.select("event_id", F.get_json_object("json", "$.k").alias("k"), F.get_json_object("json", "$.seen").alias("seen"), still.alias("still"))


@query("F50_packed_vectors", "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS n_bytes, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last, TRUE AS same FROM embeddings")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vector.packed("embedding").alias("blob"))
    back = blobs.select("vec_id", "embedding", F.octet_length("blob").alias("n_bytes"), vector.unpacked("blob").alias("back"))
    return back.select("vec_id", "n_bytes", F.get("back", F.lit(0)).cast("double").alias("first"), F.element_at("back", -1).cast("double").alias("last"), (F.col("back") == F.col("embedding")).alias("same"))


@query("T05_amounts_in_context", """WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS price, o_orderkey % 90 AS small FROM orders) SELECT o_orderkey, 0 AS at, price + 0.5e0 AS value, repeat('x', 63) || ' Le conseil vote ' || price || ',50 € pour la voirie, soit ' || small || ' € d''aide.' AS context FROM o
    UNION ALL SELECT o_orderkey, 1, CAST(small AS DOUBLE), right(repeat('x', 70) || ' Le conseil vote ' || price || ',50 € pour la voirie, soit ', 80) || small || ' € d''aide.' FROM o WHERE small > 0""")
def amounts_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, small = F.round("o_totalprice").cast("long").cast("string"), (F.col("o_orderkey") % 90).cast("string")
    told = F.concat(F.lit("x" * 70 + " Le conseil\nvote "), price, F.lit(",50 € pour la voirie, soit "), small, F.lit(" € d'aide."))
    return extract.amounts_in_context(table(spark, sf_dir, "orders").select("o_orderkey", told.alias("text")), "o_orderkey", "text")


@query("T06_votes", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 12 WHEN 1 THEN o_custkey % 30 WHEN 2 THEN 9 END AS pour, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 0 END AS contre, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS abstentions,
    CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 5 = 3 END AS unanimite FROM orders""")
def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    told = (
        F.when(k == 0, "Adopté par 12 voix « pour » à l'unanimité")
        .when(k == 1, F.concat(F.lit("par "), F.col("o_custkey") % 30, F.lit(" voix Pour et 1 abstention et 2 contre")))
        .when(k == 2, "9 voix pour et 3 contres. 5 abstentions hier")
        .when(k == 3, "Le conseil, à l’unanimité, approuve")
        .otherwise("Le conseil prend acte")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", extract.vote(told).alias("vote")).select("o_orderkey", "vote.*")


@query("T16_mentions", """WITH pages AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents), named AS (SELECT * FROM pages WHERE regexp_matches(body, '(?i)licen[sc]e')),
    hits AS (SELECT doc_id, page, lower(unnest(regexp_extract_all(body, '(?i)licen[sc]e'))) AS term FROM named UNION ALL SELECT doc_id, page, 'THEME:' || lower(unnest(regexp_extract_all(body, '(?i)software|copyright|free'))) FROM named) SELECT doc_id, CAST(page AS INTEGER) AS page, term, count(*) AS n FROM hits GROUP BY ALL""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "body")).withColumn("page", F.col("page") + 1)
    found = extract.mentions(pages, "doc_id", "page", "body", "(?i)licen[sc]e", "(?i)software|copyright|free")
    return found.where("excerpt <> ''").groupBy("doc_id", "page", "term").agg(F.count("*").alias("n"))


@query("T17_in_context", "SELECT doc_id, unnest(regexp_extract_all(text, '(?is).{0,20}(?:license).{0,60}')[1:3]) AS excerpt FROM documents")
def in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.in_context(F.col("text"), "license", 3, 20, 60)).alias("excerpt"))


@query("C14_geo_status", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'missing' WHEN l_returnflag = 'R' THEN 'ok_manual' WHEN l_suppkey % 4 < 3 OR l_linenumber = 2 OR l_discount * 10 < 0.6 THEN 'imprecise' ELSE 'ok' END AS status FROM lineitem")
def geo_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    nth = F.col("l_suppkey") % 4
    service = F.when(nth == 0, "osm").when(nth == 1, "ban").when(nth == 3, "cadastre")
    source = F.when(F.col("l_returnflag") == "R", "manual").otherwise(service)
    status = classify.geo_status(F.when(line != 1, F.lit(45.0)), F.lit(3.0), source, F.when(line != 2, F.col("l_discount") * 10))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", status.alias("status"))


@query("C15_candidate_scores", "SELECT p_partkey, greatest(20, 50 - 8 * p_size) AS by_name, 70 + 20 * (p_partkey % 5 / 4e0) AS by_words FROM part")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", classify.shared_name_score(F.col("p_size")).alias("by_name"), classify.overlap_score(F.col("p_partkey") % 5 / 4.0).alias("by_words"))


@query("C18_editable", "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS editable FROM orders")
def editable(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("o_orderstatus") == "F", "atelier").when(F.col("o_orderstatus") == "O", "verbatim").when(F.col("o_orderkey") % 2 == 0, "institutionnel")
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.editable(origin).alias("editable"))


@query("SNK04_memberships", CIVIC_SQL + "SELECT 'membership/' || r.id AS id, p.id AS person_id, b.id AS organization_id, relation_type AS role, since AS start_date, until AS end_date FROM relations r JOIN entities p ON p.id IN (from_id, to_id) AND p.type = 'person' JOIN entities b ON b.id IN (from_id, to_id) AND b.type <> 'person'")
def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return sinks.memberships(c.relations, c.entities)


@query("SNK03_features", """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (s_nationkey + 0.5) || ',45.5]},"properties":{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}}' AS json FROM supplier WHERE s_acctbal > 0""")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat = F.when(F.col("s_acctbal") > 0, F.lit(45.5))
    return sinks.geojson_features(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_nationkey") + 0.5).alias("lng"), lat.alias("lat")), "lng", "lat", ["s_suppkey", "s_name"])


@query("X08_paged_listings", """WITH f AS (SELECT l_suppkey AS source, l_partkey AS key, min(l_linenumber) AS page FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), n AS (SELECT DISTINCT source, page FROM f), gap AS (SELECT source, min(p) AS stop FROM (SELECT source, unnest(range(1, 9)) AS p FROM (SELECT DISTINCT source FROM f)) g WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source = g.source AND n.page = g.p) GROUP BY source)
    SELECT source, page, key FROM f JOIN gap USING (source) WHERE page < stop""")
def paged_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return incremental.listed(lines.select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("key")))


@query("F06_clean_labels", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'L''' || p_name || ', rue d’en haut' WHEN 2 THEN 'A.A.P.P.M.A.' WHEN 3 THEN p_name || '...' WHEN 4 THEN p_name || ' (A.C.L.G.)' ELSE '' END AS label FROM part""")
def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey") % 6
    raw = (
        F.when(k == 0, F.concat(F.lit("« "), name, F.lit(' » "'), F.upper(name), F.lit('".')))
        .when(k == 1, F.concat(F.lit("L'  "), name, F.lit(" , rue d’ en  haut .")))
        .when(k == 2, "A.A.P.P.M.A.")
        .when(k == 3, F.concat(name, F.lit("...")))
        .when(k == 4, F.concat(name, F.lit(" (A.C.L.G.). ")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_label(raw).alias("label"))


def _one_of(values: tuple[str, ...], key: str, n: int) -> Column:
    """The value at ``key`` modulo ``n``, null beyond the last."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % n).cast("int"))


@query("C05_origins", "SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'atelier' WHEN 1 THEN 'verbatim' WHEN 3 THEN 'verbatim' WHEN 4 THEN 'verbatim' WHEN 5 THEN 'institutionnel' WHEN 6 THEN 'institutionnel' WHEN 8 THEN 'institutionnel' END AS origin FROM orders")
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _one_of(("Atelier 2026", "CM 28/05/2026", "cmx", "Préfecture-30", "https://www.ville.example/elections", "Élections 2020", "RNA", "rnaud", "  data.gouv.fr", "inconnu"), "o_orderkey", 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.origin_of(source, ("ville.example",)).alias("origin"))


@query("C09_roles", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'gérant' WHEN 1 THEN 'président' WHEN 2 THEN 'associé' WHEN 3 THEN 'dirigeant' WHEN 4 THEN 'dirigeant' END AS role FROM orders")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = _one_of(("Président et Gérant", "VICE-PRÉSIDENTE", "associe unique", "Directeur général", "Liquidateur"), "o_orderkey", 6)
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.role_of(quality).alias("role"))


@query("C10_announcement_kinds", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'bodacc_creation' WHEN 1 THEN 'bodacc_depot' WHEN 2 THEN 'bodacc_divers' END AS kind FROM orders")
def announcement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = _one_of(("immatriculation", "Dépôt", "avis", "autre"), "o_orderkey", 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.announcement_kind(family).alias("kind"))


@query("T04_leases", """WITH b AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, chr(CAST(65 + o_custkey % 26 AS INTEGER)) AS c FROM orders WHERE o_orderkey % 4 = 0)
    SELECT year, 'Maison de la place - Dupont ' || c || c AS place, 'Dupont ' || c || c AS tenant, 1417.73e0 AS amount, FALSE AS monthly, min(o_orderkey) AS o_orderkey FROM b GROUP BY year, c UNION ALL SELECT year, 'Lotissement - Villa rouge', '', 250e0, TRUE, min(o_orderkey) FROM b GROUP BY year""")
def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("o_orderkey") % 4 == 0, "Loyers communaux").otherwise("Divers")
    letter = F.char(65 + F.col("o_custkey") % 26)
    body = F.concat(F.lit("Total général 5,00\nMaison de la  place - Dupont "), letter, letter, F.lit(" 1 417,73\nPAR MOIS\nLotissement - Villa rouge 250.00 \nAu-dessus de tout 200000,00\nsans montant"))
    acts = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), title.alias("title"), body.alias("text"))
    return extract.leases(acts, "o_orderkey", "date", "title", "text")


@query("T07_attendance", """SELECT o_orderkey, unnest(['presents', 'presents', 'presents', 'absents', 'pouvoirs']) AS block, unnest([1, 1, 2, 3, 4]) AS at, unnest(['M. Durand', 'Mme Paul', 'M. Henri Martin' || CASE WHEN o_orderkey % 2 = 0 THEN '-Roy' ELSE '' END, 'Mme de Noire', 'M. Blanc donne pouvoir à Mme Paul']) AS name FROM orders""")
def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = F.concat(F.lit("Séance du conseil de M. Personne\nPRÉSENTS : M. Durand, Mme Paul\nM. Henri Martin"), F.when(F.col("o_orderkey") % 2 == 0, "-Roy").otherwise(""), F.lit("\nAbsents : Mme de Noire\nM. Blanc donne pouvoir à Mme Paul\n____\nM. Plus Tard"))
    return extract.attendance(table(spark, sf_dir, "orders").select("o_orderkey", minutes.alias("text")), "o_orderkey", "text")
