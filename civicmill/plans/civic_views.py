"""The civic views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.operators import civic_views as views
from civicmill.operators.edges import doubled
from civicmill.operators.graph import public_money, relevance_closure
from civicmill.operators.publish import ECONOMIC, PUBLIC_MONEY, PUBLIC_ROLES, breaches, decide_entities, decide_flows, decide_relations, scope_allows, seated
from civicmill.operators.quality import classified, outside_list
from civicmill.plans.base import query
from civicmill.sources.civic import CIVIC_SQL, Civic, civic
from civicmill.sources.tables import checkpointed, parts_of

#: Relations, each of them several rows of a case, in one partition.
RELATIONS = 100_000

#: Outcomes in the order in which their tests are made; the first that holds is the outcome.
CONFLICTS_SQL = CIVIC_SQL + """, seats AS (
    SELECT ends.node AS holder, ends.other AS body, relation_type AS kind, since AS begun, until AS ended FROM ends JOIN relations USING (id)
), paid AS (
    SELECT DISTINCT unnest([from_id, to_id]) AS party, flows.id, flows.type, amount, year, flows.source, acts_dated.date AS day
    FROM flows LEFT JOIN acts_dated ON acts_dated.id = event_id
    WHERE list_contains(['subvention', 'subvention_demandee', 'marche_public', 'marché', 'DETR_demande', 'DSIL_demande', 'Fonds_Vert_demande', 'subvention_region'], flows.type)
), leaders AS (
    SELECT holder, kind AS entity_role, begun AS role_start, body AS entity_id, entities.name AS entity_name, entities.type AS entity_type
    FROM seats JOIN entities ON entities.id = body
    WHERE list_contains(['dirigeant', 'gérant', 'président', 'associé'], kind) AND list_contains(['association', 'business'], entities.type)
), elected AS (
    SELECT holder, entities.name AS person_name, kind AS elective_role, begun AS mandate_start, ended AS mandate_end
    FROM seats JOIN entities ON entities.id = holder AND entities.type = 'person'
    WHERE list_contains(['élu_cm', 'élu_cc', 'adjoint', 'maire', 'candidat'], kind)
), met AS (
    SELECT * EXCLUDE (party), try_cast(left(mandate_start, 4) AS INTEGER) AS opens, try_cast(left(mandate_end, 4) AS INTEGER) AS closes
    FROM elected JOIN leaders USING (holder) LEFT JOIN paid ON party = entity_id
), conflicts AS (
    SELECT DISTINCT entity_id, entity_name, entity_type, entity_role, role_start, holder AS person_id, person_name, elective_role, mandate_start, mandate_end,
        id AS flow_id, type AS flow_type, year AS flow_year, day AS flow_date, amount AS flow_amount, source AS flow_source,
        list_filter([
            if(id IS NULL, 'lien_sans_flux', NULL), if(mandate_start IS NULL AND mandate_end IS NULL, 'dates_manquantes', NULL),
            if(day > mandate_end, 'hors_mandat', NULL), if(day < mandate_start, 'anterieur_mandat', NULL), if(day IS NOT NULL, 'contemporain', NULL),
            if(year > closes, 'hors_mandat', NULL), if(year < opens, 'anterieur_mandat', NULL), if(year IN (opens, closes), 'chevauchement_annee', NULL), 'contemporain'
        ], lambda o: o IS NOT NULL)[1] AS chronology
    FROM met
)
"""


@query("J09_conflicts", CONFLICTS_SQL + "SELECT * FROM conflicts")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return views.conflicts(c.entities, c.relations, c.flows, c.events, parts_of(c.relations, F.lit(1), RELATIONS))


@query("A19_conflict_cases", CONFLICTS_SQL + """SELECT person_id, entity_id, flow_id, string_agg(DISTINCT elective_role, ',' ORDER BY elective_role) AS elective_roles,
    string_agg(DISTINCT entity_role, ',' ORDER BY entity_role) AS entity_roles,
    CAST(min(list_position(['contemporain', 'chevauchement_annee', 'anterieur_mandat', 'hors_mandat', 'dates_manquantes', 'lien_sans_flux'], chronology)) - 1 AS INTEGER) AS severity,
    max(flow_amount) AS flow_amount FROM conflicts GROUP BY ALL""")
def conflict_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.conflict_cases(conflicts(spark, sf_dir))


@query("A02_cross_mandates", CIVIC_SQL + """, kinds AS (SELECT node, relation_type AS kind, count(*) AS n FROM ends JOIN relations USING (id) GROUP BY ALL
), summed AS (
    SELECT node AS person_id, array_to_string(list_sort(list(kind)), ',') AS roles, len(list(kind)) AS n_roles,
        CAST(coalesce(sum(n) FILTER (kind IN ('élu_cm', 'élu_cc', 'adjoint', 'candidat')), 0) AS BIGINT) AS n_elective,
        CAST(coalesce(sum(n) FILTER (kind IN ('associé', 'dirigeant', 'gérant', 'président')), 0) AS BIGINT) AS n_private
    FROM kinds GROUP BY node
)
SELECT summed.*, name FROM summed JOIN entities ON entities.id = person_id WHERE entities.type = 'person' AND n_roles > 1""")
def cross_mandates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return views.cross_mandates(c.entities, c.relations)


@query("A03_beneficiaries", CIVIC_SQL + """SELECT e.id AS entity_id, e.name, e.type AS entity_type, f.type AS flow_type, count(*) AS n_flows, CAST(sum(amount) AS BIGINT) AS total,
    min(year) AS first_year, max(year) AS last_year, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
    FROM flows f JOIN entities e ON e.id = f.to_id WHERE f.type IN ('subvention', 'subvention_region', 'DETR_demande') GROUP BY e.id, e.name, e.type, f.type""")
def beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return views.beneficiaries(c.entities, c.flows)


@query("A05_shared_addresses", CIVIC_SQL + """SELECT address, count(*) AS n_entities, count(*) FILTER (type = 'business') AS n_business, count(*) FILTER (type = 'association') AS n_associations,
    string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS entity_ids FROM entities WHERE type <> 'person' GROUP BY address HAVING count(*) >= 3""")
def shared_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.shared_addresses(civic(spark, sf_dir).entities)


INFLUENCE_SQL = CIVIC_SQL + """, t AS (SELECT node, count(*) AS n FROM ends GROUP BY node),
    a AS (SELECT from_id AS node, abs(amount) AS amount, id FROM flows UNION ALL SELECT to_id, abs(amount), id FROM flows WHERE from_id <> to_id),
    m AS (SELECT node, CAST(sum({distinct} amount) AS BIGINT) AS n FROM a GROUP BY node), v AS (SELECT entity_id AS node, count(DISTINCT event_id) AS n FROM event_entities GROUP BY 1)
    SELECT e.id AS entity_id, e.type, e.name, coalesce(t.n, 0) AS n_relations, coalesce(m.n, 0) AS total_flow, coalesce(v.n, 0) AS n_events,
    coalesce(t.n, 0) + coalesce(m.n, 0) // 10000 + coalesce(v.n, 0) * 3 AS score
    FROM entities e LEFT JOIN t ON t.node = e.id LEFT JOIN m ON m.node = e.id LEFT JOIN v ON v.node = e.id"""


@query("A07_influence", INFLUENCE_SQL.replace("{distinct}", "DISTINCT"))
def influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return views.influence(c.entities, c.relations, c.flows, c.event_entities)


@query("A07_influence_all_flows", INFLUENCE_SQL.replace("{distinct}", ""))
def influence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return views.influence(c.entities, c.relations, c.flows, c.event_entities, distinct_amounts=False)


@query("A22_citations", CIVIC_SQL + """SELECT node AS entity_id, count(*) AS n_citations FROM (SELECT 'r' AS kind, id, from_id AS node FROM relations UNION SELECT 'r', id, to_id FROM relations
    UNION SELECT 'f', id, from_id FROM flows UNION SELECT 'f', id, to_id FROM flows UNION SELECT 'e', event_id, entity_id FROM event_entities) GROUP BY node""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    acts = c.event_entities.select("event_id", "entity_id").distinct().select(F.col("entity_id").alias("node"))
    every = doubled(c.relations.select("id", "from_id", "to_id")).select("node").unionAll(doubled(c.flows.select("id", "from_id", "to_id")).select("node")).unionAll(acts)
    return every.groupBy(F.col("node").alias("entity_id")).agg(F.count("*").alias("n_citations"))


ENTITY_DECISION = """roles AS (SELECT e.node AS id, max(CASE WHEN r.relation_type = 'élu_cc' THEN 1 ELSE 0 END) AS seat FROM ends e JOIN relations r ON r.id = e.id
    WHERE r.relation_type IN ('élu_cm', 'élu_cc', 'candidat', 'adjoint', 'maire') GROUP BY e.node),
decided AS (SELECT e.id, type, perimetre, CASE WHEN coalesce(confidence, '') NOT IN ('verified', 'confirmed') THEN 'confidence' WHEN perimetre IS NULL THEN 'scope_unknown'
    WHEN perimetre IN ('C2', 'C3') AND type <> 'service' AND coalesce(seat, 0) = 0 THEN 'neighbour' WHEN perimetre NOT IN ('C1', 'C2', 'C3', 'lien') THEN 'outside'
    WHEN type = 'person' AND seat IS NULL THEN 'person_without_mandate' ELSE 'public' END AS reason FROM entities e LEFT JOIN roles ON roles.id = e.id)"""


@query("C07_scope_rule", CIVIC_SQL + ", " + ENTITY_DECISION + """ SELECT e.id AS entity_id, e.perimetre AS scope, e.type, coalesce(seat, 0) = 1 AS sits,
    coalesce(e.perimetre = 'C1' OR e.perimetre = 'lien' OR ((e.perimetre = 'C2' OR e.perimetre = 'C3') AND (e.type = 'service' OR coalesce(seat, 0) = 1)), FALSE) AS allowed
    FROM entities e LEFT JOIN roles ON roles.id = e.id""")
def scope_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    allowed = scope_allows(F.col("perimetre"), F.col("type"), F.col("sits"))
    return seated(c.entities, c.relations).select(F.col("id").alias("entity_id"), F.col("perimetre").alias("scope"), "type", "sits", allowed.alias("allowed"))


@query("I01_published_breaches", CIVIC_SQL + ", " + ENTITY_DECISION + """ SELECT d.id AS entity_id, 'breach' AS breach FROM decided d JOIN entities e ON e.id = d.id LEFT JOIN roles ON roles.id = e.id
    WHERE d.reason = 'public' AND (e.confidence NOT IN ('verified', 'confirmed') OR e.perimetre IS NULL OR e.perimetre = 'hors' OR (e.perimetre IN ('C2', 'C3') AND e.type <> 'service' AND coalesce(seat, 0) = 0)
    OR (e.type = 'person' AND seat IS NULL))""")
def published_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row, as long as the decisions keep to the rules."""
    c = civic(spark, sf_dir)
    return breaches(decide_entities(c.entities, c.relations), c.relations).select(F.col("id").alias("entity_id"), "breach")


@query("I03_sources_outside_list", CIVIC_SQL + " SELECT source, count(*) AS n FROM relations WHERE source IS NULL OR source NOT IN ('ofgl', 'decp') GROUP BY source")
def sources_outside_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outside_list(civic(spark, sf_dir).relations, "source", ("ofgl", "decp"))


@query("I06_scope_classified", CIVIC_SQL + " SELECT count(*) AS n_entities, count(perimetre) AS n_classified, count(perimetre) = 0 AS refused FROM entities")
def scope_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(civic(spark, sf_dir).entities, "perimetre")


@query("C12_entity_decisions", CIVIC_SQL + ", " + ENTITY_DECISION + " SELECT id AS entity_id, type, reason, reason = 'public' AS ok FROM decided")
def entity_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return decide_entities(c.entities, c.relations).select(F.col("id").alias("entity_id"), "type", "reason", "ok")


#: The parties of a publication: whose relations carry confidence, who got public money, who is a sole proprietor, who may be named.
PARTIES_SQL = CIVIC_SQL + ", " + ENTITY_DECISION + """, shown AS (SELECT id FROM decided WHERE reason = 'public'
), ties AS (
    SELECT id, CASE id % 10 WHEN 3 THEN 'famille_proche' WHEN 7 THEN 'prestataire' WHEN 8 THEN 'voisin' ELSE relation_type END AS kind, confidence, [from_id, to_id] AS pair FROM relations
), sure AS (SELECT * FROM ties WHERE confidence IN ('verified', 'confirmed')
), sole AS (SELECT id FROM entities WHERE type <> 'person' AND id % 11 = 0
), paid AS (
    SELECT to_id AS id FROM flows WHERE source IS DISTINCT FROM 'ofgl' AND NOT ends_with(type, '_demande') AND id % 4 = 0
    UNION SELECT unnest(pair) FROM sure WHERE kind IN ('bail_loyer', 'bailleur_commune', 'locataire_commune', 'prestataire', 'subvention', 'subventionné')
), seated AS (
    SELECT DISTINCT e.id FROM entities e JOIN (SELECT unnest(pair) AS id FROM sure WHERE kind IN ('adjoint', 'candidat', 'délégué_cc', 'délégué_cm', 'élu_cc', 'élu_cm', 'maire', 'membre_commission')) s ON s.id = e.id
    WHERE e.type = 'person' AND e.confidence IN ('verified', 'confirmed')
), leaders_of AS (
    SELECT DISTINCT e.id FROM entities e JOIN (SELECT unnest(pair) AS id FROM sure WHERE kind IN ('associé', 'dirigeant', 'gérant', 'président', 'secrétaire', 'trésorier')
        AND EXISTS (SELECT 1 FROM paid WHERE list_contains(pair, paid.id)) AND NOT EXISTS (SELECT 1 FROM sole WHERE list_contains(pair, sole.id))) s ON s.id = e.id
    WHERE e.type = 'person' AND e.confidence IN ('verified', 'confirmed')
)"""


def _parties(c: Civic) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Relations of more kinds, and (node) of who is shown, civic, paid, sole and may be named."""
    n = F.col("id") % 10
    relations = c.relations.withColumn("relation_type", F.when(n == 3, "famille_proche").when(n == 7, "prestataire").when(n == 8, "voisin").otherwise(F.col("relation_type")))
    flows = c.flows.where("id % 4 = 0").withColumns({"scope": F.when(F.col("source") == "ofgl", "agregat"), "status": F.when(F.col("type").endswith("_demande"), "demande")})
    nobody = c.entities.select(F.col("id").alias("holder_id")).where(F.lit(False))
    node = lambda rows: rows.select(F.col("id").alias("node"))
    sole, money = node(c.entities.where((F.col("type") != "person") & (F.col("id") % 11 == 0))), checkpointed(public_money(relations, flows, nobody, PUBLIC_MONEY))
    named = checkpointed(relevance_closure(c.entities, relations, money, sole, PUBLIC_ROLES, ECONOMIC))  # each is read several times
    shown = checkpointed(decide_entities(c.entities, c.relations).where("ok").select("id"))
    return relations, {"shown": node(shown), "civic": node(named.where("why = 'civic'")), "money": money, "sole": sole, "persons": node(named)}


@query("C11_relation_decisions", PARTIES_SQL + """ SELECT t.id AS relation_id, CASE WHEN t.confidence IS NULL OR t.confidence NOT IN ('verified', 'confirmed') THEN 'private_confidence'
    WHEN EXISTS (SELECT 1 FROM (SELECT unnest(t.pair) AS e) ANTI JOIN shown ON shown.id = e) THEN 'endpoint_not_public' WHEN contains(kind, 'famille') THEN 'private_relation_type'
    WHEN kind IN ('adjoint', 'candidat', 'maire', 'membre_commission', 'prestataire', 'élu_cc', 'élu_cm') THEN 'public'
    WHEN kind NOT IN ('associé', 'dirigeant', 'gérant', 'président', 'secrétaire', 'trésorier') THEN 'not_in_public_allowlist'
    WHEN a.name = b.name OR a.id IN (FROM sole) OR b.id IN (FROM sole) THEN 'economique_sans_lien_public'
    WHEN a.id IN (FROM seated) OR b.id IN (FROM seated) OR a.id IN (FROM paid) OR b.id IN (FROM paid) THEN 'public_par_pertinence' ELSE 'economique_sans_lien_public' END AS reason
    FROM ties t LEFT JOIN entities a ON a.id = pair[1] LEFT JOIN entities b ON b.id = pair[2]""")
def relation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    relations, p = _parties(c)
    return decide_relations(relations, c.entities, p["shown"], p["civic"], p["money"], p["sole"]).select(F.col("id").alias("relation_id"), "reason")


@query("C13_flow_decisions", PARTIES_SQL + """, told AS (
    SELECT id, CASE WHEN id % 13 = 0 THEN 'cession_fonds' ELSE type END AS type, year, amount, CASE WHEN id % 5 = 0 THEN 4 ELSE from_id END AS from_id, to_id, CASE WHEN id % 7 = 0 THEN 'probable' ELSE 'verified' END AS confidence FROM flows
), every AS (
    SELECT * FROM told UNION ALL SELECT id + 1000000000, type, year, amount, from_id, to_id, confidence FROM told WHERE id % 10 = 0
    UNION ALL SELECT id + 2000000000, type, year, amount, from_id, NULL, 'verified' FROM told WHERE id % 4 = 1 UNION ALL SELECT id + 3000000000, type, year, amount, from_id, (id % 1000) * 3, 'verified' FROM told WHERE id % 6 = 1
), checked AS (
    SELECT * REPLACE (CASE WHEN id % 17 = 1 THEN 'verified' ELSE confidence END AS confidence, CASE WHEN id % 17 = 2 THEN 100 ELSE amount END AS amount) FROM every WHERE id % 17 > 0
), judged AS (
    SELECT *, CASE WHEN confidence <> 'verified' THEN 'private_confidence' WHEN starts_with(type, 'cession') AND from_id IS DISTINCT FROM 4 AND to_id IS DISTINCT FROM 4 THEN 'private_cession'
        WHEN EXISTS (SELECT 1 FROM entities e WHERE e.id IN (from_id, to_id) AND e.type = 'person' AND e.id NOT IN (FROM seated UNION FROM leaders_of)) THEN 'private_person_endpoint'
        WHEN from_id NOT IN (FROM shown) OR to_id NOT IN (FROM shown) THEN 'endpoint_not_public' END AS why FROM checked
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY why, year, amount, type, from_id, to_id ORDER BY id) AS nth, max(to_id) OVER (PARTITION BY why, year, amount, type, from_id) AS named FROM judged
)
SELECT id AS flow_id, coalesce(why, CASE WHEN nth > 1 OR to_id IS NULL AND named IS NOT NULL THEN 'duplicates' ELSE 'public' END) AS reason FROM numbered
UNION ALL SELECT id, 'rejete_en_atelier' FROM every WHERE id % 17 = 0""")
def flow_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with cessions, a commune (4), copies, twins without a beneficiary and payments to persons, and what people made of some of them."""
    c = civic(spark, sf_dir)
    _, p = _parties(c)
    n = F.col("id")
    told = c.flows.select("id", F.when(n % 13 == 0, "cession_fonds").otherwise(F.col("type")).alias("type"), "year", "amount", F.when(n % 5 == 0, 4).otherwise(F.col("from_id")).alias("from_id"), "to_id", F.when(n % 7 == 0, "probable").otherwise("verified").alias("confidence"))
    later = lambda rows, k, **changed: rows.withColumns({"id": n + k * 1_000_000_000} | changed).select(*told.columns)
    none, sure = F.lit(None).cast("long"), F.lit("verified")
    flows = told.union(later(told.where(n % 10 == 0), 1)).union(later(told.where(n % 4 == 1), 2, to_id=none, confidence=sure)).union(later(told.where(n % 6 == 1), 3, to_id=(n % 1000) * 3, confidence=sure))
    kind = n % 17
    given = F.when(kind == 2, F.create_map(F.lit("amount"), F.lit("100")))
    reviews = flows.where(kind < 3).select(n.alias("object_id"), F.when(kind == 0, "rejected").otherwise("checked").alias("review_status"), F.when(kind == 1, "verified").alias("confidence"), F.lit(None).cast("string").alias("note"), given.alias("corrections"))
    return decide_flows(flows, reviews, c.entities, p["shown"], p["persons"], 4).select(F.col("id").alias("flow_id"), "reason")


@query("A23_exclusions", CIVIC_SQL + ", " + ENTITY_DECISION + " SELECT type AS section, reason, count(*) AS n FROM decided WHERE reason <> 'public' GROUP BY ALL")
def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return decide_entities(c.entities, c.relations).where(~F.col("ok")).groupBy(F.col("type").alias("section"), "reason").agg(F.count("*").alias("n"))


@query("SNK02_entity_bundles", CIVIC_SQL + """, r AS (SELECT node, count(*) AS n, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other, id) AS others FROM ends GROUP BY node),
    f AS (SELECT to_id AS node, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM flows GROUP BY to_id)
    SELECT e.id AS entity_id, e.name, coalesce(r.n, 0) AS n_relations, coalesce(r.others, '') AS related, coalesce(f.n, 0) AS n_flows, coalesce(f.total, 0) AS total_received
    FROM entities e LEFT JOIN r ON r.node = e.id LEFT JOIN f ON f.node = e.id""")
def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicmill.sources.sinks import entity_bundles

    c = civic(spark, sf_dir)
    found = entity_bundles(c.entities, c.relations, c.flows)
    related = F.array_join(F.transform("relations", lambda r: r["other"].cast("string")), ",")
    total = F.aggregate("flows", F.lit(0).cast("long"), lambda s, f: s + f["amount"])
    return found.select(F.col("id").alias("entity_id"), "name", F.size("relations").cast("long").alias("n_relations"), related.alias("related"), F.size("flows").cast("long").alias("n_flows"), total.alias("total_received"))
