"""The civic views: cross mandates, conflicts of interest, beneficiaries, awardees, addresses, families, influence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.functions.chronology import chronology, severity
from civicmill.operators.edges import doubled
from civicmill.sources.tables import placed

#: Relation and flow types that the views tell apart.
ELECTIVE = ("élu_cm", "élu_cc", "candidat", "adjoint")
ELECTIVE_OR_MAYOR = ("élu_cm", "élu_cc", "adjoint", "maire", "candidat")
PRIVATE = ("dirigeant", "gérant", "président", "associé")
OTHER_ROLES = ("agent_communal", "membre_commission", "responsable")
GRANTS = ("subvention", "subvention_demandee", "subvention_region", "DETR_demande", "DSIL_demande", "Fonds_Vert_demande", "FPIC")
PUBLIC_MONEY = ("subvention", "subvention_demandee", "marche_public", "marché", "DETR_demande", "DSIL_demande", "Fonds_Vert_demande", "subvention_region")


def sorted_list(c, sep: str = ","):
    """Distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def cross_mandates(entities: DataFrame, relations: DataFrame, least: int = 2) -> DataFrame:
    """Persons with at least ``least`` kinds of role. Pre-aggregates per (person, kind), so no distinct is expanded."""
    kept = relations.where(F.col("relation_type").isin(*ELECTIVE, *PRIVATE, *OTHER_ROLES)).select("id", "from_id", "to_id", "relation_type")
    by_kind = doubled(kept).groupBy("node", "relation_type").agg(F.count("*").alias("n"))
    by_person = by_kind.groupBy("node").agg(
        F.count("*").alias("n_roles"),
        sorted_list("relation_type").alias("roles"),
        F.sum(F.when(F.col("relation_type").isin(*ELECTIVE), F.col("n")).otherwise(0)).alias("n_elective"),
        F.sum(F.when(F.col("relation_type").isin(*PRIVATE), F.col("n")).otherwise(0)).alias("n_private"),
    )
    persons = entities.where("type = 'person'").select("id", "name")
    return by_person.where(F.col("n_roles") >= least).join(persons, F.col("node") == F.col("id")).select(F.col("id").alias("person_id"), "name", "n_roles", "roles", "n_elective", "n_private")


def conflicts(entities: DataFrame, relations: DataFrame, flows: DataFrame, events: DataFrame, parts: int | None = None) -> DataFrame:
    """Elected persons who lead a body that public money touches, with how the money stands in time to the mandate.

    Both relation sides and the flow side are equi-joins on a doubled frame; the outcome is a column, not a join. Roles
    are placed by person, then cases and money by body, in ``parts`` partitions (default: as the session has it). Money
    without an act meets no act, where the join would bring all of it into one task.
    """
    ends = doubled(relations.select("id", "from_id", "to_id", "relation_type", "since", "until"))
    persons = entities.where("type = 'person'").select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    bodies = entities.where(F.col("type").isin("business", "association")).select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("type").alias("entity_type"))
    elected = ends.where(F.col("relation_type").isin(*ELECTIVE_OR_MAYOR)).select(F.col("node").alias("person_id"), F.col("relation_type").alias("elective_role"), F.col("since").alias("mandate_start"), F.col("until").alias("mandate_end"))
    leading = ends.where(F.col("relation_type").isin(*PRIVATE)).select(F.col("node").alias("person_id"), F.col("other").alias("entity_id"), F.col("relation_type").alias("entity_role"), F.col("since").alias("role_start"))
    money = flows.where(F.col("type").isin(*PUBLIC_MONEY)).select("id", "type", "year", "amount", "event_id", "source", "from_id", "to_id")
    acts = events.select(F.col("id").alias("event_id"), F.col("date").alias("flow_date"))
    dated = placed(money.where("event_id IS NOT NULL"), "event_id", parts).join(acts, "event_id", "left")
    undated = money.where("event_id IS NULL").withColumn("flow_date", F.lit(None).cast(events.schema["date"].dataType))
    money = doubled(dated.unionByName(undated)).select(F.col("node").alias("entity_id"), F.col("id").alias("flow_id"), F.col("type").alias("flow_type"), F.col("amount").alias("flow_amount"), F.col("year").alias("flow_year"), "flow_date", F.col("source").alias("flow_source"))
    roles = placed(elected, "person_id", parts).distinct().join(placed(leading, "person_id", parts).distinct(), "person_id").join(persons, "person_id")
    cases = placed(roles, "entity_id", parts).join(bodies, "entity_id").join(placed(money, "entity_id", parts), "entity_id", "left")
    outcome = chronology(F.col("flow_id"), F.col("flow_year"), F.col("flow_date"), F.col("mandate_start"), F.col("mandate_end"))
    return cases.select("person_id", "person_name", "elective_role", "mandate_start", "mandate_end", "entity_id", "entity_name", "entity_type", "entity_role", "role_start", "flow_id", "flow_type", "flow_amount", "flow_year", "flow_date", "flow_source", outcome.alias("chronology"))


def conflict_cases(found: DataFrame) -> DataFrame:
    """One row per (person, entity, flow): roles as sets, chronology reduced to its most serious outcome."""
    grouped = found.groupBy("person_id", "entity_id", "flow_id").agg(sorted_list("elective_role").alias("elective_roles"), sorted_list("entity_role").alias("entity_roles"), F.min(severity(F.col("chronology"))).alias("severity"), F.max("flow_amount").alias("flow_amount"))
    return grouped


def beneficiaries(entities: DataFrame, flows: DataFrame) -> DataFrame:
    """Grants by beneficiary and kind. Aggregated before the join with names, on integer keys."""
    kept = flows.where(F.col("type").isin(*GRANTS))
    sums = kept.groupBy("to_id", "type").agg(F.count("*").alias("n_flows"), F.sum("amount").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), sorted_list("source").alias("sources"))
    return sums.join(entities.select("id", "name", F.col("type").alias("entity_type")), F.col("to_id") == F.col("id")).select(F.col("id").alias("entity_id"), "name", "entity_type", F.col("type").alias("flow_type"), "n_flows", "total", "first_year", "last_year", "sources")


def shared_addresses(entities: DataFrame, least: int = 3) -> DataFrame:
    """Addresses that ``least`` bodies or more give; filler and bare postcode addresses are left out."""
    a = F.col("address")
    kept = entities.where(a.isNotNull() & (a != "") & ~a.contains("[ND]") & ~a.rlike("^[0-9]{5} ") & F.col("type").isin("business", "association", "service"))
    counted = kept.groupBy("address").agg(F.count("*").alias("n_entities"), F.count_if(F.col("type") == "business").alias("n_business"), F.count_if(F.col("type") == "association").alias("n_associations"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("entity_ids"))
    return counted.where(F.col("n_entities") >= least)


def influence(entities: DataFrame, relations: DataFrame, flows: DataFrame, event_entities: DataFrame, distinct_amounts: bool = True) -> DataFrame:
    """Relations, money and acts of each entity as one score.

    Each branch is summed on its own before it is joined, where a chain of outer joins would multiply them.
    ``distinct_amounts``: equal amounts count once, as the score has always been defined; False sums every flow.
    """
    ties = doubled(relations.select("id", "from_id", "to_id")).groupBy("node").agg(F.count("*").alias("n_relations"))
    amounts = doubled(flows.select("id", "from_id", "to_id", F.abs("amount").alias("amount")))
    if distinct_amounts:
        amounts = amounts.select("node", "amount").distinct()
    money = amounts.groupBy("node").agg(F.sum("amount").alias("total_flow"))
    acts = event_entities.select("entity_id", "event_id").distinct().groupBy(F.col("entity_id").alias("node")).agg(F.count("*").alias("n_events"))
    rows = entities.select(F.col("id").alias("node"), "type", "name").join(ties, "node", "left").join(money, "node", "left").join(acts, "node", "left").na.fill(0, ["n_relations", "total_flow", "n_events"])
    score = F.col("n_relations") + F.expr("total_flow div 10000") + F.col("n_events") * 3
    return rows.select(F.col("node").alias("entity_id"), "type", "name", "n_relations", "total_flow", "n_events", score.alias("score"))


def entourage(entities: DataFrame, relations: DataFrame, flows: DataFrame) -> DataFrame:
    """(id, roles) of persons who lead an association, or a body that public money reaches, and hold no elective role.

    ``roles``: sorted distinct structs (organisation, role, reason). Leading any other business opens no door.
    """
    kinds = entities.select("id", "type")
    leads = doubled(relations.where(F.col("relation_type").isin(*PRIVATE)).select("id", "from_id", "to_id", "relation_type"))
    persons = leads.join(kinds.where("type = 'person'").select(F.col("id").alias("node")), "node").select("node", "other", "relation_type")
    associations = kinds.where("type = 'association'").select(F.col("id").alias("other"), F.lit("association").alias("reason"))
    paid = flows.where("to_id IS NOT NULL").select(F.col("to_id").alias("other"), F.lit("money").alias("reason")).distinct()
    elected = doubled(relations.where(F.col("relation_type").isin(*ELECTIVE_OR_MAYOR)).select("id", "from_id", "to_id")).select("node").distinct()
    roles = persons.join(associations.union(paid), "other").join(elected, "node", "left_anti").distinct()
    return roles.groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_list(F.struct("other", "relation_type", "reason"))).alias("roles"))
