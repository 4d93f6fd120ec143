"""Publication decisions, default-deny: every row keeps a reason, and only whitelisted reasons are public."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.functions.text import normalise
from civicmill.operators.civic_views import ELECTIVE_OR_MAYOR
from civicmill.operators.edges import doubled

#: Confidence levels that may be published.
PUBLIC_CONFIDENCE = ("verified", "confirmed")
#: Roles that make a person public.
PUBLIC_ROLES = ("adjoint", "candidat", "délégué_cc", "délégué_cm", "élu_cc", "élu_cm", "maire", "membre_commission")
#: Relations that may be published, those that may if they bear on public action, and marks of those that never are.
PUBLIC_RELATIONS = (
    "adjoint", "bail_loyer", "bailleur_commune", "candidat", "délégué_cc", "délégué_cm", "locataire_commune", "maire", "mandat", "membre_commission",
    "prestataire", "président_cc", "subvention", "subventionné", "vice_président_cc", "élu_cc", "élu_cm",
)
ECONOMIC = ("associé", "dirigeant", "gérant", "président", "secrétaire", "trésorier")
PRIVATE_MARKS = ("présumé", "famille", "époux", "enfant", "proche", "même_adresse", "même_lieu_dit", "doublon")
PUBLIC_MONEY = ("bail_loyer", "bailleur_commune", "locataire_commune", "prestataire", "subvention", "subventionné")
#: Kinds of entities that are institutions, and roles that are a seat on the council that communes share.
INSTITUTIONS = ("service",)
COUNCIL_SEATS = ("élu_cc",)


def public_confidence(confidence: Column) -> Column:
    """Unknown is not public."""
    return F.coalesce(confidence.isin(*PUBLIC_CONFIDENCE), F.lit(False))


def scope_allows(scope: Column, kind: Column, sits: Column) -> Column:
    """Whether a scope lets an entity have a page of its own; one that was never classified, or is not known, does not.

    The commune itself and what is linked to it may; of its neighbours only institutions and those who sit on the
    council that the communes share.
    """
    near = scope.isin("C1", "lien") | (scope.isin("C2", "C3") & (kind.isin(*INSTITUTIONS) | sits))
    return F.coalesce(near, F.lit(False))


def scope_reason(scope: Column, kind: Column, sits: Column) -> Column:
    """Why a scope forbids publication, else null."""
    refused = F.when(scope.isNull(), "scope_unknown").when(scope.isin("C2", "C3"), "neighbour").otherwise("outside")
    return F.when(~scope_allows(scope, kind, sits), refused)


def seated(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``entities`` with (mandate, sits): whether one holds an elective role, and whether one sits on the shared council."""
    elective = relations.where(F.col("relation_type").isin(*ELECTIVE_OR_MAYOR)).select("id", "from_id", "to_id", F.col("relation_type").isin(*COUNCIL_SEATS).alias("seat"))
    roles = doubled(elective).groupBy(F.col("node").alias("id")).agg(F.max("seat").alias("sits"))
    return entities.join(roles, "id", "left").withColumns({"mandate": F.col("sits").isNotNull(), "sits": F.coalesce("sits", F.lit(False))})


def decide_entities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``entities`` with (reason, ok): confidence, then scope, then a mandate for persons."""
    reason = F.when(~public_confidence(F.col("confidence")), "confidence").otherwise(scope_reason(F.col("perimetre"), F.col("type"), F.col("sits")))
    reason = F.coalesce(reason, F.when((F.col("type") == "person") & ~F.col("mandate"), "person_without_mandate"), F.lit("public"))
    return seated(entities, relations).withColumn("reason", reason).withColumn("ok", F.col("reason") == "public").drop("mandate", "sits")


def breaches(decided: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, breach) of published entities that must not be: checked from the facts, not from the reasons."""
    shown = seated(decided.where("ok"), relations)
    breach = (
        F.when(F.col("confidence").isNull() | ~F.col("confidence").isin(*PUBLIC_CONFIDENCE), "confidence")
        .when(F.col("perimetre").isNull() | (F.col("perimetre") == "hors"), "scope")
        .when(F.col("perimetre").isin("C2", "C3") & ~F.col("type").isin(*INSTITUTIONS) & ~F.col("sits"), "neighbour")
        .when((F.col("type") == "person") & ~F.col("mandate"), "person")
    )
    return shown.select("id", breach.alias("breach")).where("breach IS NOT NULL")


def _marked(rows: DataFrame, **ids: DataFrame) -> DataFrame:
    """``rows`` with a column for each of ``ids`` (node): how many of their two ends are among them. All sets meet an end in one join."""
    sets = reduce(DataFrame.union, [nodes.select(F.col("node").alias("_node"), F.lit(mark).alias("_mark")) for mark, nodes in ids.items()])
    known = sets.groupBy("_node").agg(*[F.max((F.col("_mark") == mark).cast("int")).alias(f"_in{mark}") for mark in ids])
    for end in ("from_id", "to_id"):
        rows = rows.join(known, F.col(end) == F.col("_node"), "left").drop("_node").withColumnsRenamed({f"_in{mark}": f"{mark}_{end}" for mark in ids})
    total = {mark: F.coalesce(f"{mark}_from_id", F.lit(0)) + F.coalesce(f"{mark}_to_id", F.lit(0)) for mark in ids}
    return rows.withColumns(total).drop(*[f"{mark}_{end}" for mark in ids for end in ("from_id", "to_id")])


def decide_relations(relations: DataFrame, entities: DataFrame, shown: DataFrame, civic: DataFrame, money: DataFrame, sole: DataFrame) -> DataFrame:
    """``relations`` with a reason; those that open with "public" may be published.

    ``shown``, ``civic``, ``money`` and ``sole`` (node each) are the published entities, those with a civic role, those that
    got public money, and sole proprietors. An economic tie is public only if it bears on public action: one end is civic
    or was paid. Not so the tie of sole proprietors to themselves, whom the register knows, or else their name at both ends.
    """
    called = entities.select(F.col("id").alias("_id"), normalise(F.col("name")).alias("_name"))
    rows = _marked(relations, _shown=shown, _civic=civic, _money=money, _sole=sole)
    for end in ("from", "to"):
        rows = rows.join(called, F.col(f"{end}_id") == F.col("_id"), "left").withColumnRenamed("_name", f"_{end}_name").drop("_id")
    same_name = F.coalesce("_from_name", F.lit("")) == F.coalesce("_to_name", F.lit(""))
    relevant = (F.col("_sole") == 0) & ~same_name & ((F.col("_civic") > 0) | (F.col("_money") > 0))
    kind = F.coalesce("relation_type", F.lit(""))
    private = F.lit(False)
    for mark in PRIVATE_MARKS:
        private |= F.contains(kind, F.lit(mark))
    reason = (
        F.when(~public_confidence(F.col("confidence")), "private_confidence")
        .when(F.col("_shown") < 2, "endpoint_not_public")
        .when(private, "private_relation_type")
        .when(kind.isin(*PUBLIC_RELATIONS), "public")
        .when(kind.isin(*ECONOMIC), F.when(relevant, "public_par_pertinence").otherwise("economique_sans_lien_public"))
        .otherwise("not_in_public_allowlist")
    )
    return rows.withColumn("reason", reason).select(*relations.columns, "reason")


def decide_flows(flows: DataFrame, reviews: DataFrame, entities: DataFrame, shown: DataFrame, persons: DataFrame, commune: int) -> DataFrame:
    """``flows`` with a reason, after the review of people, which may reject a flow or settle its confidence.

    Refused are, in this order: rejected flows, those of private confidence, cessions to which the commune (an id) is no
    party, flows with a person at an end who may not be named (``persons``, node: who may), flows with an end that is not
    published (``shown``, node), and repeats: the later ones of equal flows, and a flow without a beneficiary where an equal
    one names it.
    """
    rejected = reviews.where("review_status = 'rejected'").select(F.col("object_id").alias("id")).distinct()
    refused = flows.join(rejected, "id", "left_semi").withColumn("reason", F.lit("rejete_en_atelier"))
    rows = reviewed(flows, reviews, [c for c in flows.columns if c not in ("id", "confidence")]).select(*flows.columns)
    hidden = entities.where("type = 'person'").select(F.col("id").alias("node")).join(persons.select("node"), "node", "left_anti")
    rows = _marked(rows, _hidden=hidden, _shown=shown)
    ends = F.when(F.col("from_id").isNull(), 0).otherwise(1) + F.when(F.col("to_id").isNull(), 0).otherwise(1)
    party = F.coalesce(F.col("from_id") == commune, F.lit(False)) | F.coalesce(F.col("to_id") == commune, F.lit(False))
    reason = (
        F.when(~public_confidence(F.col("confidence")), "private_confidence")
        .when(F.coalesce(F.col("type").startswith("cession"), F.lit(False)) & ~party, "private_cession")
        .when(F.col("_hidden") > 0, "private_person_endpoint")
        .when(F.col("_shown") < ends, "endpoint_not_public")
    )
    rows = rows.withColumn("reason", reason).select(*flows.columns, "reason")
    left = rows.where("reason IS NULL")
    keys = ("year", "amount", "type", "from_id")
    first = left.groupBy(*keys, "to_id").agg(F.min("id").alias("id"))  # nulls are equal to each other here
    named = first.where("to_id IS NOT NULL").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    stays = first.where("to_id IS NOT NULL").select("id").union(first.where("to_id IS NULL").join(named, same, "left_anti").select("id")).withColumn("_stays", F.lit(True))
    last = left.drop("reason").join(stays, "id", "left").withColumn("reason", F.when(F.col("_stays"), "public").otherwise("duplicates"))
    return refused.unionByName(rows.where("reason IS NOT NULL")).unionByName(last.select(*flows.columns, "reason"))


def reviewed(facts: DataFrame, annotations: DataFrame, corrected: list[str], key: str = "id") -> DataFrame:
    """The human overlay: rejected facts go, corrections (a map of text) win over stored values, others pass.

    ``annotations`` has one row a fact at most: (object_id, review_status, confidence, note, corrections). Rows gain
    ``corrected``, the names of the columns whose value a correction changed (null if none), and ``review_note``; the
    reviewer's confidence replaces the fact's. A correction that cannot be read as the column's type is passed over.
    """
    notes = annotations.select(F.col("object_id").alias(key), "review_status", F.col("confidence").alias("_confidence"), F.nullif(F.trim("note"), F.lit("")).alias("review_note"), "corrections")
    rows = facts.join(notes, key, "left").where(F.coalesce(F.col("review_status") != "rejected", F.lit(True)))
    given = {c: F.try_element_at("corrections", F.lit(c)).try_cast(facts.schema[c].dataType) for c in corrected}
    changed = F.array_compact(F.array(*[F.when(v.isNotNull() & ~v.eqNullSafe(F.col(c)), F.lit(c)) for c, v in sorted(given.items())]))
    fixed = {c: F.coalesce(v, F.col(c)) for c, v in given.items()} | {"corrected": F.when(F.size(changed) > 0, changed)}
    if "confidence" in facts.columns:
        fixed["confidence"] = F.coalesce("_confidence", fixed.get("confidence", F.col("confidence")))
    return rows.withColumns(fixed).select(*facts.columns, "corrected", "review_note")
