"""Graph operators as joins: ego networks, overviews, one-hop propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.functions.text import once
from civicmill.operators.edges import degrees, doubled, induced
from civicmill.operators.publish import public_confidence


def ego_network(edges: DataFrame, start: DataFrame, depth: int = 2, first_hop: int = 50, most: int = 120) -> DataFrame:
    """(node, hop) around ``start`` (node): at most ``first_hop`` neighbours by degree at hop 1, ``most`` nodes in all.

    The caps are part of what a reader is shown. A hop is a join of the frontier with the doubled edges and an anti-join
    with what was seen. Its result, at most ``most`` rows by the caps, goes through the driver, so no hop plans the hops
    before it again; degrees are counted for the hop's neighbours only.
    """
    spark = edges.sparkSession
    ends = doubled(edges.select("id", "from_id", "to_id")).persist()  # read twice a hop; let go below
    schema = f"node {ends.schema['node'].dataType.simpleString()}, hop int"
    seen = [(r["node"], 0) for r in start.select("node").distinct().orderBy("node").limit(most).collect()]
    frontier = seen
    try:
        for hop in range(1, depth + 1):
            known = spark.createDataFrame(seen, schema).select(F.col("node").alias("other"))
            last = spark.createDataFrame(frontier, schema).select("node")
            near = ends.join(F.broadcast(last), "node", "left_semi").select("other").distinct().join(F.broadcast(known), "other", "left_anti")  # at most ``first_hop + most`` rows a hop
            degree = ends.join(near.select(F.col("other").alias("node")), "node", "left_semi").groupBy("node").agg(F.count("id").alias("degree"))
            ranked = degree.orderBy(F.desc("degree"), "node").limit(first_hop if hop == 1 else most)
            frontier = [(r["node"], hop) for r in ranked.collect()]
            seen = seen + frontier
    finally:
        ends.unpersist()
    return spark.createDataFrame(seen, schema).orderBy("hop", "node").limit(most)


def overview(edges: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the ``most`` nodes of highest degree, and the edges among them."""
    nodes = degrees(edges).where(F.col("degree") >= least).orderBy(F.desc("degree"), "node").limit(most)
    return nodes, induced(edges, nodes)


def linked_scope(entities: DataFrame, edges: DataFrame, inside: tuple[str, ...] = ("C1", "C2"), label: str = "lien") -> DataFrame:
    """(id, perimetre): entities outside that touch one inside become ``label``; one hop, no chain."""
    members = entities.where(F.col("perimetre").isin(*inside)).select(F.col("id").alias("node"))
    touched = doubled(edges.select("id", "from_id", "to_id")).join(members, "node", "left_semi").select(F.col("other").alias("id")).distinct().withColumn("touched", F.lit(True))
    rows = entities.select("id", "perimetre").join(touched, "id", "left")
    promoted = F.col("touched").isNotNull() & ~F.coalesce(F.col("perimetre").isin(*inside), F.lit(False))
    return rows.select("id", F.when(promoted, label).otherwise(F.col("perimetre")).alias("perimetre"))


#: Relations by which a commune belongs to a body that decides in its place.
MEMBERSHIPS = ("adhère_à", "membre_de")


def classified_scopes(entities: DataFrame, relations: DataFrame, flows: DataFrame, contracts: DataFrame, declared: Column) -> DataFrame:
    """(id, scope) of every entity: the declared scope, then bodies that a member joins, then what is linked.

    A body outside that something belongs to counts with the neighbours. What is then still outside but related to an
    entity inside, party to a money flow, or holder of a contract (holder_id) is a link. Links are found from the scopes
    before any was given, so they make no chain; authorities above (C3) stay what they are.
    """
    first = once(entities, "scope", declared).select("id", "scope")
    joined = relations.where(F.col("relation_type").isin(*MEMBERSHIPS)).select(F.col("to_id").alias("id")).distinct().withColumn("joined", F.lit(True))
    outside = F.col("scope") == "hors"
    placed = first.join(joined, "id", "left").select("id", F.when(outside & F.col("joined"), "C2").otherwise(F.col("scope")).alias("scope"))
    inside = placed.where(F.col("scope").isin("C1", "C2")).select(F.col("id").alias("node"))
    related = doubled(relations.select("id", "from_id", "to_id")).join(inside, "node", "left_semi").select(F.col("other").alias("id"))
    parties = flows.select(F.explode(F.array("from_id", "to_id")).alias("id"))
    touched = related.union(parties).union(contracts.select("holder_id")).where(F.col("id").isNotNull()).distinct().withColumn("touched", F.lit(True))
    return placed.join(touched, "id", "left").select("id", F.when(outside & F.col("touched"), "lien").otherwise(F.col("scope")).alias("scope"))


def public_money(relations: DataFrame, flows: DataFrame, contracts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(node): who got public money, by a flow, a contract (holder_id) or a relation of such a kind.

    Aggregates would count a detail twice and a grant that is only asked for is no money, so flows count that are detail
    (scope) and paid (status), which both are what they are when unknown.
    """
    real = (F.coalesce("scope", F.lit("detail")) == "detail") & (F.coalesce("status", F.lit("realise")) == "realise")
    paid = flows.where(real & F.col("to_id").isNotNull()).select(F.col("to_id").alias("node"))
    holders = contracts.where(F.col("holder_id").isNotNull()).select(F.col("holder_id").alias("node"))
    named = relations.where(F.col("relation_type").isin(*kinds) & public_confidence(F.col("confidence")))
    ends = doubled(named.select("id", "from_id", "to_id")).where(F.col("node").isNotNull()).select("node")
    return paid.union(holders).union(ends).distinct()


def relevance_closure(entities: DataFrame, relations: DataFrame, money: DataFrame, sole: DataFrame, civic: tuple[str, ...], economic: tuple[str, ...]) -> DataFrame:
    """(id, why) of the persons that may be named: those with a civic role, then those tied to a body of public money.

    ``money`` holds who got some (node). Persons and relations count with a public confidence only. A tie to a sole
    proprietor (``sole``, node), who is their own business, says nothing.
    """
    persons = entities.where((F.col("type") == "person") & public_confidence(F.col("confidence"))).select("id")
    known = relations.where(public_confidence(F.col("confidence"))).select("id", "relation_type", "from_id", "to_id")
    holders = doubled(known.where(F.col("relation_type").isin(*civic))).select(F.col("node").alias("id"), F.lit(0).alias("rank"))
    ties = doubled(known.where(F.col("relation_type").isin(*economic)).select("id", "from_id", "to_id"))
    own = ties.join(sole, "node", "left_semi").select("id").distinct()  # relations with a sole proprietor at either end
    fed = ties.join(own, "id", "left_anti").join(money, "node", "left_semi")
    tied = fed.select(F.explode(F.array("node", "other")).alias("id"), F.lit(1).alias("rank"))
    best = holders.union(tied).groupBy("id").agg(F.min("rank").alias("rank"))
    return best.join(persons, "id", "left_semi").select("id", F.when(F.col("rank") == 0, "civic").otherwise("economic").alias("why"))
