"""Sinks: JSON documents with an envelope, one document per entity, GeoJSON, search indexes, interoperability frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicmill.operators.edges import doubled


def json_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """(``key``, json) of each row, nulls left out."""
    keys = [F.col(key)] if key else []
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, compact; files are written by tasks, none passes through the driver."""
    df.write.mode("overwrite").json(path)


def entity_bundles(entities: DataFrame, relations: DataFrame, flows: DataFrame) -> DataFrame:
    """Entities with arrays of their relations and received flows.

    Children are grouped by key first, so each entity meets one row per kind; arrays are as long as an entity's own
    children, sorted.
    """
    ends = doubled(relations.select("id", "from_id", "to_id", "relation_type"))
    ties = ends.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("other", "id", "relation_type"))).alias("relations"))
    money = flows.groupBy("to_id").agg(F.array_sort(F.collect_list(F.struct("year", "id", "amount", "type"))).alias("flows"))
    no_ties, no_money = F.array().cast(ties.schema["relations"].dataType), F.array().cast(money.schema["flows"].dataType)
    rows = entities.join(ties, F.col("id") == F.col("node"), "left").join(money, F.col("id") == F.col("to_id"), "left").drop("node", "to_id")
    return rows.withColumns({"relations": F.coalesce("relations", no_ties), "flows": F.coalesce("flows", no_money)})


def write_bundles(bundles: DataFrame, path: str, buckets: int = 256) -> None:
    """A folder per bucket of ids, JSON lines within: stale documents go with the overwritten table."""
    bundles.withColumn("bucket", F.pmod(F.col("id"), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def geojson_features(df: DataFrame, lng: str, lat: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature per row that has coordinates."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    rows = df.where(F.col(lng).isNotNull() & F.col(lat).isNotNull())
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("json"))


def search_index(actors: DataFrame, acts: DataFrame, contracts: DataFrame, payments: DataFrame) -> DataFrame:
    """(kind, id, title, weight) of four kinds; each frame has (id, title, links or dated). Actors weigh by links."""
    one = lambda df, kind, weight: df.select(F.lit(kind).alias("kind"), "id", "title", weight.cast("long").alias("weight"))
    rows = one(actors, "acteur", 1000 + F.col("links")).unionByName(one(acts, "acte", F.when(F.col("decision"), 700).otherwise(500)))
    return rows.unionByName(one(contracts, "marché", F.lit(600))).unionByName(one(payments, "versement", F.lit(400)))


def memberships(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Interoperability view of memberships: a person, an organisation, a role and its dates."""
    kinds = entities.select(F.col("id").alias("node"), F.col("type").alias("kind"))
    ends = doubled(relations.select("id", "from_id", "to_id", "relation_type", "since", "until"))
    persons = ends.join(kinds.where("kind = 'person'"), "node")
    bodies = kinds.where("kind <> 'person'").select(F.col("node").alias("other"))
    return persons.join(bodies, "other").select(F.concat(F.lit("membership/"), F.col("id").cast("string")).alias("id"), F.col("node").alias("person_id"), F.col("other").alias("organization_id"), F.col("relation_type").alias("role"), F.col("since").alias("start_date"), F.col("until").alias("end_date"))
