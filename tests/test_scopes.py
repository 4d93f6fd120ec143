"""Work that must not be done again for each use."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicmill.functions.classify import SUPRA, declared_scope


def test_names_are_folded_once(spark):
    told = [(1, "Mairie", " Saint-Été d'en Haut"), (2, "Club", "Œuf-lès-Bois"), (3, "Office des Deux   Rives", None), (4, f"la {SUPRA[0]} du Gard", "x"), (5, None, None), (6, "Boules", "x")]
    df = spark.createDataFrame(told, "id long, name string, commune string")
    scope = df.select("id", declared_scope(F.col("name"), F.col("commune"), "Saint-Été d'en Haut", ("Œuf-lès-Bois", "N3"), "CC des Deux-Rives").alias("scope"))
    assert [r["scope"] for r in scope.orderBy("id").collect()] == ["C1", "C2", "C2", "C3", "hors", "hors"]
    plan = scope._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2  # of the name and the commune
