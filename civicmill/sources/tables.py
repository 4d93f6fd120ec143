"""Columnar tables: one read function, so that filters and column lists reach the scan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name`` below ``folder``; any path that Spark can read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def parts_of(rows: DataFrame, size: Column, most: int) -> int:
    """How many partitions hold ``rows`` with at most about ``most`` of ``size`` each; no fewer than shuffles have."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // most))


def placed(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``rows`` shuffled by ``key`` into ``parts`` partitions (default: as the session has it); what is grouped or joined by that key then stays in place."""
    return rows.repartition(parts, key) if parts else rows.repartition(key)


def unsent(rows: DataFrame) -> DataFrame:
    """``rows`` that the next join shuffles and sorts, and never sends whole through the driver to all tasks.

    For frames that grow with the input: Spark takes rows for as many bytes as their files have, though files are compressed,
    and does not count what an explode adds.
    """
    return rows.hint("merge")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names; on one machine, where that is unset, below one made for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="civicmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/civicmill/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, written below the shared folder and read again; its lineage ends there."""
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
