"""What the training-data operators share: the shared folder, table reads and text units.

Files that a later job reads go to the folder named by ``spark.checkpoint.dir``, which the driver and all executors
share; results therefore survive lost executors, and lineage is cut by a written table rather than by local state.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the query contracts define a word's end.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset on one machine, below a folder made for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="civicmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/civicmill/{purpose}-{uuid.uuid4().hex}"


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, and its lineage ends there."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows: Python workers hold some megabytes of text at a time, also with long documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, cut at ASCII white space, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(df: DataFrame, n_bytes: int, per_part: int, *keys: Column) -> int:
    """How many partitions hold ``n_bytes`` at about ``per_part`` each."""
    return max(1, -(-int(n_bytes) // per_part))
