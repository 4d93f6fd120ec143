"""Token counts through a digest cache.

Counts are stored by content digest and tokenizer-version digest. A run digests every whole text in the JVM, looks the
digests up, encodes each distinct miss once, appends those counts to the cache and answers every row from it. Copies
are combined before and after the shuffle, so a text that a third of the rows share is encoded once.

The content that is digested is the whole text as UTF-8 with null as the empty text; nothing else is normalised, since
any other change could change its tokens. The version digest covers the model file's bytes and the library's version.

Edge cases: a null or empty text has no tokens; repeated rows each get a row; a null ``doc_id`` is kept; an empty table
gives an empty result and leaves an empty cache; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.llm.common import small_batches
from civicmill.llm.token_records import chunks

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def version_digest(model_path: str) -> str:
    """Of the model file and the library that reads it."""
    import sentencepiece

    return hashlib.sha256(Path(model_path).read_bytes() + sentencepiece.__version__.encode()).hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


@lru_cache(maxsize=2)
def processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def _counted(model_path: str, version: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = processor(model_path).encode
        for batch in batches:
            texts, n = batch["text"].tolist(), []
            for part in chunks(texts, 500_000):
                n += map(len, encode(texts[part], num_threads=1))
            yield pd.DataFrame({"digest": batch["digest"], "version": version, "n_tokens": n})

    return run


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, empty where nothing has been written yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, model_path: str, cache_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; missing counts are encoded and appended to the cache."""
    spark = docs.sparkSession
    small_batches(spark)
    version = version_digest(model_path)
    digested = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), content_digest(F.col("text")).alias("digest"))
    known = read_cache(spark, cache_path).where(F.col("version") == version)
    missing = digested if known.isEmpty() else digested.join(known.select("digest"), "digest", "left_anti")
    distinct = missing.groupBy("digest").agg(F.first("text").alias("text"))
    distinct.mapInPandas(_counted(model_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = digested.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
