"""A corpus from raw documents to token files, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``, the rows being what the stage keeps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.llm.common import saved, table
from civicmill.llm.decontamination import contaminated
from civicmill.llm.mixing import mixed_documents
from civicmill.llm.queries import tokenizer_file
from civicmill.llm.similar import similar_texts, text_digest
from civicmill.llm.token_records import token_records
from civicmill.llm.toxicity import toxicity_scores

#: Name of a column that stages add for a while: the digest of the text.
DIGEST = "_pipeline_digest"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the classifier rejects go.

    A score depends on the text alone, so rows meet it by the text's digest: rows without a ``doc_id`` and rows that
    repeat one are judged like any other. Null and empty texts are equal to each other.
    """
    keyed = docs.withColumn(DIGEST, text_digest(F.col("text")))
    rejected = toxicity_scores(keyed, table(spark, sf_dir, "labels"), keys=(DIGEST,)).where("predicted = 1").select(DIGEST).distinct()
    return keyed.join(rejected, DIGEST, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts one row stays: five-word shingles, similarity 0.8, over links.

    It is the one with the smallest ``doc_id``, none coming last; of several texts of that ``doc_id`` that with the
    smallest digest, and of repeated rows the smallest by its columns. Null and blank texts are one group.
    """
    found = saved(similar_texts(docs), "texts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")).alias("first")
    kept = found.groupBy("root").agg(first, F.count("*").alias("n")).where("n > 1").select("root", "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    grouped = found.join(kept, "root")
    gone = grouped.where(~stays).select("doc_id", "digest").distinct()
    repeated = grouped.where(stays).groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest")
    keyed = docs.withColumn(DIGEST, text_digest(F.col("text")))
    same = lambda other: keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed[DIGEST] == other["digest"])
    left = keyed.join(gone, same(gone), "left_anti")
    single = left.join(repeated, same(repeated), "left_anti").select(*docs.columns)
    again = left.join(repeated, same(repeated), "left_semi")
    once = again.groupBy("doc_id", DIGEST).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.union(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item, in any order, or 30 words of one in a row go.

    Rows meet the verdict on their text by its digest, so those without a ``doc_id`` or with a repeated one are judged
    like any other.
    """
    keyed = docs.withColumn(DIGEST, text_digest(F.col("text")))
    found = contaminated(keyed, table(spark, sf_dir, "benchmark"), keys=(DIGEST,)).select(DIGEST).distinct()
    return keyed.join(found, DIGEST, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document that the mix takes, in training order."""
    return mixed_documents(docs).select(*docs.columns)


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in record files: (doc_id, start, n_tokens, ids_crc32) of each frame, read back from the files."""
    index = token_records(docs, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("records", records),
]

#: The classifier's trees and the tokenizer are beyond SQL; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
