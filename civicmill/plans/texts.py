"""Text operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.functions.text import normalise
from civicmill.operators import extract
from civicmill.operators import search as s
from civicmill.operators.vector import cosine_top_k
from civicmill.plans.base import query
from civicmill.plans.scalars import FOLD_SQL
from civicmill.sources.tables import table

WORDS_SQL = f"list_filter(string_split(trim(regexp_replace(lower({FOLD_SQL.format(x="coalesce(text, '')")}), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
SEARCHED = "the re"


@query("T01_search", f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents), h AS (SELECT doc_id, len(words) AS length, len(list_filter(words, lambda x: starts_with(x, 'the'))) AS a, len(list_filter(words, lambda x: starts_with(x, 're'))) AS b FROM w),
    g AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM h)
    SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score
    FROM h, g WHERE a > 0 AND b > 0""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.search(table(spark, sf_dir, "documents"), "doc_id", "text", SEARCHED)


@query("T01_inverted_index", f"SELECT token, conv_id, CAST(sum(n) AS BIGINT) AS tf FROM (SELECT conv_id, unnest({WORDS_SQL}) AS token, 1 AS n FROM conversations) GROUP BY ALL")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "text")
    return s.inverted_index(turns, "conv_id", "text").groupBy("token", "conv_id").agg(F.sum("tf").alias("tf"))


@query("T02_folded_contains", f"SELECT doc_id FROM documents WHERE contains(lower({FOLD_SQL.format(x='text')}), 'license')")
def folded_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.contains(normalise(F.col("text")), F.lit("license"))).select("doc_id")


@query("T14_contacts", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))), ',') AS emails, len(list_distinct(regexp_extract_all(coalesce(text, ''), '(?:\+33 ?|0)[1-9](?:[ .-]?[0-9]{2}){4}'))) AS n_phones FROM documents")
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(extract.found_all(F.col("text"), extract.EMAIL)), ",").alias("emails"), F.size(extract.found_all(F.col("text"), extract.PHONE)).cast("long").alias("n_phones"))


@query("T15_keywords", "SELECT doc_id, array_to_string(list_filter(['license', 'password', 'secret', 'email'], lambda k: contains(lower(text), k)), ',') AS keywords FROM documents WHERE text IS NOT NULL")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("license", "password", "secret", "email")))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.filter(words, lambda k: F.contains(F.lower("text"), k)), ",").alias("keywords"))


@query("T09_repeated_lines", "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' AND length(line) < 60 GROUP BY ALL HAVING count(*) >= 4")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.repeated_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("T18_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", extract.html_text(F.col("html")).alias("text"))


@query("T19_chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 2000, 200).select("doc_id", "n", "start", F.length("chunk").alias("length"), F.md5("chunk").alias("digest"))


@query("T20_citations", f"SELECT conv_id, turn, len(q) >= 15 AND contains(t, q) AS cited FROM (SELECT conv_id, turn, trim(regexp_replace(lower({FOLD_SQL.format(x='text')}), '[^a-zA-Z0-9]+', ' ', 'g')) AS t, trim(regexp_replace(lower({FOLD_SQL.format(x='substr(text, 20, 40)')}), '[^a-zA-Z0-9]+', ' ', 'g')) AS q FROM conversations) WHERE t IS NOT NULL")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", extract.cited(F.col("text"), F.substring("text", 20, 40)).alias("cited"))


@query("T22_redacted")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["the", "Re", "them", "license"]
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(extract.redacted(F.col("text"), names)).alias("digest"), F.regexp_count("text", F.lit(extract.names_pattern(names))).cast("long").alias("n_names"))


@query("I02_leaks", r"SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS email, regexp_matches(text, 'AKIA[0-9A-Z]{16}|-----BEGIN|password') AS secret, regexp_matches(text, '(?i)/users/|/home/|file:') AS path FROM documents WHERE text IS NOT NULL")
def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").where(t.isNotNull()).select("doc_id", t.rlike(extract.EMAIL).alias("email"), t.rlike("AKIA[0-9A-Z]{16}|-----BEGIN|password").alias("secret"), t.rlike("(?i)/users/|/home/|file:").alias("path"))


@query("V01_cosine_top", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(CAST(list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / greatest(sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-8) AS DOUBLE), 4) AS score FROM embeddings, q)
    SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.where("vec_id = 0").select("embedding").first()[0]
    return cosine_top_k(vectors, "vec_id", "embedding", wanted, 20)
