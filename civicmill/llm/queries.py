"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.llm.common import shared_dir, table
from civicmill.llm.decontamination import contaminated_documents
from civicmill.llm.hard_negatives import hard_negatives
from civicmill.llm.licenses import license_scan
from civicmill.llm.mixing import mixed
from civicmill.llm.repair import damaged, repair
from civicmill.llm.simhash import near_duplicates
from civicmill.llm.substrings import repeated_units
from civicmill.llm.token_counts import token_counts
from civicmill.llm.token_records import token_records
from civicmill.llm.topk import top_k
from civicmill.llm.toxicity import toxicity_scores
from civicmill.llm.urls import url_verdicts
from civicmill.llm.warc import archived


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position", "positions")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache each time, so its cost doesn't hang on earlier runs; the cache is kept."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), shared_dir(spark, "token-cache"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archived(table(spark, sf_dir, "pages"), min_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), radius=3, shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_records(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_substrings": op2_substrings,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_topk": op5_topk,
    "op6_token_counts": op6_token_counts,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_licenses": op9_licenses,
    "op10_token_records": op10_token_records,
    "op11_url_filters": op11_url_filters,
    "op12_repair": op12_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op5_topk": """
        WITH q AS (
            SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) AS BIGINT) AS score
            FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
        ), bits AS (
            SELECT *, array_to_string([['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100',
                '1101', '1110', '1111'][strpos('0123456789abcdef', hex[i])] FOR i IN range(1, 41)], '') AS bits FROM p
        ), digests AS (
            SELECT page_id, html, array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT)
                + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT)] FOR i IN range(0, 32)], '') AS digest FROM bits
        ), firsts AS (
            SELECT *, max(page_id) OVER (PARTITION BY digest) AS first FROM digests
        )
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM firsts
    """,
    "op11_url_filters": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parted AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
        ), rules(rule_host, rule_path, verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), ruled AS (
            SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM parted JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
        ), globs(pattern, regex) AS (
            VALUES ('*spam**', '[^/]*spam.*'), ('*.cheap-**', '[^/]*\.cheap-.*'), ('*pills**', '[^/]*pills.*'), ('*casino**', '[^/]*casino.*'), ('**/login**', '.*/login.*'),
                ('**/cart/**', '.*/cart/.*'), ('**/tag/*/page/**', '.*/tag/[^/]*/page/.*'), ('**.exe', '.*\.exe'), ('**.zip', '.*\.zip'),
                ('m.*.example.net/es/9??**', '\.m\.[^/]*\.example\.net/es/9[^/][^/].*'), ('**/en/**/page/?', '.*/en/.*/page/[^/]')
        ), globbed AS (
            SELECT page_id, arg_max(pattern, length(pattern)) AS pattern FROM parted JOIN globs ON regexp_full_match('.' || host || path, regex, 's') GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(ruled.verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern
        FROM parted LEFT JOIN ruled USING (page_id) LEFT JOIN globbed USING (page_id)
    """,
    "op12_repair": r"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(unicode(c) AS BIGINT)) AS bytes
            FROM conversations
        ), dealt AS (
            SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes),
                lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))) % 20 AS how
            FROM keyed
        ), left_rows AS (
            SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
            FROM dealt, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)
        ), rowed AS (
            SELECT conv_id, turn, role, text, row_number() OVER w AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, md5(role || chr(0) || text), copy) AS time
            FROM left_rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(0) || text), copy)
        ), faulty AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN time > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM rowed
        ), counted AS (
            SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM faulty GROUP BY conv_id
        ), edits(initial, price) AS (VALUES ('K', 0), ('R', 3), ('D', 4)
        ), ways AS (
            SELECT s.a AS a, k, initial, price + 3 * k AS price, CASE WHEN k = 0 THEN s.a WHEN (s.a = 'u') = (k = 1) THEN 'a' ELSE 'u' END AS mid,
                CASE WHEN k = 0 THEN [] WHEN s.a = 'u' THEN ['assistant:', 'user:'][:k] ELSE ['user:', 'assistant:'][:k] END AS inserted
            FROM (VALUES (''), ('s'), ('u'), ('a')) AS s(a), unnest(range(3)) AS t(k), edits
        ), walk AS (
            SELECT conv_id, 0 AS i, '' AS a, {'cost': 0, 'audit': '', 'turns': CAST([] AS VARCHAR[])} AS best FROM counted
            UNION ALL
            SELECT conv_id, i, a, min(best) AS best FROM (
                SELECT w.conv_id, w.i + 1 AS i, CASE initial WHEN 'D' THEN mid WHEN 'R' THEN CASE mid WHEN 'u' THEN 'a' ELSE 'u' END ELSE left(role, 1) END AS a,
                    {'cost': w.best.cost + price + CASE WHEN initial <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, 'audit': w.best.audit || repeat('I', k) || initial,
                        'turns': w.best.turns || inserted || CASE initial WHEN 'D' THEN [] WHEN 'R' THEN [CASE mid WHEN 'u' THEN 'assistant:' ELSE 'user:' END || text] ELSE [role || ':' || text] END} AS best
                FROM walk w JOIN ways ON ways.a = w.a JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
                WHERE (initial = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (initial <> 'K' OR (mid || left(role, 1)) IN ('s', 'u', 'su', 'au', 'ua') AND left(role, 1) <> '')
            ) GROUP BY conv_id, i, a
        ), closed AS (
            SELECT conv_id, min({'cost': best.cost + 3 * k, 'audit': best.audit || repeat('I', k), 'turns': best.turns || inserted}) AS best
            FROM walk JOIN counted USING (conv_id) JOIN ways USING (a) WHERE i = n AND initial = 'K' AND mid IN ('', 'a') GROUP BY conv_id
        )
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counted USING (conv_id) LEFT JOIN closed USING (conv_id)
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), mined AS (
            SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
            FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 5
    """,
}
