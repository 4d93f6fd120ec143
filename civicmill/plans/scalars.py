"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.functions import classify, jsons, numbers, text
from civicmill.plans.base import query
from civicmill.sources.civic import CIVIC_SQL, civic
from civicmill.sources.tables import table

#: Each accented letter that ``fold`` knows, for DuckDB.
FOLD_SQL = f"replace(replace(replace(replace(translate({{x}}, '{text.ACCENTED}', '{text.FOLDED}'), 'Œ', 'OE'), 'œ', 'oe'), 'Æ', 'AE'), 'æ', 'ae')"


@query("F02_normalised_names", f"SELECT doc_id, trim(regexp_replace(lower({FOLD_SQL.format(x='text')}), '[^a-zA-Z0-9]+', ' ', 'g')) AS normalised FROM documents")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("normalised"))


@query("F04_key_words", f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower({FOLD_SQL.format(x='text')}), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4 AND w NOT IN ('avec', 'dans')))), ' ') AS words FROM conversations WHERE text IS NOT NULL")
def key_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.array_join(text.key_words(F.col("text"), ("avec", "dans")), " ").alias("words"))


@query("F11_slugs", "SELECT p_partkey, regexp_replace(substr(regexp_replace(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-zA-Z0-9]+', ' ', 'g')), ' ', '-', 'g'), 1, 16), '-+$', '') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand"), 16).alias("slug"))


@query("F14_plausible_names", """WITH n AS (SELECT p_partkey, ['', 'Le ', 'du ', 'A. '][1 + p_partkey % 4] || split_part(p_name, ' ', 1 + CAST(p_size % 2 AS INT)) || ['', ' de la', ' ' || p_name, ' X'][1 + p_size % 4] AS name FROM part),
    w AS (SELECT *, list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM n),
    f AS (SELECT *, list_filter(words, lambda x: NOT list_contains(['de', 'du', 'des', 'd', 'la', 'le', 'l', 'van', 'von'], x)) AS own FROM w)
    SELECT p_partkey, len(words) BETWEEN 2 AND 5 AND NOT regexp_matches(name, '[0-9]') AND NOT list_contains(words, 'ring') AND len(own) >= 2 AND len(list_filter(own, lambda x: length(x) < 2)) = 0 AS plausible FROM f""")
def plausible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (1 + n % 4).cast("int"))
    given = F.split_part(F.col("p_name"), F.lit(" "), (1 + F.col("p_size") % 2).cast("int"))
    name = F.concat(pick(["", "Le ", "du ", "A. "], F.col("p_partkey")), given, pick(["", " de la", F.concat(F.lit(" "), "p_name"), " X"], F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", text.plausible_name(name, ("ring",)).alias("plausible"))


@query("P14_safe_urls", r"""WITH u AS (SELECT page_id, ['', '  file:///Users/a/', chr(9) || '/Users/a/', ' ', 'FILE:', chr(160) || 'c:\', ' /home/x/'][1 + page_id % 7] || CASE WHEN page_id % 7 = 3 AND page_id % 2 = 0 THEN '' ELSE url END || '  ' AS url FROM pages),
    t AS (SELECT page_id, trim(url, ' ' || chr(9) || chr(160)) AS url FROM u)
    SELECT page_id, CASE WHEN url = '' OR starts_with(lower(url), 'file:') OR starts_with(lower(url), '/users/') OR starts_with(lower(url), '/home/') OR lower(url)[2:3] = ':\' THEN NULL ELSE url END AS url FROM t""")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with paths of somebody's machine put before them, blanks around."""
    fronts = F.array(*map(F.lit, ("", "  file:///Users/a/", "\t/Users/a/", " ", "FILE:", "\u00a0c:\\", " /home/x/")))
    bare = (F.col("page_id") % 7 == 3) & (F.col("page_id") % 2 == 0)
    url = F.concat(F.element_at(fronts, (1 + F.col("page_id") % 7).cast("int")), F.when(bare, "").otherwise(F.col("url")), F.lit("  "))
    return table(spark, sf_dir, "pages").select("page_id", text.safe_url(url).alias("url"))


@query("P13_hosts", "WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages) SELECT page_id, host, host = 'example.org' OR ends_with(host, '.example.org') AS denied FROM h")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = text.host_of(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), text.denied(host, ("example.org",)).alias("denied"))


@query("F20_amounts", "SELECT o_orderkey, CAST(replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), ',', '.') AS DOUBLE) AS amount, o_totalprice BETWEEN 10 AND 50000000 AS plausible FROM orders")
def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written the French way and read back."""
    written = F.translate(F.format_number("o_totalprice", 2), ",.", " ,")
    found = numbers.amount(F.concat(written, F.lit(" €")))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("amount"), numbers.plausible(found).alias("plausible"))


@query("F22_rates", "SELECT l_orderkey, l_linenumber, l_partkey, round(100.0 * l_discount / nullif(l_tax, 0), 2) AS rate FROM lineitem")
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.rate(F.col("l_discount"), F.col("l_tax")).alias("rate"))


@query("F23_exposure", CIVIC_SQL + "SELECT e.id AS entity_id, least(count(x.id), 12) + 2 * coalesce((SELECT count(*) FROM flows WHERE to_id = e.id), 0) AS exposure FROM entities e LEFT JOIN ends x ON x.node = e.id GROUP BY e.id")
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicmill.operators.edges import degrees

    c = civic(spark, sf_dir)
    flows = c.flows.groupBy(F.col("to_id").alias("received_id")).agg(F.count("*").alias("n_flows"))
    rows = c.entities.select("id").join(degrees(c.relations), F.col("id") == F.col("node"), "left").join(flows, F.col("id") == F.col("received_id"), "left")
    return rows.select(F.col("id").alias("entity_id"), numbers.exposure(F.coalesce("degree", F.lit(0)), F.coalesce("n_flows", F.lit(0))).alias("exposure"))


@query("F26_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written with French month names and read back."""
    month = F.element_at(F.array(*map(F.lit, numbers.MONTHS)), F.month("o_orderdate"))
    day = F.when(F.day("o_orderdate") == 1, "1er").otherwise(F.day("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.iso_date(F.concat_ws(" ", F.lit("Séance du"), day, month, F.year("o_orderdate"))).alias("day"))


@query("F30_ages", "SELECT event_id, datediff('day', CAST(ts AS DATE), DATE '2024-06-30') AS days, CAST(floor((epoch_us(TIMESTAMP '2024-06-30') - epoch_us(ts)) / 60000000) AS BIGINT) AS minutes FROM events")
def ages(spark: SparkSession, sf_dir: str, as_of: str = "2024-06-30") -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", F.datediff(F.lit(as_of).cast("date"), F.to_date("ts")).cast("long").alias("days"), F.timestamp_diff("MINUTE", F.col("ts"), now).alias("minutes"))


@query("F40_json_members", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.absent') IS NULL AS absent FROM events")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jsons.parsed(F.col("props"), "struct<k:int,absent:string>")
    return table(spark, sf_dir, "events").select("event_id", found["k"].alias("k"), found["absent"].isNull().alias("absent"))


@query("F41_json_amounts", "SELECT l_orderkey, max(l_extendedprice) AS largest, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def json_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's prices as a JSON document under both generations of keys, and its largest read from it."""
    price = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("montant"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_extendedprice")).alias("value"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(price).alias("montants"))).alias("metadata"))
    return docs.select("l_orderkey", jsons.largest_amount(F.col("metadata")).alias("largest"), F.size(jsons.parsed(F.col("metadata"), jsons.AMOUNTS)["montants"]).cast("long").alias("n"))


@query("F49_fingerprints", "SELECT c_custkey, substr(sha1('nom|' || lower(c_name) || '|' || c_mktsegment), 1, 16) AS fingerprint FROM customer")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", jsons.fingerprint(F.lit("nom"), F.lower("c_name"), F.col("c_mktsegment")).alias("fingerprint"))


@query("C03_directions", CIVIC_SQL + "SELECT id AS flow_id, CASE WHEN to_id = 2 THEN 'entrant' WHEN from_id = 1 THEN 'sortant' ELSE 'tiers' END AS direction FROM flows")
def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = civic(spark, sf_dir).flows
    inward, outward = classify.direction(F.col("from_id"), F.col("to_id"), F.lit(2)), classify.direction(F.col("from_id"), F.col("to_id"), F.lit(1))
    return flows.select(F.col("id").alias("flow_id"), F.when(inward == "entrant", inward).when(outward == "sortant", outward).otherwise("tiers").alias("direction"))


@query("C08_categories", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|bolt') THEN 'quincaillerie' WHEN regexp_matches(p_name, 'widget') THEN 'gadget' END AS category FROM part")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", classify.first_match(F.col("p_name"), [("ring|bolt", "quincaillerie"), ("widget", "gadget")]).alias("category"))


@query("C16_relevance", "SELECT page_id, least(1.0, CAST(0.3 AS DOUBLE) + CASE WHEN contains(url, '/fr/') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN contains(html, '<article') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(html, '<table') THEN 0.1::DOUBLE ELSE 0 END)::DOUBLE AS relevance FROM pages")
def relevances(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ((F.col("url").contains("/fr/"), 0.4), (F.col("html").contains("<article"), 0.2), (F.col("html").contains("<table"), 0.1))
    return table(spark, sf_dir, "pages").select("page_id", classify.relevance(*hits).alias("relevance"))


@query("C17_corrections", "SELECT p_partkey, CASE WHEN p_size * 50 BETWEEN 1900 AND 2100 THEN CAST(p_size * 50 AS VARCHAR) END AS year FROM part")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", classify.valid_correction("year", (F.col("p_size") * 50).cast("string")).alias("year"))
