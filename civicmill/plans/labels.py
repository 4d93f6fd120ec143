"""Labels, places, nested values and file shapes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.functions import places, text
from civicmill.operators import extract
from civicmill.plans.base import query
from civicmill.sources import files
from civicmill.sources.civic import CIVIC_SQL, civic
from civicmill.sources.tables import table

BUYER_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'Mairie de ' WHEN 1 THEN 'CC des ' WHEN 2 THEN 'Syndicat de ' ELSE 'Communauté de communes ' END || c_mktsegment || ' — service n° ' || c_custkey % 7"
OWNERS = [("building", "commune"), ("machinery", "epci")]


@query("F05_buyer_keys", f"""WITH b AS (SELECT c_custkey, regexp_replace(regexp_replace(lower(translate({BUYER_SQL}, 'é', 'e')), '\\b({'|'.join(text.STRUCTURAL)})\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS buyer_key FROM customer)
    SELECT *, CASE WHEN starts_with(buyer_key, 'building') THEN 'commune' WHEN starts_with(buyer_key, 'machinery') THEN 'epci' END AS owner FROM b""")
def buyer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(BUYER_SQL)
    return table(spark, sf_dir, "customer").select("c_custkey", text.buyer_key(name).alias("buyer_key"), text.buyer_of(name, OWNERS).alias("owner"))


CORRECTIONS = {"red widget": "Widget Rouge", "étui": "étui de métal"}
LABEL_SQL = "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE p_name || ', étui, ETUI' END"


@query("F07_rectified", f"SELECT p_partkey, replace(replace(replace(replace({LABEL_SQL}, 'red widget', 'Widget Rouge'), 'RED WIDGET', 'WIDGET ROUGE'), 'étui', 'étui de métal'), 'ETUI', 'ETUI DE METAL') AS label FROM part")
def rectified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.rectified(F.expr(LABEL_SQL), CORRECTIONS).alias("label"))


@query("F10_event_titles", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'CM du ' || strftime(o_orderdate, '%Y-%m-%d') || ' -  Questions  diverses ' WHEN 1 THEN 'Séance  du conseil ' || o_orderpriority END AS raw FROM orders), c AS
    (SELECT o_orderkey, trim(regexp_replace(regexp_replace(coalesce(raw, ''), '^CM\\s+du\\s+\\d{4}-\\d{2}-\\d{2}\\s*[-—–]\\s*', ''), '\\s+', ' ', 'g')) AS title FROM t) SELECT *, lower(title) IN ('', 'questions diverses') AS says_nothing FROM c""")
def event_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixed = F.concat(F.lit("CM du "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" -  Questions  diverses "))
    raw = F.when(F.col("o_orderkey") % 3 == 0, prefixed).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Séance  du conseil "), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.event_title(raw).alias("title"), text.says_nothing(raw).alias("says_nothing"))


@query("F12_birth_names", """WITH n AS (SELECT p_partkey, p_partkey % 3 = 0 AS has, p_name, p_type, p_brand FROM part)
    SELECT p_partkey, CASE WHEN has THEN p_name || ' ' || p_type END AS in_use, CASE WHEN has THEN upper(p_name) END AS at_birth, p_type AS surnames FROM n""")
def birth_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("( "), F.upper("p_name"), F.lit(") "))))
    in_use, at_birth = text.birth_name(name)
    return table(spark, sf_dir, "part").select("p_partkey", in_use.alias("in_use"), at_birth.alias("at_birth"), F.array_join(text.surnames(name), " ").alias("surnames"))


@query("F15_strings", "SELECT p_partkey, substr(p_name, 2, 4) AS part, CAST(length(p_name) AS INTEGER) AS n, upper(p_name) || '/' || replace(p_brand, '#', ' ') AS label FROM part")
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.upper("p_name"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.substring("p_name", 2, 4).alias("part"), F.length("p_name").alias("n"), label.alias("label"))


RING_SQL = "list_transform(range(o_orderkey % 5), lambda i: [(i * i) * 0.25 + o_orderkey % 7, i * 0.5 - o_orderkey % 3])"


def _ring():
    key = F.col("o_orderkey")
    steps = F.slice(F.array(*map(F.lit, range(4))), F.lit(1), (key % 5).cast("int"))
    return F.transform(steps, lambda i: F.array((i * i) * F.lit(0.25) + key % 7, i * F.lit(0.5) - key % 3))


@query("F32_centroids", f"WITH r AS (SELECT o_orderkey, {RING_SQL} AS ring FROM orders) SELECT o_orderkey, CAST(list_avg(list_transform(ring, lambda p: CAST(p[1] AS DOUBLE))) AS DOUBLE) AS x, CAST(list_avg(list_transform(ring, lambda p: CAST(p[2] AS DOUBLE))) AS DOUBLE) AS y FROM r")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = places.centroid(_ring())
    return table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), y.alias("y"))


@query("A47_bounding_boxes", f"WITH r AS (SELECT o_orderkey, {RING_SQL} AS ring FROM orders), f AS (SELECT o_orderkey, list_transform(ring, lambda p: CAST(p[1] AS DOUBLE)) AS lng, list_transform(ring, lambda p: CAST(p[2] AS DOUBLE)) AS lat FROM r) SELECT o_orderkey, round(list_min(lat) - 0.01, 6) AS south, round(list_min(lng) - 0.01, 6) AS west, round(list_max(lat) + 0.01, 6) AS north, round(list_max(lng) + 0.01, 6) AS east FROM f")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = places.bounding_box(F.array(_ring(), _ring()))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.round(c, 6).alias(n) for n, c in zip(("south", "west", "north", "east"), box, strict=True)])


LAT_SQL, LNG_SQL = "CASE WHEN id % 11 <> 0 THEN 44 + (id % 40) / 20e0 END", "3 + (id % 30) / 15e0"


@query("F33_location_quality", CIVIC_SQL + f""", p AS (SELECT id, type, {LAT_SQL} AS lat, {LNG_SQL} AS lng FROM entities), q AS (SELECT *, CASE WHEN type = 'person' THEN 'hidden_person' WHEN lat IS NULL THEN 'missing' WHEN type = 'business' AND id % 4 = 0 THEN 'hidden_home'
    WHEN NOT (lat BETWEEN 44.2 AND 45.6 AND lng BETWEEN 3.1 AND 4.8) THEN 'outside' WHEN lat BETWEEN 44.9 AND 45.1 AND lng BETWEEN 3.5 AND 4.5 THEN 'approx_center' ELSE 'usable' END AS quality FROM p)
    SELECT id, quality, CASE WHEN quality IN ('missing', 'outside', 'usable') OR (quality = 'approx_center' AND type IN ('place', 'service')) THEN lat END AS lat, quality = 'usable' OR (quality = 'approx_center' AND type IN ('place', 'service')) AS shown FROM q""")
def location_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = F.expr(LAT_SQL), F.expr(LNG_SQL)
    quality = places.location_quality(F.col("type"), lat, lng, F.col("id") % 4 == 0, (44.2, 3.1, 45.6, 4.8), (44.9, 3.5, 45.1, 4.5))
    rated = civic(spark, sf_dir).entities.select("id", "type", lat.alias("lat"), quality.alias("quality"))
    quality, kind = F.col("quality"), F.col("type")
    return rated.select("id", "quality", F.when(places.coordinates_kept(quality, kind), F.col("lat")).alias("lat"), places.location_shown(quality, kind).alias("shown"))


@query("F35_parcel_keys", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || l_linestatus ELSE lower(l_returnflag) END AS section, CASE WHEN l_linenumber = 3 THEN '12b' WHEN l_linenumber <> 5 THEN CAST(l_partkey AS VARCHAR) END AS number FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN regexp_matches(number, '^[0-9]+$') THEN upper(CASE WHEN length(section) < 2 THEN lpad(section, 2, '0') ELSE section END) || CASE WHEN length(number) < 4 THEN lpad(number, 4, '0') ELSE number END END AS parcel FROM p""")
def parcel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    section = F.when(line % 2 == 0, F.concat("l_returnflag", "l_linestatus")).otherwise(F.lower("l_returnflag"))
    number = F.when(line == 3, "12b").when(line != 5, F.col("l_partkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", places.parcel_key(section, number).alias("parcel"))


@query("F45_distinct_in_order", "WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type) || ' ' || p_name || ' end', ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 3), ' ') AS words FROM w")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), "p_name", F.lit("end")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.slice(F.array_distinct(words), 1, 3), " ").alias("words"))


@query("F46_nested_rows", "SELECT event_id, CAST(i AS INTEGER) AS at, CAST(json_extract(props, '$.k') AS INTEGER) + i AS k FROM events, (SELECT unnest([0, 1]) AS i) WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 3 = 0")
def nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested array of a JSON answer as rows; records without one keep a row."""
    k = F.get_json_object("props", "$.k").cast("int")
    answer = F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct(F.array(F.struct(k.alias("k")), F.struct((k + 1).alias("k"))).alias("items")))).otherwise("{}")
    items = F.from_json(answer, "items array<struct<k int>>")["items"]
    return table(spark, sf_dir, "events").select("event_id", F.posexplode_outer(items).alias("at", "item")).select("event_id", "at", "item.k")


@query("F47_numbered_columns", "WITH h AS (SELECT p_partkey, list_filter([CASE WHEN p_size % 2 = 0 THEN p_brand END, p_type, CASE WHEN p_size > 25 THEN p_name END], lambda x: x IS NOT NULL) AS h FROM part) SELECT p_partkey, CAST(len(h) AS INTEGER) AS n, array_to_string(h, ',') AS holders FROM h")
def numbered_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    holders = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_type"), F.when(F.col("p_size") > 25, F.col("p_name"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(holders).alias("n"), F.array_join(holders, ",").alias("holders"))


@query("F48_merged_maps", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'brand=' || p_brand || ',size=' || p_size || ',type=' || p_type ELSE 'brand=' || p_brand || ',size=0' END AS merged FROM part")
def merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the second map win."""
    first = F.create_map(F.lit("size"), F.lit("0"), F.lit("brand"), F.col("p_brand"))
    second = F.when(F.col("p_size") > 25, F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))).otherwise(F.expr("CAST(map() AS map<string, string>)"))
    merged = F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)
    entries = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, ",").alias("merged"))


@query("C04_provenance", """SELECT event_id, CASE event_type WHEN 'error' THEN 'saisie' WHEN 'purchase' THEN 'open_data' ELSE 'site' END AS origin, CASE WHEN value > 50 THEN 'document' WHEN value IS NOT NULL THEN 'lien' ELSE 'aucun' END AS document,
    CASE WHEN event_type = 'error' THEN 'manuel' WHEN value > 50 THEN 'extraction' ELSE 'import' END AS processing FROM events""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", "saisie").when(kind == "purchase", "open_data").otherwise("site").alias("origin"),
        F.when(value > 50, "document").when(value.isNotNull(), "lien").otherwise("aucun").alias("document"),
        F.when(kind == "error", "manuel").when(value > 50, "extraction").otherwise("import").alias("processing"),
    )


@query("T03_subsidies", """WITH f AS (SELECT year(o_orderdate) AS year, o_orderkey, c_mktsegment || CASE WHEN o_orderkey % 2 = 0 THEN '.' ELSE '' END AS raw, CAST(o_totalprice AS BIGINT) AS amount FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P')
    SELECT CAST(year AS INTEGER) AS year, rtrim(raw, '.') AS beneficiary, amount, o_orderkey FROM f WHERE amount BETWEEN 1 AND 200000 QUALIFY row_number() OVER (PARTITION BY year, lower(rtrim(raw, '.')) ORDER BY o_orderkey) = 1""")
def subsidies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = F.regexp_replace(F.format_number(F.bround("o_totalprice"), 0), ",", " ")
    name = F.concat(F.col("c_mktsegment"), F.when(F.col("o_orderkey") % 2 == 0, ".").otherwise(""))
    wording = F.concat(F.lit("Le conseil décide d'attribuer à la "), name, F.lit(" une subvention exceptionnelle de "), sums, F.lit(" € et de l'inscrire au budget."))
    acts = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    acts = acts.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("date"), wording.alias("text"))
    return extract.subsidies(acts, "o_orderkey", "date", "text")


@query("SRC08_blocks", "SELECT p_partkey, 1 AS block, p_name AS Liste, CAST(p_size AS VARCHAR) AS Voix FROM part UNION ALL SELECT p_partkey, 2, NULL, p_type FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 12, p_brand, NULL FROM part")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("Liste 1"), F.col("p_size").alias("Voix 1"), F.lit(None).cast("string").alias("Liste 2"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("Voix 2"), F.col("p_brand").alias("Liste 12"),
    )
    return files.unpivot_blocks(wide, ["p_partkey"])


def register_names(part: DataFrame) -> DataFrame:
    """(p_partkey, name): parts' names as a register writes bodies, most in capitals, with elisions, acronyms, brackets and quotes."""
    n, words = F.col("p_partkey"), F.split("p_name", " ")
    a, b = F.upper(F.get(words, F.lit(0))), F.upper(F.get(words, F.lit(1)))
    forms = [
        F.concat(F.lit("ASSOCIATION DE L'"), a, F.lit(" ET DU "), b), F.concat(F.lit("CC DES "), a, F.lit(" (CCAS) – SIVU."), b), F.concat(F.lit("D’"), a, F.lit(" «"), b, F.lit("»;")), F.concat(a, F.lit("'"), b, F.lit(" NEZ HJH A LA ÉTÉ...")),
        F.concat(F.lit("LES AMIS  DU "), b, F.lit(", (SANS "), a, F.lit(")")), F.col("p_name"), F.initcap("p_name"), F.concat(F.lit('" QU\'EN "'), a, F.lit("-"), b), F.lit("."), F.lit(None).cast("string"), F.concat(F.lit("L'O'"), a),
    ]
    return part.select("p_partkey", F.element_at(F.array(*forms), (1 + n % len(forms)).cast("int")).alias("name"))


@query("F08_human_case")
def human_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register_names(table(spark, sf_dir, "part")).select("p_partkey", text.human_case(F.col("name")).alias("name"))


def labelled_flows(part: DataFrame) -> DataFrame:
    """(p_partkey, label, actor, amount): labels that tell the actor's name and the amount again, in many ways."""
    n, words = F.col("p_partkey"), F.split("p_name", " ")
    actor = F.concat(F.initcap(F.get(words, F.lit(0))), F.lit("-Écoles "), F.upper(F.get(words, F.lit(1))))
    turned = F.concat(F.get(words, F.lit(1)), F.lit(" L'ecoles"), F.lit(" "))
    forms = [
        F.concat(actor, F.lit(" — Subvention  communale 2026 — "), actor), F.concat(F.lit("Subvention - "), turned), F.concat(actor, F.lit(" – "), actor), F.concat(F.lit("Bail — "), F.upper(actor), F.lit(" (320 + 4 044) — 11 637,87 €")),
        F.concat(actor, F.lit(" (détail) - suite")), F.lit("- 12\u00a0000 € "), F.lit(None).cast("string"), F.concat(F.lit("Travaux — "), F.get(words, F.lit(1)), F.lit(" — reste")), F.lit("Prêt – 3 500.5 €"), F.lit(" "),
    ]
    pick = lambda k: F.element_at(F.array(*forms), (1 + k % len(forms)).cast("int"))
    return part.select("p_partkey", pick(n).alias("label"), F.when(n % 7 == 0, F.lit(None)).when(n % 7 == 1, "").otherwise(actor).alias("actor"), F.when(n % 3 > 0, F.col("p_retailprice")).alias("amount"))


@query("F09_flow_labels")
def flow_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_flows(table(spark, sf_dir, "part")).select("p_partkey", text.flow_label(F.col("label"), F.col("actor"), F.col("amount")).alias("label"))
