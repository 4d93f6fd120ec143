"""Graph and entity-resolution operators over the civic frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.functions.classify import declared_scope
from civicmill.functions.text import key_words
from civicmill.operators import graph, resolve
from civicmill.operators.civic_views import PRIVATE
from civicmill.operators.publish import PUBLIC_ROLES
from civicmill.plans.base import query
from civicmill.sources.civic import CIVIC_SQL, civic
from civicmill.sources.tables import table, unsent


@query("G01_ego_network", CIVIC_SQL + """, u AS (SELECT DISTINCT node, other FROM ends), d AS (SELECT node AS other, count(*) AS degree FROM ends GROUP BY 1),
    h1 AS (SELECT DISTINCT other FROM u WHERE node = 0 AND other <> 0), c1 AS (SELECT other AS node FROM h1 JOIN d USING (other) ORDER BY degree DESC, other LIMIT 50),
    h2 AS (SELECT DISTINCT other FROM u WHERE node IN (SELECT node FROM c1) AND other <> 0 AND other NOT IN (SELECT node FROM c1)), c2 AS (SELECT other AS node FROM h2 JOIN d USING (other) ORDER BY degree DESC, other LIMIT 120),
    a AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS hop UNION ALL SELECT node, 1 FROM c1 UNION ALL SELECT node, 2 FROM c2) SELECT node, hop FROM a ORDER BY hop, node LIMIT 120""")
def ego_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ego_network(civic(spark, sf_dir).relations, spark.range(1).select(F.col("id").alias("node")))


@query("G02_overview", CIVIC_SQL + """, n AS (SELECT node, count(DISTINCT id) AS degree FROM ends GROUP BY node HAVING count(DISTINCT id) >= 3 ORDER BY degree DESC, node LIMIT 300)
    SELECT id AS edge_id, from_id, to_id FROM relations WHERE from_id IN (SELECT node FROM n) AND to_id IN (SELECT node FROM n)""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.overview(civic(spark, sf_dir).relations, 3, 300)[1].select(F.col("id").alias("edge_id"), "from_id", "to_id")


@query("G04_linked_scope", CIVIC_SQL + """, m AS (SELECT id FROM entities WHERE perimetre IN ('C1', 'C2')), t AS (SELECT DISTINCT other AS id FROM ends WHERE node IN (SELECT id FROM m))
    SELECT id AS entity_id, CASE WHEN id IN (SELECT id FROM t) AND coalesce(perimetre, '') NOT IN ('C1', 'C2') THEN 'lien' ELSE perimetre END AS perimetre FROM entities""")
def linked_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = civic(spark, sf_dir)
    return graph.linked_scope(c.entities, c.relations).select(F.col("id").alias("entity_id"), "perimetre")


SCOPE_SQL = CIVIC_SQL + """, told AS (
    SELECT id, CASE id % 19 WHEN 0 THEN 'Sous-Préfecture de ' || name WHEN 1 THEN 'COMMUNAUTÉ DE COMMUNES des deux-rives' WHEN 2 THEN 'Mars ' || name WHEN 3 THEN 'Parsons ' || name
            WHEN 4 THEN 'Agence de l’Eau' WHEN 5 THEN 'Office des Deux   Rives' WHEN 6 THEN NULL ELSE name END AS name,
        CASE WHEN id % 23 = 0 THEN NULL WHEN id % 23 = 1 THEN ' Saint-Été d''en Haut' WHEN id % 23 = 2 THEN 'SAINT ETE D’EN HAUT' WHEN id % 23 = 3 THEN 'Œuf-lès-Bois' ELSE commune END AS commune
    FROM entities
), bare AS (
    SELECT id, trim(regexp_replace(translate(lower(strip_accents(coalesce(name, ''))), '-''’', '   '), '\\s+', ' ', 'g')) AS name,
        trim(regexp_replace(translate(lower(strip_accents(replace(coalesce(commune, ''), 'Œ', 'OE'))), '-''’', '   '), '\\s+', ' ', 'g')) AS commune FROM told
), declared AS (
    SELECT id, CASE WHEN commune = 'saint ete d en haut' THEN 1 WHEN commune IN ('oeuf les bois', 'n3') OR contains(name, 'des deux rives') THEN 2
        WHEN regexp_matches(name, 'prefecture|departement|conseil regional|region occitanie|etat francais|agence de l eau|ademe|dreal|ars |rectorat|tresorerie|dgfip') THEN 3 ELSE 4 END AS ring FROM bare
), kinds AS (
    SELECT id, CASE WHEN id % 40 = 0 THEN 'membre_de' WHEN id % 40 = 20 THEN 'adhère_à' ELSE relation_type END AS kind, from_id, to_id FROM relations WHERE id % 4 = 0
), placed AS (
    SELECT id, CASE WHEN ring = 4 AND id IN (SELECT to_id FROM kinds WHERE kind IN ('membre_de', 'adhère_à')) THEN 2 ELSE ring END AS ring FROM declared
)
SELECT id AS entity_id, CASE WHEN ring < 4 THEN 'C' || ring WHEN id IN (SELECT s_suppkey * 3 + 1 FROM supplier WHERE s_acctbal < 0) OR id IN (SELECT unnest([from_id, to_id]) FROM flows WHERE id % 30 = 0)
    OR id IN (SELECT k.to_id FROM kinds k JOIN placed p ON p.id = k.from_id WHERE p.ring < 3 UNION SELECT k.from_id FROM kinds k JOIN placed p ON p.id = k.to_id WHERE p.ring < 3) THEN 'lien' ELSE 'hors' END AS scope
FROM placed"""


@query("C06_scopes", SCOPE_SQL)
def classified_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and communes that are spelt in many ways, some memberships, a quarter of the relations, few flows, suppliers in debt as holders of contracts."""
    c = civic(spark, sf_dir)
    n, m, name = F.col("id") % 19, F.col("id") % 23, F.col("name")
    told = F.when(n == 0, F.concat(F.lit("Sous-Préfecture de "), name)).when(n == 1, "COMMUNAUTÉ DE COMMUNES des deux-rives").when(n == 2, F.concat(F.lit("Mars "), name)).when(n == 3, F.concat(F.lit("Parsons "), name))
    told = told.when(n == 4, "Agence de l’Eau").when(n == 5, "Office des Deux   Rives").when(n != 6, name)
    commune = F.when(m == 1, " Saint-Été d'en Haut").when(m == 2, "SAINT ETE D’EN HAUT").when(m == 3, "Œuf-lès-Bois").when(m != 0, F.col("commune"))
    relations = c.relations.where("id % 4 = 0").withColumn("relation_type", F.when(F.col("id") % 40 == 0, "membre_de").when(F.col("id") % 40 == 20, "adhère_à").otherwise(F.col("relation_type")))
    contracts = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") * 3 + 1).alias("holder_id"))
    declared = declared_scope(told, commune, "Saint-Été d'en Haut", ("Œuf-lès-Bois", "N3"), "CC des Deux-Rives")
    return graph.classified_scopes(c.entities, relations, c.flows.where("id % 30 = 0"), contracts, declared).select(F.col("id").alias("entity_id"), "scope")


@query("G06_relevance_closure", CIVIC_SQL + """, sure AS (SELECT *, [from_id, to_id] AS pair FROM relations WHERE confidence IN ('verified', 'confirmed')
), fed AS (
    SELECT to_id AS id FROM flows WHERE source IS DISTINCT FROM 'ofgl' AND NOT ends_with(type, '_demande')
    UNION SELECT s_suppkey * 3 + 1 FROM supplier WHERE s_acctbal < 0 UNION SELECT unnest(pair) FROM sure WHERE relation_type = 'membre_commission'
), tied AS (
    SELECT unnest(pair) AS id FROM sure WHERE relation_type IN ('dirigeant', 'gérant', 'président', 'associé') AND EXISTS (SELECT 1 FROM fed WHERE list_contains(pair, fed.id))
        AND NOT EXISTS (SELECT 1 FROM entities s WHERE s.type <> 'person' AND s.id % 11 = 0 AND list_contains(pair, s.id))
), seated AS (
    SELECT unnest(pair) AS id FROM sure WHERE relation_type IN ('adjoint', 'candidat', 'délégué_cc', 'délégué_cm', 'élu_cc', 'élu_cm', 'maire', 'membre_commission')
)
SELECT id AS entity_id, CASE WHEN id IN (SELECT id FROM seated) THEN 'civic' ELSE 'economic' END AS why FROM entities
WHERE type = 'person' AND confidence IN ('verified', 'confirmed') AND (id IN (SELECT id FROM seated) OR id IN (SELECT id FROM tied))""")
def relevance_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holders of contracts are suppliers in debt; every eleventh body is a sole proprietor."""
    c = civic(spark, sf_dir)
    flows = c.flows.withColumns({"scope": F.when(F.col("source") == "ofgl", "agregat"), "status": F.when(F.col("type").endswith("_demande"), "demande")})
    contracts = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") * 3 + 1).alias("holder_id"))
    sole = c.entities.where((F.col("type") != "person") & (F.col("id") % 11 == 0)).select(F.col("id").alias("node"))
    money = graph.public_money(c.relations, flows, contracts, ("membre_commission",))
    return graph.relevance_closure(c.entities, c.relations, money, sole, PUBLIC_ROLES, PRIVATE).select(F.col("id").alias("entity_id"), "why")


@query("R01_matched_entities", CIVIC_SQL + """, e AS (SELECT id, name, commune, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS k FROM entities),
    m AS (SELECT c_custkey AS mention_id, CASE WHEN c_nationkey < 8 THEN c_name ELSE upper(c_name) END AS name, CASE WHEN c_nationkey < 16 THEN 'N' || c_nationkey END AS commune FROM customer),
    x AS (SELECT name, min(id) AS id FROM e GROUP BY 1), l AS (SELECT k, commune, min(id) AS id FROM e GROUP BY ALL), a AS (SELECT k, min(id) AS id FROM e GROUP BY k HAVING count(*) = 1)
    SELECT mention_id, coalesce(x.id, l.id, CASE WHEN m.commune IS NULL THEN a.id END) AS entity_id, CASE WHEN x.id IS NOT NULL THEN 'exact' WHEN l.id IS NOT NULL THEN 'commune' WHEN m.commune IS NULL AND a.id IS NOT NULL THEN 'unique' END AS how
    FROM m LEFT JOIN x ON x.name = m.name LEFT JOIN l ON l.k = trim(regexp_replace(lower(m.name), '[^a-z0-9]+', ' ', 'g')) AND l.commune = m.commune LEFT JOIN a ON a.k = trim(regexp_replace(lower(m.name), '[^a-z0-9]+', ' ', 'g'))""")
def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_nationkey") < 8, F.col("c_name")).otherwise(F.upper("c_name"))
    commune = F.when(F.col("c_nationkey") < 16, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    mentions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mention_id"), name.alias("name"), commune.alias("commune"))
    return resolve.match_entities(mentions, civic(spark, sf_dir).entities).select("mention_id", "entity_id", "how")


TOKENS_SQL = """WITH l AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4)) AS t FROM benchmark),
    r AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(lower({f}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 4)) AS t FROM conversations),
    p AS (SELECT item_id, conv_id * 100 + turn AS turn_id, len(l.t) AS nl, len(r.t) AS nr, len(list_intersect(l.t, r.t)) AS s FROM l JOIN r ON list_has_any(l.t, r.t))"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf_dir, "benchmark").select("item_id", key_words(F.col("text")).alias("tokens"))
    right = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), key_words(F.col("text")).alias("tokens"))
    return left, right


def _tokens_sql() -> str:
    from civicmill.plans.scalars import FOLD_SQL

    return TOKENS_SQL.replace("{f}", FOLD_SQL.format(x="text")).replace("lower(text)", f"lower({FOLD_SQL.format(x='text')})")


@query("J16_best_jaccard", _tokens_sql() + "SELECT item_id, turn_id, round(CAST(s AS DOUBLE) / (nl + nr - s), 6) AS score FROM p WHERE round(CAST(s AS DOUBLE) / (nl + nr - s), 6) >= 0.02 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, turn_id) = 1")
def best_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return resolve.best_by_jaccard(left, right, "item_id", "turn_id", 0.02)


@query("J17_best_coverage", _tokens_sql() + "SELECT item_id, turn_id, round(CAST(s AS DOUBLE) / nr + CASE WHEN s = nr THEN 0.5 ELSE 0.0 END, 6) AS score FROM p WHERE round(CAST(s AS DOUBLE) / nr + CASE WHEN s = nr THEN 0.5 ELSE 0.0 END, 6) >= 0.05 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, nr DESC, turn_id) = 1")
def best_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return resolve.best_by_coverage(left, right, "item_id", "turn_id", 0.05)


@query("R03_homonyms", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name HAVING count(*) = 1 UNION ALL SELECT c_name, min(c_custkey) FROM customer GROUP BY c_name HAVING count(*) = 1")
def homonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = resolve.unambiguous(table(spark, sf_dir, "part").select("p_name", "p_partkey"), "p_partkey", "p_name")
    people = table(spark, sf_dir, "customer").select(F.col("c_name").alias("p_name"), F.col("c_custkey").alias("p_partkey"))
    return parts.unionByName(resolve.unambiguous(people, "p_partkey", "p_name"))


@query("R05_reconciled", CIVIC_SQL + """, b AS (SELECT DISTINCT e.node AS person_id, r.source FROM ends e JOIN relations r ON r.id = e.id WHERE r.until IS NULL), g AS (SELECT DISTINCT o_custkey * 3 AS person_id, 'decp' AS source FROM orders UNION SELECT DISTINCT o_custkey * 3, 'cm' FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT coalesce(b.person_id, g.person_id) AS person_id, coalesce(b.source, g.source) AS source, CASE WHEN b.person_id IS NOT NULL AND g.person_id IS NOT NULL THEN 'accord' WHEN b.person_id IS NOT NULL THEN 'absent_du_registre' ELSE 'absent_de_la_base' END AS finding
    FROM b FULL JOIN g ON b.person_id = g.person_id AND b.source = g.source WHERE coalesce(b.source, g.source) IN ('decp', 'cm')""")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from civicmill.operators.edges import doubled

    active = doubled(civic(spark, sf_dir).relations.where("until IS NULL").select("id", "source", "from_id", "to_id")).select(F.col("node").alias("person_id"), "source")
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("person_id"), "o_orderpriority")
    register = orders.select("person_id", F.lit("decp").alias("source")).union(orders.where("o_orderpriority <> '5-LOW'").select("person_id", F.lit("cm"))).distinct()
    return resolve.reconciled(active, register, ["person_id"], register.select("source"), "source")


@query("K01_natural_keys", CIVIC_SQL + "SELECT id AS entity_id, CASE WHEN siren IS NOT NULL THEN 'siren:' || siren ELSE 'nom:' || type || ':' || substr(sha1(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))), 1, 16) END AS natural_key FROM entities")
def natural_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = civic(spark, sf_dir).entities
    return entities.select(F.col("id").alias("entity_id"), resolve.natural_key(F.col("type"), F.col("siren"), F.lit(None).cast("string"), F.col("name")).alias("natural_key"))


LETTERS_SQL = "translate(CAST({n} AS VARCHAR), '0123456789', 'abcdefghij')"
#: What people write for the first part's body, and nobody else's.
ALIASES = {"ape": "small widget", "les boulistes": "amicale des boulistes"}


def _letters(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", "abcdefghij")


@query("R04_beneficiaries", """WITH RECURSIVE bodies AS (
    SELECT p_partkey AS id, p_name || ' w' || """ + LETTERS_SQL.format(n="p_partkey % 97") + """ || ' v' || """ + LETTERS_SQL.format(n="p_partkey % 31") + """ AS name, p_partkey % 3 = 0 AS asso, p_partkey % 5 = 0 AS paid FROM part WHERE p_partkey % 11 > 0
), said AS (
    SELECT o_orderkey AS mention_id, p_name AS plain, p_name || ' w' || """ + LETTERS_SQL.format(n="p_partkey % 97") + """ || ' v' || """ + LETTERS_SQL.format(n="p_partkey % 31") + """ AS name FROM orders JOIN part ON p_partkey = o_custkey
), told AS (
    SELECT mention_id, CASE mention_id % 9 WHEN 0 THEN upper(name) WHEN 1 THEN 'Association  ' || name WHEN 2 THEN array_to_string(list_reverse(string_split(name, ' ')), '-') WHEN 3 THEN array_to_string(string_split(name, ' ')[1:3], ' ')
        WHEN 4 THEN name || ' nouveau club' WHEN 5 THEN 'Amicale z' || """ + LETTERS_SQL.format(n="mention_id % 40") + """ || ' ' || plain WHEN 6 THEN CASE mention_id % 4 WHEN 0 THEN 'amicale des boulistes' ELSE 'small widget' END WHEN 7 THEN 'l' || chr(39) || name ELSE CASE mention_id % 5 WHEN 0 THEN NULL ELSE 'de la' END END AS name FROM said
), keyed AS (
    SELECT mention_id, name, lower(trim(name)) AS key, mention_id % 9 = 6 AS aliased FROM told WHERE name IS NOT NULL
), tokens AS (
    SELECT key, min(mention_id) AS first, list_distinct(list_filter(string_split(trim(regexp_replace(key, '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('de', 'des', 'du', 'la', 'le', 'les', 'et', 'au', 'aux', 'pour', 'association', 'asso'))) AS words FROM keyed GROUP BY key
), exact AS (
    SELECT lower(name) AS key, arg_min(id, (NOT asso, id)) AS exact_id FROM bodies GROUP BY lower(name)
), body_words AS (
    SELECT id, asso, paid, list_distinct(string_split(lower(name), ' ')) AS words FROM bodies
), scored AS (
    SELECT key, id, paid, row_number() OVER (PARTITION BY key ORDER BY paid DESC, len(list_intersect(t.words, b.words)) DESC, asso DESC, len(b.words), id) AS nth
    FROM tokens t ANTI JOIN exact USING (key) JOIN body_words b ON list_has_any(t.words, b.words) AND len(list_intersect(t.words, b.words)) * 10 >= len(t.words) * 6
), alike AS (SELECT key, id, paid FROM scored WHERE nth = 1
), unknown AS (
    SELECT key, first, words, row_number() OVER (ORDER BY first) AS k FROM tokens ANTI JOIN exact USING (key) ANTI JOIN alike USING (key)
), walk AS (
    SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(first BIGINT, words VARCHAR[])[]) AS made, CAST(NULL AS VARCHAR) AS key, CAST(NULL AS BIGINT) AS registered_by
    UNION ALL
    SELECT k, CASE WHEN hit IS NULL THEN list_append(made, {'first': first, 'words': words}) ELSE made END, key, coalesce(hit, first) FROM (
        SELECT u.k, w.made, u.key, u.first, u.words, list_sort(list_transform(list_filter(w.made, lambda m: len(u.words) > 0 AND len(list_intersect(u.words, m.words)) * 10 >= len(u.words) * 6),
            lambda m: {'a': -len(list_intersect(u.words, m.words)), 'b': len(m.words), 'first': m.first}))[1].first AS hit
        FROM walk w JOIN unknown u ON u.k = w.k + 1)
)
SELECT told.mention_id, coalesce(exact_id, alike.id) AS entity_id, registered_by,
    CASE WHEN told.name IS NULL THEN 'nothing' WHEN exact_id IS NOT NULL THEN CASE WHEN aliased THEN 'alias' ELSE 'exact' END WHEN alike.id IS NOT NULL THEN CASE WHEN paid THEN 'subsidised' ELSE 'known' END
        WHEN registered_by = told.mention_id THEN 'registered' ELSE 'new' END AS how
FROM told LEFT JOIN keyed ON keyed.mention_id = told.mention_id LEFT JOIN exact ON exact.key = keyed.key LEFT JOIN alike ON alike.key = keyed.key LEFT JOIN walk ON walk.key = keyed.key""")
def beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts' bodies as orders tell them: in capitals, in another order, in part, with more, as an alias, or of unknown clubs."""
    part = table(spark, sf_dir, "part")
    body = F.concat("p_name", F.lit(" w"), _letters(F.col("p_partkey") % 97), F.lit(" v"), _letters(F.col("p_partkey") % 31))
    entities = part.where("p_partkey % 11 > 0").select(F.col("p_partkey").alias("id"), body.alias("name"), F.when(F.col("p_partkey") % 3 == 0, "association").otherwise("business").alias("type"))
    n = F.col("o_orderkey")
    words = F.split("name", " ")
    told = (
        F.when(n % 9 == 0, F.upper("name")).when(n % 9 == 1, F.concat(F.lit("Association  "), "name")).when(n % 9 == 2, F.array_join(F.reverse(words), "-")).when(n % 9 == 3, F.array_join(F.slice(words, 1, 3), " "))
        .when(n % 9 == 4, F.concat("name", F.lit(" nouveau club"))).when(n % 9 == 5, F.concat(F.lit("Amicale z"), _letters(n % 40), F.lit(" "), "p_name"))
        .when(n % 9 == 6, F.when(n % 4 == 0, " Les  Boulistes").otherwise("APE")).when(n % 9 == 7, F.concat(F.lit("l’"), "name")).when(n % 5 != 0, "de la")
    )
    rows = table(spark, sf_dir, "orders").join(unsent(part.select("p_partkey", "p_name", body.alias("name"))), F.col("o_custkey") == F.col("p_partkey"))
    paid = entities.where("id % 5 = 0").select("id")
    return resolve.resolved_beneficiaries(rows.select(n.alias("mention_id"), told.alias("name")), entities, paid, ALIASES)
