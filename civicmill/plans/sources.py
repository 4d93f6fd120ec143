"""Sources that answer page by page, fed from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.plans.base import query
from civicmill.sources.files import read_grants
from civicmill.sources.paged import PagedSource, publish
from civicmill.sources.tables import shared_folder, table


@query("SRC20_paged_events", "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def paged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a paged service's records and read back by windows of at most a thousand."""
    path = shared_folder(spark, "pages")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("at"))
    publish(events, "at", path)
    spark.dataSource.register(PagedSource)
    pages = spark.read.format("paged").schema("event_id long, user_id long, event_type string, at string").options(path=path, cap=1000, pageSize=200).load()
    return pages.select("event_id", "user_id", "event_type", F.col("at").alias("day"))


@query("SRC09_headed_tables", """SELECT lpad(CAST(c_custkey % 90000 AS VARCHAR), 5, '0') AS insee, c_name AS name, round(c_acctbal, 2) AS forfaitaire, CASE WHEN c_custkey % 9 > 0 THEN round(abs(c_acctbal) * 2, 2) END AS dsr,
    CASE (c_custkey // 100) % 3 WHEN 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(c_custkey AS DOUBLE) END AS total FROM customer""")
def headed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as communes with grants, a hundred a file, in three layouts: other separators, heads, columns and numbers."""
    n = F.col("c_custkey")
    code = F.lpad((n % 90_000).cast("string"), 5, "0")
    money = lambda c: F.format_string("%.2f", F.round(c, 2))
    a, b = money(F.col("c_acctbal")), F.when(n % 9 > 0, money(F.abs("c_acctbal") * 2)).otherwise("-")
    comma = lambda c: F.replace(c, F.lit("."), F.lit(","))
    spaced = F.regexp_replace(comma(a), r"(\d)(\d{3}),", "$1\u00a0$2,")
    layout = F.floor(n / 100) % 3
    quoted = F.concat(F.lit('"'), "c_name", F.lit('"'))
    row = (
        F.when(layout == 0, F.concat_ws(";", code, F.col("c_name"), spaced, comma(b)))
        .when(layout == 1, F.concat_ws(",", F.substring(code, 1, 2), F.substring(code, 3, 3), quoted, n.cast("string"), b, a))
        .otherwise(F.concat_ws(";", F.concat((n % 90_000).cast("string"), F.lit(".0")), n.cast("string"), F.lit("x"), comma(a), comma(b), F.col("c_name")))
    )
    heads = (
        F.when(layout == 0, "Notification des dotations;;\n;;;\nCode INSEE;Commune;Dotation Forfaitaire 2024;Dot. Solidarité  rurale\n")
        .when(layout == 1, "Code département,Code commune,Nom Commune,Total DGF,DSR,Dot forfaitaire\n")
        .otherwise("\n;;\nN° INSEE de la collectivité;Montant DGF;autre;dotation forfaitaire;DSR éligible;Libellé\n")
    )
    written = table(spark, sf_dir, "customer").select(F.floor(n / 100).alias("file"), heads.alias("head"), F.struct(n, row.alias("row")).alias("row"))
    files = written.groupBy("file").agg(F.concat(F.first("head"), F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["row"]), "\n")).alias("value"))  # a hundred rows each
    path = shared_folder(spark, "grants")
    files.repartition("file").write.partitionBy("file").text(path)
    return read_grants(spark, f"{path}/*").select("insee", "name", "forfaitaire", "dsr", "total")
