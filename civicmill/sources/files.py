"""Files as public bodies publish them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicmill.functions.text import fold


#: Control characters of ISO-8859-1 that are letters and signs in windows-1252, which Spark's reader doesn't take.
WINDOWS = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header, plain or gzipped, all columns texts: UTF-8, or windows-1252 if it isn't UTF-8."""
    rows = spark.read.csv(path, sep=sep, header=True)
    broken = F.concat_ws("", *[F.col(f"`{c}`") for c in rows.columns]).contains("\ufffd")
    if "\ufffd" not in "".join(rows.columns) and rows.where(broken).isEmpty():
        return rows
    rows = spark.read.csv(path, sep=sep, header=True, encoding="ISO-8859-1")
    return rows.select(*[F.translate(F.col(f"`{c}`"), "".join(WINDOWS), "".join(WINDOWS.values())).alias(c.translate(str.maketrans(WINDOWS))) for c in rows.columns])


def unpivot_blocks(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Repeated columns ("Voix 1", "Liste 1", "Voix 2", …) as a row for each number: ids, ``block`` and a column a name.

    Blocks without any value are left out.
    """
    blocks: dict[int, dict[str, str]] = {}
    for c in rows.columns:
        if m := re.fullmatch(r"(.+?)\s+(\d+)", c):
            blocks.setdefault(int(m[2]), {})[m[1]] = c
    names = sorted({n for b in blocks.values() for n in b})
    cell = lambda b, n: F.col(f"`{b[n]}`").cast("string") if n in b else F.lit(None).cast("string")
    each = F.array(*[F.struct(F.lit(k).alias("block"), *[cell(b, n).alias(n) for n in names]) for k, b in sorted(blocks.items())])
    return rows.select(*ids, F.explode(each).alias("one")).select(*ids, "one.*").where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())


def read_contracts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Consolidated JSON whose root is a list of contracts or ``{"marches": {"marche": [...]}}``, plain or gzipped."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", f"marches struct<marche: array<struct<{schema}>>>")["marches"]["marche"]
    plain = F.from_json("value", f"array<struct<{schema}>>")
    return text.select(F.explode(F.when(F.ltrim("value").startswith("["), plain).otherwise(nested)).alias("one")).select("one.*")


def read_decisions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Decisions, one JSON object a line; lines that are none are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").json(path, columnNameOfCorruptRecord="_bad")
    return rows.where("_bad IS NULL").drop("_bad")


def read_seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Curated seeds, pretty-printed JSON of one object or a list of them a file; files that are none are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").json(path, multiLine=True, columnNameOfCorruptRecord="_bad")
    return rows.where("_bad IS NULL").drop("_bad")


#: What heads the columns of a table of grants by commune.
GRANTS = {
    "forfaitaire": ("dotation forfaitaire", "dot forfaitaire"), "dsr": ("solidarite rurale", "dsr"), "dsu": ("solidarite urbaine", "dsu"),
    "dnp": ("nationale de perequation", "dnp"), "total": ("dotation globale de fonctionnement", "montant dgf", "total dgf", "dgf totale"),
}


def _heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(text)), r"\s+", " "))


def french_number(text: Column) -> Column:
    """A number with blanks between thousands and a comma or point; null for a dash, a blank or anything else."""
    return F.replace(F.regexp_replace(text, r"[\s\x{00A0}\x{202F}€]", ""), F.lit(","), F.lit(".")).try_cast("double")


def read_grants(spark: SparkSession, path: str, components: dict[str, tuple[str, ...]] = GRANTS, first_lines: int = 15) -> DataFrame:
    """(path, line, insee, name, one column a component) of tables of communes, whatever stands above them and however columns are called.

    Files are CSV with semicolons or commas, whichever their start holds more of. The head is the first of the first lines
    that are not blank to speak of an INSEE code, or of commune and département; else the first line. Columns are known by
    words in their headings, the first that fits; the code of a commune is put together from those of its département and
    its own where it is not given. Each file is one row while its head is found, as its lines only mean something together;
    cells that hold line ends are not read.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    start = F.substring("value", 1, 4096)
    comma = F.regexp_count(start, F.lit(",")) > F.regexp_count(start, F.lit(";"))
    quoted = lambda sep: F.split("line", f'{sep}(?=(?:[^"]*"[^"]*")*[^"]*$)')
    lines = files.select("path", comma.alias("comma"), F.posexplode(F.split("value", r"\r?\n")).alias("line_number", "line"))
    cells = F.transform(F.when(F.col("comma"), quoted(",")).otherwise(quoted(";")), lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"')))
    rows = lines.select("path", (F.col("line_number") + 1).alias("line"), cells.alias("cells")).where(F.exists("cells", lambda c: F.trim(c) != ""))

    told = F.array_join(F.transform("cells", _heading), " ")
    speaks = F.contains(told, F.lit("insee")) | (F.contains(told, F.lit("commune")) & F.contains(told, F.lit("departement"))) | F.contains(told, F.lit("code commune"))
    by_line = Window.partitionBy("path").orderBy("line")
    ranked = rows.withColumn("nth", F.row_number().over(by_line)).where(F.col("nth") <= first_lines)
    heads = ranked.groupBy("path").agg(F.coalesce(F.min_by(F.when(speaks, F.struct("line", "cells")), F.when(speaks, F.col("line"))), F.min_by(F.struct("line", "cells"), "line")).alias("head"))

    names = F.transform("head.cells", _heading)
    at = lambda fits: F.array_position(F.transform(names, fits), True)  # noqa: E731  0 for none
    holds = lambda *words: lambda n: reduce(lambda a, b: a | b, [F.contains(n, F.lit(w)) for w in words])
    places = {
        "_insee": at(holds("insee")), "_dep": at(lambda n: holds("departement")(n) | n.isin("dep", "code dep")),
        "_com": at(lambda n: holds("code commune", "code com")(n) | (n == "com")), "_name": at(lambda n: holds("nom commune")(n) | n.isin("commune", "libelle", "nom")),
    } | {f"_{c}": at(holds(*words)) for c, words in components.items()}
    mapped = heads.select("path", F.col("head.line").alias("_head"), *[p.cast("int").alias(c) for c, p in places.items()])
    body = rows.join(mapped, "path").where(F.col("line") > F.col("_head"))
    cell = lambda c: F.when(F.col(c) > 0, F.get("cells", F.col(c) - 1))
    whole = lambda c: F.get(F.split(F.trim(cell(c)), r"\."), F.lit(0))
    dep, com = F.lpad(F.trim(cell("_dep")), 2, "0"), F.lpad(whole("_com"), 3, "0")
    long = F.greatest(F.lit(5), F.length(whole("_insee")))
    given = F.when(whole("_insee").rlike(r"^\d+$"), F.lpad(whole("_insee"), long, F.lit("0"))).otherwise(F.nullif(whole("_insee"), F.lit("")))
    made = F.when(dep.rlike(r"^\d+$") & com.rlike(r"^\d+$"), F.substring(F.concat(dep, com), 1, 5))
    insee = F.when(F.col("_insee") > 0, given).otherwise(made)
    found = body.select("path", "line", insee.alias("insee"), F.trim(cell("_name")).alias("name"), *[french_number(cell(f"_{c}")).alias(c) for c in components])
    return found.where("insee IS NOT NULL")
