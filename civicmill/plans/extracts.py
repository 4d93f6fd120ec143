"""Extraction from minutes over the driver's documents.

The documents are prose without a layout, so heads of acts are put in at hashed places: every document gets one of several
layouts, with gaps, false titles and running heads, so that what does not match is met as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicmill.operators import approvals as approved
from civicmill.operators import budgets
from civicmill.operators import minutes as m
from civicmill.operators import people
from civicmill.plans.base import query
from civicmill.sources.tables import parts_of, table

#: Bytes of text in a partition whose lines are sorted.
TEXT_BYTES = 16 << 20


def picked(values: list[Column | str], n: Column) -> Column:
    """One of ``values`` by ``n``; the others are not computed."""
    at, out = F.pmod(n, F.lit(len(values))), F.lit(None).cast("string")
    for k, v in reversed(list(enumerate(values))):
        out = F.when(at == k, F.lit(v) if isinstance(v, str) else v).otherwise(out)
    return out


def with_minutes(documents: DataFrame) -> DataFrame:
    """(doc_id, text): sentences as lines, heads in one of seven layouts by the document's id."""
    layout = F.col("doc_id") % 7

    def head(line: Column, i: Column) -> Column:
        k = F.floor(i / 4).cast("int")
        h = F.pmod(F.hash("doc_id", i), F.lit(11))
        words, n = F.substring(line, 1, 60), k.cast("string")
        title = F.when(h == 0, "DETR 52 655.52 € 27.62 %").when(h == 1, "M. DURAND : Oui").when(h == 2, F.concat(words, F.lit(" 39,60 318.37"))).otherwise(words)
        roman = picked(["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"], k)
        number = F.when(h == 3, F.concat(n, F.lit("/2024 "))).otherwise(F.concat(n, F.lit("/2024 : n° "), (4700 + k).cast("string"), F.lit(" : ")))
        ident = F.concat(F.lit(" (N° DE_2026_"), n, F.lit(")"))
        wide = F.concat(F.upper(words), F.lit("\n"), F.lower(words), ident)
        listed = F.when((h == 4) & (layout == 3), line).otherwise(F.concat(title, picked(["", ", approuvé à l'unanimité"], h)))
        return (
            F.when(layout == 0, F.concat(number, title, F.lit("\nVu le code général\n"), line))
            .when(layout == 1, F.concat(F.when(h > 7, wide).otherwise(F.concat(title, ident)), F.lit("\n"), line))
            .when(layout == 2, F.concat(picked(["• ", "(cid:127) ", "– "], h), title, F.lit(" : "), line))
            .when(layout == 3, F.concat(F.when(h == 4, "").otherwise(F.concat((k + 1).cast("string"), F.lit(". "))), listed, F.lit("\n"), line))
            .when(layout == 4, F.concat(F.upper(title), F.lit("\n"), line, F.lit("\nVILLE DE HAUT\n")))
            .when(layout == 5, F.concat(roman, F.lit(". "), title, F.lit("\n\n"), line))
            .otherwise(line)
        )

    sentences = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")
    lines = F.transform(sentences, lambda line, i: F.when(i % 4 == 1, head(line, i)).otherwise(line))
    opening = F.when(F.col("doc_id") % 2 == 0, "PRÉSENTS : TOUS\nSecrétaire de séance : Mme X\n").otherwise("")
    closing = F.when(F.col("doc_id") % 3 == 0, "\nLa séance est levée à 20 h.\nLe Maire, X").otherwise("")
    return documents.select("doc_id", F.concat(opening, F.array_join(lines, "\n"), closing).alias("text"))


@query("T08_acts")
def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return m.acts(with_minutes(documents), "doc_id", "text", parts=parts_of(documents, F.octet_length("text"), TEXT_BYTES))


FIRST = ("Jean", "Marie-Claude", "Paul", "Élodie", "René", "Anne")
LAST = ("DUPONT", "Le Goff", "MARTIN", "de Cazenove", "Séo", "FONTENAY")


def _person(n: Column) -> Column:
    return F.concat(picked(list(FIRST), n), F.lit(" "), picked(list(LAST), F.shiftright(n, 3)))


def with_people(documents: DataFrame) -> DataFrame:
    """(doc_id, text): sentences as lines, every third one with officers told in one of many wordings."""

    def told(line: Column, i: Column) -> Column:
        h = F.pmod(F.hash("doc_id", i), F.lit(1 << 20))
        role = picked(["Président", "trésorière", "SECRÉTAIRE GÉNÉRALE", "gérant", "vice-présidente", "Responsable"], F.shiftright(h, 6))
        a, b = _person(h), _person(F.shiftright(h, 9))
        said = [
            F.concat(role, F.lit(" : "), a), F.concat(role, F.lit(" : Mme "), a, F.lit(", Secrétaire "), b), F.concat(a, F.lit(", "), role, F.lit(" — "), b, F.lit(", trésorière")),
            F.concat(F.lit("Pour contacter "), a, F.lit(" ("), role, F.lit(")")), F.concat(F.lit("présidée par "), a, F.lit(" depuis 2020")), F.concat(role, F.lit(" : Contact Mairie")), F.concat(role, F.lit(" Le Goff")),
            F.concat(F.lit("M. "), a, F.lit(" - le "), role, F.lit(" : "), b), line, role,
        ]
        return F.concat(line, F.lit(" "), picked(said, h))

    sentences = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")
    return documents.select("doc_id", F.array_join(F.transform(sentences, lambda line, i: F.when(i % 3 == 1, told(line, i)).otherwise(line)), "\n").alias("text"))


@query("T13_roles")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.roles(with_people(table(spark, sf_dir, "documents")), "doc_id", "text")


def with_committees(documents: DataFrame) -> DataFrame:
    """(doc_id, text): sentences as lines, between them titles, leads, members, overflowing lists, speech and page numbers."""

    def put(line: Column, i: Column) -> Column:
        h = F.pmod(F.hash("doc_id", i), F.lit(1 << 20))
        name = lambda k: F.concat(picked(["Brigitte", "René\n", "Jean-\nJacques", "Ève"], F.shiftright(h, k)), F.lit(" "), picked(["MARTIN", "FLOUTIER", "LAVERGNE (volet agricole)", "Dubois"], F.shiftright(h, k + 2)))
        three = F.concat(name(3), F.lit(", "), name(7), picked([" - ", "; ", " – "], h), name(11))
        short = F.initcap(F.substring(F.regexp_replace(line, "[^a-zA-Z ]", ""), 1, 30))
        said = [
            short, F.concat(short, F.lit(" :")), F.concat(F.lit("Responsable : "), name(5)), F.concat(F.lit("Responsables : "), three), F.concat(F.lit("Membres : "), three), F.concat(F.lit("MEMBRE : "), name(4)),
            F.upper(three), F.lit("travaux et services"), F.lit("12"), F.lit(""), line, F.when(F.shiftright(h, 8) % 8 == 0, "M. VANTARD : nous allons voter").otherwise(short),
        ]
        return picked(said, F.shiftright(h, 4))

    sentences = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")
    return documents.select("doc_id", F.array_join(F.transform(sentences, lambda line, i: F.when(i % 5 < 4, put(line, i)).otherwise(line)), "\n").alias("text"))


@query("T12_committees")
def committees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.committees(with_committees(table(spark, sf_dir, "documents")), "doc_id", "text")


def with_budgets(documents: DataFrame) -> DataFrame:
    """(doc_id, date, title, text): sentences as lines, between them heads and lines of budget tables, as spreadsheets and web pages write them."""

    def put(line: Column, i: Column) -> Column:
        h = F.pmod(F.hash("doc_id", i), F.lit(1 << 24))
        at = lambda k: F.shiftright(h, k)
        year = picked(["2024", "2025"], F.col("doc_id"))
        name = picked(["PRINCIPAL ", "le budget annexe de la Chaufferie bois ", "M57 ", "qui s'établit ainsi : Parc locatif ", "", "du 2024 "], at(3))
        section = picked(["section de fonctionnement", "SECTION D'INVESTISSEMENT", "dépenses d’investissement", "recettes", "section fonctionnement"], at(6))
        later = picked(["", " 11 0", " CA 2024", "", " Restes à réaliser"], at(9))
        head = F.concat(name, section, picked(["\n", " dépenses "], at(4)), F.lit("Chap/art Intitulé"), picked(["", " Réalisé 2023 | ", "\n"], at(5)), F.lit(" BP "), year, later)
        whole = lambda k: F.concat((at(k) % 900 + 1).cast("string"), F.lit(" "), F.lpad((at(k + 2) % 1000).cast("string"), 3, "0"))
        amount = lambda k: picked([F.concat(whole(k), F.lit(",50")), whole(k), F.concat(F.lit("-"), whole(k), F.lit(".07")), F.lit("65"), F.lit("0,00")], at(k))
        label = picked(["TOTAL DES RECETTES FONCT. EXERCICE", "Total des dépenses fonctionnement", "Total des recettes d'investissement", "TOTAL DES DEPENSES INVEST", ".012 Charges de personnel et frais", "011 charges à caractère général", "Solde d’exécution"], at(2))
        row = F.concat(label, F.lit(" "), amount(8), picked(["\n", " | ", " Autres ", " "], at(7)), amount(11), F.lit(" "), amount(5))
        return picked([head, row, row, line, row], at(1))

    sentences = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")
    body = F.array_join(F.transform(sentences, lambda line, i: F.when(i % 6 < 4, put(line, i)).otherwise(line)), "\n")
    title = F.when(F.col("doc_id") % 3 > 0, picked(["Budget", "PRINCIPAL section de fonctionnement"], F.col("doc_id")))
    return documents.select("doc_id", F.when(F.col("doc_id") % 10 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 50).cast("int"))).alias("date"), title.alias("title"), body.alias("text"))


@query("T10_budget_tables")
def budget_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = budgets.budget_tables(with_budgets(table(spark, sf_dir, "documents")), "doc_id", "title", "text")
    return found.select("doc_id", "nth", "year", "scope", "section", "verdict", F.array_join(F.transform("lines", lambda e: F.format_string("%s=%.12e", e["label"], e["value"])), ";").alias("lines"))


@query("T10_voted_budgets")
def voted_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budgets.voted_budgets(with_budgets(table(spark, sf_dir, "documents")), "doc_id", "date", "title", "text")


def with_plans(documents: DataFrame) -> DataFrame:
    """(doc_id, date, title, text): sentences as lines, every fifth one a vote on a plan, worded in many ways; titles of every kind."""

    def put(line: Column, i: Column) -> Column:
        h = F.pmod(F.hash("doc_id", i), F.lit(1 << 24))
        at = lambda k: F.shiftright(h, k)
        amount = lambda k: F.concat((at(k) % 7 + 1).cast("string"), picked([" 130,10", "\u00a0500", "0 000.5", "99", " 000 000 000"], at(k + 3)))
        who = picked(["Le SMEG propose", "M. SERRE : le SIVOM", "le syndicat mixte d'électrification porte", "Monsieur  SDEE et le Syndicat de la Vallée du Gardon suite", "la commune"], at(4))
        vote = picked(["approuve le projet de travaux", "vote le plan de financement", "Ce projet s’élève à", "avant-projet ci-joint", "examine l'affaire"], at(7))
        money = picked([F.concat(amount(2), F.lit(" € HT soit "), amount(9), F.lit(" € TTC")), F.concat(amount(5), F.lit(" HT")), F.concat(amount(1), F.lit(" euros")), F.concat(amount(6), F.lit(" € ttc et "), amount(3), F.lit(" € ttc"))], at(10))
        return F.concat(line, F.lit("\n"), who, F.lit(" "), vote, F.lit(" "), money, F.lit(". Fin; "), line)

    sentences = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\n"), "\n")
    body = F.array_join(F.transform(sentences, lambda line, i: F.when(i % 5 == 2, put(line, i)).otherwise(line)), "\n")
    title = picked(["Coût des travaux", "EXTENSION DU RESEAU D'ECLAIRAGE PUBLIC DU POSTE", "Travaux au lieu-dit Calviac et alentours", "Séance du conseil de la commune de Haut", "M. SERRE : Le SMEG propose un projet", " "], F.col("doc_id"))
    date = F.when(F.col("doc_id") % 9 > 0, F.date_add(F.lit("2020-01-01").cast("date"), ((F.col("doc_id") * 37) % 1500).cast("int")))
    return documents.select("doc_id", date.alias("date"), title.alias("title"), body.alias("text"))


@query("T11_approvals")
def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = approved.approvals(with_plans(table(spark, sf_dir, "documents")), "doc_id", "date", "title", "text")
    return approved.best_named(found, "doc_id")
