"""Approved projects in the text of acts: the sentence that votes a plan, its amounts, what it is about and who carries it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.functions.text import bound, once
from civicmill.operators.windows import best_of_near_repeats

#: How minutes vote a plan, and titles that name no operation.
VOTED = r"(?iu)approuve le projet|[ée]tat financier estimatif|inscription au programme|avant[- ]projet ci[- ]joint|ce projet s['’]\s*[ée]l[èe]ve|plan de financement"
AMOUNT = r"(?i)(\d[\d \x{00A0}\x{202F}]{2,}(?:[.,]\d{1,2})?)\s*€?\s*(HT|TTC)"
GENERIC = r"(?iu)^(PV du CM|CM du|Conseil municipal|Conseil communautaire|D[ée]lib[ée]rations? du|Proc[èe]s[- ]verbal|Compte[- ]rendu|S[ée]ance)"
SPEECH = r"(?i)^(?:M\.|Mme|Mlle|Monsieur|Madame)\s+\S+\s*:"
#: An acronym of a syndicate, or the word; a surname in capitals looks alike but follows a civility.
OWNER = r"(?=[sS])(?<![\p{L}\p{N}_])(?<!(?:M\.|Mme|Mlle|Monsieur|Madame)\s{0,9})(?:S[A-Z]{2,5}(?![\p{L}\p{N}_])|[sS][yY][nN][dD][iI][cC][aA][tT](?:\s+[\p{L}\p{N}_'’-]+){1,4})"
QUALIFIERS = ("mixte", "intercommunal", "intercommunale", "departemental", "departementale", "départemental", "départementale", "communal", "communale")
PREPOSITIONS = ("de", "du", "des", "d'", "d’", "la", "le", "les", "l'", "l’")
LEAST, MOST, SHORT_TITLE, NEAR_DAYS = 500.0, 20_000_000.0, 25, 200
#: Fixed value: what makes an object name its operation.
PROPER = r"[«\"]|(?<=\s)[A-ZÉÈÀÎÔ][a-zéèêàîô]{2,}"


def sentences(text: Column) -> Column:
    """Sentences and lines; a point inside a number has no white space after it and cuts nothing."""
    return F.filter(F.transform(F.split(text, r"(?<=[.;])\s+|\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def owner(text: Column) -> Column:
    """The first syndicate that a text names, cut where its name ends; null if none."""
    bare = lambda w: F.regexp_replace(F.lower(w), "[.,;:]+$", "")

    def step(s: Column, w: Column) -> Column:
        glued = bare(w).rlike("^[dl]['’]")
        fits = bare(w).isin(*QUALIFIERS, *PREPOSITIONS) | glued | w.rlike(r"^\p{Lu}") | s["after"]
        goes = s["on"] & fits
        return F.struct(goes.alias("on"), F.when(goes, bare(w).isin(*PREPOSITIONS) | glued).otherwise(s["after"]).alias("after"), F.when(goes, F.concat(s["kept"], F.array(w))).otherwise(s["kept"]).alias("kept"))

    def kept(words: Column) -> Column:
        start = F.struct(F.lit(True).alias("on"), F.lit(False).alias("after"), F.slice(words, 1, 1).alias("kept"))
        return F.aggregate(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), start, step)["kept"]

    def ended(words: Column) -> Column:
        full = F.array_max(F.transform(words, lambda w, i: F.when(~bare(w).isin(*PREPOSITIONS), i)))
        return F.array_join(F.slice(words, F.lit(1), full + 1), " ")

    words = F.split(F.get(F.regexp_extract_all(text, F.lit(OWNER), F.lit(0)), F.lit(0)), r"\s+")
    return bound(words, lambda w: bound(kept(w), ended))


def approvals(acts: DataFrame, key: str, date: str, title: str, text: str) -> DataFrame:
    """(key, at, date, object, without_tax, with_tax, owner, quote): the sentences that vote a plan with an amount.

    Amounts without and with tax are paired from one sentence, the first of each. The object is the act's title if it
    names the operation, the title and the sentence if it is short or generic, and the sentence if it is a speech.
    """
    rows = once(acts, text, F.col(text)).where(F.col(text).isNotNull()).select(key, date, title, F.posexplode(sentences(F.col(text))).alias("at", "quote")).where(F.col("quote").rlike(VOTED))
    raw, base = (F.regexp_extract_all("quote", F.lit(AMOUNT), F.lit(g)) for g in (1, 2))
    number = lambda r: F.replace(F.regexp_replace(r, r"[ \x{00A0}\x{202F}]", ""), F.lit(","), F.lit(".")).try_cast("double")
    pairs = F.filter(F.zip_with(raw, base, lambda r, b: F.struct(F.upper(b).alias("base"), number(r).alias("value"))), lambda p: p["value"].between(LEAST, MOST))
    first = lambda kind: F.get(F.filter("pairs", lambda p: p["base"] == kind), F.lit(0))["value"]
    rows = once(rows, "pairs", pairs).where(F.size("pairs") > 0)
    said = F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", "")
    useful = F.when(said.rlike(SPEECH), "").otherwise(said)
    vague = (useful != "") & ((F.length(useful) < SHORT_TITLE) | useful.rlike(GENERIC))
    about = F.when(vague, F.concat(useful, F.lit(" — "), "quote")).when(useful != "", useful).otherwise(F.col("quote"))
    return rows.select(
        key, "at", F.col(date).alias("date"), F.substring(about, 1, 255).alias("object"), first("HT").alias("without_tax"), first("TTC").alias("with_tax"),
        owner(F.concat("quote", F.lit(" "), F.coalesce(title, F.lit("")))).alias("owner"), F.substring("quote", 1, 500).alias("quote"),
    )


def best_named(found: DataFrame, key: str) -> DataFrame:
    """One row of those that vote an equal amount without tax within ``NEAR_DAYS`` days: the one whose object names the operation best.

    An object with a proper name comes before a longer one without; then the longer one, then the earlier act.
    """
    best = (F.desc(F.col("object").rlike(PROPER)), F.desc(F.length("object")), F.col(key), F.col("at"))
    return best_of_near_repeats(found, ["without_tax"], "date", NEAR_DAYS, *best)
