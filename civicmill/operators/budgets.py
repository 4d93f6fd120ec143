"""Voted budgets in the text of acts: tables found by their head, one value a line, tables that can't be told refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.functions.text import bound, fold, once
from civicmill.operators.windows import first_per_key

#: The head of a budget table, what names section and budget before it, and columns that may follow it.
HEAD = r"chap(?:\s*[/.]\s*art)?\.?\s*[\s|]*intitul[ée]*\b([\s\S]{0,60}?)bp\s+(20\d\d)"
SECTION = r"(fonctionnement|investissement)(?![a-z])"
NAMED = r"([a-z0-9.'\x{00A0}\x{202F} -]{0,40}?)\s*section\s+(?:de\s+)?(?:fonctionnement|d'\s?investissement)"
LATER_COLUMN = r"\bca\s*20\d\d\b|compte\s+administratif|realis|\brar\b|mandat"
BEFORE, BEFORE_SECTION, AFTER = 200, 60, 45
#: Lines of a table and what they are called; the balance is called by its section.
LABELS = {
    "Recettes de fonctionnement": r"total\s+des\s+recettes\s+fonct\w*\.?\s*(?:exercice)?", "Dépenses de fonctionnement": r"total\s+des\s+depenses\s+fonct\w*\.?\s*(?:exercice)?",
    "Recettes d'investissement": r"total\s+des\s+recettes\s+d[' ]?\s*invest\w*\.?\s*(?:exercice)?", "Dépenses d'investissement": r"total\s+des\s+depenses\s+d[' ]?\s*invest\w*\.?\s*(?:exercice)?",
    "Charges de personnel": r"\.?\s*012\s+charges\s+de\s+personnel[^\d]{0,40}", "Charges à caractère général": r"\.?\s*011\s+charges\s+a\s+caractere\s+general[^\d]{0,40}",
}
BALANCE = r"solde\s+d[' ]?\s*execution"
BALANCES = {"fonctionnement": "Excédent net de fonctionnement", "investissement": "Solde d'exécution d'investissement"}
AMOUNT = r"-?\s?\d{1,3}(?:[ \x{00A0}\x{202F}]\d{3})*(?:[.,]\d{1,2})?"
#: Words that belong to the sentence before a budget's name.
SENTENCE = (
    "pv", "detail", "par", "chapitre", "chapitres", "ainsi", "etablit", "qui", "du", "de", "des", "la", "le", "les", "et", "en", "au", "aux", "budget", "budgets",
    "annexe", "annexes", "suit", "suivant", "vote", "votes", "adopte", "presente", "propose", "s'etablit",
)


def plain(text: Column) -> Column:
    """Lower case without accents, one kind of apostrophe; null is blank."""
    return F.lower(F.translate(fold(F.coalesce(text, F.lit(""))), "’‘", "''"))


def budget_name(words: Column) -> Column:
    """The name at the end of what stands before "section": at most three words, back to the first that belongs to the sentence.

    "principal" is the main budget, and so is the name of a nomenclature (M57). Null where there is none: no budget is taken
    for the main one by default.
    """
    back = F.transform(F.reverse(F.regexp_extract_all(words, F.lit(r"[a-z0-9'.-]+"), F.lit(0))), lambda w: F.regexp_replace(w, r"^[.':-]+|[.':-]+$", ""))
    foreign = F.transform(back, lambda w: (w == "") | w.isin(*SENTENCE) | w.rlike(r"^[\d.'-]+$"))
    first = F.array_position(foreign, True)
    n = F.least(F.lit(3), F.when(first > 0, first - 1).otherwise(F.size(back))).cast("int")
    name = F.array_join(F.reverse(F.slice(back, F.lit(1), n)), " ")
    return F.when(name.rlike(r"^(principal|m\s?\d{1,2})$"), "principal").otherwise(F.nullif(name, F.lit("")))


def last_amount(tail: Column, most: int = 3) -> Column:
    """Of the sums that follow at once, with white space and bars between them, at most ``most``, the last; null for none.

    The number of the next line's chapter is no sum: sums have decimals or are a thousand at least.
    """
    number = lambda raw: F.replace(F.regexp_replace(raw, r"[\s\x{00A0}\x{202F}]", ""), F.lit(","), F.lit(".")).try_cast("double")
    sums = lambda raw, value: (raw != "") & (raw.rlike(r"[.,]\d{1,2}$") | (F.abs(value) >= 1000))

    def read(rest: Column, before: Column, left: int) -> Column:
        after = lambda value: bound(F.regexp_replace(rest, rf"^[ \t\n\r|:]*{AMOUNT}", ""), lambda r: read(r, value, left - 1)) if left > 1 else value
        told = lambda raw: bound(number(raw), lambda value: F.when(sums(raw, value), after(value)).otherwise(before))
        return bound(F.regexp_extract(rest, rf"^[ \t\n\r|:]*({AMOUNT})", 1), lambda raw: F.when(raw == "", before).otherwise(told(raw)))

    return bound(tail, lambda t: read(t, F.lit(None).cast("double"), most))


def _found(body: Column, label: str) -> Column:
    """The value of the first line of that label that has one, not nothing."""
    tails = F.split(body, label)
    values = F.transform(F.slice(tails, F.lit(2), F.size(tails)), lambda t: last_amount(F.substring(t, 1, 120)))
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != 0)), F.lit(0))


def budget_tables(acts: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, nth, year, scope, section, verdict, lines) of the budget tables of each act.

    The head of columns is the anchor: it says that this is a table and whose year it votes. Section and budget stand before
    it; a table that doesn't tell them goes on from the table before it of the same year. The voted budget is the last column,
    so the last sum of a line counts. ``verdict`` is "lu", or why a table is refused: another column follows the voted one
    (colonne_incertaine), no line was read (sans_montant), or nothing names the budget (budget_indetermine).
    """
    whole = once(acts, "whole", F.concat(plain(F.col(title)), F.lit(" "), plain(F.col(text)))).select(key, "whole").where(F.col("whole").rlike(HEAD))
    cut = whole.select(key, F.split("whole", HEAD).alias("pieces"), *[F.regexp_extract_all("whole", F.lit(HEAD), F.lit(g)).alias(n) for g, n in ((0, "heads"), (2, "years"))])
    stretches = F.transform("heads", lambda h, i: F.concat(F.get("pieces", i), h))
    tables = cut.select(key, "pieces", "years", stretches.alias("stretches"), F.explode(F.sequence(F.lit(0), F.size("heads") - 1)).alias("nth"))
    before = F.right(F.concat(F.array_join(F.slice("stretches", F.lit(1), F.col("nth")), ""), F.get("pieces", F.col("nth"))), F.lit(BEFORE))
    tables = tables.select(key, "nth", F.get("years", F.col("nth")).cast("int").alias("year"), before.alias("before"), F.get("pieces", F.col("nth") + 1).alias("body"))
    last = lambda text, pattern: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))
    tables = tables.select(key, "nth", "year", "body", budget_name(last(F.col("before"), NAMED)).alias("scope"), last(F.right("before", F.lit(BEFORE_SECTION)), SECTION).alias("section"))
    order = Window.partitionBy(key).orderBy("nth")
    tables = tables.withColumn("turn", F.coalesce((F.col("year") != F.lag("year").over(order)).cast("int"), F.lit(0))).withColumn("run", F.sum("turn").over(order))
    far = Window.partitionBy(key, "run").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    tables = tables.withColumns({c: F.last(c, ignorenulls=True).over(far) for c in ("scope", "section")})

    balance = F.when(F.col("section").isNotNull(), _found(F.col("body"), BALANCE))
    called = F.when(F.col("section") == "fonctionnement", BALANCES["fonctionnement"]).otherwise(BALANCES["investissement"])
    each = [F.struct(F.lit(name).alias("label"), _found(F.col("body"), pattern).alias("value")) for name, pattern in LABELS.items()]
    lines = F.filter(F.array(*each, F.struct(called.alias("label"), balance.alias("value"))), lambda e: e["value"].isNotNull())
    rows = tables.withColumn("lines", lines)
    doubtful = F.substring("body", 1, AFTER).rlike(LATER_COLUMN)
    verdict = F.when(doubtful, "colonne_incertaine").when(F.size("lines") == 0, "sans_montant").when(F.col("scope").isNull(), "budget_indetermine").otherwise("lu")
    return rows.select(key, "nth", "year", "scope", "section", verdict.alias("verdict"), F.when(verdict == "lu", F.col("lines")).otherwise(F.slice("lines", 1, 0)).alias("lines"))


def voted_budgets(acts: DataFrame, key: str, date: str, title: str, text: str) -> DataFrame:
    """(year, scope, label, value, key): the budget as it was voted last; a later decision revises an earlier one."""
    lines = budget_tables(acts, key, title, text).join(acts.select(key, date), key).select(key, date, "nth", "year", "scope", F.inline("lines"))
    latest = first_per_key(lines, ["year", "scope", "label"], F.desc_nulls_last(date), F.desc(key), F.desc("nth"))
    return latest.select("year", "scope", "label", "value", key)
