"""Extraction from text: contacts, amounts in context, votes, HTML to text, chunks, citations, redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.functions.numbers import amount, plausible
from civicmill.functions.text import normalise

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+33 ?|0)[1-9](?:[ .-]?[0-9]{2}){4}"
AMOUNT = r"([0-9][0-9   .]*(?:,[0-9]{1,2})?) ?(?:€|euros)"


def found_all(text: Column, pattern: str, most: int | None = None, group: int = 0) -> Column:
    """Distinct matches in order."""
    every = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)))
    return F.slice(every, 1, most) if most else every


def amounts_in(text: Column) -> Column:
    """Plausible amounts of a text, in order."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(AMOUNT), F.lit(1))
    return F.filter(F.transform(raw, lambda a: amount(F.replace(a, F.lit("."), F.lit("")))), plausible)


#: How minutes word a ballot and the amounts of a decision.
BALLOT = r"(?i)\d+\s+voix\s+[«\"“”]?\s*pour(?:\s*[»\"“”])?(?:\s+et\s+\d+\s+(?:abstention|contre)s?){0,2}"
IN_EUROS = r"[0-9][0-9\s\x{00A0}]*(?:[,.][0-9]{2,3})?\s*€"


def vote(text: Column) -> Column:
    """struct(pour, contre, abstentions, unanimite) of a decision's text, null where it tells of no vote.

    Unanimity counts only where no ballot is told. Votes against and abstentions count with and without quotes around "pour".
    """
    ballot = F.regexp_extract(F.coalesce(text, F.lit("")), BALLOT, 0)
    count = lambda word: F.coalesce(F.regexp_extract(ballot, rf"(?i)(\d+)\s+{word}", 1).try_cast("int"), F.lit(0))
    told = ballot != ""
    result = F.struct(F.when(told, count("voix")).alias("pour"), count("contre").alias("contre"), count("abstention").alias("abstentions"), (~told).alias("unanimite"))
    return F.when(told | F.coalesce(text.rlike("(?i)à l.unanimité"), F.lit(False)), result)


def places_of(text: Column, pattern: str) -> Column:
    """array<struct(start, hit)> of all matches, ``start`` from 0, without leaving the JVM."""
    whole = F.coalesce(text, F.lit(""))
    hits, gaps = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), F.split(whole, pattern, -1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,hit:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), x["hit"].alias("hit")))).alias("out"))

    return F.aggregate(F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap")), none, step, lambda s: s["out"])


def around(text: Column, place: Column, before: int, after: int) -> Column:
    """A match with its surroundings, white space squeezed."""
    begin = F.greatest(place["start"] - before, F.lit(0))
    cut = F.substring(text, begin + 1, place["start"] - begin + F.length(place["hit"]) + after)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def amounts_in_context(docs: DataFrame, key: str, text: str, before: int = 80, after: int = 40) -> DataFrame:
    """(key, at, value, context) of each positive amount in euros."""
    found = docs.select(key, text, F.posexplode(places_of(F.col(text), IN_EUROS)).alias("at", "place"))
    value = F.replace(F.regexp_replace("place.hit", r"[\s\x{00A0}€]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return found.select(key, "at", value.alias("value"), around(F.col(text), F.col("place"), before, after).alias("context")).where("value > 0")


def mentions(pages: DataFrame, key: str, page: str, text: str, names: str, themes: str, context: int = 100) -> DataFrame:
    """(key, page, term, excerpt): matches of ``names`` on each page, and of ``themes`` on pages that hold a name."""
    rows = pages.select(key, page, text, places_of(F.col(text), names).alias("named")).where(F.size("named") > 0)
    tagged = lambda places, tag: F.transform(places, lambda p: F.struct(F.concat(F.lit(tag), F.lower(p["hit"])).alias("term"), p.alias("place")))
    hits = rows.select(key, page, text, F.explode(F.concat(tagged(F.col("named"), ""), tagged(places_of(F.col(text), themes), "THEME:"))).alias("hit"))
    return hits.select(key, page, "hit.term", around(F.col(text), F.col("hit.place"), context, context).alias("excerpt"))


def in_context(text: Column, pattern: str, most: int, before: int = 80, after: int = 200) -> Column:
    """The first ``most`` places of a pattern with what stands around them; places inside an excerpt are not told again."""
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?is).{{0,{before}}}(?:{pattern}).{{0,{after}}}"), F.lit(0)), 1, most)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, blocks and cells become line ends and tabs, entities letters."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</t[dh]\s*>", "\t")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/article|/section|/title)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, letter in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[  ]+", " "), r"\s*\n\s*", "\n"))


#: Letters that a task holds of slices before it gives them out.
HELD = 4_000_000


def _chunked(batches: Iterator[pa.RecordBatch], key: str, size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, given out whenever ``HELD`` letters are together: a text at a time is a Python object."""
    for batch in batches:
        kind = pa.schema([(key, batch.schema.field(key).type), ("n", pa.int32()), ("start", pa.int32()), ("chunk", pa.string())])
        rows, held = [], 0
        for k, text in zip(batch[key], batch["text"], strict=True):
            for n, (begin, part) in enumerate(chunks(text.as_py() or "", size, overlap)):
                rows.append((k.as_py(), n, begin, part))
                held += len(part)
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)


def chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, slice): each slice ends at the last line end of its second half, if there is one; slices overlap."""
    begin = 0
    while begin < len(text):
        end = min(begin + size, len(text))
        if end < len(text) and (cut := text.rfind("\n", begin + size // 2, end)) > begin:
            end = cut
        yield begin, text[begin:end]
        if end >= len(text):
            return
        begin = max(end - overlap, begin + 1)


def chunked(docs: DataFrame, key: str, text: str, size: int = 10_000, overlap: int = 1_000) -> DataFrame:
    """(key, n, start, chunk): where a slice ends depends on the one before, so this is an Arrow function per row."""
    rows = docs.select(key, F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _chunked(batches, key, size, overlap), f"{key} {kind}, n int, start int, chunk string")


def cited(text: Column, quote: Column, shortest: int = 15) -> Column:
    """Whether a quotation of some length stands in the text, both flattened."""
    flat = normalise(quote)
    return F.coalesce((F.length(flat) >= shortest) & F.contains(normalise(text), flat), F.lit(False))


def names_pattern(names: list[str]) -> str:
    """An alternation of whole names, longest first, so that a name inside another does not hide it."""
    return r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)) if n) + r")(?![\p{L}\p{N}])"


def redacted(text: Column, names: list[str], mask: str = "[…]") -> Column:
    """``text`` without the names. The list is one that people keep (some thousands), not a table."""
    return F.regexp_replace(text, names_pattern(names), mask) if names else text


def repeated_lines(docs: DataFrame, key: str, text: str, least: int = 4, longest: int = 60) -> DataFrame:
    """(key, line, n) of short lines that recur in a document: running heads and feet."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line")).select(key, F.trim("line").alias("line"))
    short = lines.where((F.col("line") != "") & (F.length("line") < longest))
    return short.groupBy(key, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)

#: Fixed value: how minutes word a subsidy; beneficiary and amount are its groups.
SUBSIDY = (
    r"(?i)attribuer\s+(?:à|au|aux)\s+(?:l['’]|la\s+|le\s+)?(.{2,55}?)\s+une\s+(?:subvention|avance[^.]{0,20}?subvention|aide)\s+"
    r"(?:exceptionnelle\s+)?(?:par anticipation\s+)?de\s+([\d\s\x{00A0}\x{202F}]{2,12})\s*€"
)


def subsidies(acts: DataFrame, key: str, date: str, text: str, most: int = 200_000) -> DataFrame:
    """(year, beneficiary, amount, key): subsidies that dated texts grant, the first act of each (year, beneficiary).

    Of one act the first mention counts; amounts of nothing or over ``most`` are left out before.
    """
    names, sums = (F.regexp_extract_all(F.col(text), F.lit(SUBSIDY), F.lit(g)) for g in (1, 2))
    dated = acts.where(F.col(date).isNotNull()).select(F.year(date).alias("year"), F.col(key), F.posexplode(F.arrays_zip(names.alias("name"), sums.alias("sum"))).alias("at", "hit"))
    name = F.regexp_replace(F.regexp_replace(F.col("hit.name"), r"\s+", " "), "^[ ,.]+|[ ,.]+$", "")
    found = dated.select("year", key, "at", name.alias("beneficiary"), F.regexp_replace("hit.sum", "[^0-9]", "").cast("long").alias("amount")).where(F.col("amount").between(1, most))
    first = found.groupBy("year", F.lower("beneficiary").alias("who")).agg(F.min_by(F.struct("beneficiary", "amount", key), F.struct(key, "at")).alias("first"))
    return first.select("year", "first.*")


#: How tariffs word leases, and words that name a place rather than who rents it.
LEASE_TITLE = r"(?i)LOYERS?|BAIL|BAUX|TARIFS?\s+LOCATION|LOCATION\s+"
LEASE_LINE = r"^(.{6,90}?)\s+(\d{1,3}(?:[\s\x{00A0}]\d{3})+|\d{1,7})[.,](\d{2})\s*$"
LEASE_NOISE = r"(?i)^(?:total|indice|soit|montant)"
PER_MONTH = r"(?i)^\s*(?:PAR\s+MOIS|/\s*mois|mensuel)\s*$"
PLACES = (
    "appart", "appartement", "atelier", "bureau", "cave", "chambre", "dependance", "dépendance", "etage", "étage", "garage",
    "grange", "hangar", "local", "locaux", "logement", "maison", "parking", "rez", "salle", "studio", "terrain", "terrasse",
    "terrasses", "villa", "villas", "gauche", "droite",
)


def leases(acts: DataFrame, key: str, date: str, title: str, text: str, most: float = 100_000) -> DataFrame:
    """(year, place, tenant, amount, monthly, key): rents that dated tariffs list, the first of each (year, place).

    Rents after a line "per month" are monthly. What follows the last dash is the tenant, unless it opens with a word for
    a place: a rent must never be laid at the wrong name, so the tenant is then blank.
    """
    listed = acts.where(F.col(date).isNotNull() & F.col(title).rlike(LEASE_TITLE))
    lines = listed.select(F.year(date).alias("year"), F.col(key), F.posexplode(F.split(text, r"\r?\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    monthly = F.max(F.col("line").rlike(PER_MONTH)).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumn("monthly", monthly).where(F.col("line").rlike(LEASE_LINE) & ~F.col("line").rlike(LEASE_NOISE))
    part = lambda k: F.regexp_extract("line", LEASE_LINE, k)
    place = F.regexp_replace(F.regexp_replace(part(1), r"\s+", " "), "^[ –-]+|[ –-]+$", "")
    amount = F.concat(F.regexp_replace(part(2), "[^0-9]", ""), F.lit("."), part(3)).cast("double")
    rows = rows.select("year", key, "at", "monthly", place.alias("place"), amount.alias("amount")).where((F.col("amount") > 0) & (F.col("amount") <= most))
    last = F.when(F.col("place").rlike(" [–-] "), F.trim(F.element_at(F.split("place", " [–-] "), -1)))
    opens = F.get(F.split(F.lower(last), r"[^\p{L}\p{N}_]+"), F.lit(0))
    tenant = F.when((F.length(last) >= 3) & ~opens.isin(*PLACES), last).otherwise("")
    first = rows.withColumn("tenant", tenant).groupBy("year", F.lower("place").alias("_place")).agg(F.min_by(F.struct("place", "tenant", "amount", "monthly", key), F.struct(key, "at")).alias("first"))
    return first.select("year", "first.*")


#: Fixed value: a title and the one or two capitalised words after it.
TITLED = r"\b(?:MM?\.|Mmes?)\s+(?:de\s+)?[A-ZÀÂÇÉÈÊËÎÏÔÙÛÜ][A-ZÀ-Ÿa-zà-ÿ-]+(?:\s+(?:de\s+)?[A-ZÀÂÇÉÈÊËÎÏÔÙÛÜ][A-ZÀ-Ÿa-zà-ÿ-]+)?"


def attendance(minutes: DataFrame, key: str, text: str, head: int = 35) -> DataFrame:
    """(key, block, at, name): who the head of minutes lists as present or absent, and its lines on proxies.

    A block runs from its heading to the next one or to a ruled line. Minutes list attendance in their first ``head``
    lines; a name told later is no attendance.
    """
    lines = minutes.select(key, F.posexplode(F.slice(F.split(text, "\n"), 1, head)).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"\x{00A0}", " ")))
    says = lambda pattern: F.col("line").rlike(pattern)
    heading = F.when(says(r"(?iu)présents?\s*:"), "presents").when(says(r"(?i)absents?\s*:"), "absents")
    proxy = heading.isNull() & says(r"(?i)donne\s+pouvoir")
    mark = F.coalesce(heading, F.when(~proxy & says("^_{3,}$"), ""))
    block = F.last(mark, ignorenulls=True).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.select(key, "at", "line", F.when(proxy, "pouvoirs").otherwise(block).alias("block")).where("block <> ''")
    names = F.when(F.col("block") == "pouvoirs", F.array("line")).otherwise(F.regexp_extract_all("line", F.lit(TITLED), F.lit(0)))
    return rows.select(key, "block", "at", F.explode(names).alias("name"))
