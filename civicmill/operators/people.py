"""People in texts: who leads an association, and who sits on a committee."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.functions.text import fold, once, plausible_name

#: Roles as texts word them, longer ones before those they open with, and the relation each stands for.
ROLES = {
    "vice-présidente": "membre_bureau", "vice-président": "membre_bureau", "vice-presidente": "membre_bureau", "vice-president": "membre_bureau",
    "co-présidente": "président", "co-président": "président", "présidente": "président", "président": "président", "presidente": "président", "president": "président",
    "présidée par": "président", "présidé par": "président", "dirigée par": "dirigeant", "dirigé par": "dirigeant",
    "trésorière": "trésorier", "trésorier": "trésorier", "tresoriere": "trésorier", "tresorier": "trésorier",
    "secrétaire générale": "secrétaire", "secrétaire général": "secrétaire", "secrétaire": "secrétaire", "secretaire": "secrétaire",
    "directrice": "dirigeant", "directeur": "dirigeant", "gérante": "gérant", "gérant": "gérant",
    "responsable": "responsable", "fondatrice": "dirigeant", "fondateur": "dirigeant",
}
#: Words that follow a role and are no name, and words that open a sentence before one.
NO_NAMES = (
    "association", "club", "comite", "bureau", "conseil", "administration", "membres", "membre", "contact", "contacts", "mairie", "commune", "seance",
    "reunion", "ordre", "jour", "statuts", "elu", "elue", "sortant", "sortante", "adjoint", "maire", "tresorerie", "secretariat", "equipe", "accueil",
    "horaires", "adhesion", "cotisation", "nous", "vous", "notre", "site",
)
OPENERS = r"(?i)^(?:Pour|Avec|Dans|Depuis|Notre|Nos|Votre|Vos|Cette|Ce|Les|Le|La|Un|Une|Contacter|Contact|Voir|Lire|Suivez|Merci|Bonjour|Ici|Tous|Toute)\s+"
CIVILITY = r"(?i)^(?:M\.|MM\.|Mme|Mmes|Mlle|Monsieur|Madame|Mademoiselle)\s+"

#: A name is capitalised words and particles; what stands after a role, and what before one.
_PARTICLE = r"(?:de|du|des|le|la|von|van)\b"
_WORD = r"[A-ZÀ-Ý][\w'’\-]+"
_NAME = rf"(?P<name>(?:{_WORD}|{_PARTICLE}\s)(?:\s+(?:{_WORD}|{_PARTICLE}))*)"
_ROLE = rf"(?P<role>(?i:{'|'.join(map(re.escape, ROLES))}))"
RIGHT = re.compile(rf"\b{_ROLE}\b(?:\s*:\s*|\s+)(?:(?i:M\.|Mme|Mlle|Monsieur|Madame))?\s*{_NAME}")
LEFT = re.compile(rf"{_NAME}\s*[,(–—-]\s*(?i:le\s+|la\s+)?{_ROLE}\b")

SPAN = "array<struct<start int, end int, name string, role string>>"


def _spans(pattern: re.Pattern):
    """Where a pattern matches: SQL finds matches, but not their places."""

    @F.pandas_udf(SPAN)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "name": m["name"], "role": m["role"]} for m in pattern.finditer(t or "")])

    return found


def clean_name(name: Column) -> Column:
    """A name without the civility and the words of a sentence that stuck to it."""
    out = F.regexp_replace(F.trim(name), CIVILITY, "")
    for _ in range(3):
        out = F.regexp_replace(out, OPENERS, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def roles(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, role, relation, form, start, end): who holds which role, by the words beside the name.

    "Role: Name" is read first, and where it gives a name its span is reserved; "Name, role" counts outside those spans
    only, or a list of officers would give each the role of the next. Of one person in one relation the first hit counts,
    those of the first form before those of the second.
    """

    def hits(spans: Column, form: int) -> Column:
        made = F.transform(spans, lambda s: F.struct(F.lit(form).alias("form"), s["start"].alias("start"), s["end"].alias("end"), clean_name(s["name"]).alias("name"), F.lower(s["role"]).alias("role")))
        return F.filter(made, lambda s: plausible_name(s["name"], NO_NAMES))

    rows = texts.where(F.col(text).isNotNull()).select(key, _spans(RIGHT)(text).alias("right"), _spans(LEFT)(text).alias("left"))
    rows = rows.select(key, hits(F.col("right"), 0).alias("right"), hits(F.col("left"), 1).alias("left"))
    free = F.filter("left", lambda s: ~F.exists("right", lambda r: (s["start"] < r["end"]) & (s["end"] > r["start"])))
    found = rows.select(key, F.inline(F.concat("right", free)))
    relation = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("role"))
    found = found.withColumn("relation", F.coalesce(relation, F.lit("dirigeant")))
    person = F.regexp_replace(F.upper(fold(F.col("name"))), r"[-'\s]+", " ")
    first = found.groupBy(key, person.alias("_person"), "relation").agg(F.min(F.struct("form", "start", "end", "name", "role")).alias("first"))
    return first.select(key, "first.name", "first.role", "relation", F.when(F.col("first.form") == 0, "role_name").otherwise("name_role").alias("form"), "first.start", "first.end")


#: How minutes write the composition of committees.
LEADS = r"(?iu)^\s*Responsables?\s*:\s*(.+)$"
MEMBERS = r"(?iu)^\s*Membres?\s*:\s*(.+)$"
SPEECH = r"^\s*(?:M\.|Mme|MM\.|Mmes)\s+[A-ZÀ-Ÿ][^:]{0,40}:"
PAGE_NUMBER = r"^\s*\d{1,3}\s*$"
COMMITTEE_TITLE = r"^[^:]{4,90}:?$"
PROSE = r"[.!?]\s*$|^[^\p{L}\p{N}_]|\.\s+[A-ZÀ-Ÿ]"


def rejoined(text: Column) -> Column:
    """Names that a line's end cut in two put together again."""
    out = F.regexp_replace(text, r"-\s*\n\s*", "-")
    return F.regexp_replace(out, r"([A-ZÀ-Ÿ][a-zà-ÿ]+)\s*\n\s*([A-ZÀ-Ÿ]{2,})", "$1 $2")


def listed_names(fragment: Column) -> Column:
    """(name, note) of each entry of a list that holds a surname in capitals; brackets are the note."""
    entries = F.split(F.translate(fragment, "–—", "--"), r"\s*[,;]\s*|\s+-\s+")

    def entry(raw: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\s*\([^)]*\)", ""), r"\s+", " "), r"^[ .-]+|[ .-]+$", "")
        return F.struct(bare.alias("name"), F.trim(F.regexp_extract(raw, r"\(([^)]*)\)", 1)).alias("note"))

    return F.filter(F.transform(entries, entry), lambda e: e["name"].rlike("[A-ZÀ-Ÿ]{2,}"))


_BARE = r"^[ :–-]+|[ :–-]+$"


def committees(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, committee, role, name, note): who leads and who sits on each committee that a text composes.

    An automaton over the lines: a title is remembered, a line of leads or members opens a committee of that title, lines
    of names go on, another title closes it. Speech before the first committee opens the debate, after it ends the reading.
    A committee without a title is no composition. The state holds what was found, so a text costs its own length.
    """
    empty = F.array().cast("array<struct<name string, note string>>")

    def parsed(line: Column) -> Column:
        leads, members = line.rlike(LEADS), line.rlike(MEMBERS)
        kind = F.when((line == "") | line.rlike(PAGE_NUMBER), "blank").when(line.rlike(SPEECH), "speech").when(leads, "lead").when(members, "member").otherwise("other")
        names = F.when(leads, listed_names(F.regexp_extract(line, LEADS, 1))).when(members, listed_names(F.regexp_extract(line, MEMBERS, 1))).when(F.length(line) <= 2000, listed_names(line)).otherwise(empty)
        first = F.substring(line, 1, 1)
        goes_on = line.rlike(r"^\p{Lu}") & ~line.rlike("[a-zà-ÿ]{6,}")
        overflow = (F.lower(first) == first) & (F.upper(first) != first) & (F.length(line) <= 40) & ~F.contains(line, F.lit("."))
        return F.struct(
            line.alias("line"), kind.alias("kind"), names.alias("names"), line.rlike(COMMITTEE_TITLE).alias("titled"), line.rlike(PROSE).alias("prose"), goes_on.alias("goes_on"), overflow.alias("overflow")
        )

    found = "array<struct<nth int, committee string, role string, name string, note string>>"
    start = F.struct(F.lit("").alias("title"), F.lit(0).alias("nth"), F.lit(False).alias("open"), F.lit("").alias("called"), F.lit(0).alias("leads"), F.lit(0).alias("members"), F.lit(False).alias("over"), F.array().cast(found).alias("found"))

    def step(s: Column, line: Column) -> Column:
        kind, n = line["kind"], F.size(line["names"])
        listing = kind.isin("lead", "member")
        opens = listing & (~s["open"] | (s["members"] > 0) | ((kind == "lead") & (s["leads"] > 0)))
        held = s["open"] & (s["members"] > 0)
        more = (kind == "other") & held & line["titled"] & (n > 0) & line["goes_on"]
        titles = (kind == "other") & ~(held & ~line["titled"]) & ~more & ~line["prose"] & line["titled"]
        still = s["over"] | (kind == "blank")
        nth, called = F.when(opens, s["nth"] + 1).otherwise(s["nth"]), F.when(opens, s["title"]).otherwise(s["called"])
        role = F.when(kind == "lead", "lead").otherwise("member")
        entries = F.transform(line["names"], lambda e: F.struct(nth.alias("nth"), called.alias("committee"), role.alias("role"), e["name"].alias("name"), e["note"].alias("note")))
        title = F.when((s["title"] != "") & line["overflow"], F.regexp_replace(F.concat(s["title"], F.lit(" "), line["line"]), _BARE, "")).otherwise(F.regexp_replace(line["line"], _BARE, ""))
        speech = kind == "speech"
        fields = {
            "title": F.when(speech & (s["nth"] == 0), "").when(titles, title).otherwise(s["title"]),
            "nth": nth,
            "open": F.when(opens, True).when(titles, False).otherwise(s["open"]),
            "called": called,
            "leads": F.when(opens, 0).otherwise(s["leads"]) + F.when(kind == "lead", n).otherwise(0),
            "members": F.when(opens, 0).otherwise(s["members"]) + F.when((kind == "member") | more, n).otherwise(0),
            "over": s["over"] | (speech & (s["nth"] > 0)),
            "found": F.when(listing | more, F.concat(s["found"], entries)).otherwise(s["found"]),
        }
        return F.struct(*[F.when(still, s[name]).otherwise(value).alias(name) for name, value in fields.items()])

    bare = F.transform(F.split(rejoined(F.col(text)), r"\r?\n"), lambda raw: F.regexp_replace(raw, r"^\s+|\s+$", ""))
    lines = F.transform(bare, parsed)
    read = once(texts, text, F.col(text)).where(F.col(text).isNotNull()).select(key, lines.alias("lines")).select(key, F.aggregate("lines", start, step)["found"].alias("found"))
    return read.select(key, F.inline("found")).where("committee <> ''")
