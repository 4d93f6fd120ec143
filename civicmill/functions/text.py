"""Text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters and what they fold to; ligatures open into two letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
LIGATURES = {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it: an array of one, transformed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that filters above it don't compute again: an exploded array of one keeps them from being pushed below."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def fold(text: Column) -> Column:
    """Accents dropped, composed or combining; ligatures opened. A text of as many bytes as letters has none."""
    out = F.translate(text, ACCENTED, FOLDED)
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(out, r"\p{Mn}", ""))


def normalise(text: Column, keep: str = "", case: str = "lower", separator: str = " ", folded: bool = False) -> Column:
    """One parametrised form of a name: folded (unless it is), cased, and everything but letters, digits and ``keep`` made a separator."""
    plain = text if folded else fold(text)
    cased = F.lower(plain) if case == "lower" else F.upper(plain)
    squeezed = F.regexp_replace(cased, rf"[^a-zA-Z0-9{keep}]+", separator)
    return F.trim(squeezed) if separator == " " else squeezed


def key_words(text: Column, stop: tuple[str, ...] = (), shortest: int = 4) -> Column:
    """Distinct words of at least ``shortest`` letters that are not stop words, sorted."""
    words = F.array_distinct(F.split(normalise(text), " "))
    kept = F.filter(words, lambda w: F.length(w) >= shortest)
    return F.array_sort(F.array_except(kept, F.array(*map(F.lit, stop))) if stop else kept)


def slug(text: Column, most: int = 60) -> Column:
    """URL-safe form of a title."""
    return F.regexp_replace(F.substring(F.regexp_replace(normalise(text), " ", "-"), 1, most), "-+$", "")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


#: Particles of family names, which make no name on their own.
PARTICLES = ("de", "du", "des", "le", "la", "von", "van", "d", "l")


def plausible_name(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Two to five words without digits and stop words, at least two of them besides particles, each of two letters."""
    words = F.split(normalise(text), " ")
    full = F.filter(words, lambda w: ~w.isin(*PARTICLES))
    fine = F.size(words).between(2, 5) & ~text.rlike("[0-9]") & (F.size(full) >= 2) & F.forall(full, lambda w: F.length(w) >= 2)
    return F.coalesce(fine & ~F.arrays_overlap(words, F.array(*map(F.lit, stop))) if stop else fine, F.lit(False))


def clean_label(text: Column) -> Column:
    """A name or address fit for display, its words and case untouched.

    Quotes go, an elision rejoins its word, blanks before points and commas go, a name written twice over is told once
    (however its halves are spelt), and a closing full stop goes unless it ends an acronym or an ellipsis. Null is blank.
    """
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "[\"«»“”]", " ")
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}_])([\p{L}\p{N}_]{1,2}['’])\s+", "$1")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+([,.])", "$1"), r"\s+", " "))
    words = F.split(out, " ")
    half = F.floor(F.size(words) / 2).cast("int")
    first, second = F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, half), " ")
    bones = lambda part: F.replace(normalise(part), F.lit(" "), F.lit(""))
    twice = (F.size(words) >= 4) & (F.size(words) % 2 == 0) & (bones(first) != "") & (bones(first) == bones(second))
    out = F.when(twice, first).otherwise(out)
    return F.when(out.rlike(r"\.\.$|(?:^|\.)\p{L}\.$"), out).otherwise(F.rtrim(F.regexp_replace(out, r"\.$", "")))


def safe_url(url: Column) -> Column:
    """The address without white space around it; null if it is blank or would publish a path of somebody's machine."""
    bare = F.regexp_replace(url, r"^[\s\p{Z}\p{Cc}]+|[\s\p{Z}\p{Cc}]+$", "")
    return F.when((bare != "") & ~F.lower(bare).rlike(r"^(file:|/users/|/home/|[a-z]:\\)"), bare)


def host_of(url: Column) -> Column:
    """Lower-cased host without "www."."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def denied(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of ``domains`` or below one."""
    out = host.isin(*domains)
    for d in domains:
        out |= host.endswith(f".{d}")
    return out


#: Structural words that tell no public buyer from another.
STRUCTURAL = (
    "cc", "ca", "cu", "communaute", "communautes", "commune", "communes", "mairie", "mairies", "ville", "villes",
    "de", "du", "des", "d", "la", "le", "les", "l",
)

#: Titles that say nothing outside their document.
EMPTY_TITLES = (
    "questions diverses", "divers", "informations diverses", "informations et questions diverses", "point divers",
    "questions et informations diverses", "(sans titre)",
)


def buyer_key(name: Column) -> Column:
    """A buyer's name without accents, case, punctuation and structural words, for comparison by prefix."""
    plain = F.lower(fold(F.coalesce(name, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(plain, rf"\b(?:{'|'.join(STRUCTURAL)})\b", " "), "[^a-z0-9]+", "")


def buyer_of(name: Column, owners: list[tuple[str, str]]) -> Column:
    """The id of the first of ``owners`` (key of the name, id) whose key opens the buyer's key, else null.

    A suffix ("service eau") is the owner still; a foreign prefix ("syndicat de") is somebody else.
    """
    key = buyer_key(name)
    return F.coalesce(*[F.when(key.startswith(k), F.lit(i)) for k, i in owners], F.lit(None).cast("string"))


def event_title(title: Column) -> Column:
    """A title without the archive's prefix of council and date, white space squeezed."""
    rest = F.regexp_replace(F.coalesce(title, F.lit("")), r"^CM\s+du\s+\d{4}-\d{2}-\d{2}\s*[-—–]\s*", "")
    return F.trim(F.regexp_replace(rest, r"\s+", " "))


def says_nothing(title: Column) -> Column:
    return F.lower(event_title(title)).isin("", *EMPTY_TITLES)


def birth_name(name: Column) -> tuple[Column, Column]:
    """(name in use, name at birth) of "Name (BIRTH NAME)"; nulls without brackets at the end."""
    pattern = r"^(.*?)\s*\(([^)]+)\)\s*$"
    there = name.rlike(pattern)
    return F.when(there, F.trim(F.regexp_extract(name, pattern, 1))), F.when(there, F.trim(F.regexp_extract(name, pattern, 2)))


def surnames(name: Column) -> Column:
    """Words of over two letters written in capitals, brackets left out."""
    words = F.split(F.trim(F.regexp_replace(name, r"\([^)]*\)", "")), r"\s+")
    return F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 2))


def rectified(text: Column, corrections: dict[str, str]) -> Column:
    """Declared corrections, each as it is written and in capitals without accents."""
    for wrong, right in corrections.items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
        text = F.replace(text, F.upper(fold(F.lit(wrong))), F.upper(fold(F.lit(right))))
    return text


#: Words that join others in a name, elided words, and acronyms that stay in capitals.
LINKS = ("DE", "DES", "DU", "D", "LA", "LE", "LES", "L", "ET", "EN", "AU", "AUX", "POUR", "SUR", "PAR", "UN", "UNE", "A", "AVEC", "SOUS", "SANS", "OU")
ELIDED = ("D", "L", "N", "S", "C", "J", "QU")
ACRONYMS = (
    "ADMR", "AFPPA", "ANS", "APE", "ASART", "ASL", "ATSEM", "BOAMP", "CAC", "CAF", "CCAS", "CC", "CD30", "CDG", "CERISE", "CIAS", "CLIC", "CNRS", "CVN", "DDFIP", "DETR", "DGCL",
    "DGF", "DSP", "EHPAD", "EPCI", "EPI", "ESAT", "EVEN", "FCTVA", "FSC", "MJC", "MSA", "OFGL", "ONF", "PLU", "PNC", "RAM", "RNA", "RPI", "SAS", "SARL", "SCI", "SCIC", "SCOP",
    "SIVU", "SPANC", "SYMTOMA", "UFOLEP", "USEP", "USPOP", "VTT", "ZAD",
)


def human_case(name: Column) -> Column:
    """A register's name in capitals as people write it; a name in mixed case was settled by somebody and stays.

    Acronyms stay, known ones, what has two letters or no vowel, and a word alone in brackets; words that join others are
    small but for the first; an elision is small and what follows it is not. Null is blank.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", ""), r"\.+$", "")

    def block(word: Column, first: Column) -> Column:
        link = F.when(first, F.initcap(word)).otherwise(F.lower(word))
        short = (F.length(word) <= 2) | ~word.rlike("[AEIOUY]")
        return F.when(word.isin(*ACRONYMS), word).when(word.isin(*LINKS), link).when(short, word).otherwise(F.initcap(word))

    def rewritten(word: Column, i: Column) -> Column:
        before = F.regexp_extract(word, "^[(«\"']*", 0)
        rest = F.substr(word, F.length(before) + 1)
        after = F.regexp_extract(rest, "[)».,;:\"]*$", 0)
        core = F.substr(rest, F.lit(1), F.length(rest) - F.length(after))
        parts, first = F.split(core, "['’]"), i == 0
        head, tail, mark = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.regexp_extract(core, "['’]", 0)
        opened = F.when(head.isin(*ELIDED), F.when(first, F.initcap(head)).otherwise(F.lower(head))).otherwise(block(head, first))
        spelt = F.when(F.size(parts) == 2, F.concat(opened, mark, block(tail, F.lit(False)))).otherwise(block(core, first))
        alone = F.contains(before, F.lit("(")) & F.contains(after, F.lit(")"))
        return F.when((core == "") | alone, word).otherwise(F.concat(before, spelt, after))

    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
    return F.when((bare == "") | (bare != F.upper(bare)), bare).otherwise(F.array_join(F.transform(words, rewritten), " "))


def _compared(text: Column) -> Column:
    plain = F.regexp_replace(fold(F.translate(F.coalesce(text, F.lit("")), "’‘—–", "")), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.translate(F.upper(plain), "-", " "), r"\s+", " "))


def flow_label(text: Column, actor: Column, amount_shown: Column) -> Column:
    """The label of a flow without what its line shows anyway: the actor's name, as its words in any order, and the amount at the end.

    Of the parts between dashes those that say nothing but the actor go, unless nothing would be left; a part that opens
    with the name and goes on in brackets keeps the brackets. Null is blank.
    """
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    tokens = lambda compared: F.filter(F.split(F.replace(compared, F.lit("'"), F.lit(" ")), r"\s+"), lambda w: F.length(w) >= 2)
    rest = lambda p: F.trim(F.substr(F.trim(p), F.length(actor) + 1))

    def without_actor(label: Column, target: Column, own: Column, dash: str) -> Column:
        says = lambda p: bound(_compared(p), lambda c: (c != target) & ~bound(tokens(c), lambda t: (F.size(t) > 0) & (F.size(F.array_except(t, own)) == 0)))
        kept = lambda p: F.when(rest(p).startswith("(") & _compared(p).startswith(F.concat(target, F.lit(" "))), rest(p)).otherwise(p)
        told = lambda parts: bound(F.transform(F.filter(parts, says), kept), lambda t: F.when(F.size(t) > 0, F.array_join(t, dash)).otherwise(label))
        return bound(F.split(label, dash), lambda parts: F.when(F.size(parts) > 1, told(parts)).otherwise(label))

    def without(label: Column, target: Column, own: Column, dashes: tuple[str, ...]) -> Column:
        return bound(without_actor(label, target, own, dashes[0]), lambda rest: without(rest, target, own, dashes[1:])) if dashes else label

    named = bound(_compared(actor), lambda target: bound(tokens(target), lambda own: bound(out, lambda label: without(label, target, own, (" — ", " – ", " - ")))))
    out = F.when(F.coalesce(actor, F.lit("")) != "", named).otherwise(out)
    out = F.when(amount_shown.isNotNull(), F.regexp_replace(out, r"\s*[—–-]\s*[\d \x{00A0}\x{202F}]+(?:[.,]\d+)?\s*€\s*$", "")).otherwise(out)
    return F.regexp_replace(out, "^[ —–-]+|[ —–-]+$", "")
