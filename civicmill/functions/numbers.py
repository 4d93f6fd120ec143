"""Amounts, rates, numerals, dates and coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicmill.functions.text import fold

#: French month names, folded.
MONTHS = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
#: Roman numerals by size.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: Constants of the Lambert-93 projection.
L93_N, L93_C, L93_XS, L93_YS, L93_LON0, L93_E = 0.7256077650532670, 11754255.426096, 700000.0, 12655612.049876, math.radians(3.0), 0.08181919106


def amount(text: Column) -> Column:
    """A French amount as double: blanks of any kind between thousands, a decimal comma, € and % dropped; else null."""
    bare = F.regexp_replace(text, "[\\s   €%]", "")
    return F.regexp_replace(bare, ",", ".").try_cast("double")


def plausible(value: Column, least: float = 10, most: float = 50_000_000) -> Column:
    return F.coalesce(value.between(least, most), F.lit(False))


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Per cent, null for an empty whole."""
    return F.round(100.0 * part / F.nullif(whole, F.lit(0)), digits)


def price_per_m2(price: Column, land: Column, built: Column) -> Column:
    """By land where there is some, else by built surface."""
    return F.round(price / F.nullif(F.coalesce(land, built), F.lit(0)), 1)


def exposure(links: Column, flows: Column, most: int = 12) -> Column:
    """Links count up to ``most``, flows twice; an unknown count makes the score unknown."""
    capped = F.when(links.isNotNull() & flows.isNotNull(), F.least(links, F.lit(most)))
    return capped + 2 * flows


def roman(text: Column) -> Column:
    """Value of a Roman numeral; null for anything else."""
    digits = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv]), c))
    step = F.transform(digits, lambda v, i: F.when(F.coalesce(F.get(digits, i + 1), F.lit(0)) > v, -v).otherwise(v))
    return F.when(F.upper(text).rlike("^[IVXLCDM]+$"), F.aggregate(step, F.lit(0), lambda s, v: s + v))


def iso_date(text: Column) -> Column:
    """An ISO date, a numeric French date or one with the month's name, "1er" included; two-digit years are refused."""
    t = F.lower(fold(text))
    part = lambda k: F.regexp_extract(t, r"\b(\d{1,2})(?:er)? (" + "|".join(MONTHS) + r") (\d{4})\b", k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(2))
    named = F.try_to_date(F.format_string("%s-%02d-%02d", part(3), month, part(1).try_cast("int")), "yyyy-MM-dd")
    num = lambda k: F.regexp_extract(t, r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b", k)
    numeric = F.try_to_date(F.format_string("%s-%02d-%02d", num(3), num(2).try_cast("int"), num(1).try_cast("int")), "yyyy-MM-dd")
    iso = F.try_to_date(F.regexp_extract(t, r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")
    return F.coalesce(iso, F.when(part(3) != "", named), F.when(num(3) != "", numeric))


def event_date(title: Column, content: Column, published: Column, before: int = 1, after: int = 2, read: int = 1200) -> Column:
    """struct(date, origin) of an announcement: the date its title names, else the start of its content, else publication.

    A date counts from ``before`` years ahead of publication to ``after`` years past it. A day without a year is in the
    year of publication, or in the next one if its month is over by more than a month. Days that no month has are passed
    over.
    """
    named = []
    for text in (title, F.substring(content, 1, read)):
        plain = F.lower(fold(text))
        part = lambda k, plain=plain: F.regexp_extract(plain, rf"\b(\d{{1,2}})(?:er)? ({'|'.join(MONTHS)})\b(?! \d{{4}})", k)
        month = F.array_position(F.array(*map(F.lit, MONTHS)), part(2))
        year = F.year(published) + F.when(month < F.month(published) - 1, 1).otherwise(0)
        bare = F.when(part(2) != "", F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, part(1).try_cast("int")), "yyyy-MM-dd"))
        for found in (iso_date(text), bare):
            named.append(F.when(F.year(found).between(F.year(published) - before, F.year(published) + after), found))
    date = F.coalesce(*named)
    return F.struct(F.coalesce(date, published).alias("date"), F.when(date.isNotNull(), "texte").otherwise("publication").alias("origin"))


def placeholder_date(date: Column) -> Column:
    """Dates that forms are filled with by default."""
    return F.coalesce(date.rlike(r"^1900|-(?:12-25|01-01)$"), F.lit(False))


def lambert93(lat: Column, lng: Column) -> tuple[Column, Column]:
    """(x, y) in metres of WGS84 degrees."""
    phi, lam = F.radians(lat), F.radians(lng)
    es = L93_E * F.sin(phi)
    iso = F.log(F.tan(math.pi / 4 + phi / 2) * F.pow((1 - es) / (1 + es), F.lit(L93_E / 2)))
    r = L93_C * F.exp(-L93_N * iso)
    turn = L93_N * (lam - L93_LON0)
    return L93_XS + r * F.sin(turn), L93_YS - r * F.cos(turn)


def wgs84(x: Column, y: Column, steps: int = 6) -> tuple[Column, Column]:
    """(lat, lng) in degrees of Lambert-93 metres; the latitude by a fixed number of iterations, in columns."""
    dx, dy = x - L93_XS, y - L93_YS
    r, turn = F.sqrt(dx * dx + dy * dy), F.atan(dx / -dy)
    iso = -F.log(r / L93_C) / L93_N
    phi = 2 * F.atan(F.exp(iso)) - math.pi / 2
    for _ in range(steps):
        es = L93_E * F.sin(phi)
        phi = 2 * F.atan(F.pow((1 + es) / (1 - es), F.lit(L93_E / 2)) * F.exp(iso)) - math.pi / 2
    return F.degrees(phi), F.degrees(turn / L93_N + L93_LON0)
