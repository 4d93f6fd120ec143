"""JSON columns: tolerant parsing, extraction, mutation, natural keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNTS = "struct<montants:array<struct<montant:double,value:double>>>"


def parsed(text: Column, schema: str) -> Column:
    """Typed value, null for what is no JSON of that shape."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def truthy(text: Column, path: str) -> Column:
    """Whether a member is there and is not false, 0 or empty."""
    value = F.get_json_object(text, path)
    return value.isNotNull() & ~value.isin("false", "0", "")


def largest_amount(metadata: Column) -> Column:
    """The largest of an act's amounts, under either generation of keys."""
    return F.array_max(F.transform(parsed(metadata, AMOUNTS)["montants"], lambda m: F.coalesce(m["montant"], m["value"])))


def top_amounts(metadata: Column, k: int = 5, least: float = 10, most: float = 50_000_000) -> Column:
    """The ``k`` largest plausible amounts."""
    every = F.transform(parsed(metadata, AMOUNTS)["montants"], lambda m: F.coalesce(m["montant"], m["value"]))
    return F.slice(F.sort_array(F.filter(every, lambda v: v.between(least, most)), asc=False), 1, k)


def with_member(text: Column, key: str, value: Column) -> Column:
    """A flat object with a member set."""
    old = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, v: k != key), F.create_map(F.lit(key), value.cast("string"))))


def without_member(text: Column, key: str) -> Column:
    """A flat object with a member removed."""
    return F.to_json(F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: k != key))


def fingerprint(*parts: Column) -> Column:
    """16 hexadecimal digits over normalised fields, null ones left out."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)
