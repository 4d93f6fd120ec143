"""Data-quality rules: each gives (check, severity, ref), and a registry runs them together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.functions.text import normalise
from civicmill.operators.edges import doubled


def finding(rows: DataFrame, check: str, severity: str, ref: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), ref.cast("string").alias("ref"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str, check: str, ref: Column) -> DataFrame:
    """Rows whose key is set and stands for nothing."""
    p = parent.select(F.col(parent_key).alias("_p"))
    return finding(child.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_p"), "left_anti"), check, "error", ref)


def self_loops(edges: DataFrame, check: str = "self_loop") -> DataFrame:
    return finding(edges.where("from_id = to_id"), check, "error", F.col("id"))


def duplicates(rows: DataFrame, keys: list[Column], check: str) -> DataFrame:
    """A finding per key that several rows bear."""
    grouped = rows.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n")).where("n > 1")
    named = F.concat_ws(":", *[F.col(f"k{i}").cast("string") for i in range(len(keys))])
    return finding(grouped, check, "warn", named)


def duplicate_names(entities: DataFrame) -> DataFrame:
    return duplicates(entities.where(F.col("type") != "person"), [F.col("type"), normalise(F.col("name"))], "duplicate_name")


def bad_domain(rows: DataFrame, column: str, allowed: tuple[str, ...], check: str) -> DataFrame:
    """A value outside the whitelist, or none."""
    return finding(rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)), check, "error", F.col("id"))


#: Relations that are a mandate, and those that are a seat in a body beside it.
MANDATES = ("élu_cm", "élu_cc", "adjoint", "maire", "délégué_cm", "délégué_cc")
BODY_SEATS = ("membre_commission", "adjoint", "délégué_cm", "responsable")


def never_closed(relations: DataFrame, before: str) -> DataFrame:
    """Mandates of an earlier term that nothing ended; other relations may be as old as they like."""
    old = (F.col("since") < before) & F.col("until").isNull()
    return finding(relations.where(old & F.col("relation_type").isin(*MANDATES)), "never_closed", "warn", F.col("id"))


def stale_seats(relations: DataFrame, entities: DataFrame, as_of: str) -> DataFrame:
    """Seats in a body that are still open though all mandates of their holder, one at least, are closed on that day.

    Seen from the person's end of a relation, whichever that is.
    """
    persons = entities.where("type = 'person'").select(F.col("id").alias("node"))
    held = doubled(relations.select("id", "relation_type", "until", "from_id", "to_id")).join(persons, "node", "left_semi")
    open_still = F.col("until").isNull() | (F.col("until") > as_of)
    mandates = held.where(F.col("relation_type").isin(*MANDATES)).groupBy("node").agg(F.max(open_still).alias("sits"))
    left = mandates.where(~F.col("sits")).select("node")
    return finding(held.where(F.col("relation_type").isin(*BODY_SEATS) & open_still).join(left, "node", "left_semi"), "stale_seat", "error", F.col("id"))


def stale(runs: DataFrame, ttl_days: DataFrame, as_of: Column) -> DataFrame:
    """(source, age, severity): sources older than 1.5 or 3 times their time to live, or that never ran."""
    last = runs.where("status = 'ok'").groupBy("source").agg(F.max("started").alias("last"))
    rows = ttl_days.join(last, "source", "left").withColumn("age", F.datediff(as_of, F.to_date("last")))
    severity = F.when(F.col("last").isNull() | (F.col("age") > 3 * F.col("ttl")), "error").when(F.col("age") > 1.5 * F.col("ttl"), "warn").otherwise("ok")
    return rows.select("source", "age", severity.alias("severity"))


def run_checks(checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All findings of a registry."""
    out = None
    for make in checks.values():
        out = make() if out is None else out.unionByName(make())
    return out


def outside_list(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """(column, n) of the values that an allow-list lacks; unknown values are outside too."""
    outside = rows.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
    return outside.groupBy(column).agg(F.count("*").alias("n"))


def classified(rows: DataFrame, column: str) -> DataFrame:
    """(n_entities, n_classified, refused): a build is refused where no row was ever classified."""
    n = F.count(column)
    return rows.agg(F.count("*").alias("n_entities"), n.alias("n_classified"), (n == 0).alias("refused"))


def until_clean(rows: DataFrame, scan: Callable[[DataFrame], DataFrame], fix: Callable[[DataFrame], DataFrame], most: int = 5) -> DataFrame:
    """``rows`` after fixing as often as ``scan`` still finds something, ``most`` times at the most; what is left then stays.

    A round adds ``fix`` to the plan, which ``most`` bounds; a dear frame comes as a written table.
    """
    for _ in range(most):
        if scan(rows).isEmpty():
            break
        rows = fix(rows)
    return rows
