"""Merges without a transactional table: each returns the whole new state, to be written as a new table version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicmill.functions.numbers import lambert93
from civicmill.operators.windows import first_per_key


def inserted(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Keep what exists, add new keys; of new rows with one key the first under ``order``."""
    new = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(first_per_key(new, keys, *order) if order else new.dropDuplicates(keys), allowMissingColumns=True)


def replaced(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Whole rows of ``incoming``, whose keys are unique, replace existing ones."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str], keep: Column | None = None, fill_only: bool = False) -> DataFrame:
    """``columns`` of existing rows take the incoming values that are not null; new keys are added.

    ``keep``: condition on existing columns under which a row stays as it is (a human's entry, say). ``fill_only``: only
    nulls are filled.
    """
    rest = [c for c in existing.columns if c not in keys]
    there = existing.select(*keys, *rest, F.lit(True).alias("_there"))
    if keep is not None:
        there = there.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    news = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in incoming.columns if c not in keys])
    rows = there.join(news, keys, "full")

    def value(c: str) -> Column:
        if f"_{c}" not in news.columns:
            return F.col(c)
        order = (F.col(c), F.col(f"_{c}")) if fill_only or c not in columns else (F.col(f"_{c}"), F.col(c))
        updated = F.coalesce(*order) if c in columns else F.when(F.col("_there").isNull(), F.col(f"_{c}")).otherwise(F.col(c))
        return F.when(F.col("_keep"), F.col(c)).otherwise(updated) if keep is not None else updated

    return rows.select(*keys, *[value(c).alias(c) for c in rest])


def swept(existing: DataFrame, reread: DataFrame, keys: list[str], attached: DataFrame) -> DataFrame:
    """Rows that a new reading did not find again go, unless something is attached to them."""
    gone = existing.join(reread.select(*keys), keys, "left_anti").join(attached.select(*keys), keys, "left_anti")
    return existing.join(gone.select(*keys), keys, "left_anti")


def renamed(rows: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target, outcome): of rows that want one name the smallest key gets it, the others collide."""
    least = rows.groupBy(target).agg(F.min(key).alias("_first"))
    joined = rows.select(key, target).join(least, target)
    return joined.select(key, target, F.when(F.col(key) == F.col("_first"), "renamed").otherwise("collision").alias("outcome"))


def replayed(entries: DataFrame, key: str, order: str, withdrawn: str) -> DataFrame:
    """The latest state of each manual entry, withdrawn ones left out: replaying twice changes nothing."""
    return first_per_key(entries, [key], F.desc(order)).where(~F.coalesce(F.col(withdrawn), F.lit(False)))


def audit(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, old, new): a row for each field that changed."""
    old = before.select(key, *[F.col(c).cast("string").alias(f"_old_{c}") for c in columns])
    new = after.select(key, *[F.col(c).cast("string").alias(f"_new_{c}") for c in columns])
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_old_{c}").alias("old"), F.col(f"_new_{c}").alias("new")) for c in columns])
    changed = F.filter(fields, lambda f: ~f["old"].eqNullSafe(f["new"]))
    return old.join(new, key).select(key, F.inline(changed))


def decided(local: DataFrame, decisions: DataFrame, key: str, value: str) -> DataFrame:
    """(key, outcome) of imported decisions: applied, up to date, disagreement, or unknown."""
    mine = local.select(key, F.col(value).alias("_mine"), F.lit(True).alias("_known"))
    rows = decisions.select(key, F.col(value).alias("_theirs")).join(mine, key, "left")
    outcome = F.when(F.col("_known").isNull(), "unknown").when(F.col("_mine").isNull(), "applied").when(F.col("_mine") == F.col("_theirs"), "up_to_date").otherwise("disagreement")
    return rows.select(key, outcome.alias("outcome"))


def reloaded(existing: DataFrame, incoming: DataFrame, partition: list[str]) -> DataFrame:
    """Partitions that ``incoming`` has are replaced as a whole; the others stay."""
    return existing.join(incoming.select(*partition).distinct(), partition, "left_anti").unionByName(incoming)


def journalled(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after, added, status) of a load per collector; one that added nothing is empty, not ok."""
    counts = before.groupBy(key).agg(F.count("*").alias("before")).join(after.groupBy(key).agg(F.count("*").alias("after")), key, "full")
    filled = counts.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before", "after")])
    added = F.col("after") - F.col("before")
    return filled.withColumns({"added": added, "status": F.when(added > 0, "ok").otherwise("empty")})


def placed_by_hand(rows: DataFrame, moves: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` (key, lat, lng, geo_source, geo_score, x, y) where a person's coordinates (key, lat, lng) win.

    Moved rows have source "manual", score 1 and a projected pair of their own; a move without both coordinates does
    nothing. ``moves`` has one row a key at most.
    """
    hand = moves.where("lat IS NOT NULL AND lng IS NOT NULL").select(key, F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    x, y = lambert93(F.col("_lat"), F.col("_lng"))
    moved = F.col("_lat").isNotNull()
    new = {"lat": F.col("_lat"), "lng": F.col("_lng"), "geo_source": F.lit("manual"), "geo_score": F.lit(1.0), "x": x, "y": y}
    return rows.join(hand, key, "left").withColumns({c: F.when(moved, v).otherwise(F.col(c)) for c, v in new.items()}).select(*rows.columns)


def applied_if_unchanged(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new rows, outcomes): changes to rows that are still as their author saw them.

    ``rows`` have ``version`` and ``batch``, the last batch that changed them; ``changes`` are (batch, key, seen, columns): the
    version that was seen and the new values, null for none, one a batch and key. Of several batches for one row the
    first, by name, is applied, which makes the others stale. Outcomes (batch, key, outcome): applied, repeated (that batch
    changed the row before, so a batch that runs twice changes nothing), stale, or unknown.
    """
    there = rows.select(F.col(key), F.col("version").alias("_version"), F.col("batch").alias("_batch"), F.lit(True).alias("_there"))
    told = changes.join(there, key, "left")
    outcome = (
        F.when(F.col("_there").isNull(), "unknown").when(F.coalesce(F.col("_batch") == F.col("batch"), F.lit(False)), "repeated").when(~F.col("_version").eqNullSafe(F.col("seen")), "stale")
    )
    judged = told.withColumn("outcome", outcome).drop("_version", "_batch", "_there")
    first = judged.where("outcome IS NULL").groupBy(key).agg(F.min("batch").alias("_first"))
    final = F.coalesce("outcome", F.when(F.col("batch") == F.col("_first"), "applied").otherwise("stale"))
    judged = judged.join(first, key, "left").withColumn("outcome", final).drop("_first")
    new = judged.where("outcome = 'applied'").select(key, F.col("batch").alias("_batch"), *[F.col(c).alias(f"_{c}") for c in columns])
    merged = rows.join(new, key, "left")
    changed = {c: F.coalesce(f"_{c}", c) for c in columns}
    changed |= {"version": F.when(F.col("_batch").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1), "batch": F.coalesce("_batch", "batch")}
    return merged.withColumns(changed).select(*rows.columns), judged.select("batch", key, "outcome")
