"""Mixing sources to target weights along a time-varying curriculum.

Each source has a piecewise-linear weight schedule over training time 0 to 1. The integral of its schedule is its
weight; weights share the token budget, no source beyond ``most_epochs`` times its size, the excess going to the others
by weight until none is above. A source's documents stand in a fixed random order (by digest of their id) and are read
round and round until its target is met. Each reading takes the training position at which the source's cumulative
demand reaches it: the schedule's integral, inverted. Documents are then range-sorted by position.

Running sums are two-level: sums of 4,096 digest buckets per source, then a window inside a bucket, so a source with
any share of the rows is spread over as many tasks as there are.

Edge cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, sorted last;
rows without an id are ordered by the digest of their text; repeated rows are separate documents, one after another;
sources of size 0 get target 0; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.llm.common import saved, word_count

#: Knots (time, factor) of the schedules by turn: rising, falling, peaking half-way; each has integral 1.
RAMPS = ([(0.0, 0.5), (1.0, 1.5)], [(0.0, 1.5), (1.0, 0.5)], [(0.0, 0.5), (0.5, 1.5), (1.0, 0.5)])


def segments_of(knots: list[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start, end, weight at start, weight at end, integral before) of each piece of a schedule."""
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1, w0, w1, before))
        before += (t1 - t0) * (w0 + w1) / 2
    return out


def default_schedules(rank: Column) -> tuple[Column, Column]:
    """(weight, schedule number) of the source at ``rank`` (from 0): weights 1, 2, 3 repeating."""
    return (rank % 3 + 1).cast("int"), (rank % len(RAMPS)).cast("int")


def position_at(share: Column, schedule: Column) -> Column:
    """The time at which the integral of a source's schedule reaches ``share`` (0 to 1) of its whole."""
    out = F.lit(None).cast("double")
    for number, knots in enumerate(RAMPS):
        pieces = segments_of(knots)
        whole = pieces[-1][4] + (pieces[-1][1] - pieces[-1][0]) * (pieces[-1][2] + pieces[-1][3]) / 2
        for t0, t1, w0, w1, before in pieces:
            area = F.greatest(share * whole - before, F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            inverse = F.lit(t0) + 2 * area / (F.lit(w0) + F.sqrt(F.lit(w0 * w0) + 2 * slope * area))
            out = F.when((schedule == number) & (share * whole >= before), inverse).otherwise(out)
    return out


def source_targets(totals: DataFrame, schedules: Callable[[Column], tuple[Column, Column]] = default_schedules, most_epochs: int = 3) -> DataFrame:
    """(source, rank, source_size, weight, schedule, target) from (source, source_size): one row per source.

    Sorted by the level at which each source is full, the first sources are full and the others share what is left by
    weight. The windows without a key run over sources, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    weight, schedule = schedules(F.col("rank"))
    ranked = ranked.withColumns({"weight": weight, "schedule": schedule, "most": most_epochs * F.col("source_size")})
    fill = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    every = Window.partitionBy(F.lit(1))
    ranked = ranked.withColumns({
        "full_before": F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "budget": F.sum("source_size").over(every),
    })
    overflows = F.col("weight") * (F.col("budget") - F.col("full_before")) >= F.col("most") * F.col("weight_left")
    ranked = ranked.withColumn("open_rank", F.sum((~overflows).cast("int")).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = lambda c: F.max(F.when(F.col("open_rank") == 1, F.struct("open_rank", F.col(c).alias("v")))).over(every)["v"]
    ranked = ranked.withColumns({"level_budget": F.col("budget") - first("full_before"), "level_weight": first("weight_left")})
    target = F.when(F.col("open_rank") == 0, F.col("most").cast("double")).otherwise((F.col("weight") * F.col("level_budget")).cast("double") / F.col("level_weight"))
    return ranked.select("source", "rank", "source_size", "weight", "schedule", target.alias("target"))


def mixed(docs: DataFrame, schedules: Callable[[Column], tuple[Column, Column]] = default_schedules, most_epochs: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, positions), range-sorted by first position.

    ``keys``: columns that tell rows apart and are carried along; they also settle ties of the order.

    ``taken`` are the words that the mix takes of a document, repeats counted: a source's sum is its rounded target.
    ``positions`` has the training position of each of its readings; the last reading of a source may stop within a
    document.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    sized = saved(docs.select("doc_id", "source", *keys, order.alias("order"), word_count(F.col("text")).alias("size")), "sizes")
    totals = saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = saved(source_targets(totals, schedules, most_epochs), "targets").withColumnRenamed("source", "named")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    rows = rows.withColumn("bucket", F.substring("order", 1, 3))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("rank", "bucket").orderBy("order", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["rank", "bucket"]).withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    words = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumns({"words": words, "epochs": epochs})
    placed = placed.withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    placed = placed.withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long"))
    readings = F.when(F.col("taken") == 0, 0).otherwise(F.col("epochs") + (last > 0).cast("long"))
    at = lambda k: (F.col("start") + k * F.col("source_size")) / F.col("words")
    every = F.array(*[F.when(readings > k, position_at(at(F.lit(k)), F.col("schedule"))) for k in range(most_epochs)])
    placed = placed.withColumn("positions", F.array_compact(every))
    placed = placed.withColumn("position", F.try_element_at("positions", F.lit(1)))
    out = placed.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "positions", *keys)
    place = (F.col("position").asc_nulls_last(), F.xxhash64("doc_id").asc())  # what is not taken has no position: spread by hash
    return out.repartitionByRange(*place).sortWithinPartitions(*place)


def mixed_documents(docs: DataFrame, schedules: Callable[[Column], tuple[Column, Column]] = default_schedules, most_epochs: int = 3) -> DataFrame:
    """The documents in training order: a row for each reading that takes over half of the document's words.

    Documents that the mix does not take go. Each row gets a key, made once and saved, by which it meets its own
    readings, so rows without a ``doc_id`` are read as well, and rows that share one are read as often as the mix says.
    """
    key, at = "_mixing_row", "_mixing_position"  # beside columns of any other name
    rows = saved(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    plan = saved(mixed(rows.select("doc_id", "source", "text", key), schedules, most_epochs, (key,)).select(key, "size", "taken", "positions"), "plan")
    readings = F.slice("positions", F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int"))
    readings = plan.where("taken > 0").select(key, F.explode(readings).alias(at))
    read = rows.join(readings, key)
    return read.repartitionByRange(at).sortWithinPartitions(at, "doc_id", key).drop(at, key)
