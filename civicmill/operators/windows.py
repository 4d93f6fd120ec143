"""Window-style operators: latest and first rows per key, running totals, runs, near repeats, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicmill.sources.tables import checkpointed


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under ``order``, which must decide between any two rows.

    Spark keeps only each task's best rows before the shuffle (a rank limit below the exchange).
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def pareto(df: DataFrame, group: list[str], key: str, amount: str, shares: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """How few keys reach each share of a group's total. ``df`` has one row per (group, key), already summed."""
    down = Window.partitionBy(*group).orderBy(F.desc(amount), key)
    rows = df.withColumns({"_run": F.sum(amount).over(down.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(down), "_total": F.sum(amount).over(Window.partitionBy(*group))})
    reach = [F.min(F.when(F.col("_run") >= F.col("_total") * s, F.col("_n"))).alias(f"k{round(100 * s)}") for s in shares]
    return rows.groupBy(*group).agg(F.count("*").alias("n_keys"), *reach)


def runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, start, end, length) of the runs of consecutive distinct integers of each key."""
    distinct = df.select(*keys, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return distinct.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(number).alias("start"), F.max(number).alias("end"), F.count("*").alias("length")).drop("_island")


def longest_run(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The longest run of each key; of equally long ones the last."""
    return first_per_key(runs(df, keys, number), keys, F.desc("length"), F.desc("start"))


def without_near_repeats(df: DataFrame, keys: list[str], date: str, days: int, tie: str) -> DataFrame:
    """Of rows with equal ``keys``, in order of date, one stays if it comes over ``days`` after the last one that stayed.

    A row that comes so long after the row before it stays whatever was kept, so the scan runs within such chains only.
    Rows without a date are near to all: one stays if its key has no dated row.
    """
    over = Window.partitionBy(*keys).orderBy(F.col(date).asc_nulls_last(), tie)
    opens = (F.datediff(date, F.lag(date).over(over)) > days).cast("int")
    chained = df.withColumn("_opens", F.coalesce(opens, F.lit(0))).withColumn("_chain", F.sum("_opens").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.struct(F.col(date).isNull().alias("undated"), F.to_date(date).alias("day"), F.col(date).alias("date"), F.col(tie).alias("tie"), F.struct(*df.columns).alias("row"))
    chains = chained.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_chain").agg(F.array_sort(F.collect_list(entry)).alias("entries"))

    def step(state: Column, one: Column) -> Column:
        stays = state["first"] | (F.datediff(one["day"], state["last"]) > days)
        kept = F.when(stays, F.concat(state["kept"], F.array(one["row"]))).otherwise(state["kept"])
        return F.struct(F.lit(False).alias("first"), F.when(stays, one["day"]).otherwise(state["last"]).alias("last"), kept.alias("kept"))

    none = F.slice(F.transform("entries", lambda e: e["row"]), 1, 0)
    start = F.struct(F.lit(True).alias("first"), F.lit(None).cast("date").alias("last"), none.alias("kept"))
    return chains.select(F.inline(F.aggregate("entries", start, step)["kept"]))


def carried(column: str, keys: list[str], *order: Column) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def densified(df: DataFrame, key: str, axis: str) -> DataFrame:
    """Every key with every value of ``axis``, nulls in the holes. The axis is short (years); keys may be many."""
    axis_values = df.agg(F.array_sort(F.collect_set(axis)).alias("_axis"))
    keys = df.select(key).distinct()
    grid = keys.join(F.broadcast(axis_values)).select(key, F.explode("_axis").alias(axis))  # one row
    return grid.join(df, [key, axis], "left")


def best_of_near_repeats(df: DataFrame, keys: list[str], date: str, days: int, *best: Column) -> DataFrame:
    """Of rows with equal ``keys`` within ``days`` of each other the one that comes first under ``best``.

    A row stays if no row that stays is better and near. A row without a date is near to all of its keys; rows with a null
    key are near to none. ``best`` must decide between any two rows of a key.

    Each round keeps what is best among the undecided rows near it and drops what is near to those; both are range windows,
    so a key's rows are streamed, never gathered. Rounds end when nothing is undecided.
    """
    own, day = Window.partitionBy(*keys), F.datediff(date, F.lit("1970-01-01"))
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    without_key = df.where(~F.coalesce(*[F.when(F.col(k).isNull(), F.lit(False)) for k in keys], F.lit(True)))
    rows = checkpointed(known.withColumns({"_best": F.row_number().over(own.orderBy(*best)), "_day": day}))
    near = own.orderBy("_day").rangeBetween(-days, days)
    dated, undated = F.col("_day").isNotNull(), F.col("_day").isNull()
    stays = None
    while not rows.isEmpty():
        around = F.when(undated, F.min("_best").over(own)).otherwise(F.least(F.min(F.when(dated, F.col("_best"))).over(near), F.min(F.when(undated, F.col("_best"))).over(own)))
        judged = rows.withColumn("_stays", F.col("_best") == around)
        close = F.when(undated, F.max("_stays").over(own)).otherwise(F.coalesce(F.max(dated & F.col("_stays")).over(near), F.lit(False)) | F.max(undated & F.col("_stays")).over(own))
        judged = checkpointed(judged.withColumn("_close", close))
        kept, rows = judged.where("_stays").select(*df.columns), judged.where(~F.col("_stays") & ~F.col("_close")).drop("_stays", "_close")
        stays = kept if stays is None else stays.union(kept)
    return without_key if stays is None else stays.union(without_key)
