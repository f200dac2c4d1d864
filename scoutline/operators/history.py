"""Run history: streaks, silent breaks, budgets and ranges of adjacent numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.functions.frames import blocked


def _newest_first(days: DataFrame) -> DataFrame:
    return days.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("day"))))


def leading_zero_streak(days: DataFrame) -> DataFrame:
    """Newest recorded days in a row without items, per source."""
    first = F.min(F.when(F.col("items") != 0, F.col("rn")))
    return _newest_first(days).groupBy("source").agg((F.coalesce(first, F.count(F.lit(1)) + 1) - 1).cast("long").alias("streak"))


def islands(df: DataFrame, number: str, keys: list[str] = [], blocks: int = 1024) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(numbers, runs): distinct numbers of each key with their piece of a run, and pieces with the run (first, last) that they are of.

    Pieces are found inside blocks of equally many numbers.  Only the outermost two of a block, at most 2 * ``blocks`` rows of a key,
    pass one ordered window that joins them.
    """
    xs = df.select(*keys, F.col(number).cast("long").alias("x")).where("x is not null").distinct()
    piece = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("x"))
    numbers = blocked(xs, "x", blocks).withColumn("_piece", piece)
    at = [*keys, "_block", "_piece"]
    within = Window.partitionBy(*keys, "_block")
    outer = (F.col("first") == F.min("first").over(within)) | (F.col("last") == F.max("last").over(within))
    runs = numbers.groupBy(*at).agg(F.min("x").alias("first"), F.max("x").alias("last")).withColumn("_outer", outer)
    order = Window.partitionBy(*keys).orderBy("first")
    fresh = F.when(F.col("first") == F.lag("last").over(order) + 1, 0).otherwise(1)
    edge = runs.where("_outer").withColumn("_fresh", fresh).withColumn("_g", F.sum("_fresh").over(order))
    whole = Window.partitionBy(*keys, "_g")
    joined = edge.select(*at, F.min("first").over(whole).alias("first"), F.max("last").over(whole).alias("last"))
    return numbers, runs.where("not _outer").select(*at, "first", "last").unionByName(joined)


def ranges(df: DataFrame, number: str, buckets: int = 1024, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Runs of adjacent numbers of each key as (first, last, n)."""
    _, runs = islands(df, number, keys, buckets)
    return runs.select(*keys, "first", "last").distinct().withColumn("n", F.col("last") - F.col("first") + 1)


def leading_streak(runs: DataFrame, key: str, order: str, bad: Column) -> DataFrame:
    """How many of the newest recorded runs in a row are bad, per key; runs that are not recorded do not count."""
    first = F.min(F.when(~F.col("_bad"), F.col("_n")))
    ranked = runs.withColumns({"_bad": bad, "_n": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))})
    return ranked.groupBy(key).agg((F.coalesce(first, F.count(F.lit(1)) + 1) - 1).cast("long").alias("streak"))


def _mean_before(days: DataFrame, ends: DataFrame, window: int) -> DataFrame:
    """(source, mean) of the calendar days before each source's end, without failed ones."""
    both = days.join(ends, "source").where((F.col("status") != "failed") & (F.col("day") >= F.date_sub("_end", window)) & (F.col("day") < F.col("_end")))
    return both.groupBy("source").agg(F.avg("items").alias("mean"))


def health(days: DataFrame, window: int = 7) -> DataFrame:
    """Newest run, newest success, mean of the days before the newest run, empty streak.  days: source, day, items, status."""
    last = days.groupBy("source").agg(F.max("day").alias("last_run"), F.max_by(F.struct("items", "status"), "day").alias("l"), F.max(F.when((F.col("status") == "ok") & (F.col("items") > 0), F.col("day"))).alias("last_success"))
    mean = _mean_before(days, last.select("source", F.col("last_run").alias("_end")), window)
    streak = leading_streak(days, "source", "day", F.col("items") == 0)
    both = last.join(mean, "source", "left").join(streak, "source")
    return both.select("source", "last_run", "last_success", "l.items", "l.status", F.round(F.coalesce("mean", F.lit(0.0)), 2).alias("average_7d"), F.col("streak").alias("zero_streak"))


def breaks(days: DataFrame, streak_days: int = 7, min_average: float = 2.0, window: int = 7) -> DataFrame:
    """Sources that went quiet: the mean is of the days before the empty streak began, so a long silence cannot hide itself."""
    streak = leading_streak(days, "source", "day", F.col("items") == 0)
    last = days.groupBy("source").agg(F.max("day").alias("_last"), F.max_by(F.struct("items", "status"), "day").alias("l")).join(streak, "source")
    ends = last.select("source", F.expr("date_sub(_last, int(greatest(streak - 1, 0)))").alias("_end"))
    both = last.join(_mean_before(days, ends, window), "source", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    empty = F.col("l.items") == 0
    warning, alert = empty & (F.col("l.status") != "failed") & (F.col("mean") >= min_average), empty & (F.col("streak") >= streak_days) & (F.col("mean") > min_average)
    return both.select("source", "streak", F.round("mean", 6).alias("average"), warning.alias("warning"), alert.alias("alert"))


def running(df: DataFrame, keys: list[str], order: str, cost: str, blocks: int = 256) -> DataFrame:
    """Append ``spent``: the running cost within each key, over blocks of the order and inside them.

    A key may hold a large share of all rows: no task gets more of it than a block.  The order must be unique in a key.
    """
    cut = blocked(df, order, blocks)
    sums = cut.groupBy(*keys, "_block").agg(F.sum(cost).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_inside", F.sum(cost).over(inside)).join(sums, [*keys, "_block"]).withColumn("spent", F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def budgeted(work: DataFrame, key: str, step: str, order: str, cost: str, budget: int) -> DataFrame:
    """Work that three passes can pay for: steps 0 and 1 a third of the budget each, step 2 what they left."""
    spent = running(work, [key, step], order, cost)
    early = spent.where((F.col(step) < 2) & (F.col("spent") <= budget // 3))
    used = early.groupBy(key).agg(F.sum(cost).alias("_used"))
    late = spent.where(F.col(step) == 2).join(used, key, "left").where(F.col("spent") <= budget - F.coalesce("_used", F.lit(0)))
    return early.select(key, step, order, "spent").unionByName(late.select(key, step, order, "spent"))
