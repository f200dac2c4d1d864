"""Keyed relational operators: first rows, diffs, provenance, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.functions.frames import blocked


def first_of(df: DataFrame, keys: list[str], *order: Column | str, k: int = 1) -> DataFrame:
    """The first k rows of each key; the last column of the order must be unique, so that ties are settled."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose row was inserted, deleted or updated; equal rows give nothing, so a rerun is empty."""
    rest = sorted(set(before.columns) - set(keys))
    mark = lambda df, name: df.select(*keys, F.xxhash64(*rest).alias(name))
    both = mark(before, "_old").join(mark(after, "_new"), keys, "full_outer")
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update")
    return both.select(*keys, change.alias("change")).where("change is not null")


def resolve_provenance(observations: DataFrame) -> DataFrame:
    """The value of the most trusted, then newest observation of each entity, and how many there are."""
    trust = F.when(F.col("kind") == "share_issue", 100).when(F.col("kind") == "grant_award", 80).when(F.col("kind") == "spinout", 65).when(F.col("kind") == "press", 40).otherwise(10)
    order = F.struct(trust.alias("trust"), "occurred_on", "signal_id")
    return observations.groupBy("company_id").agg(F.max_by("kind", order).alias("value"), F.count(F.lit(1)).alias("trail"))


def threshold_sweep(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, precision and recall at every change point.

    Thresholds are whole numbers from 0 to 100, so labelled rows are first summed up to at most 102 of them, by the highest
    threshold that they reach; running sums over these give every count.  Without labelled rows all counts are 0.
    """
    points = scores.select(F.greatest(F.lit(0), F.least(F.lit(100), F.col("fit"))).alias("threshold")).distinct().withColumn("asked", F.lit(True))
    reached = F.greatest(F.lit(-1), F.least(F.lit(100), F.floor("fit"))).cast("int").alias("threshold")
    counted = scores.join(labels, "doc_id").groupBy(reached).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    both = points.join(counted, "threshold", "full_outer").fillna(0, ["good", "bad"])
    above = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.orderBy(F.desc("threshold")).rowsBetween(1, Window.unboundedFollowing)
    swept = both.select("threshold", "asked", F.sum("good").over(above).alias("tp"), F.sum("bad").over(above).alias("fp"), F.coalesce(F.sum("good").over(below), F.lit(0)).alias("fn")).where("asked")
    share = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return swept.select("threshold", "tp", "fp", "fn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


def threshold_metrics(scores: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Counts, precision, recall and F1 at the thresholds where the shortlist changes.

    scores: id, fit; labels: id, good.  Whole thresholds from 0 to 100 are the only ones, so sums by floor are at most 101
    rows, and running sums over them give every count; above ``limit`` thresholds an even sample with both ends is kept.
    """
    floor = F.greatest(F.lit(0), F.least(F.lit(100), F.floor("fit"))).cast("int").alias("threshold")
    per = scores.join(labels, "id", "left").groupBy(floor).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), F.count_if(F.col("fit") < 0).alias("below"), F.count_if((F.col("fit") < 0) & F.col("good")).alias("good_below"), F.count_if((F.col("fit") < 0) & ~F.col("good")).alias("bad_below"))
    # Fits below 0 are at threshold 0 but reach it not.
    from_here = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("threshold")
    total = Window.partitionBy()
    swept = per.select("threshold", (F.sum(F.col("n") - F.col("below")).over(from_here)).alias("would_shortlist"), F.sum(F.col("good") - F.col("good_below")).over(from_here).alias("tp"), F.sum(F.col("bad") - F.col("bad_below")).over(from_here).alias("fp"), F.sum("good").over(total).alias("all_good"), (F.row_number().over(every) - 1).alias("i"), F.count(F.lit(1)).over(total).alias("points"))
    even = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda x: F.bround(x * (F.col("points") - 1) / F.lit(limit - 1.0), 0).cast("int"))
    swept = swept.where((F.col("points") <= limit) | F.array_contains(even, F.col("i"))).withColumn("fn", F.col("all_good") - F.col("tp"))
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp = F.col("tp")
    return swept.select("threshold", "would_shortlist", "tp", "fp", "fn", share(tp, tp + F.col("fp")).alias("precision"), share(tp, tp + F.col("fn")).alias("recall"), share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def weight_sweep(fits: DataFrame, id_col: str, attributes: tuple[str, ...], weights: tuple[int, ...], least: float) -> DataFrame:
    """How many entities reach a fit when one attribute's weight is another; fits: id, components (key, weight, sub).

    All variants are columns of one aggregate, so the entities are read once and not multiplied.
    """
    parts = F.col("components")

    def above(a: str, w: int) -> Column:
        weight = lambda x: F.when(x["key"] == a, F.lit(w)).otherwise(x["weight"])
        points = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["sub"], F.lit(0.0)) * weight(x))
        whole = F.aggregate(parts, F.lit(0), lambda acc, x: acc + weight(x))
        return F.count_if(F.bround(100 * points / whole, 1) >= least)

    variants = [(a, w) for a in attributes for w in weights]
    row = fits.agg(*(above(a, w).alias(f"{a}:{w}") for a, w in variants))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.lit(w).alias("weight"), F.col(f"`{a}:{w}`").alias("above")) for a, w in variants))).alias("x"))
    return long.select("x.*")


def exact_median(df: DataFrame, key: str, value: str, blocks: int = 256) -> DataFrame:
    """(key, median): the middle value, or the mean of the two in the middle.

    Values are counted, then summed by blocks of about equally many of them; only the block that holds a middle is ordered, so no
    task gets all values of a key, outliers or not.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counted = blocked(counted, "v", blocks).withColumnRenamed("_block", "b")
    sums = counted.groupBy(key, "b").agg(F.sum("n").alias("held"))
    before = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"before": F.coalesce(F.sum("held").over(before), F.lit(0)), "total": F.sum("held").over(Window.partitionBy(key))})
    sums = sums.withColumns({"m1": F.floor((F.col("total") + 1) / 2), "m2": F.floor(F.col("total") / 2) + 1})
    middle = sums.where("(before < m1 and m1 <= before + held) or (before < m2 and m2 <= before + held)")
    inside = Window.partitionBy(key, "b").orderBy("v")
    rows = counted.join(middle, [key, "b"]).withColumn("upto", F.col("before") + F.sum("n").over(inside)).withColumn("from", F.col("upto") - F.col("n"))
    at = lambda m: F.max(F.when((F.col("from") < F.col(m)) & (F.col(m) <= F.col("upto")), F.col("v")))
    return rows.groupBy(key).agg(((at("m1") + at("m2")) / 2).alias("median"))
