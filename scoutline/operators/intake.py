"""Rows of several sources as one, with counters of what was dropped and why, and a failure of one source kept to itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scoutline.operators import lifecycle

STATUS = "source string, status string, seen long, kept long, dropped map<string, long>, error string"


def counted(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, Observation]:
    """(rows that break no rule, counters): each row counts for the first rule that it breaks, in the pass that reads it."""
    marks = Observation()
    screened = lifecycle.screened(df, rules)
    metrics = [F.count(F.lit(1)).alias("seen"), F.count_if(F.col("screen").isNull()).alias("kept"), *(F.count_if(F.col("screen") == name).alias(f"dropped:{name}") for name, _ in rules)]
    return screened.observe(marks, *metrics).where("screen is null").drop("screen"), marks


def allowed(configured: list[str], asked: list[str] | None = None, disabled: tuple[str, ...] = ()) -> list[str]:
    """Sources that may run: configured ones, of them those asked for (none asked: all), without disabled ones, in their order."""
    return [s for s in configured if (not asked or s in asked) and s not in disabled]


def gathered(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], rules: list[tuple[str, Column]], path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``source``, status rows): each source is read, screened and written in one job of its own.

    A source that fails costs one status row; its former rows stay as they are.  Sources are few and named, so the driver walks through them.
    """
    status = []
    for name, read in sources.items():
        try:
            kept, marks = counted(read(), rules)
            kept.write.mode("overwrite").parquet(f"{path.rstrip('/')}/source={name}")
            found = marks.get
            dropped = {k.split(":", 1)[1]: v for k, v in found.items() if k.startswith("dropped:")}
            status.append((name, "ok" if found["kept"] else "empty", found["seen"], found["kept"], dropped, None))
        except Exception as error:  # noqa: BLE001  whatever a source raises stays its own
            status.append((name, "failed", 0, 0, {}, f"{type(error).__name__}: {str(error).splitlines()[0][:200] if str(error) else ''}"))
    rows = spark.createDataFrame(status, STATUS)
    some = [f"{path.rstrip('/')}/source={s[0]}" for s in status if s[1] != "failed"]
    union = spark.read.option("basePath", path).parquet(*some) if some else spark.createDataFrame([], "source string")
    return union, rows


def rolled_up(status: DataFrame) -> DataFrame:
    """One row for a run: failed if any source failed, else empty if any was, else ok; sums, and failed sources by name."""
    worst = F.when(F.max((F.col("status") == "failed").cast("int")) == 1, "failed").when(F.max((F.col("status") == "empty").cast("int")) == 1, "empty").otherwise("ok")
    return status.agg(worst.alias("status"), F.sum("seen").alias("seen"), F.sum("kept").alias("kept"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("source")))), ", ").alias("failed"))
