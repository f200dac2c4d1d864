"""Rendered grids and tables kept by partition, each with its SQL where SQL can tell it.

A tab holds the orders of one year, a line for each by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.functions.frames import stored
from scoutline.operators import grids, history, partitions
from scoutline.plans import proxies
from scoutline.streaming import windows as stream

t = proxies.table
COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"]
ENTERED = ["o_totalprice"]


def _lines(spark, sf):
    rows = t(spark, sf, "orders").select(F.year("o_orderdate").alias("tab"), *COLUMNS).withColumn("one", F.lit(1))
    return history.running(rows, ["tab"], "o_orderkey", "one").select("tab", *COLUMNS, F.col("spent").alias("number"))


def _changed(spark, sf):
    before = stored(_lines(spark, sf))
    after = before.where("number % 500 <> 0").withColumns(
        {
            "o_orderstatus": F.when(F.col("number") % 64 < 9, "X").otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(F.col("number") % 96 < 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        }
    )
    return grids.changed_rows(before, after, ["tab"], COLUMNS, ENTERED)


def grid_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges to write after a change: adjacent lines together, raw and typed columns apart."""
    return grids.write_ranges(_changed(spark, sf), ["tab"], COLUMNS, ENTERED)


def grid_tight_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The same with only those lines that differ in the columns of the range."""
    return grids.write_ranges(_changed(spark, sf), ["tab"], COLUMNS, ENTERED, tight=True)


def _sorted_again(spark, sf):
    """Lines by key, and after some orders have been pulled to the top and others deleted."""
    before = stored(_lines(spark, sf))
    rows = before.where("o_orderkey % 53 <> 0").withColumns({"place": F.col("o_orderkey") + F.when(F.col("o_orderkey") % 97 == 0, 0).otherwise(1_000_000_000_000), "one": F.lit(1)})
    after = history.running(rows.drop("number"), ["tab"], "place", "one").withColumnRenamed("spent", "number")
    return before, stored(after)


def grid_moves(spark: SparkSession, sf: str) -> DataFrame:
    """What happened to each line: as few as possible have moved."""
    before, after = _sorted_again(spark, sf)
    return grids.moves(before, after, "tab", "o_orderkey")


def grid_resorted(spark: SparkSession, sf: str) -> DataFrame:
    """Tabs in which somebody has changed the order of lines: those of even years."""
    before, after = _sorted_again(spark, sf)
    seen = after.where("tab % 2 = 0").select("tab", "number", "o_orderkey").unionByName(before.where("tab % 2 = 1").select("tab", "number", "o_orderkey"))
    return grids.resorted(before, seen, ["tab"], "o_orderkey")


def newest_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of each user and kind by day, from a stream read again with an overlap and with late users."""
    path, folder = f"{sf}/events.parquet", stream._folder(spark)
    table = partitions.Partitions(spark, f"{folder}/table", "event_id long, user_id long, event_type string, ts timestamp, value double, day date", "day", ["user_id", "event_type", "day"], ["ts", "event_id"])
    events = lambda: stream.events(spark, path).withColumn("day", F.to_date("ts"))
    partitions.swept(events().where("day(ts) < 20 and user_id % 3 > 0"), table, f"{folder}/first")
    partitions.swept(events().where("day(ts) >= 10 or user_id % 3 = 0"), table, f"{folder}/second")
    return table.table().select("day", "user_id", "event_type", "event_id", "value")


QUERIES = {f.__name__: f for f in (grid_ranges, grid_tight_ranges, grid_moves, grid_resorted, newest_by_day)}

_LINES = "lines AS (SELECT year(o_orderdate)::INT AS tab, *, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS number FROM orders)"
_GONE = "number % 500 = 0"
_RAW, _TYPED = "number % 64 < 9 AND o_orderstatus <> 'X'", "number % 96 < 5"
_ISLANDS = "SELECT tab, min(number) AS first, max(number) AS last FROM (SELECT *, number - row_number() OVER (PARTITION BY tab ORDER BY number) AS island FROM (SELECT tab, number FROM lines WHERE {})) GROUP BY tab, island"
_RUNS = "(VALUES ('raw', 'A', 'C'), ('entered', 'D', 'D'), ('raw', 'E', 'E')) r(option, first_column, last_column)"
SQL = {
    "grid_ranges": f"WITH {_LINES}, i AS ({_ISLANDS.format(f'{_GONE} OR {_RAW} OR {_TYPED}')}) SELECT tab, option, first_column, last_column, first, last FROM i, {_RUNS}",
    "grid_tight_ranges": f"WITH {_LINES} SELECT tab, 'raw' AS option, 'A' AS first_column, 'C' AS last_column, first, last FROM ({_ISLANDS.format(f'{_GONE} OR {_RAW}')}) "
    f"UNION ALL SELECT tab, 'entered', 'D', 'D', first, last FROM ({_ISLANDS.format(f'{_GONE} OR {_TYPED}')}) UNION ALL SELECT tab, 'raw', 'E', 'E', first, last FROM ({_ISLANDS.format(_GONE)})",
    "grid_resorted": f"WITH {_LINES}, kept AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY o_orderkey % 97 <> 0, o_orderkey) AS now FROM lines WHERE o_orderkey % 53 <> 0 AND tab % 2 = 0) "
    "SELECT DISTINCT l.tab FROM lines l LEFT JOIN kept k ON k.tab = l.tab AND k.now = l.number WHERE l.tab % 2 = 0 AND l.o_orderkey IS DISTINCT FROM k.o_orderkey",
    "newest_by_day": "SELECT ts::DATE AS day, user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY ts::DATE, user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
}
