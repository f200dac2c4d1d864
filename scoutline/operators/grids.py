"""Rendered grids: what of a tab has to be written again, as ranges of rows by runs of columns, and which rows moved.

Grids are tables of one row for each line: tab columns, ``number`` and the cells.  Null cells are empty text.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.functions.frames import stored
from scoutline.operators.history import islands, ranges, running


def letters(i: int) -> str:
    """Name of the i-th column from 0: A to Z, AA and on."""
    return (letters(i // 26 - 1) if i > 25 else "") + chr(65 + i % 26)


def column_runs(columns: Sequence[str], entered: Sequence[str] = ()) -> list[tuple[str, int, int]]:
    """(option, first, last): runs of adjacent columns that are written alike, ``entered`` ones as if typed, others raw."""
    kinds = groupby(range(len(columns)), key=lambda i: "entered" if columns[i] in entered else "raw")
    return [(kind, at[0], at[-1]) for kind, group in kinds for at in [list(group)]]


def changed_rows(before: DataFrame, after: DataFrame, tab: list[str], columns: Sequence[str], entered: Sequence[str] = (), force: bool = False) -> DataFrame:
    """Lines whose cells differ: tab, number, the new cells (blank if the line is gone), ``runs`` in which some cell differs.

    force: all lines count as different, in all runs (after somebody has sorted the tab).
    """
    keys = [*tab, "number"]
    cells = lambda df, x: df.select(*keys, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{x}{i}") for i, c in enumerate(columns)))
    both = cells(before, "o").join(cells(after, "n"), keys, "full_outer").fillna("")
    differ = lambda i: F.lit(True) if force else F.col(f"_o{i}") != F.col(f"_n{i}")
    found = []
    for r, (_, first, last) in enumerate(column_runs(columns, entered)):
        hit = differ(first)
        for i in range(first + 1, last + 1):
            hit = hit | differ(i)
        found.append(F.when(hit, F.lit(r)))
    out = both.select(*keys, *(F.col(f"_n{i}").alias(c) for i, c in enumerate(columns)), F.array_compact(F.array(*found)).alias("runs"))
    return out.where(F.size("runs") > 0)


def write_ranges(changed: DataFrame, tab: list[str], columns: Sequence[str], entered: Sequence[str] = (), tight: bool = False) -> DataFrame:
    """Ranges to write: tab, option, first_column, last_column, first, last (line numbers).

    Adjacent lines are one range for each run of columns; tight: only lines that differ in that run.
    """
    runs = column_runs(columns, entered)
    named = F.array(*(F.struct(F.lit(r).alias("run"), F.lit(o).alias("option"), F.lit(letters(a)).alias("first_column"), F.lit(letters(b)).alias("last_column")) for r, (o, a, b) in enumerate(runs)))
    if tight:
        found = ranges(changed.select(*tab, "number", F.explode("runs").alias("run")), "number", keys=[*tab, "run"]).withColumn("_r", F.get(named, F.col("run")))
    else:
        found = ranges(changed, "number", keys=tab).withColumn("_r", F.explode(named))
    return found.select(*tab, "_r.option", "_r.first_column", "_r.last_column", "first", "last")


def resorted(recorded: DataFrame, seen: DataFrame, tab: list[str], key: str) -> DataFrame:
    """Tabs in which a recorded key is no longer at its line; both: tab, number, key."""
    now = seen.select(*tab, "number", F.trim(F.col(key).cast("string")).alias("_now"))
    there = recorded.select(*tab, "number", F.col(key).cast("string").alias("_key")).join(now, [*tab, "number"], "left")
    return there.where(~F.col("_key").eqNullSafe(F.col("_now"))).select(*tab).distinct()


def heaviest_rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Which members are in the heaviest rising subsequence of distinct values (of equal ones that found first)."""
    n = len(values)
    at = np.empty(n, np.int64)
    at[np.argsort(values, kind="stable")] = np.arange(1, n + 1)
    best, owner = [0] * (n + 1), [-1] * (n + 1)  # a tree of prefix maxima over the values' ranks
    before = [-1] * n
    end, most = -1, 0
    for i, (rank, weight) in enumerate(zip(at.tolist(), weights.tolist(), strict=True)):
        total, last, j = 0, -1, rank - 1
        while j:
            if best[j] > total:
                total, last = best[j], owner[j]
            j &= j - 1
        before[i], total = last, total + weight
        if total > most:
            end, most = i, total
        while rank <= n:
            if total > best[rank]:
                best[rank], owner[rank] = total, i
            rank += rank & -rank
    stays = np.zeros(n, bool)
    while end >= 0:
        stays[end] = True
        end = before[end]
    return stays


def moves(before: DataFrame, after: DataFrame, tab: str, key: str) -> DataFrame:
    """tab, key, number_before, number_after, change: insert, delete, move or stay.

    before, after: tab, key (unique in a tab), number (unique in a tab); a null tab or key meets nothing, so its lines are inserts and
    deletes.  As few lines as possible move: those that stay are a longest
    subsequence with the same order in both.  Lines that follow one another in both are one strip, which stays or moves whole, so only
    strips go to one task, tab by tab; their number grows with what moved, and a tab ends at ten million cells by its format.
    """
    name = lambda df, x: df.select(tab, key, F.col("number").cast("long").alias(f"number_{x}"))
    both = stored(name(before, "before").join(name(after, "after"), [tab, key], "full_outer"))
    held = both.where("number_before is not null and number_after is not null").withColumn("_one", F.lit(1))
    was = stored(running(held, [tab], "number_before", "_one").withColumnRenamed("spent", "_was"))
    ranked = stored(running(was, [tab], "number_after", "_one").select(tab, key, F.col("spent").alias("x"), (F.col("spent") - F.col("_was")).alias("_shift")))
    keys = [tab, "_shift"]
    numbers, pieces = islands(ranked, "x", keys)
    pieces = stored(pieces)
    strips = pieces.select(*keys, "first", "last").distinct()

    def settle(group):
        group = group.sort_values("first", ignore_index=True)
        stays = heaviest_rising((group["first"] - group["_shift"]).to_numpy(), (group["last"] - group["first"] + 1).to_numpy())
        return group[[tab, "_shift", "first"]].assign(stays=stays)

    kinds = dict(strips.dtypes)
    settled = strips.groupBy(tab).applyInPandas(settle, f"`{tab}` {kinds[tab]}, _shift long, first long, stays boolean")
    by_line = numbers.join(pieces, [*keys, "_block", "_piece"]).join(settled, [*keys, "first"]).select(*keys, "x", "stays")
    judged = ranked.join(by_line, [*keys, "x"]).select(tab, key, "stays")
    change = F.when(F.col("number_before").isNull(), "insert").when(F.col("number_after").isNull(), "delete").when(F.col("stays"), "stay").otherwise("move")
    return both.join(judged, [tab, key], "left").select(tab, key, "number_before", "number_after", change.alias("change"))
