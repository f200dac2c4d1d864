"""Ladder, band, curve and calendar expressions that the analytics share; all are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Value of a small fixed table, null for other keys."""
    literal = lambda x: "'" + x + "'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)
    return F.expr("map(" + ", ".join(literal(x) for pair in table.items() for x in pair) + ")")[key]


def band(x: Column, bands: Sequence[tuple[float, float]], unknown: float) -> Column:
    """Score of the first band whose upper end is not below x; 0 above the last, ``unknown`` for null."""
    out = F.when(x.isNull(), F.lit(float(unknown)))
    for upper, score in bands:
        out = out.when(x <= F.lit(float(upper)), F.lit(float(score)))
    return out.otherwise(F.lit(0.0))


def curve(x: Column, knots: Sequence[tuple[float, float]], unknown: float) -> Column:
    """Piecewise-linear score: the first knot's below it, 0 above the last knot, ``unknown`` for null."""
    out = F.when(x.isNull(), F.lit(float(unknown))).when(x <= float(knots[0][0]), F.lit(float(knots[0][1])))
    for (x0, s0), (x1, s1) in zip(knots, knots[1:]):
        out = out.when(x <= float(x1), F.lit(float(s0)) + (x - F.lit(float(x0))) / F.lit(float(x1 - x0)) * F.lit(float(s1 - s0)))
    return out.otherwise(F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """Half-even rounding, as scores are rounded everywhere."""
    return F.bround(x, digits)


def months(start: Column, end: Column, mode: str) -> Column:
    """Months between two dates.

    ``mean``: days / 30.4375; ``calendar``: whole calendar months, negative allowed; ``calendar_floor``: not
    below 0; ``rounded``: days / 30.44 to the nearest whole.
    """
    days = F.datediff(end, start)
    if mode == "mean":
        return days / F.lit(30.4375)
    if mode == "rounded":
        return F.bround(days / F.lit(30.44), 0).cast("int")
    whole = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)
    return F.greatest(whole, F.lit(0)) if mode == "calendar_floor" else whole


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that is true; null conditions do not fire."""
    out = None
    for condition, name in rules:
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def flags(*rules: tuple[Column, str]) -> Column:
    """Names of all rules that are true, in order."""
    return F.array_compact(F.array(*(F.when(condition, name) for condition, name in rules)))


def any_of(*verdicts: Column) -> Column:
    """True if any is true, else null if any is null, else false (SQL's OR)."""
    out = verdicts[0]
    for v in verdicts[1:]:
        out = out | v
    return out
