"""The daily queue: who may be shown, why not, in which order; ledgers and pivots of scores; vetoes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline import config
from scoutline.operators import text
from scoutline.operators.relations import first_of

#: Cities that cannot satisfy a regional mandate (fixed values), and the mandates.
GOLDEN_CITIES, REGIONAL = ("oxford", "cambridge", "london"), ("north_east", "yorkshire", "north_england", "sunderland", "outside_golden_triangle")


def blocking_reason() -> Column:
    """First reason against showing an entity: a gate, what is unknown on its route, its place, a veto.

    Columns: gate, flags, route, stage_no, venture_signal, geo_hard, geo_ok, vetoed.
    """
    unknown_age = F.array_contains("flags", "age_unknown")
    other = F.get(F.filter("flags", lambda f: f != "age_unknown"), F.lit(0))
    registry = F.coalesce(F.col("route") == "registry", F.lit(False))
    late = F.col("stage_no").isNull() | (F.col("stage_no") > config.STAGES.index("seed"))
    return (
        F.when(F.col("gate").isNotNull(), F.col("gate"))
        .when(registry & unknown_age, "age_unknown")
        .when(other.isNotNull(), other)
        .when(registry & ~F.col("venture_signal"), "registry_without_venture_signal")
        .when(~registry & unknown_age & late, "maturity_unknown")
        .when(F.col("geo_hard") & ~F.col("geo_ok"), "geography_mismatch")
        .when(F.col("geo_hard") & F.col("geo_ok").isNull(), "geography_unverified")
        .when(F.col("vetoed"), "vetoed")
    )


def queue(best: DataFrame, reviewed: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` entities that nothing blocks and nobody reviewed today: shortlisted before others, then priority, then id.

    best: id, tier, priority, reason (null if it may be shown).  What is skipped takes no place.
    """
    open_ = best.where("reason is null and tier <> 'reject'").join(reviewed.select("id"), "id", "left_anti")
    return open_.orderBy((F.col("tier") != "shortlist").cast("int"), F.desc("priority"), "id").limit(cap)


def latest_per(scores: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key, then the best priority, then the smaller id."""
    return first_of(scores, list(keys), F.desc("scored_on"), F.desc("priority"), "score_id")


def veto(card_text: Column, on_portfolio: Column, city: Column, geo_values: Column) -> Column:
    """Why a card is no early lead, by its wording: a listing, a late round, a backer, a place."""
    blob = F.coalesce(card_text, F.lit(""))
    late = text.LATE.replace(r"(?!a\b)[a-z]", "[b-z]")
    place = F.lower(F.trim(F.coalesce(city, F.lit("")))).isin(*GOLDEN_CITIES) & geo_values.isin(*REGIONAL)
    return F.when(blob.rlike(text.IPO), "ipo").when(blob.rlike(late), "late_stage").when(F.coalesce(on_portfolio, F.lit(False)) | blob.rlike(text.BACKED), "already_backed").when(place, "geography_mismatch")


def status(sub: Column) -> Column:
    """Unknown is never a failure."""
    return F.when(sub.isNull(), "unknown").when(sub >= config.POSITIVE_AT, "met").when(sub <= config.NEGATIVE_AT, "missed").otherwise("partial")


def ledger(components: DataFrame, keys: list[str], rows: int = 3) -> DataFrame:
    """The components to show: the heaviest missed one, the heaviest met one, then by weight; ``rows`` in all.

    components: keys, key, place (order of criteria), weight, sub.
    """
    graded = components.withColumn("status", status(F.col("sub"))).where("status <> 'unknown'")
    heaviest = Window.partitionBy(*keys, "status").orderBy(F.desc("weight"), "place")
    seat = F.when((F.row_number().over(heaviest) == 1) & F.col("status").isin("missed", "met"), 0).otherwise(1)
    chosen = graded.withColumn("_seat", seat).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_seat", F.desc("weight"), "place")))
    return chosen.where(F.col("_n") <= rows).drop("_seat", "_n")


def wide(scores: DataFrame, id_col: str = "company_id") -> DataFrame:
    """One row per entity: a fit per fund, the best fund, and the others that it fits, best first."""
    order = F.struct((-F.col("priority")).alias("p"), F.col("fund_ordinal").alias("o"), F.col("fund").alias("fund"))
    fits = [F.max(F.when(F.col("fund") == f, F.col("fit"))).alias(f"fit_{f}") for f in config.FUNDS]
    ranked = F.array_sort(F.collect_list(F.when(F.col("tier") != "reject", order)))
    out = scores.groupBy(id_col).agg(*fits, ranked.alias("_r"))
    return out.withColumns({"best": F.get("_r", F.lit(0))["fund"], "also": F.array_join(F.transform(F.slice("_r", 2, 9), lambda x: x["fund"]), " · ")}).drop("_r")
