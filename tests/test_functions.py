"""Scalar expressions and scoring rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scoutline import config
from scoutline.functions import identity, ladders
from scoutline.operators import history, relations, resolve, scoring

COMPANY = (
    "company_id long, name string, incorporated_on date, founded_year int, total_funding_gbp double, announced_stage string, sector string, sic_codes array<string>, region string, country string, "
    "outcode string, city string, hq_region string, is_spinout boolean, spinout_university string, seis_eis_qualifying boolean, uk_exec_pct double, last_round_gbp double, prior_total_gbp double, "
    "valuation_gbp double, on_portfolio boolean, press_count int, route string, has_share_issue boolean, max_prior_appointments int, n_founders int, any_psc boolean, signal_kinds array<string>, website string"
)
NAMES = [x.split()[0] for x in COMPANY.split(", ")]


def company(spark, **known):
    values = {"company_id": 1, "sic_codes": [], "signal_kinds": []} | known
    return spark.createDataFrame([tuple(values.get(n) for n in NAMES)], COMPANY)


def test_worked_example(spark):
    df = company(spark, sector="climate_tech", announced_stage="seed", hq_region="north_east", is_spinout=True, spinout_university="Durham University", signal_kinds=["grant_award"], total_funding_gbp=450_000.0, press_count=2, incorporated_on=dt.date(2024, 3, 11), country="GB", route="spinout")
    rows = {r.fund: r for r in scoring.explanation(scoring.rescore(df, F.lit("2026-08-12").cast("date"))).collect()}
    n = rows["northstar"]
    assert (n.fit, n.raw_sum, n.coverage, n.edge, n.priority, n.vehicle) == (92.2, 18, 1.0, 55.5, 77.5, "spinout_inspire")
    assert (rows["outward"].fit, rows["outward"].tier) == (15.0, "reject")
    assert (rows["dsw"].fit, rows["dsw"].vehicle, rows["dsw"].tier) == (54.7, "eis_service", "watchlist")
    assert rows["anticus"].reject_reason == "no_eligible_vehicle" and rows["anticus"].fit > 0 and len(rows["anticus"].components) == 5
    assert n.explanation.startswith("Matches on sector (Climate Tech, +25pts); geography (North East, +25pts); founder signal (research/spinout, +19pts) — 69 of 92 total.")
    assert "Route to North East Spinout Inspire Fund (£200k–£750k)" in n.explanation


@pytest.mark.parametrize(
    "known, reason",
    [({"incorporated_on": dt.date(2026, 1, 1) - dt.timedelta(days=int(m * 30.4375))}, r) for m, r in [(1, None), (12, None), (36, None), (36.1, "max_company_age_months"), (60, "max_company_age_months")]]
    + [({}, None)]
    + [({"total_funding_gbp": x}, r) for x, r in [(0.0, None), (8e5, None), (3e6, None), (3_000_001.0, "max_total_funding_gbp"), (1.2e7, "max_total_funding_gbp")]]
    + [({"announced_stage": x}, r) for x, r in [("pre_seed", None), ("series_a", None), ("series_b_plus", "max_stage"), ("growth", "max_stage")]]
    + [({"on_portfolio": x}, r) for x, r in [(False, None), (True, "already_on_vc_portfolio")]]
    + [({"country": x}, r) for x, r in [("GB", None), ("US", "min_uk_presence")]],
)
def test_freshness_gates(spark, known, reason):
    df = company(spark, **{"country": "GB", "hq_region": "north_east", "announced_stage": "pre_seed"} | known)
    assert scoring.with_freshness(scoring.with_derived(df, F.lit("2026-01-01").cast("date"))).first().reject_reason == reason


def test_rejected_rows_hold_nothing_but_their_reason(spark):
    df = company(spark, sector="fintech", country="US", route="news")
    rows = scoring.explanation(scoring.rescore(df, F.lit("2026-01-01").cast("date"))).collect()
    assert {r.fund for r in rows} == set(config.FUNDS)
    for r in rows:
        assert (r.fit, r.coverage, r.raw_sum, r.components, r.edge, r.priority, r.tier) == (0, 0, 0, [], 0, 0, "reject")
        assert r.flags == ["age_unknown"] and r.explanation == "Rejected: min_uk_presence (not a UK company)."


def test_each_caveat_is_stated_once(spark):
    df = company(spark, sector="fintech", announced_stage="seed", country="GB", hq_region="london", route="news")
    text = next(r.explanation for r in scoring.explanation(scoring.rescore(df, F.lit("2026-01-01").cast("date"))).collect() if r.fund == "outward")
    assert text.count("age unknown") == 1 and text.count("⚠") == 1 and "gate unverified" in text


@pytest.mark.parametrize("policy, fit", [("neutral", 0.0), ("pessimistic", 0.0), ("assume", 20.0)])
def test_unknown_value_policies(spark, policy, fit):
    df = scoring.with_freshness(scoring.with_derived(company(spark, country="GB", hq_region="us"), F.lit("2026-01-01").cast("date")))
    row = scoring.with_fit(df, {"stage": policy}, {"stage": "seed"}).select(F.explode("fits").alias("f")).where("f.fund = 'outward'").select("f.*").first()
    assert row.fit == round({"assume": 100 * 3 * 3 / 4 / 15}.get(policy, 0.0), 1)
    assert row.coverage == (0.2 if policy == "neutral" else 0.4)


def test_unknown_is_not_zero(spark):
    df = scoring.with_fit(scoring.with_freshness(scoring.with_derived(company(spark, sector="fintech", country="GB"), F.lit("2026-01-01").cast("date"))))
    row = df.select(F.explode("fits").alias("f")).where("f.fund = 'outward'").select("f.*").first()
    # Sector 4 of 4 and geography uk_wide 1 of 4; the unknown rest stays in the denominator.
    assert row.fit == round(100 * (4 * 1 + 2 * 0.25) / 15, 1) and row.coverage == 0.4


def test_registry_find_without_proof_has_no_row(spark):
    as_of = F.lit("2026-01-01").cast("date")
    assert scoring.rescore(company(spark, route="registry", country="GB", website="https://a"), as_of).count() == 0
    assert scoring.rescore(company(spark, route="registry", country="GB", has_share_issue=True), as_of).count() == len(config.FUNDS)
    assert {r.reject_reason for r in scoring.rescore(company(spark, route="registry", country="US"), as_of).collect()} == {"min_uk_presence"}


@pytest.mark.parametrize("text, amount, currency", [("raised £1.5m today", 1.5e6, "GBP"), ("$2,500k", 2.5e6, "USD"), ("€3 bn", 3e9, "EUR"), ("£450,000", 450_000, "GBP"), ("CHF 12", 12.0, "CHF"), ("1,200", 1200.0, None), ("undisclosed", None, None), ("nothing", None, None), (None, None, None)])
def test_money(spark, text, amount, currency):
    a, c = identity.money(F.col("x"))
    row = spark.createDataFrame([(text,)], "x string").select(a.alias("a"), c.alias("c")).first()
    assert (row.a, row.c) == (amount, currency)


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("The Café & Sons Co. Ltd",), ("Limited",), (None,)], "x string")
    assert [r.y for r in df.select(identity.norm_name(F.col("x")).alias("y")).collect()] == ["cafe and sons", "", ""]
    odd = spark.createDataFrame([("Škoda Ltd",), ("Газпром",), ("Łódź Labs",), ("ﬁne Ｗｉｄｅ",), ("Zero\u200bWidth",)], "x string")
    assert [r.y for r in odd.select(identity.norm_name(F.col("x")).alias("y")).collect()] == ["skoda", "газпром", "łodz labs", "fine wide", "zerowidth"]
    df = spark.createDataFrame([("sc1234",), ("445790",), ("ABC",), ("123456789",)], "x string")
    assert [r.y for r in df.select(identity.registry_number(F.col("x")).alias("y")).collect()] == ["SC001234", "00445790", "ABC", "123456789"]


def test_similarity(spark):
    pairs = [("acme robotics", "acme robotic arms"), ("acme robotic", "acme robotics"), ("robotics acme", "acme robotics")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.y for r in df.select(identity.fuzzy_score(F.col("a"), F.col("b")).alias("y")).collect()] == [86.67, 96.0, 100.0]


def test_block_and_ladder(spark):
    names = spark.createDataFrame([(1, "acme robotics"), (2, "acme robotic"), (3, "other firm"), (4, "acme sweets and more")], "id long, name string")
    got = {(r.a, r.b): r.verdict for r in resolve.ladder(resolve.block(names)).collect()}
    assert got == {(1, 2): "merge", (1, 4): "distinct", (2, 4): "distinct"}


def test_curves_and_months(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (6.0,), (36.0,), (37.0,)], "x double")
    got = [r.y for r in df.select(ladders.curve(F.col("x"), config.AGE_CURVE, 0.5).alias("y")).collect()]
    assert got[0] == 0.5 and got[1] == 1.0 and abs(got[2] - 0.925) < 1e-9 and abs(got[3] - 0.15) < 1e-9 and got[4] == 0.0
    df = spark.createDataFrame([(dt.date(2024, 1, 31), dt.date(2024, 2, 29))], "a date, b date")
    assert df.select(ladders.months(F.col("a"), F.col("b"), "calendar").alias("m")).first().m == 0


def test_diff_of_equal_frames_is_empty(spark, tiny):
    c = spark.read.parquet(f"{tiny}/customer.parquet")
    assert relations.keyed_diff(c, c, ["c_custkey"]).count() == 0


def test_streaks(spark):
    days = [("a", dt.date(2024, 1, d), 0 if d > 12 else 4) for d in range(1, 21)] + [("b", dt.date(2024, 1, d), 1) for d in range(1, 21)] + [("c", dt.date(2024, 1, 1), 0)]
    df = spark.createDataFrame(days, "source string, day date, items long").withColumn("status", F.lit("ok"))
    got = {r.source: (r.streak, r.average, r.warning, r.alert) for r in history.breaks(df).collect()}
    assert got == {"a": (8, 4.0, True, True), "b": (0, 1.0, False, False), "c": (1, 0.0, False, False)}


def test_ranges_cross_buckets(spark):
    xs = [*range(1, 40), *range(50, 51), *range(60, 100), 200, 201, -5]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    for buckets in (1, 3, 7, 4096):
        got = sorted(tuple(r) for r in history.ranges(df, "x", buckets).collect())
        assert got == [(-5, -5, 1), (1, 39, 39), (50, 50, 1), (60, 99, 40), (200, 201, 2)]
    assert history.ranges(df.limit(0), "x").count() == 0


def test_median_of_odd_and_even_groups(spark):
    rows = [("a", float(x)) for x in (5, 1, 3)] + [("b", float(x)) for x in (4, 1, 2, 100)] + [("c", 7.0), ("d", None)] + [("e", 2.0)] * 5
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r.k: r.median for r in relations.exact_median(df, "k", "v").collect()} == {"a": 3.0, "b": 3.0, "c": 7.0, "e": 2.0}


def test_rules_and_hash():
    assert config.parse_rules("round_max:5,000 · requires_seis_eis:yes; odd:1") == {"round_max": 5000.0, "requires_seis_eis": True, "unknown": ["odd"]}
    assert config.config_hash() == config.config_hash() and len(config.config_hash()) == 16


@pytest.mark.parametrize(
    "a, b, decision, rule",
    [
        (("Bolt Robotics Ltd",), ("BOLT ROBOTICS",), "merge", "normkey_exact"),
        (("Crème Ltd",), ("Creme Limited",), "merge", "normkey_exact"),
        (("Bolt Robotics",), ("Bolt Robotics Marine Division",), "distinct", "no_match"),
        (("Bolt Robotics Ltd", None, None, "GB"), ("Bolt Robotics Inc", None, None, "US"), "distinct", "normkey_country_conflict"),
        (("AI Labs",), ("Tech Solutions",), "distinct", "no_match"),
        (("Stealth",), ("Stealth",), "distinct", "placeholder"),
        (("Bolt", "445790"), ("Bolt Robotics", "00445790"), "merge", "ch_exact"),
        (("Bolt", "SC445790"), ("Bolt", "00445790"), "distinct", "ch_conflict"),
        (("Bolt", None, "bolt.com"), ("Cargo", None, "www.bolt.com/x"), "merge", "domain_exact"),
        (("Bolt", None, "linkedin.com/co/bolt"), ("Cargo", None, "linkedin.com/co/cargo"), "distinct", "no_match"),
        (("Kelvin Bio", None, "eng.ox.ac.uk/kelvin"), ("Thames Nanopore", None, "ox.ac.uk"), "distinct", "no_match"),
        (("NEWCO 4471 LIMITED", "00445790"), ("Bolt Robotics", "445790"), "merge", "ch_exact"),
        (("Baker & Partners",), ("Baker & Sons",), "review", "person_name_shared_token"),
        (("Bolted Robotic",), ("Bolted Robotics",), "merge", "fuzzy"),
        (("Acme Robotics",), ("Acme Robotic Arms",), "review", "fuzzy"),
        (("Bolted Holdings",), ("Bolted Holding",), "review", "fuzzy_corporate_role_conflict"),
    ],
)
def test_match_ladder(spark, a, b, decision, rule):
    row = lambda i, x: (i, *x, *[None] * (4 - len(x)))
    known = resolve.keyed(spark.createDataFrame([row(1, a), row(2, b)], "id long, name string, number string, domain string, country string"))
    side = lambda x, i: known.where(f"id = {i}").select(*(F.col(c).alias(f"{c}_{x}") for c in known.columns if c != "id"), F.col("id").alias(x))
    got = resolve.compared(side("a", 1).join(side("b", 2))).first()
    assert (got.decision, got.rule) == (decision, rule)


def test_similarity_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    words = ["".join(rng.choices("abc ", k=rng.randint(1, 80))).strip() or "a" for _ in range(60)]
    pairs = list(zip(words, reversed(words)))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.n for r in df.select(identity.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()] == [lcs(a, b) for a, b in pairs]
    assert abs(identity.jaro_winkler("martha", "marhta") - 0.961111) < 1e-6 and abs(identity.jaro_winkler("dixon", "dicksonx") - 0.813333) < 1e-6
