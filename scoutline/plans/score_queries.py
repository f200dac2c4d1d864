"""Scoring queries over the proxies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutline import config
from scoutline.functions import ladders
from scoutline.functions.frames import stored
from scoutline.operators import generations, scoring
from scoutline.plans import proxies


def as_of() -> Column:
    return F.lit(proxies.AS_OF).cast("date")


def _text(x: object) -> str:
    if x is None:
        return "NULL"
    return f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x)


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + f") AS t({names})"


def _case(column: str, table: dict[str, str]) -> str:
    groups: dict[str, list[str]] = {}
    for key, value in table.items():
        groups.setdefault(value, []).append(key)
    return f"CASE {' '.join(f'WHEN {column} IN ({', '.join(map(_text, keys))}) THEN {_text(v)}' for v, keys in groups.items())} END"


def _vehicle_rows() -> list[tuple]:
    rows, stage = [], config.STAGES.index
    for i, v in enumerate(config.VEHICLES):
        r = v["rules"]
        caps = [r.get(k) for k in ("round_max", "prior_total_max", "valuation_max", "uk_exec_pct_min")]
        row = (v["fund"], v["vehicle"], i, stage(v["first_stage"]), stage(v["last_stage"]), v["geo_rule"], v["geo_values"][0], v["age_cap_years"], *caps, "requires_seis_eis" in r, "beyond_research_stage" in r, ",".join(r["university_spinout_required"]) if "university_spinout_required" in r else None)
        if v["active"]:
            rows.append((*row, f"{v['name']} ({config.cheque_label(*v['cheque'])})"))
    return rows


_EXACT, _PREFIX = config.flat(config.SECTOR_CODES), config.SECTOR_PREFIXES
_CODE = "coalesce(" + _case("{c}", _EXACT) + ", " + _case("left({c}, 3)", _PREFIX) + ", " + _case("left({c}, 2)", _PREFIX) + ")"
_STAGE = "list_position(" + "[" + ", ".join(map(_text, config.STAGES)) + "], {c}) - 1"
_UK = "CASE WHEN country IN (" + ", ".join(map(_text, config.UK_COUNTRIES)) + ") THEN TRUE WHEN country IS NOT NULL THEN FALSE WHEN coalesce(outcode, geography) IS NOT NULL THEN TRUE END"
_CITY = r"regexp_replace(regexp_replace(lower(trim(city)), '\s+', ' ', 'g'), '^(?:the )?(?:city|county) of ', '')"
_CURVE = "CASE WHEN age_months IS NULL THEN 0.5::DOUBLE WHEN age_months <= 0 THEN 1.0 " + " ".join(f"WHEN age_months <= {x1} THEN {s0}::DOUBLE + (age_months - {x0}::DOUBLE) / {x1 - x0}::DOUBLE * ({s1}::DOUBLE - {s0}::DOUBLE)" for (x0, s0), (x1, s1) in zip(config.AGE_CURVE, config.AGE_CURVE[1:])) + " ELSE 0.0 END"
_BAND = lambda c, bands: f"CASE WHEN {c} IS NULL THEN 0.5::DOUBLE " + " ".join(f"WHEN {c} <= {u} THEN {s}::DOUBLE" for u, s in bands) + " ELSE 0.0 END"
_ROUTE = "CASE WHEN route = 'registry' AND press_count > 0 THEN 0.6::DOUBLE " + " ".join(f"WHEN route = '{r}' THEN {s}::DOUBLE" for r, s in config.ROUTES.items()) + " ELSE 0.5::DOUBLE END"

CTE = (
    "WITH company AS ("
    + proxies.duck(proxies.COMPANY)
    + f"""), born AS (SELECT *, date_diff('day', coalesce(incorporated_on, make_date(founded_year, 7, 1)), DATE '{proxies.AS_OF}') / 30.4375::DOUBLE AS age_months, string_split(codes, ',') AS code_list FROM company),
placed AS (SELECT * EXCLUDE (sector), coalesce(sector, CASE WHEN len(code_list) > 0 THEN coalesce({_CODE.replace('{c}', 'code_list[1]')}, {_CODE.replace('{c}', 'code_list[2]')}, 'other') END) AS sector,
  {_case(_CITY, config.flat(config.CITIES))} AS by_city,
  CASE WHEN outcode IS NOT NULL THEN coalesce({_case("regexp_extract(upper(outcode), '^[A-Z]+')", config.flat(config.AREAS))}, 'uk_wide') END AS by_outcode,
  CASE WHEN region IS NOT NULL OR country IN ({', '.join(map(_text, config.UK_COUNTRIES))}) THEN
    CASE WHEN region = 'London' THEN 'london' WHEN region = 'North East' THEN 'north_east' WHEN region = 'Yorkshire and The Humber' THEN 'yorkshire'
         WHEN country IN ('Scotland', 'Wales', 'Northern Ireland') THEN 'uk_regions' WHEN region <> '' THEN 'uk_regions' ELSE 'uk_wide' END END AS by_region
  FROM born),
staged AS (SELECT *, coalesce(hq_region, by_city, nullif(by_outcode, 'uk_wide'), by_region, by_outcode) AS geography,
  coalesce(announced_stage, CASE WHEN coalesce(has_share_issue, FALSE) AND age_months <= 24 THEN 'pre_seed' WHEN coalesce(has_share_issue, FALSE) THEN 'seed' WHEN age_months <= 12 THEN 'idea' END) AS stage
  FROM placed),
derived AS (SELECT *,
  CASE WHEN is_spinout THEN 'research_spinout' WHEN max_prior_appointments >= 1 THEN 'repeat_founder' WHEN sector IN ('deeptech', 'life_sciences') AND any_psc THEN 'technical_founder' WHEN n_founders > 0 THEN 'generalist_unclear' END AS founder_signal,
  CASE WHEN signal = 'grant_award' THEN 'clinical_grant_validation' WHEN signal = 'competition_win' THEN 'community_traction' WHEN stage IN ('pre_seed', 'idea') AND NOT has_share_issue THEN 'pre_revenue_concept' END AS traction_signal
  FROM staged),
gated AS (SELECT *, {_UK} AS uk, {_STAGE.replace('{c}', 'stage')} AS ordinal,
  CASE WHEN age_months > {config.MAX_AGE_MONTHS} THEN 'max_company_age_months' WHEN total_funding_gbp > {config.MAX_FUNDING} THEN 'max_total_funding_gbp' WHEN {_STAGE.replace('{c}', 'stage')} > {config.STAGES.index(config.MAX_STAGE)} THEN 'max_stage'
       WHEN on_portfolio THEN 'already_on_vc_portfolio' WHEN NOT ({_UK}) THEN 'min_uk_presence' END AS gate,
  100 * ({_CURVE} * 30.0::DOUBLE + {_BAND('press_count', config.PRESS_BANDS)} * 30.0::DOUBLE + {_BAND('total_funding_gbp', config.FUNDING_BANDS)} * 20.0::DOUBLE + {_ROUTE} * 20.0::DOUBLE) / 100.0::DOUBLE AS edge_raw,
  coalesce(has_share_issue, FALSE) AS q1, signal = 'grant_award' AS q2, coalesce(is_spinout, FALSE) AS q3, coalesce(press_count > 0, FALSE) OR signal IN ('press', 'competition_win') AS q4
  FROM derived),
edged AS (SELECT *, round_even(edge_raw, 1) AS edge_all, (route IS NOT NULL AND route <> 'registry') OR q1 OR q2 OR q3 OR q4 AS admitted FROM gated),
vehicle AS (SELECT * FROM {_values(_vehicle_rows(), 'fund, vehicle, v_ordinal, first_stage, last_stage, geo_rule, geo_value, age_cap, round_max, prior_max, valuation_max, uk_pct, needs_seis, needs_later, schools, v_name')}),
matrix AS (SELECT * FROM {_values(config.matrix_rows(), 'attribute, value, fund, raw')}),
importance AS (SELECT * FROM {_values(config.importance_rows(), 'attribute, fund, weight')}),
geo AS (SELECT e.company_id, v.vehicle AS g_vehicle, coalesce(nullif(e.geography, 'uk_wide'), e.by_city, e.geography) AS place,
  CASE v.geo_value
    WHEN 'outside_golden_triangle' THEN CASE WHEN coalesce(outcode, '') LIKE 'OX%' OR coalesce(outcode, '') LIKE 'CB%' THEN FALSE WHEN coalesce(geography, '') = 'london' OR lower(coalesce(city, '')) IN ('oxford', 'cambridge', 'london') THEN FALSE WHEN outcode IS NOT NULL OR geography <> 'uk_wide' THEN TRUE WHEN by_city <> 'uk_wide' THEN TRUE END
    WHEN 'sunderland' THEN CASE WHEN city IS NOT NULL THEN lower(trim(city)) IN ({', '.join(map(_text, config.SUNDERLAND_CITIES))}) WHEN outcode IS NOT NULL THEN outcode LIKE 'SR%' END
    WHEN 'north_england' THEN CASE WHEN place <> 'uk_wide' THEN place IN ('north_east', 'yorkshire') END
    WHEN 'uk_wide' THEN uk
    WHEN 'uk_regions' THEN place IN ('uk_regions', 'north_east', 'yorkshire', 'uk_wide')
    ELSE CASE WHEN place <> 'uk_wide' THEN place = v.geo_value END END AS geo_ok
  FROM edged e, vehicle v),
judged AS (SELECT e.*, v.*, g.geo_ok,
  CASE WHEN ordinal < first_stage OR ordinal > last_stage THEN 'stage_range' WHEN age_months > age_cap * 12 THEN 'max_age_years' WHEN geo_rule = 'HARD' AND NOT geo_ok THEN 'geography:' || geo_value
       WHEN last_round_gbp > round_max THEN 'round_max' WHEN prior_total_gbp > prior_max THEN 'prior_total_max' WHEN uk_exec_pct < uk_pct THEN 'uk_exec_pct_min'
       WHEN needs_seis AND coalesce(sector = 'lending', FALSE) THEN 'seis_eis_excluded_trade' WHEN needs_seis AND NOT seis_eis_qualifying THEN 'requires_seis_eis' WHEN valuation_gbp > valuation_max THEN 'valuation_max'
       WHEN schools IS NOT NULL AND NOT is_spinout THEN 'university_spinout_required'
       WHEN schools IS NOT NULL AND spinout_university IS NOT NULL AND len(list_filter(string_split(schools, ','), lambda s: contains(lower(spinout_university), s))) = 0 THEN 'university_spinout_required'
       WHEN needs_later AND stage = 'idea' THEN 'beyond_research_stage' END AS vehicle_reason,
  coalesce(stage IS NULL OR (age_cap IS NOT NULL AND age_months IS NULL) OR (geo_rule = 'HARD' AND geo_ok IS NULL) OR (round_max IS NOT NULL AND last_round_gbp IS NULL) OR (prior_max IS NOT NULL AND prior_total_gbp IS NULL)
   OR (uk_pct IS NOT NULL AND uk_exec_pct IS NULL) OR (needs_seis AND NOT coalesce(sector = 'lending', FALSE) AND seis_eis_qualifying IS NULL) OR (valuation_max IS NOT NULL AND valuation_gbp IS NULL)
   OR (schools IS NOT NULL AND (is_spinout IS NULL OR (is_spinout AND spinout_university IS NULL))) OR (needs_later AND stage IS NULL), FALSE) AS unverified
  FROM edged e JOIN vehicle v ON TRUE JOIN geo g ON g.company_id = e.company_id AND g.g_vehicle = v.vehicle),
best AS (SELECT company_id, fund, arg_min(vehicle, v_ordinal) AS vehicle, bool_or(unverified) AS unverified FROM judged WHERE vehicle_reason IS NULL GROUP BY company_id, fund),
attributes AS (SELECT company_id, unnest(['stage', 'sector', 'geography', 'founder_signal', 'traction_signal']) AS attribute, unnest([stage, sector, geography, founder_signal, traction_signal]) AS value, unnest([1, 2, 3, 4, 5]) AS place FROM edged),
component AS (SELECT a.company_id, i.fund, a.attribute AS key, a.place, a.value, i.weight, CASE WHEN a.value IS NOT NULL THEN coalesce(m.raw, 0) END AS raw
  FROM attributes a JOIN importance i USING (attribute) LEFT JOIN matrix m ON m.attribute = a.attribute AND m.value = a.value AND m.fund = i.fund),
fitted AS (SELECT company_id, fund, round_even(100 * sum(coalesce(raw * weight::DOUBLE / 4.0, 0.0)) / sum(weight)::DOUBLE, 1) AS fit, round_even(count(raw) / 5.0::DOUBLE, 2) AS coverage, sum(coalesce(raw, 0))::INT AS raw_sum FROM component GROUP BY company_id, fund),
joined AS (SELECT e.company_id, f.fund, e.gate, b.vehicle AS v, b.unverified, CASE WHEN e.gate IS NULL THEN f.fit ELSE 0 END AS fit, CASE WHEN e.gate IS NULL THEN f.coverage ELSE 0 END AS coverage, CASE WHEN e.gate IS NULL THEN f.raw_sum ELSE 0 END AS raw_sum,
  e.edge_all, e.age_months, e.uk, e.route, e.geography, e.sector, e.stage, e.total_funding_gbp
  FROM edged e JOIN fitted f USING (company_id) LEFT JOIN best b ON b.company_id = e.company_id AND b.fund = f.fund WHERE e.gate IS NOT NULL OR e.admitted),
flagged AS (SELECT * EXCLUDE (v), CASE WHEN gate IS NULL THEN v END AS vehicle, coalesce(gate, CASE WHEN v IS NULL THEN 'no_eligible_vehicle' END) AS reject_reason,
  CASE WHEN gate IS NOT NULL OR v IS NULL THEN 0.0::DOUBLE ELSE edge_all END AS edge,
  concat_ws(',', CASE WHEN age_months IS NULL THEN 'age_unknown' END, CASE WHEN gate IS NULL AND v IS NOT NULL AND coalesce(unverified, FALSE) THEN 'gate_unverified' END, CASE WHEN gate IS NULL AND uk IS NULL THEN 'uk_unverified' END) AS flags FROM joined),
scored AS (SELECT *, CASE WHEN reject_reason IS NOT NULL THEN 'reject' WHEN flags <> '' THEN CASE WHEN fit >= {config.WATCHLIST_FIT} THEN 'watchlist' ELSE 'reject' END
    WHEN fit >= {config.SHORTLIST_FIT} AND edge >= {config.SHORTLIST_EDGE} AND coverage >= {config.SHORTLIST_COVERAGE} THEN 'shortlist' WHEN fit >= {config.WATCHLIST_FIT} THEN 'watchlist' ELSE 'reject' END AS tier,
  CASE WHEN flags <> '' AND fit >= {config.WATCHLIST_FIT} THEN replace(string_split(flags, ',')[1], '_', ' ') || ' — verify before sending' WHEN flags <> '' THEN 'below fit threshold'
    WHEN fit >= {config.SHORTLIST_FIT} AND edge >= {config.SHORTLIST_EDGE} AND coverage >= {config.SHORTLIST_COVERAGE} THEN NULL WHEN fit >= {config.SHORTLIST_FIT} AND coverage < {config.SHORTLIST_COVERAGE} THEN 'strong fit but too little known — needs 10 minutes of research'
    WHEN fit >= {config.SHORTLIST_FIT} AND edge < {config.SHORTLIST_EDGE} THEN 'good fit but likely already on their radar' WHEN fit >= {config.WATCHLIST_FIT} THEN NULL ELSE 'below fit threshold' END AS tier_reason,
  CASE WHEN reject_reason IS NOT NULL THEN 0.0::DOUBLE ELSE round_even({config.WEIGHT_FIT}::DOUBLE * fit + {config.WEIGHT_EDGE}::DOUBLE * edge, 1) END AS priority FROM flagged)
"""
)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_freshness(scoring.with_derived(proxies.companies(spark, sf_dir), as_of()))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rescore(proxies.companies(spark, sf_dir), as_of())


def rescore_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("company_id", "fund", "fit", "edge", "coverage", "raw_sum", "priority", "tier", "vehicle", "reject_reason", F.array_join("flags", ",").alias("flags"))


def judged(companies: DataFrame) -> DataFrame:
    return scoring.rescore(companies, as_of()).select("company_id", "fund", "fit", "edge", "priority", "tier", "reject_reason")


def changed_companies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Companies before and after every hundredth one has raised money."""
    old = proxies.companies(spark, sf_dir)
    raised = F.when(F.col("company_id") % 100 == 7, F.coalesce("total_funding_gbp", F.lit(0.0)) + 2_500_000.0).otherwise(F.col("total_funding_gbp"))
    return old, old.withColumn("total_funding_gbp", raised)


def rescore_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after a change: those of the changed companies are computed, the others taken over."""
    old, new = changed_companies(spark, sf_dir)
    former = stored(judged(old))
    return generations.refreshed(new, generations.marked(old, config.config_hash()), former, "company_id", config.config_hash(), judged)[0]


def tier_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy("fund", "tier").agg(F.count(F.lit(1)).alias("n"))


def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).where("reject_reason is not null").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


def freshness_gate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("company_id", "reject_reason", F.array_join("gate_flags", ",").alias("flags"))


def vehicle_gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = scoring.vehicle_gates(base(spark, sf_dir))
    return gated.select("company_id", "fund", "vehicle", "vehicle_reason", "unverified")


def best_vehicle_per_fund(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.with_routes(base(spark, sf_dir)).select("company_id", F.posexplode("routes").alias("i", "r"))
    fund = F.array(*map(F.lit, config.FUNDS))[F.col("i")]
    return rows.where("r.vehicle is not null").select("company_id", fund.alias("fund"), "r.vehicle", "r.unverified")


def fund_fit_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.with_fit(base(spark, sf_dir)).select("company_id", F.explode("fits").alias("f"))
    return rows.select("company_id", "f.fund", "f.fit", "f.coverage", "f.raw_sum")


def discovery_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("company_id", scoring.discovery_edge().alias("edge"))


def priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each fund; ties end with the entity's id."""
    order = Window.partitionBy("fund").orderBy(F.desc("priority"), "company_id")
    return scores(spark, sf_dir).where("reject_reason is null").withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("fund", "rank", "company_id", "priority")


def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.components(scores(spark, sf_dir)).select("company_id", "fund", "key", "value", "weight", "raw")


def explanation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("company_id").orderBy(F.desc("occurred_on"), F.desc("signal_id"))
    last = proxies.signals(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 2")
    headline = F.concat(F.replace("kind", F.lit("_"), F.lit(" ")), F.lit(" #"), F.col("signal_id").cast("string"))
    found = last.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", headline.alias("headline"), "occurred_on"))), lambda s: F.struct(s["headline"].alias("headline"), s["occurred_on"].alias("occurred_on"))).alias("signals"))
    df = proxies.companies(spark, sf_dir).join(found, "company_id", "left")
    return scoring.explanation(scoring.rescore(df, as_of())).select("company_id", "fund", "explanation")


def qualification_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where("reject_reason is null").where(~scoring.admitted()).select("company_id", "route")


def derive_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("company_id", "geography", "sector", "stage", "founder_signal", "traction_signal")


def derive_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = proxies.companies(spark, sf_dir)
    return df.select("company_id", scoring.city_region(F.col("city")).alias("by_city"), scoring.outcode_region(F.col("outcode")).alias("by_outcode"))


def route_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxies.companies(spark, sf_dir).select("company_id", scoring.route_score(F.col("route"), F.col("press_count")).alias("score"))


def band_and_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = scoring.edge_parts()
    return base(spark, sf_dir).select("company_id", *(F.round(parts[k], 6).alias(k) for k in ("age", "press", "funding")))


def matrix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpivoted attributes joined with the matrix (a fixed dimension), blank cells 0."""
    dims = config.dims(spark)
    long = base(spark, sf_dir).select("company_id", *config.ATTRIBUTES).unpivot("company_id", list(config.ATTRIBUTES), "attribute", "value").where("value is not null")
    return long.join(F.broadcast(dims["matrix"]), ["attribute", "value"]).groupBy("fund", "attribute").agg(F.sum("raw").alias("points"), F.count(F.lit(1)).alias("n"))


def entity_fund_vehicle_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = scoring.vehicle_gates(base(spark, sf_dir))
    return gated.groupBy("fund", "vehicle").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vehicle_reason").isNull()).alias("eligible"), F.count_if("unverified").alias("unverified"))


def months_four_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = proxies.companies(spark, sf_dir).where("incorporated_on is not null")
    modes = ("mean", "calendar", "calendar_floor", "rounded")
    return df.select("company_id", *(F.round(ladders.months(F.col("incorporated_on"), as_of(), m), 6).alias(m) if m == "mean" else ladders.months(F.col("incorporated_on"), as_of(), m).alias(m) for m in modes))


QUERIES = {f.__name__: f for f in (rescore_all, rescore_changed, tier_histogram, reject_reasons, freshness_gate_reason, vehicle_gate_verdict, best_vehicle_per_fund, fund_fit_pct, discovery_edge, priority_rank, score_components, explanation_text, qualification_pool, derive_attributes, derive_geography, route_score, band_and_curve, matrix_lookup, entity_fund_vehicle_cross, months_four_ways)}

_WHOLE = f"(date_part('year', DATE '{proxies.AS_OF}') - date_part('year', incorporated_on)) * 12 + date_part('month', DATE '{proxies.AS_OF}') - date_part('month', incorporated_on) - CASE WHEN date_part('day', DATE '{proxies.AS_OF}') < date_part('day', incorporated_on) THEN 1 ELSE 0 END"
_GATE_FLAGS = "concat_ws(',', CASE WHEN age_months IS NULL THEN 'age_unknown' END, CASE WHEN gate IS NULL AND uk IS NULL THEN 'uk_unverified' END) AS flags"
_WORDS = "replace(key, '_', ' ')"
SQL = {
    "rescore_all": "SELECT company_id, fund, fit, edge, coverage, raw_sum, priority, tier, vehicle, reject_reason, flags FROM scored",
    "tier_histogram": "SELECT fund, tier, count(*) AS n FROM scored GROUP BY fund, tier",
    "reject_reasons": "SELECT reject_reason, count(*) AS n FROM scored WHERE reject_reason IS NOT NULL GROUP BY reject_reason",
    "freshness_gate_reason": f"SELECT company_id, gate AS reject_reason, {_GATE_FLAGS} FROM edged",
    "vehicle_gate_verdict": "SELECT company_id, fund, vehicle, vehicle_reason, unverified FROM judged",
    "best_vehicle_per_fund": "SELECT company_id, fund, vehicle, unverified FROM best",
    "fund_fit_pct": "SELECT company_id, fund, fit, coverage, raw_sum FROM fitted",
    "discovery_edge": "SELECT company_id, edge_all AS edge FROM edged",
    "priority_rank": "SELECT fund, rank::INT AS rank, company_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY priority DESC, company_id) AS rank FROM scored WHERE reject_reason IS NULL) WHERE rank <= 10",
    "score_components": "SELECT c.company_id, c.fund, c.key, c.value, c.weight, c.raw FROM component c JOIN scored s ON s.company_id = c.company_id AND s.fund = c.fund WHERE s.gate IS NULL",
    "explanation_text": f"""SELECT company_id, fund, CASE WHEN gate IS NOT NULL THEN 'Rejected: ' || gate || ' (' || CASE gate WHEN 'max_company_age_months' THEN round_even(age_months, 0)::INT || ' months old' WHEN 'max_total_funding_gbp' THEN format('£{{:,}}', round_even(total_funding_gbp, 0)::BIGINT) || ' raised'
    WHEN 'max_stage' THEN 'stage ' || stage WHEN 'already_on_vc_portfolio' THEN 'found on a tracked VC portfolio page' ELSE 'not a UK company' END || ').'
  WHEN vehicle IS NULL THEN 'Rejected: no eligible vehicle — every hard rule failed.'
  ELSE concat_ws('. ', nullif(body, ''), '⚠ ' || nullif(array_to_string(list_filter(string_split(replace(flags, '_', ' '), ','), lambda f: f <> '' AND NOT contains(lower(body), f)), ', '), '')) || '.' END AS explanation
FROM (SELECT scored.*, concat_ws('. ', 'Found via ' || found, 'Matches on ' || pos || ' — ' || round_even(pos_sum, 0)::INT || ' of ' || round_even(fit, 0)::INT || ' total', 'Against: ' || neg, 'Unknown: ' || unk, 'Route to ' || v_name, CASE WHEN edge >= {config.LOW_VISIBILITY_EDGE} THEN 'Low visibility — no coverage found in our tracked sources' END,
    CASE WHEN coverage < {config.COVERAGE_NOTE_BELOW} THEN 'Only ' || round_even(100 * coverage, 0)::INT || '% of criteria could be assessed' END, tier_reason) AS body
  FROM scored LEFT JOIN vehicle v USING (fund, vehicle)
  LEFT JOIN (SELECT company_id, string_agg(replace(kind, '_', ' ') || ' #' || signal_id || ' (' || occurred_on || ')', '; ' ORDER BY n) AS found FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY occurred_on DESC, signal_id DESC) AS n FROM ({proxies.duck(proxies.SIGNAL)})) WHERE n <= 2 GROUP BY company_id) USING (company_id)
  LEFT JOIN (SELECT company_id, fund, string_agg(CASE WHEN raw >= 3 AND p <= 3 THEN {_WORDS} || ' (' || evidence || ', +' || round_even(pts, 0)::INT || 'pts)' END, '; ' ORDER BY p) AS pos, sum(CASE WHEN raw >= 3 AND p <= 3 THEN pts END ORDER BY p) AS pos_sum,
      string_agg(CASE WHEN raw <= 1 AND g <= 2 THEN {_WORDS} || ' (' || evidence || ')' END, '; ' ORDER BY g) AS neg, string_agg(CASE WHEN raw IS NULL AND u <= 2 THEN {_WORDS} END, ', ' ORDER BY u) AS unk
    FROM (SELECT *, {_case('value', {v: config.label(v) for cells in config.MATRIX.values() for v in cells})} AS evidence, 100.0::DOUBLE * weight * (raw / 4.0::DOUBLE) / sum(weight) OVER (PARTITION BY company_id, fund) AS pts,
       row_number() OVER (PARTITION BY company_id, fund, raw >= 3 ORDER BY weight * raw DESC, place) AS p, row_number() OVER (PARTITION BY company_id, fund, raw <= 1 ORDER BY weight * (4 - raw) DESC, place) AS g,
       row_number() OVER (PARTITION BY company_id, fund, raw IS NULL ORDER BY weight DESC, place) AS u FROM component) GROUP BY company_id, fund) USING (company_id, fund))""",
    "qualification_pool": "SELECT company_id, route FROM edged WHERE gate IS NULL AND NOT admitted",
    "derive_attributes": "SELECT company_id, geography, sector, stage, founder_signal, traction_signal FROM derived",
    "derive_geography": "SELECT company_id, by_city, by_outcode FROM placed",
    "route_score": f"SELECT company_id, {_ROUTE} AS score FROM company",
    "band_and_curve": f"SELECT company_id, round({_CURVE}, 6) AS age, round({_BAND('press_count', config.PRESS_BANDS)}, 6) AS press, round({_BAND('total_funding_gbp', config.FUNDING_BANDS)}, 6) AS funding FROM born",
    "matrix_lookup": "SELECT m.fund, m.attribute, sum(m.raw)::BIGINT AS points, count(*) AS n FROM attributes a JOIN matrix m ON m.attribute = a.attribute AND m.value = a.value GROUP BY m.fund, m.attribute",
    "entity_fund_vehicle_cross": "SELECT fund, vehicle, count(*) AS n, count(*) FILTER (WHERE vehicle_reason IS NULL) AS eligible, count(*) FILTER (WHERE unverified) AS unverified FROM judged GROUP BY fund, vehicle",
    "months_four_ways": f"SELECT company_id, round(date_diff('day', incorporated_on, DATE '{proxies.AS_OF}') / 30.4375::DOUBLE, 6) AS mean, ({_WHOLE})::INT AS calendar, greatest({_WHOLE}, 0)::INT AS calendar_floor, round_even(date_diff('day', incorporated_on, DATE '{proxies.AS_OF}') / 30.44::DOUBLE, 0)::INT AS rounded FROM company WHERE incorporated_on IS NOT NULL",
}
SQL = {k: f"{CTE} {v}" for k, v in SQL.items()}

_FUNDING = "CASE WHEN c.c_custkey % 5 = 0 THEN NULL WHEN c.c_acctbal < 0 THEN CAST(0.0 AS DOUBLE) ELSE c.c_acctbal * 400 END"
SQL["rescore_changed"] = f"SELECT company_id, fund, fit, edge, priority, tier, reject_reason FROM ({SQL['rescore_all'].replace(_FUNDING, f'CASE WHEN c.c_custkey % 100 = 7 THEN coalesce({_FUNDING}, 0) + 2500000 ELSE {_FUNDING} END')})"
