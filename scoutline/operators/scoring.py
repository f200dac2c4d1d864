"""Scoring of entities against every fund: derive, gate, qualify, fit, edge, tier, explain.

One declarative pipeline without Python per row.  Unknown is never zero: a null input passes a gate with a
flag, a null sub-score earns nothing but keeps its weight in the denominator.  ``as_of`` is always an
argument.  The dimensions (fund, vehicle, matrix, importance) are fixed by the configuration and are unrolled
into the plan as text, so each rule is only the comparison that it needs; entities are never shuffled, so the plan is
one stage over the entity table.

Input columns (null where unknown): company_id, name, incorporated_on, founded_year, total_funding_gbp,
announced_stage, sector, sic_codes (array), region, country, outcode, city, hq_region,
is_spinout, spinout_university, seis_eis_qualifying, uk_exec_pct, last_round_gbp, prior_total_gbp,
valuation_gbp, on_portfolio, press_count, route, has_share_issue, max_prior_appointments, n_founders,
any_psc, signal_kinds (array), website; and, if there is one, signals (array of headline, occurred_on).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline import config
from scoutline.functions.frames import held
from scoutline.functions.ladders import band, curve, first_reason, flags, lookup, months, rounded


def stage_ordinal(stage: Column) -> Column:
    """Position in the list of stages, null for unknown ones."""
    return F.nullif(F.array_position(F.array(*map(F.lit, config.STAGES)), stage) - 1, F.lit(-1)).cast("int")


def norm_city(city: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.trim(city)), r"\s+", " ")
    return F.regexp_replace(flat, r"^(?:the )?(?:city|county) of ", "")


def city_region(city: Column) -> Column:
    return lookup(norm_city(city), config.flat(config.CITIES))


def outcode_region(outcode: Column) -> Column:
    area = F.regexp_extract(F.upper(outcode), "^[A-Z]+", 0)
    return F.when(F.coalesce(outcode, F.lit("")) != "", F.coalesce(lookup(area, config.flat(config.AREAS)), F.lit("uk_wide")))


def api_region(region: Column, country: Column) -> Column:
    return (
        F.when(region == "London", "london")
        .when(region == "North East", "north_east")
        .when(region == "Yorkshire and The Humber", "yorkshire")
        .when(country.isin("Scotland", "Wales", "Northern Ireland"), "uk_regions")
        .when(region != "", "uk_regions")
        .otherwise("uk_wide")
    )


def sector_of_codes(codes: Column) -> Column:
    """The first code that is known exactly or by its three- or two-digit prefix; other codes mean ``other``."""
    exact, prefix = config.flat(config.SECTOR_CODES), config.SECTOR_PREFIXES
    one = lambda c: F.coalesce(lookup(F.trim(c), exact), lookup(F.left(F.trim(c), F.lit(3)), prefix), lookup(F.left(F.trim(c), F.lit(2)), prefix))
    known = F.filter(F.transform(codes, one), lambda s: s.isNotNull())
    return F.when(F.size(codes) > 0, F.coalesce(F.get(known, F.lit(0)), F.lit("other")))


def with_derived(df: DataFrame, as_of: Column) -> DataFrame:
    """Fill geography, sector, stage, founder and traction signals; what is stated always wins."""
    has = lambda kind: F.array_contains("signal_kinds", kind)
    born = F.coalesce("incorporated_on", F.make_date("founded_year", F.lit(7), F.lit(1)))
    df = df.withColumns({"age_months": months(born, as_of, "mean"), "by_city": city_region(F.col("city")), "by_outcode": outcode_region(F.col("outcode"))})
    located = F.when(F.col("region").isNotNull() | F.col("country").isin(*config.UK_COUNTRIES), api_region(F.col("region"), F.col("country")))
    geography = F.coalesce("hq_region", "by_city", F.nullif("by_outcode", F.lit("uk_wide")), located, "by_outcode")
    df = df.withColumns({"geography": geography, "place": F.coalesce(F.nullif(geography, F.lit("uk_wide")), "by_city", geography), "sector": F.coalesce("sector", sector_of_codes(F.col("sic_codes")))})
    young = lambda n: F.col("age_months") <= n
    issue = F.coalesce("has_share_issue", F.lit(False))
    stage = F.when(issue & young(config.SHARE_ISSUE_PRE_SEED_MONTHS), "pre_seed").when(issue, "seed").when(young(config.IDEA_MONTHS), "idea")
    df = df.withColumn("stage", F.coalesce("announced_stage", stage))
    founder = (
        F.when(F.col("is_spinout"), "research_spinout")
        .when(F.col("max_prior_appointments") >= 1, "repeat_founder")
        .when(F.col("sector").isin(*config.TECHNICAL_SECTORS) & F.col("any_psc"), "technical_founder")
        .when(F.col("n_founders") > 0, "generalist_unclear")
    )
    traction = F.when(has("grant_award"), "clinical_grant_validation").when(has("competition_win"), "community_traction").when(F.col("stage").isin(*config.EARLY_STAGES) & ~F.col("has_share_issue"), "pre_revenue_concept")
    return df.withColumns({"founder_signal": founder, "traction_signal": traction})


def uk_presence() -> Column:
    return F.when(F.col("country").isin(*config.UK_COUNTRIES), True).when(F.col("country").isNotNull(), False).when(F.coalesce("outcode", "geography").isNotNull(), True)


def with_freshness(df: DataFrame) -> DataFrame:
    """reject_reason (first gate that fails) and gate_flags (what could not be verified up to that gate)."""
    late = F.col("stage_no") > config.STAGES.index(config.MAX_STAGE)
    reason = first_reason(
        (F.col("age_months") > config.MAX_AGE_MONTHS, "max_company_age_months"),
        (F.col("total_funding_gbp") > config.MAX_FUNDING, "max_total_funding_gbp"),
        (late, "max_stage"),
        (F.col("on_portfolio"), "already_on_vc_portfolio"),
        (~F.col("uk"), "min_uk_presence"),
    )
    df = df.withColumns({"uk": uk_presence(), "stage_no": stage_ordinal(F.col("stage"))}).withColumn("reject_reason", reason)
    unknown = F.col("reject_reason").isNull() & F.col("uk").isNull()
    df = df.withColumn("gate_flags", flags((F.col("age_months").isNull(), "age_unknown"), (unknown, "uk_unverified")))
    return held(df, "geography", "place", "sector", "stage", "stage_no", "founder_signal", "traction_signal", "age_months", "by_city", "by_outcode", "uk", "reject_reason", "gate_flags")


def qualifiers() -> Column:
    """What the record proves, in the vocabulary's order."""
    has = lambda *kinds: F.arrays_overlap("signal_kinds", F.array(*map(F.lit, kinds)))
    true = lambda c: F.coalesce(c, F.lit(False))
    return flags(
        (true(F.col("has_share_issue")) | has("share_issue"), "share_issue"),
        (has("grant_award"), "grant"),
        (true(F.col("is_spinout")) | has("spinout"), "spinout"),
        (true(F.col("press_count") > 0) | has("press", "news", "competition_win"), "press"),
        (true(F.col("max_prior_appointments") >= 1), "repeat_founder"),
        (F.col("website").isNotNull(), "website"),
    )


def admitted() -> Column:
    """Registry finds need a proof of their own; finds by any other route came with one."""
    proofs = F.size(F.array_intersect(qualifiers(), F.array(*map(F.lit, config.ADMITTING))))
    return (F.col("route").isNotNull() & (F.col("route") != "registry")) | (proofs >= config.MIN_QUALIFIERS)


def route_score(route: Column, press: Column) -> Column:
    key = F.lower(F.trim(route))
    return F.when((key == "registry") & (press > 0), config.REGISTRY_WITH_PRESS).otherwise(F.coalesce(lookup(key, config.ROUTES), F.lit(config.UNKNOWN_SUB)))


def edge_parts() -> dict[str, Column]:
    return {
        "age": curve(F.col("age_months"), config.AGE_CURVE, config.UNKNOWN_SUB),
        "press": band(F.col("press_count"), config.PRESS_BANDS, config.UNKNOWN_SUB),
        "funding": band(F.col("total_funding_gbp"), config.FUNDING_BANDS, config.UNKNOWN_SUB),
        "route": route_score(F.col("route"), F.col("press_count")),
    }


def discovery_edge() -> Column:
    parts, total = edge_parts(), sum(config.EDGE_WEIGHTS.values())
    return rounded(100 * reduce(lambda a, b: a + b, (s * F.lit(float(config.EDGE_WEIGHTS[k])) for k, s in parts.items())) / float(total), 1)


def _sql(x: object) -> str:
    """A literal of the plan's text."""
    return f"'{x}'" if isinstance(x, str) else f"{float(x)}D" if isinstance(x, float) else str(x)


def cells(attribute: str) -> str:
    """Cells of an attribute's value for all funds, in their order: null for an unknown value, zeros for a blank one."""
    places = [config.MATRIX_FUNDS.index(f) for f in config.FUNDS]
    pairs = ", ".join(f"'{v}', array({', '.join(str(marks[i]) for i in places)})" for v, marks in config.MATRIX[attribute].items())
    return f"if({attribute} is null, null, coalesce(map({pairs})[{attribute}], array({', '.join('0' * len(config.FUNDS))})))"


def with_fit(df: DataFrame, policies: dict[str, str] | None = None, assumed: dict[str, str] | None = None) -> DataFrame:
    """fits: fund, fit, coverage, raw_sum and components of every fund, as an array of structs.

    policies: what an unknown attribute does: ``neutral`` (no points, its weight counts), ``pessimistic`` (a known
    zero) or ``assume`` (the value that ``assumed`` names).
    """
    policies, assumed = policies or {}, assumed or {}
    places = [config.MATRIX_FUNDS.index(f) for f in config.FUNDS]
    raws, subs, evidence = {}, {}, {}
    df = df.withColumns({f"_{a}": F.expr(cells(a)) for a in config.ATTRIBUTES})
    labels = ", ".join(f"'{v}', '{config.label(v)}'" for marks in config.MATRIX.values() for v in marks)
    for a in config.ATTRIBUTES:
        policy = policies.get(a, "neutral")
        guess = [config.MATRIX[a].get(assumed.get(a, ""), (0, 0, 0, 0))[i] for i in places] if policy == "assume" and a in assumed else None
        title = f"initcap(replace({a}, '_', ' '))"
        known = f"coalesce(map({labels})[{a}], {title})"
        without = "'unknown (counted against)'" if policy == "pessimistic" else f"'assumed {config.label(assumed[a])}'" if guess else "'unknown'"
        evidence[a] = f"if({a} is null, {without}, {known})"
        for i, fund in enumerate(config.FUNDS):
            raw = f"_{a}[{i}]" if not guess else f"coalesce(_{a}[{i}], {guess[i]})"
            raws[a, fund] = raw
            subs[a, fund] = f"coalesce({raw} / 4D, 0D)" if policy == "pessimistic" else f"{raw} / 4D"

    def one(i: int, fund: str) -> str:
        weight = {a: config.IMPORTANCE[a][i] for a in config.ATTRIBUTES}
        points = " + ".join(f"coalesce({subs[a, fund]} * {weight[a]}D, 0D)" for a in config.ATTRIBUTES)
        known = " + ".join(f"int({subs[a, fund]} is not null)" for a in config.ATTRIBUTES)
        parts = ", ".join(f"struct('{a}' as key, {a} as value, {weight[a]} as weight, {raws[a, fund]} as raw, {subs[a, fund]} as sub, _e_{a} as evidence)" for a in config.ATTRIBUTES)
        return (
            f"struct('{fund}' as fund, {i} as fund_ordinal, bround(100 * ({points}) / {sum(weight.values())}D, 1) as fit, "
            f"bround(({known}) / {len(config.ATTRIBUTES)}D, 2) as coverage, {' + '.join(f'coalesce({raws[a, fund]}, 0)' for a in config.ATTRIBUTES)} as raw_sum, array({parts}) as components)"
        )

    df = df.withColumns({f"_e_{a}": F.expr(evidence[a]) for a in config.ATTRIBUTES})
    made = df.withColumn("fits", F.expr(f"array({', '.join(one(i, f) for i, f in enumerate(config.FUNDS))})"))
    return held(made.drop(*(f"_{a}" for a in config.ATTRIBUTES), *(f"_e_{a}" for a in config.ATTRIBUTES)), "fits")


def _geo_verdict(rule: str) -> str:
    """True, false or null (cannot tell) for one geography rule; the column place is geography refined by the stated city."""
    words = lambda xs: ", ".join(map(_sql, xs))
    starts = lambda prefixes: "(" + " or ".join(f"startswith(upper(outcode), '{p}')" for p in prefixes) + ")"
    if rule == "outside_golden_triangle":
        inside = f"coalesce({starts(config.TRIANGLE_OUTCODES)}, false) or coalesce(geography = 'london', false) or coalesce(lower(trim(city)) in ({words(config.TRIANGLE_CITIES)}), false)"
        return f"case when {inside} then false when outcode <> '' or geography <> 'uk_wide' or by_city <> 'uk_wide' then true end"
    if rule == "sunderland":
        return f"case when trim(city) <> '' then lower(trim(city)) in ({words(config.SUNDERLAND_CITIES)}) when outcode <> '' then {starts(config.SUNDERLAND_OUTCODES)} end"
    if rule == "north_england":
        return f"case when place <> 'uk_wide' then place in ({words(config.NORTH_ENGLAND)}) end"
    if rule == "uk_wide":
        return "uk"
    if rule == "uk_regions":
        return "place in ('uk_regions', 'north_east', 'yorkshire', 'uk_wide')"
    return f"case when place <> 'uk_wide' then place = '{rule}' end"


def judged(v: dict) -> tuple[str, str]:
    """Reason of the first rule of a vehicle that fails (else null), and whether some rule could not be verified."""
    rules, stage = v["rules"], config.STAGES.index
    reasons = [(f"stage_no < {stage(v['first_stage'])} or stage_no > {stage(v['last_stage'])}", "stage_range")]
    unknown = ["stage_no is null"]

    def rule(fails: str, name: str, input_is_unknown: str) -> None:
        reasons.append((fails, name))
        unknown.append(input_is_unknown)

    if v["age_cap_years"]:
        rule(f"age_months > {v['age_cap_years'] * 12}", "max_age_years", "age_months is null")
    if v["geo_rule"] == "HARD":
        geo = "(" + " or ".join(f"geo_{g}" for g in v["geo_values"]) + ")"
        rule(f"not {geo}", f"geography:{','.join(v['geo_values'])}", f"{geo} is null")
    for name, column in (("round_max", "last_round_gbp"), ("prior_total_max", "prior_total_gbp")):
        if name in rules:
            rule(f"{column} > {rules[name]}", name, f"{column} is null")
    if "uk_exec_pct_min" in rules:
        rule(f"uk_exec_pct < {rules['uk_exec_pct_min']}", "uk_exec_pct_min", "uk_exec_pct is null")
    if rules.get("requires_seis_eis"):
        excluded = f"coalesce(sector in ({', '.join(map(_sql, config.SEIS_EXCLUDED_SECTORS))}), false)"
        reasons.append((excluded, "seis_eis_excluded_trade"))
        rule("not seis_eis_qualifying", "requires_seis_eis", f"(not {excluded} and seis_eis_qualifying is null)")
    if "valuation_max" in rules:
        rule(f"valuation_gbp > {rules['valuation_max']}", "valuation_max", "valuation_gbp is null")
    if "university_spinout_required" in rules:
        school = "lower(trim(coalesce(spinout_university, '')))"
        listed = " or ".join(f"contains({school}, '{x}')" for x in rules["university_spinout_required"])
        reasons.append(("not is_spinout", "university_spinout_required"))
        rule(f"{school} <> '' and not ({listed})", "university_spinout_required", f"(is_spinout is null or (is_spinout and {school} = ''))")
    if rules.get("beyond_research_stage"):
        rule("stage = 'idea'", "beyond_research_stage", "stage is null")
    reason = "case " + " ".join(f"when {c} then '{n}'" for c, n in reasons) + " end"
    return reason, f"coalesce({' or '.join(unknown)}, false)"


def with_verdicts(df: DataFrame) -> DataFrame:
    """Append _reason_<i> and _open_<i> (could not be verified) of every active vehicle."""
    active = config.active_vehicles()
    rules = dict.fromkeys(g for v in active for g in v["geo_values"])
    df = df.withColumns({f"geo_{g}": F.expr(_geo_verdict(g)) for g in rules})
    made = {}
    for i, v in enumerate(active):
        reason, unverified = judged(v)
        made |= {f"_reason_{i}": F.expr(reason), f"_open_{i}": F.expr(unverified)}
    return held(df.withColumns(made).drop(*(f"geo_{g}" for g in rules)), *made)


def vehicle_gates(df: DataFrame) -> DataFrame:
    """Every entity with every active vehicle: fund, vehicle, vehicle_reason (null if it passes) and unverified."""
    active = config.active_vehicles()
    rows = ", ".join(f"struct('{v['fund']}' as fund, '{v['vehicle']}' as vehicle, _reason_{i} as vehicle_reason, _open_{i} as unverified)" for i, v in enumerate(active))
    hidden = [f"{x}_{i}" for i in range(len(active)) for x in ("_reason", "_open")]
    return with_verdicts(df).select("*", F.expr(f"inline(array({rows}))")).drop(*hidden)


def with_routes(df: DataFrame) -> DataFrame:
    """Append ``routes``: per fund the first eligible vehicle, and whether any eligible one is unverified."""
    active = config.active_vehicles()

    def route(fund: str) -> str:
        own = [(i, v) for i, v in enumerate(active) if v["fund"] == fund]
        first = "case " + " ".join(f"when _reason_{i} is null then '{v['vehicle']}'" for i, v in own) + " end"
        return f"struct({first} as vehicle, {' or '.join(f'(_reason_{i} is null and _open_{i})' for i, _ in own)} as unverified)"

    hidden = [f"{x}_{i}" for i in range(len(active)) for x in ("_reason", "_open")]
    return held(with_verdicts(df).withColumn("routes", F.expr(f"array({', '.join(map(route, config.FUNDS))})")).drop(*hidden), "routes")


def _tiered(strong: str, watch: str) -> tuple[str, str]:
    """Tier and its reason, from fit, edge, coverage and flags; texts are fixed."""
    thin, seen = f"fit >= {config.SHORTLIST_FIT} and coverage < {config.SHORTLIST_COVERAGE}", f"fit >= {config.SHORTLIST_FIT} and edge < {config.SHORTLIST_EDGE}"
    tier = f"case when size(flags) = 0 and {strong} then 'shortlist' when {watch} then 'watchlist' else 'reject' end"
    verify = "concat(replace(flags[0], '_', ' '), ' — verify before sending')"
    reason = (
        f"case when size(flags) > 0 and {watch} then {verify} when size(flags) > 0 then 'below fit threshold' when {strong} then '' "
        f"when {thin} then 'strong fit but too little known — needs 10 minutes of research' when {seen} then 'good fit but likely already on their radar' when {watch} then '' else 'below fit threshold' end"
    )
    return tier, reason


def rescore(companies: DataFrame, as_of: Column) -> DataFrame:
    """One row per entity and fund with fit, edge, priority, tier, vehicle, flags, reason and components.

    An entity that a freshness gate rejects has a row per fund with nothing in it but the reason and its flags; one
    without an eligible vehicle keeps its fit.  A registry find without a proof yields no row.
    """
    base = with_routes(with_fit(with_freshness(with_derived(companies, as_of)))).withColumns({"edge_all": discovery_edge(), "admitted": admitted()})
    kept = [c for c in base.columns if c not in ("fits", "routes")]
    both = base.select(*kept, F.explode(F.when(F.expr("reject_reason is not null or admitted"), F.arrays_zip("fits", "routes"))).alias("z")).selectExpr(*kept, "z.fits.*", "if(reject_reason is null, z.routes.vehicle, null) as vehicle", "z.routes.unverified as unverified")
    nothing = {"fit": "0D", "coverage": "0D", "raw_sum": "0", "components": "cast(array() as array<struct<key:string,value:string,weight:int,raw:int,sub:double,evidence:string>>)"}
    both = both.withColumns({c: F.expr(f"if(reject_reason is null, {c}, {empty})") for c, empty in nothing.items()} | {"gate": F.col("reject_reason")})
    lost = "reject_reason is not null"
    out = both.withColumn("reject_reason", F.expr("if(reject_reason is null and vehicle is null, 'no_eligible_vehicle', reject_reason)"))
    out = out.withColumns({"flags": F.expr(f"array_sort(if(not ({lost}) and coalesce(unverified, false), array_append(gate_flags, 'gate_unverified'), gate_flags))"), "edge": F.expr(f"if({lost}, 0D, edge_all)")})
    strong = f"fit >= {config.SHORTLIST_FIT} and edge >= {config.SHORTLIST_EDGE} and coverage >= {config.SHORTLIST_COVERAGE}"
    tier, reason = _tiered(strong, f"fit >= {config.WATCHLIST_FIT}")
    priority = f"bround({config.WEIGHT_FIT}D * fit + {config.WEIGHT_EDGE}D * edge, 1)"
    made = {"tier": f"if({lost}, 'reject', {tier})", "tier_reason": f"if({lost}, null, {reason})", "priority": f"if({lost}, 0D, {priority})"}
    out = out.withColumns({c: F.expr(x) for c, x in made.items()}).drop("edge_all", "unverified", "admitted")
    return held(out, *(c for c in out.columns if c not in kept or c in ("reject_reason", "vehicle")))


def components(scores: DataFrame) -> DataFrame:
    """One row per score and attribute; a score that a freshness gate emptied has none."""
    return scores.select("company_id", "fund", F.explode("components").alias("c")).select("company_id", "fund", "c.*")


def explanation(scores: DataFrame) -> DataFrame:
    """Append ``explanation``: how it was found, what matches, what is against, what is unknown, the route and the caveats."""
    parts = F.col("components")
    pts = lambda c: 100.0 * c["weight"] * c["sub"] / F.aggregate(parts, F.lit(0), lambda a, x: a + x["weight"])
    place = lambda c: F.array_position(F.transform(parts, lambda x: x["key"]), c["key"])  # noqa: E731  ties keep their order
    order = lambda key: lambda a, b: F.when(key(a) > key(b), -1).when(key(a) < key(b), 1).when(place(a) < place(b), -1).otherwise(1)
    top = lambda keep, key, n: F.slice(F.array_sort(F.filter(parts, keep), order(key)), 1, n)
    name = lambda c: F.replace(c["key"], F.lit("_"), F.lit(" "))
    whole = lambda x: F.format_string("%d", F.bround(x, 0).cast("long"))
    scores = scores.withColumns({"_p": top(lambda c: c["sub"] >= config.POSITIVE_AT, pts, 3), "_n": top(lambda c: c["sub"] <= config.NEGATIVE_AT, lambda c: c["weight"] * (1 - c["sub"]), 2), "_u": top(lambda c: c["sub"].isNull(), lambda c: c["weight"], 2)})
    scores = held(scores, "_p", "_n", "_u")
    clause = lambda head, items, cut="; ", tail=F.lit(""): F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, cut), tail))
    total = F.aggregate("_p", F.lit(0.0), lambda a, c: a + pts(c))
    routes = F.expr("map(" + ", ".join(f"'{v['vehicle']}', '{v['name']} ({config.cheque_label(*v['cheque'])})'" for v in config.VEHICLES) + ")")
    found = None
    if "signals" in scores.columns:
        said = F.transform(F.slice("signals", 1, 2), lambda s: F.concat(s["headline"], F.coalesce(F.concat(F.lit(" ("), s["occurred_on"].cast("string"), F.lit(")")), F.lit(""))))
        found = clause("Found via ", said)
    body = F.concat_ws(
        ". ",
        *([found] if found is not None else []),
        clause("Matches on ", F.transform("_p", lambda c: F.concat(name(c), F.lit(" ("), c["evidence"], F.lit(", +"), whole(pts(c)), F.lit("pts)"))), "; ", F.concat(F.lit(" — "), whole(total), F.lit(" of "), whole(F.col("fit")), F.lit(" total"))),
        clause("Against: ", F.transform("_n", lambda c: F.concat(name(c), F.lit(" ("), c["evidence"], F.lit(")")))),
        clause("Unknown: ", F.transform("_u", name), ", "),
        F.concat(F.lit("Route to "), routes[F.col("vehicle")]),
        F.when(F.col("edge") >= config.LOW_VISIBILITY_EDGE, "Low visibility — no coverage found in our tracked sources"),
        F.when(F.col("coverage") < config.COVERAGE_NOTE_BELOW, F.concat(F.lit("Only "), whole(100 * F.col("coverage")), F.lit("% of criteria could be assessed"))),
        F.nullif("tier_reason", F.lit("")),
    )
    scores = held(scores.withColumn("_body", body), "_body")
    unsaid = F.filter(F.transform("flags", lambda f: F.replace(f, F.lit("_"), F.lit(" "))), lambda f: ~F.contains(F.lower("_body"), f))
    text = F.concat(F.concat_ws(". ", "_body", F.when(F.size(unsaid) > 0, F.concat(F.lit("⚠ "), F.array_join(unsaid, ", ")))), F.lit("."))
    age = F.bround("age_months", 0).cast("long")
    detail = (
        F.when(F.col("gate") == "max_company_age_months", F.concat(F.format_string("%d month", age), F.when(age == 1, "").otherwise("s"), F.lit(" old")))
        .when(F.col("gate") == "max_total_funding_gbp", F.concat(F.lit("£"), F.format_number(F.bround("total_funding_gbp", 0), 0), F.lit(" raised")))
        .when(F.col("gate") == "max_stage", F.concat(F.lit("stage "), F.col("stage")))
        .when(F.col("gate") == "already_on_vc_portfolio", "found on a tracked VC portfolio page")
        .otherwise("not a UK company")
    )
    out = F.when(F.col("gate").isNotNull(), F.concat(F.lit("Rejected: "), "gate", F.lit(" ("), detail, F.lit(").")))
    out = out.when(F.col("vehicle").isNull(), "Rejected: no eligible vehicle — every hard rule failed.").otherwise(text)
    return scores.withColumn("explanation", out).drop("_p", "_n", "_u", "_body")
