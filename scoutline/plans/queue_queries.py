"""The daily queue, ledgers, pivots, vetoes, run histories, budgets and tuning, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutline import config
from scoutline.functions.frames import held
from scoutline.operators import history, queue, relations, scoring
from scoutline.plans import proxies, score_queries

t = proxies.table
c = F.col
N = lambda: F.count(F.lit(1)).alias("n")


def _best(spark, sf):
    """The best score of each entity with what may block it; a veto for every thirteenth."""
    s = score_queries.scores(spark, sf)
    signal = F.exists("signal_kinds", lambda k: k.isin("grant_award", "competition_win", "press"))
    best = relations.first_of(s.withColumns({"venture_signal": signal}), ["company_id"], F.desc("priority"), "fund_ordinal")
    hard = F.coalesce(F.col("vehicle").isin(*(v["vehicle"] for v in config.VEHICLES if v["geo_rule"] == "HARD")), F.lit(False))
    ok = F.when(F.col("geography") != "uk_wide", F.lit(True))
    best = held(best.withColumns({"geo_hard": hard, "geo_ok": ok, "vetoed": c("company_id") % 13 == 0}), "geo_hard", "geo_ok", "vetoed")
    return held(best.withColumn("reason", queue.blocking_reason()).withColumnRenamed("company_id", "id"), "reason")


def queue_block_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of the first reason against each entity."""
    return _best(spark, sf).groupBy(F.coalesce("reason", F.lit("open")).alias("reason")).agg(N())


def today_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The queue of ten; entities reviewed today and blocked ones take no place."""
    reviewed = t(spark, sf, "customer").where("c_custkey % 6 = 0").select(c("c_custkey").alias("id"))
    return queue.queue(_best(spark, sf), reviewed, 10).select("id", "tier", "priority", "fund")


def fund_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Fits of all funds in one row, the best fund and the others that fit."""
    return queue.wide(score_queries.scores(spark, sf))


def evidence_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Three components of each score: the heaviest missed, the heaviest met, then by weight."""
    parts = score_queries.scores(spark, sf).select("company_id", "fund", F.posexplode("components").alias("place", "x")).select("company_id", "fund", "place", "x.key", "x.weight", "x.sub")
    return queue.ledger(parts, ["company_id", "fund"]).select("company_id", "fund", "key", "status")


def fund_leaders(spark: SparkSession, sf: str) -> DataFrame:
    """The five best of each fund, an entity with its best fund only."""
    s = score_queries.scores(spark, sf).where("tier <> 'reject'")
    own = relations.first_of(s, ["company_id"], F.desc("priority"), "fund_ordinal")
    return relations.first_of(own, ["fund"], F.desc("priority"), "company_id", k=5).select("fund", "company_id", "priority")


def needs_review(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with open questions and all their reasons."""
    s = score_queries.scores(spark, sf).select("company_id", F.explode("flags").alias("flag")).distinct()
    return s.groupBy("company_id").agg(F.array_join(F.array_sort(F.collect_list("flag")), " · ").alias("reasons"))


def vetoes(spark: SparkSession, sf: str) -> DataFrame:
    """Cards whose wording is of no early lead."""
    words = F.expr("CASE c_custkey % 9 WHEN 0 THEN 'Acme files for IPO' WHEN 1 THEN 'closes Series C' WHEN 2 THEN 'a portfolio company of X' WHEN 3 THEN 'pre-IPO talk' ELSE 'an early Series A' END")
    city, geo = F.expr("CASE c_custkey % 4 WHEN 0 THEN ' Oxford' WHEN 1 THEN 'Leeds' END"), F.when(c("c_custkey") % 3 == 0, "yorkshire").otherwise("uk_wide")
    return t(spark, sf, "customer").select("c_custkey", queue.veto(words, c("c_custkey") % 17 == 0, city, geo).alias("veto"))


def _health(spark, sf):
    return proxies.source_days(spark, sf).withColumn("status", F.when((F.dayofmonth("day") % 9 == 0) & (c("source") == "click"), "failed").otherwise("ok"))


def source_health(spark: SparkSession, sf: str) -> DataFrame:
    """Last run, last success, mean of the last seven days without failed ones, streak of empty runs."""
    return history.health(_health(spark, sf))


def status_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the newest runs of each source in a row were empty or failed."""
    bad = _health(spark, sf).withColumn("bad", (c("items") == 0) | (c("status") == "failed"))
    return history.leading_streak(bad, "source", "day", c("bad"))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with what they found and the names of the sources that failed or gave nothing."""
    d = _health(spark, sf)
    failed = F.array_sort(F.collect_list(F.when((c("status") == "failed") | (c("items") == 0), c("source"))))
    return d.groupBy("day").agg(F.sum("items").alias("items"), F.array_join(failed, ", ").alias("failed"))


def last_good_run(spark: SparkSession, sf: str) -> DataFrame:
    return _health(spark, sf).groupBy("source").agg(F.max(F.when((c("status") == "ok") & (c("items") > 0), c("day"))).alias("last_good"), F.max("day").alias("last"))


def budget_passes(spark: SparkSession, sf: str) -> DataFrame:
    """Three passes over a work queue: a third of the budget at most for each of the first two, the rest for the last."""
    work = t(spark, sf, "documents").select("source", "doc_id", "n_chars", F.pmod("doc_id", F.lit(3)).cast("int").alias("step"))
    return history.budgeted(work, "source", "step", "doc_id", "n_chars", 60_000)


def kind_list(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of each entity's signals in the order of their first appearance."""
    first = proxies.signals(spark, sf).groupBy("company_id", "kind").agg(F.min(F.struct("occurred_on", "signal_id")).alias("at"))
    return first.groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]), " · ").alias("kinds"))


def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 at every threshold that changes the shortlist, thirty at most, evenly spread."""
    s = t(spark, sf, "documents").select(c("doc_id").alias("id"), (F.least(F.floor(c("n_chars") / 40), F.lit(120)) - 5).cast("double").alias("fit"))
    labels = t(spark, sf, "labels").where("quality is not null").select(c("doc_id").alias("id"), (c("quality") == 1).alias("good"))
    return relations.threshold_metrics(s, labels, 30)


def weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """What each weight of an attribute does to the number of entities above the fit of the shortlist."""
    base = scoring.with_fit(score_queries.base(spark, sf)).select("company_id", F.explode("fits").alias("f")).where("f.fund = 'northstar'").select("company_id", "f.components")
    return relations.weight_sweep(base, "company_id", config.ATTRIBUTES, (1, 2, 3, 4), config.SHORTLIST_FIT)


def signals_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Children of an entity as a list in its row, newest first."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_date("occurred_on")).alias("d"), (-c("signal_id")).alias("s"), "kind"))), lambda x: x["kind"])
    nested = proxies.signals(spark, sf).groupBy("company_id").agg(kids.alias("kinds"))
    return t(spark, sf, "customer").select(c("c_custkey").alias("company_id")).join(nested, "company_id", "left").select("company_id", F.coalesce(F.size("kinds"), F.lit(0)).alias("n"), F.array_join(F.slice(F.coalesce("kinds", F.array().cast("array<string>")), 1, 3), ",").alias("newest"))


def work_order(spark: SparkSession, sf: str) -> DataFrame:
    """A work queue: entities with a signal first, then the newest, then the smaller id; the first twenty."""
    signalled = proxies.signals(spark, sf).where("kind = 'grant_award'").select("company_id").distinct().withColumn("has", F.lit(1))
    last = proxies.signals(spark, sf).groupBy("company_id").agg(F.max("occurred_on").alias("newest"))
    return last.join(signalled, "company_id", "left").orderBy(F.coalesce("has", F.lit(0)).desc(), F.desc("newest"), "company_id").limit(20).select("company_id", F.col("has").isNotNull().alias("signalled"), "newest")


def name_search(spark: SparkSession, sf: str) -> DataFrame:
    """Names that hold a word in any case: an equal one first, then the shorter."""
    rank = F.row_number().over(Window.orderBy((F.lower("p_name") != "red").cast("int"), F.length("p_name"), "p_name"))
    names = t(spark, sf, "part").where(c("p_name").ilike("%red%")).select("p_name").distinct().orderBy((F.lower("p_name") != "red").cast("int"), F.length("p_name"), "p_name").limit(10)
    return names.withColumn("rank", rank)


def undated_kept(spark: SparkSession, sf: str) -> DataFrame:
    """A recency filter that keeps what has no date."""
    df = proxies.companies(spark, sf)
    return df.where(c("incorporated_on").isNull() | (c("incorporated_on") >= F.lit("2000-01-01").cast("date"))).select("company_id", c("incorporated_on").alias("on"))


def links_only(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with a web source that is not the register; a computed key marks those already seen."""
    s = proxies.signals(spark, sf).where(c("source_url").rlike("^https?://") & ~F.contains("source_url", F.lit("register")))
    seen = t(spark, sf, "customer").where("c_custkey % 9 = 0").select(F.concat(F.lit("seen:"), c("c_custkey").cast("string")).alias("key"))
    return s.select("company_id").distinct().withColumn("key", F.concat(F.lit("seen:"), c("company_id").cast("string"))).join(seen, "key", "left_anti").select("company_id")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "N"}

CTE = score_queries.CTE
_SIG = "(" + proxies.duck(proxies.SIGNAL) + ")"
_D = "(SELECT *, CASE WHEN date_part('day', day) % 9 = 0 AND source = 'click' THEN 'failed' ELSE 'ok' END AS status FROM (" + proxies.duck(proxies.SOURCE_DAY) + "))"
_ORD = "CASE fund " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(config.FUNDS)) + " END"
_HARD = ", ".join(f"'{v['vehicle']}'" for v in config.VEHICLES if v["geo_rule"] == "HARD")
_BESTSQL = f"""{CTE}, b AS (SELECT s.*, e.ordinal, e.signal FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY priority DESC, {_ORD}) AS rn FROM scored) s JOIN edged e USING (company_id) WHERE rn = 1),
q AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN route = 'registry' AND contains(flags, 'age_unknown') THEN 'age_unknown' WHEN trim(replace(flags, 'age_unknown', ''), ',') <> '' THEN split_part(trim(replace(flags, 'age_unknown', ''), ','), ',', 1)
  WHEN route = 'registry' AND NOT (signal IN ('grant_award', 'competition_win', 'press')) THEN 'registry_without_venture_signal' WHEN coalesce(route, '') <> 'registry' AND contains(flags, 'age_unknown') AND (ordinal IS NULL OR ordinal > 2) THEN 'maturity_unknown'
  WHEN vehicle IN ({_HARD}) AND (geography IS NULL OR geography = 'uk_wide') THEN 'geography_unverified' WHEN company_id % 13 = 0 THEN 'vetoed' END AS reason FROM b)"""
_STREAK = f"(SELECT source, coalesce(min(rn) FILTER (WHERE items <> 0), count(*) + 1) - 1 AS streak, max(day) AS last FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS rn FROM {_D}) GROUP BY source)"
SQL = {
    "queue_block_reasons": f"{_BESTSQL} SELECT coalesce(reason, 'open') AS reason, count(*) AS n FROM q GROUP BY 1",
    "today_queue": f"{_BESTSQL} SELECT company_id AS id, tier, priority, fund FROM q WHERE reason IS NULL AND tier <> 'reject' AND company_id % 6 <> 0 ORDER BY tier <> 'shortlist', priority DESC, company_id LIMIT 10",
    "fund_pivot": f"{CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY tier = 'reject', priority DESC, {_ORD}) AS rn FROM scored) SELECT company_id, " + ", ".join(f"max(fit) FILTER (WHERE fund = '{f}') AS fit_{f}" for f in config.FUNDS) + ", max(fund) FILTER (WHERE rn = 1 AND tier <> 'reject') AS best, coalesce(string_agg(fund, ' · ' ORDER BY rn) FILTER (WHERE rn > 1 AND tier <> 'reject'), '') AS also FROM r GROUP BY company_id",
    "evidence_ledger": f"""{CTE}, g AS (SELECT c.company_id, c.fund, c.key, c.place, c.weight, CASE WHEN raw / 4.0 >= 0.6 THEN 'met' WHEN raw / 4.0 <= 0.34 THEN 'missed' ELSE 'partial' END AS status FROM component c JOIN scored s ON s.company_id = c.company_id AND s.fund = c.fund WHERE s.gate IS NULL AND raw IS NOT NULL),
h AS (SELECT *, CASE WHEN status IN ('met', 'missed') AND row_number() OVER (PARTITION BY company_id, fund, status ORDER BY weight DESC, place) = 1 THEN 0 ELSE 1 END AS seat FROM g) SELECT company_id, fund, key, status FROM h QUALIFY row_number() OVER (PARTITION BY company_id, fund ORDER BY seat, weight DESC, place) <= 3""",
    "fund_leaders": f"{CTE}, o AS (SELECT * FROM scored WHERE tier <> 'reject' QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY priority DESC, {_ORD}) = 1) SELECT fund, company_id, priority FROM o QUALIFY row_number() OVER (PARTITION BY fund ORDER BY priority DESC, company_id) <= 5",
    "needs_review": f"{CTE} SELECT company_id, string_agg(flag, ' · ' ORDER BY flag) AS reasons FROM (SELECT DISTINCT company_id, unnest(string_split(flags, ',')) AS flag FROM scored WHERE flags <> '') GROUP BY company_id",
    "vetoes": rf"SELECT c_custkey, CASE WHEN k IN (0, 3) THEN 'ipo' WHEN k = 1 THEN 'late_stage' WHEN c_custkey % 17 = 0 OR k = 2 THEN 'already_backed' WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'geography_mismatch' END AS veto FROM (SELECT *, c_custkey % 9 AS k FROM customer)",
    "source_health": f"SELECT h.source, s.last AS last_run, last_ok AS last_success, items, status, round(coalesce(mean, 0), 2) AS average_7d, streak::BIGINT AS zero_streak FROM {_D} h JOIN {_STREAK} s ON s.source = h.source AND s.last = h.day LEFT JOIN (SELECT source, max(day) AS last_ok FROM {_D} WHERE status = 'ok' AND items > 0 GROUP BY 1) o ON o.source = h.source LEFT JOIN (SELECT d.source, avg(items) AS mean FROM {_D} d JOIN {_STREAK} s ON s.source = d.source WHERE status <> 'failed' AND day >= s.last - 7 AND day < s.last GROUP BY 1) m ON m.source = h.source",
    "status_streaks": f"SELECT source, (coalesce(min(rn) FILTER (WHERE NOT (items = 0 OR status = 'failed')), count(*) + 1) - 1)::BIGINT AS streak FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS rn FROM {_D}) GROUP BY 1",
    "run_log": f"SELECT day, sum(items)::BIGINT AS items, coalesce(string_agg(source, ', ' ORDER BY source) FILTER (WHERE status = 'failed' OR items = 0), '') AS failed FROM {_D} GROUP BY day",
    "last_good_run": f"SELECT source, max(day) FILTER (WHERE status = 'ok' AND items > 0) AS last_good, max(day) AS last FROM {_D} GROUP BY 1",
    "budget_passes": """WITH w AS (SELECT source, doc_id, n_chars, (doc_id % 3)::INT AS step FROM documents), r AS (SELECT *, sum(n_chars) OVER (PARTITION BY source, step ORDER BY doc_id) AS spent FROM w), a AS (SELECT * FROM r WHERE step < 2 AND spent <= 20000),
u AS (SELECT source, sum(n_chars) AS used FROM a GROUP BY 1) SELECT source, step, doc_id, spent::BIGINT AS spent FROM a UNION ALL SELECT r.source, step, doc_id, spent::BIGINT FROM r LEFT JOIN u USING (source) WHERE step = 2 AND spent <= 60000 - coalesce(used, 0)""",
    "kind_list": f"SELECT company_id, string_agg(kind, ' · ' ORDER BY first_at) AS kinds FROM (SELECT company_id, kind, min((occurred_on, signal_id)) AS first_at FROM {_SIG} GROUP BY ALL) GROUP BY 1",
    "threshold_metrics": """WITH s AS (SELECT doc_id AS id, (least(floor(n_chars / 40), 120) - 5)::DOUBLE AS fit FROM documents), f AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT greatest(0, least(100, floor(fit)))::INT AS t FROM s)),
p AS (SELECT DISTINCT t FROM f WHERE n <= 30 OR i IN (SELECT round_even(x * (n - 1) / 29.0, 0) FROM range(0, 30) r(x))), l AS (SELECT fit, quality = 1 AS good FROM s JOIN labels ON doc_id = id WHERE quality IS NOT NULL),
m AS (SELECT t, count(*) FILTER (WHERE fit >= t AND good) AS tp, count(*) FILTER (WHERE fit >= t AND NOT good) AS fp, count(*) FILTER (WHERE fit < t AND good) AS fn FROM p, l GROUP BY t)
SELECT t AS threshold, (SELECT count(*) FROM s WHERE fit >= t) AS would_shortlist, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM m""",
    "weight_sweep": f"{CTE}, x AS (SELECT a.attribute, w.w, c.company_id, 100.0 * sum(coalesce(raw / 4.0, 0) * CASE WHEN key = a.attribute THEN w.w ELSE weight END) / sum(CASE WHEN key = a.attribute THEN w.w ELSE weight END) AS fit FROM component c, (SELECT unnest(['stage', 'sector', 'geography', 'founder_signal', 'traction_signal']) AS attribute) a, (SELECT unnest([1, 2, 3, 4]) AS w) w WHERE fund = 'northstar' GROUP BY ALL) SELECT attribute, w AS weight, count(*) FILTER (WHERE round_even(fit, 1) >= {config.SHORTLIST_FIT}) AS above FROM x GROUP BY ALL",
    "signals_nested": f"SELECT c_custkey AS company_id, coalesce(n, 0)::INT AS n, coalesce(newest, '') AS newest FROM customer LEFT JOIN (SELECT company_id, count(*) AS n, array_to_string(list(kind ORDER BY occurred_on DESC, signal_id DESC)[1:3], ',') AS newest FROM {_SIG} GROUP BY 1) s ON s.company_id = c_custkey",
    "work_order": f"SELECT company_id, coalesce(bool_or(kind = 'grant_award'), FALSE) AS signalled, max(occurred_on) AS newest FROM {_SIG} GROUP BY 1 ORDER BY signalled DESC, newest DESC, company_id LIMIT 20",
    "name_search": "SELECT p_name, row_number() OVER (ORDER BY lower(p_name) <> 'red', length(p_name), p_name)::INT AS rank FROM (SELECT DISTINCT p_name FROM part WHERE p_name ILIKE '%red%') ORDER BY rank LIMIT 10",
    "undated_kept": "SELECT company_id, incorporated_on AS on FROM (" + proxies.duck(proxies.COMPANY) + ") WHERE incorporated_on IS NULL OR incorporated_on >= DATE '2000-01-01'",
    "links_only": f"SELECT DISTINCT company_id FROM {_SIG} WHERE regexp_matches(source_url, '^https?://') AND NOT contains(source_url, 'register') AND company_id % 9 <> 0",
}
