"""Joins, aggregates, windows, sets, state, identity, text and stream queries over the proxies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutline.functions import identity as ident
from scoutline.functions.frames import stored
from scoutline.operators import grounding, history, intake, relations, resolve, text
from scoutline.plans import proxies
from scoutline.plans.identity_queries import _KEYED, _PLACEHOLDER
from scoutline.streaming import state
from scoutline.streaming import windows as stream

t = proxies.table
DAY = F.to_date
N = lambda: F.count(F.lit(1)).alias("n")


def _labels(spark, sf):
    return t(spark, sf, "labels").where("quality is not null").select("doc_id", "quality")


def _doc_scores(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "source", (F.least(F.floor(F.col("n_chars") / 40), F.lit(120)) - 5).cast("int").alias("fit"))


def shortlist_join(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(t(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


def source_yield_left_join(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = t(spark, sf, "documents").select("doc_id", "source"), _labels(spark, sf)
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(F.countDistinct("doc_id").alias("found"), F.coalesce(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)), F.lit(0)).alias("good"))


def has_signal_exists(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey").join(proxies.signals(spark, sf).where("kind = 'grant_award'").select(F.col("company_id").alias("c_custkey")), "c_custkey", "left_semi")


def not_reviewed_anti(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


def latest_run_scalar(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").withColumn("day", DAY("ts"))
    last = e.agg(F.max("day").alias("day"))
    return e.join(F.broadcast(last), "day", "left_semi").groupBy("day", "event_type").agg(N())


def best_score_self_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that reach the largest amount of their customer; ties stay."""
    best = F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    return t(spark, sf, "orders").withColumn("best", best).where("o_totalprice = best").select("o_custkey", "o_orderkey", "o_totalprice")


def latest_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    return relations.first_of(proxies.signals(spark, sf), ["company_id"], F.desc("occurred_on"), F.desc("signal_id")).select("company_id", "signal_id", "kind", "occurred_on")


def top_k_signals_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    return relations.first_of(proxies.signals(spark, sf), ["company_id"], F.desc("amount_gbp"), "signal_id", k=3).select("company_id", "signal_id", "amount_gbp")


def preferred_source_row(spark: SparkSession, sf: str) -> DataFrame:
    register = F.col("source_url").contains("register").cast("int")
    return relations.first_of(proxies.signals(spark, sf), ["company_id"], register, F.desc("occurred_on"), F.desc("signal_id")).select("company_id", "source_url")


def count_distinct_entities(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.signals(spark, sf).groupBy("kind").agg(F.countDistinct("company_id").alias("entities"), N())


def run_funnel(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").groupBy(DAY("ts").alias("day")).agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "click", "signup", "purchase", "error")))
    return e.withColumn("survivors", F.greatest(F.col("view") - F.col("error"), F.lit(0).cast("long")))


def stale_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = proxies.source_days(spark, sf).groupBy("source").agg(F.sum("items").alias("items"), F.count_if(F.col("items") == 0).alias("zero_days"), F.round(F.avg("items"), 6).alias("mean"))
    return d.where("zero_days > 0")


def duplicate_audit(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").groupBy("p_name", "p_brand").agg(N()).where("n > 1")


def monthly_spend(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(N(), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"))


def median_amount(spark: SparkSession, sf: str) -> DataFrame:
    return relations.exact_median(t(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select("o_orderpriority", F.round("median", 4).alias("median"))


def label_confusion(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.when(F.col("fit") >= 70, "shortlist").when(F.col("fit") >= 45, "watchlist").otherwise("reject")
    return _doc_scores(spark, sf).join(_labels(spark, sf), "doc_id").groupBy(tier.alias("tier"), "quality").agg(N())


def press_count_recompute(spark: SparkSession, sf: str) -> DataFrame:
    press = proxies.signals(spark, sf).where("kind in ('press', 'news_mention')").groupBy("company_id").agg(N())
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("company_id")).join(press, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0)).alias("press_count"))


def calendar_pivot(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").withColumn("day", DAY("ts"))
    return e.groupBy("day").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


def zero_streak(spark: SparkSession, sf: str) -> DataFrame:
    return history.leading_zero_streak(proxies.source_days(spark, sf))


def silent_break_alert(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that went quiet against the mean of the week before the silence."""
    return history.breaks(proxies.source_days(spark, sf).withColumn("status", F.lit("ok")), streak_days=5)


def trailing_7_average(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("day").rowsBetween(-6, 0)
    zero3 = F.sum("items").over(Window.partitionBy("source").orderBy("day").rowsBetween(-2, 0)) == 0
    return proxies.source_days(spark, sf).select("source", "day", F.round(F.avg("items").over(w), 6).alias("mean7"), zero3.alias("zero3"))


def range_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return history.ranges(t(spark, sf, "labels").select("doc_id").distinct(), "doc_id")


def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: documents in id order while their running cost stays within the budget."""
    return history.running(t(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars").where("spent <= 50000").select("source", "doc_id", "spent")


def snapshot_new_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the days after a snapshot that it does not have."""
    e, key = t(spark, sf, "events"), ["user_id", "event_type"]
    before, after = (e.where(x).select(*key).distinct() for x in ("ts < timestamp '2024-01-02'", "ts >= timestamp '2024-01-02'"))
    return after.join(before, key, "left_anti")


def officers_union(spark: SparkSession, sf: str) -> DataFrame:
    a = t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    return a.unionByName(t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))).distinct()


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return relations.threshold_sweep(_doc_scores(spark, sf), _labels(spark, sf))


def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    return relations.first_of(proxies.signals(spark, sf), ["company_id", "kind", "source_url"], "signal_id").select("company_id", "kind", "source_url", "signal_id")


def upsert_keep_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.signals(spark, sf).groupBy("company_id", "source_url").agg(F.min("occurred_on").alias("first_seen"), F.max("occurred_on").alias("last_seen"))


def minimal_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 10 <> 1").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 2, "NEW").otherwise(F.col("c_mktsegment")))
    return relations.keyed_diff(c.where("c_custkey % 10 <> 3"), new, ["c_custkey"])


def merge_fold_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one winner folded: first known value by id, largest flag, summed count, date range."""
    o = t(spark, sf, "orders").withColumn("known", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return o.groupBy("o_custkey").agg(F.min_by("known", F.when(F.col("known").isNotNull(), F.col("o_orderkey"))).alias("priority"), F.max(F.col("o_orderstatus") == "F").alias("any_f"), N(), F.min(DAY("o_orderdate")).alias("first_on"), F.max(DAY("o_orderdate")).alias("last_on"))


def provenance_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return relations.resolve_provenance(proxies.signals(spark, sf))


def norm_name_key(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", ident.norm_name(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " & Co. Ltd").when(F.col("p_partkey") % 3 == 1, "  GROUP-plc").otherwise(""))).alias("norm"))


def norm_registry_number(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.when(F.col("c_custkey") % 3 == 0, "sc ").otherwise(""), F.col("c_custkey").cast("string"))
    return t(spark, sf, "customer").select("c_custkey", ident.registry_number(raw).alias("number"))


def parse_money(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "£").otherwise("$"), F.format_string("%d", F.floor("o_totalprice")), F.when(F.col("o_orderkey") % 5 == 0, "k").when(F.col("o_orderkey") % 5 == 1, " million").otherwise(""))
    amount, currency = ident.money(raw)
    return t(spark, sf, "orders").select("o_orderkey", amount.alias("amount"), currency.alias("currency"))


def host_of_url(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", ident.host(F.col("url")).alias("host"))


def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def near_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that agree in a thousand characters behind the first two hundred; shorter texts have no key."""
    long = F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 200
    return t(spark, sf, "documents").where(long).groupBy(text.near_copy_key(F.col("text")).alias("key")).agg(N(), F.min("doc_id").alias("first_id")).where("n > 1")


def verbatim_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that holds a whole benchmark passage word for word."""
    texts = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    quotes = t(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return grounding.grounded(texts, quotes).select(F.col("quote_id").alias("item_id"), F.col("id").alias("doc_id"))


def quote_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages that stand in a document as a whole, across lines and inside them."""
    texts = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    quotes = t(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return grounding.grounded(texts, quotes).groupBy(F.col("quote_id").alias("item_id")).agg(F.countDistinct("id").alias("n"))


def prefilter_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade over whole documents, their first line as the title."""
    verdict = text.prefilter(F.lit(""), F.substring_index("text", "\n", 1), F.col("text"))
    return t(spark, sf, "documents").groupBy(verdict.alias("verdict")).agg(N())


def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", F.nullif(F.trim(F.regexp_extract("html", "(?i)<title[^>]*>([^<]*)</title>", 1)), F.lit("")).alias("title"))


def _norms(spark, sf):
    """Names of mentions that are no placeholders, made once: blocking reads them several times."""
    return stored(resolve.keyed(proxies.mentions(spark, sf)).where(~ident.is_placeholder(F.col("norm_key"))).select("id", F.col("norm").alias("name"), "norm_key", "tokens"))


def block_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of mentions by distinctive tokens."""
    return resolve.block(_norms(spark, sf), tokens=F.col("tokens")).select("a", "b", "shared")


def match_ladder_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.ladder(resolve.block(_norms(spark, sf), ("norm_key",), tokens=F.col("tokens"))).select("a", "b", "score", "verdict")


def stream_tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stream.tumbling(spark, f"{sf}/events.parquet")


def stream_sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stream.sliding(spark, f"{sf}/events.parquet")


def stream_new_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of a stream when they are first seen."""
    return stream.new_keys(spark, f"{sf}/events.parquet", "user_id", "event_type")


def sliding_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = F.window("ts", "2 days", "1 day")
    return t(spark, sf, "events").groupBy(w.alias("w"), "event_type").agg(N()).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    w = F.session_window("ts", "30 minutes")
    return t(spark, sf, "events").groupBy(w.alias("w"), "user_id").agg(N()).select("user_id", F.col("w.start").alias("start"), "n")


def user_silences(spark: SparkSession, sf: str) -> DataFrame:
    """Users without an event for two days, told by a stream's timers up to its watermark."""
    events = stream.events(spark, f"{sf}/events.parquet").select("at", "user_id")
    told = state.run(state.silences(events, "user_id", 2.0), stream._folder(spark))
    return told.select("key", F.col("last").cast("timestamp_ntz").alias("last"), F.col("since").cast("timestamp_ntz").alias("since"), "n")


def content_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """What requests cost by day, if equal contents are paid once in five days (a stream with state of its own)."""
    events = stream.events(spark, f"{sf}/events.parquet").select("at", "props", "value")
    rows = state.run(state.ledger(events, "props", "value", 5.0), stream._folder(spark))
    return rows.groupBy(F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.count_if("paid").alias("paid"), F.round(F.sum("cost"), 4).alias("cost"))


def intake_status(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of event as a source: rows seen, kept and dropped by the first rule that they break."""
    rules = [("too_small", F.col("value") < 5), ("night", F.hour("ts") < 6)]
    kinds = sorted(r.event_type for r in t(spark, sf, "events").select("event_type").distinct().collect())
    sources = {k: (lambda k=k: t(spark, sf, "events").where(F.col("event_type") == k)) for k in kinds}
    _, status = intake.gathered(spark, sources, rules, stream._folder(spark))
    return status.select("source", "status", "seen", "kept", F.coalesce(F.col("dropped")["too_small"], F.lit(0)).alias("too_small"), F.coalesce(F.col("dropped")["night"], F.lit(0)).alias("night"))


_SKIP = {"t", "N", "DAY"}
QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _SKIP}

_SIGNAL = "(" + proxies.duck(proxies.SIGNAL) + ")"
_SOURCE_DAY = "(" + proxies.duck(proxies.SOURCE_DAY) + ")"
_SCORES = "(SELECT doc_id, source, (least(floor(n_chars / 40), 120) - 5)::INT AS fit FROM documents)"
_STREAKS = f"(SELECT source, day, items, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS rn FROM {_SOURCE_DAY})"
_STREAK = f"(SELECT source, (coalesce(min(rn) FILTER (WHERE items <> 0), count(*) + 1) - 1)::BIGINT AS streak, count(*) AS days FROM {_STREAKS} GROUP BY source)"
_VERBATIM = "trim(regexp_replace(replace(replace(translate(nfc_normalize(text), '‘’‚‛“”„«»‐‑‒–—―−' || chr(160) || chr(8201) || chr(8239), '''''''''\"\"\"\"\"-------   '), '…', '...'), chr(8203), ''), '[\\s]+', ' ', 'g'))"
SQL = {
    "shortlist_join": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'",
    "source_yield_left_join": "SELECT source, count(DISTINCT d.doc_id) AS found, coalesce(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source",
    "has_signal_exists": f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {_SIGNAL} s WHERE s.company_id = c_custkey AND kind = 'grant_award')",
    "not_reviewed_anti": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "latest_run_scalar": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events) GROUP BY ALL",
    "best_score_self_join": "SELECT o.o_custkey, o_orderkey, o_totalprice FROM orders o JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey) b ON o.o_custkey = b.o_custkey AND o_totalprice = m",
    "latest_per_entity": f"SELECT company_id, signal_id, kind, occurred_on FROM {_SIGNAL} QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY occurred_on DESC, signal_id DESC) = 1",
    "top_k_signals_per_entity": f"SELECT company_id, signal_id, amount_gbp FROM {_SIGNAL} QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY amount_gbp DESC, signal_id) <= 3",
    "preferred_source_row": f"SELECT company_id, source_url FROM {_SIGNAL} QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY contains(source_url, 'register'), occurred_on DESC, signal_id DESC) = 1",
    "count_distinct_entities": f"SELECT kind, count(DISTINCT company_id) AS entities, count(*) AS n FROM {_SIGNAL} GROUP BY kind",
    "run_funnel": "SELECT *, greatest(\"view\" - error, 0) AS survivors FROM (SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'view') AS \"view\", count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1)",
    "stale_sources": f"SELECT source, sum(items)::BIGINT AS items, count(*) FILTER (WHERE items = 0) AS zero_days, round(avg(items), 6) AS mean FROM {_SOURCE_DAY} GROUP BY source HAVING count(*) FILTER (WHERE items = 0) > 0",
    "duplicate_audit": "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1",
    "monthly_spend": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spend FROM orders GROUP BY 1",
    "median_amount": "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1",
    "label_confusion": f"SELECT CASE WHEN fit >= 70 THEN 'shortlist' WHEN fit >= 45 THEN 'watchlist' ELSE 'reject' END AS tier, quality, count(*) AS n FROM {_SCORES} JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL",
    "press_count_recompute": f"SELECT c_custkey AS company_id, coalesce(n, 0) AS press_count FROM customer LEFT JOIN (SELECT company_id, count(*) AS n FROM {_SIGNAL} WHERE kind IN ('press', 'news_mention') GROUP BY 1) s ON s.company_id = c_custkey",
    "calendar_pivot": "SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS \"view\" FROM events GROUP BY 1",
    "zero_streak": f"SELECT source, streak FROM {_STREAK}",
    "silent_break_alert": f"""WITH d AS (SELECT *, 'ok' AS status FROM {_SOURCE_DAY}), k AS (SELECT source, coalesce(min(rn) FILTER (WHERE items <> 0), count(*) + 1) - 1 AS streak, max(day) AS last FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS rn FROM d) GROUP BY source)
SELECT k.source, streak::BIGINT AS streak, round(coalesce(mean, 0), 6) AS average, d.items = 0 AND coalesce(mean, 0) >= 2 AS warning, d.items = 0 AND streak >= 5 AND coalesce(mean, 0) > 2 AS alert FROM k JOIN d ON d.source = k.source AND d.day = k.last
LEFT JOIN (SELECT k.source, avg(items) AS mean FROM k JOIN d ON d.source = k.source WHERE day >= last - greatest(streak - 1, 0)::INT - 7 AND day < last - greatest(streak - 1, 0)::INT GROUP BY 1) m ON m.source = k.source""",
    "trailing_7_average": f"SELECT source, day, round(avg(items) OVER (PARTITION BY source ORDER BY day ROWS 6 PRECEDING), 6) AS mean7, sum(items) OVER (PARTITION BY source ORDER BY day ROWS 2 PRECEDING) = 0 AS zero3 FROM {_SOURCE_DAY}",
    "range_coalesce": "SELECT min(doc_id) AS first, max(doc_id) AS last, count(*) AS n FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS island FROM (SELECT DISTINCT doc_id FROM labels)) GROUP BY island",
    "budget_prefix": "SELECT source, doc_id, spent::BIGINT AS spent FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents) WHERE spent <= 50000",
    "snapshot_new_ids": "SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < TIMESTAMP '2024-01-02')",
    "officers_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "threshold_sweep": f"""WITH points AS (SELECT DISTINCT greatest(0, least(100, fit)) AS threshold FROM {_SCORES}), s AS (SELECT fit, quality FROM {_SCORES} JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
c AS (SELECT threshold, count(*) FILTER (WHERE fit >= threshold AND quality = 1) AS tp, count(*) FILTER (WHERE fit >= threshold AND quality = 0) AS fp, count(*) FILTER (WHERE fit < threshold AND quality = 1) AS fn FROM points, s GROUP BY threshold)
SELECT threshold, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
    "insert_or_ignore": f"SELECT company_id, kind, source_url, min(signal_id) AS signal_id FROM {_SIGNAL} GROUP BY ALL",
    "upsert_keep_first_seen": f"SELECT company_id, source_url, min(occurred_on) AS first_seen, max(occurred_on) AS last_seen FROM {_SIGNAL} GROUP BY ALL",
    "minimal_diff": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'delete' WHEN c_custkey % 10 = 3 THEN 'insert' ELSE 'update' END AS change FROM customer WHERE c_custkey % 10 IN (1, 3) OR (c_custkey % 10 = 2 AND c_mktsegment <> 'NEW')",
    "merge_fold_columns": "SELECT o_custkey, arg_min(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END) AS priority, bool_or(o_orderstatus = 'F') AS any_f, count(*) AS n, min(o_orderdate::DATE) AS first_on, max(o_orderdate::DATE) AS last_on FROM orders GROUP BY 1",
    "provenance_resolve": f"""SELECT company_id, kind AS value, trail FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY company_id) AS trail FROM (SELECT *, CASE kind WHEN 'share_issue' THEN 100 WHEN 'grant_award' THEN 80 WHEN 'spinout' THEN 65 WHEN 'press' THEN 40 ELSE 10 END AS trust FROM {_SIGNAL})
WINDOW w AS (PARTITION BY company_id ORDER BY trust DESC, occurred_on DESC, signal_id DESC)) WHERE rn = 1""",
    "norm_name_key": r"""SELECT p_partkey, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' & Co. Ltd' WHEN p_partkey % 3 = 1 THEN '  GROUP-plc' ELSE '' END), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')), '^the ', ''), '( (ltd|limited|plc|llp|lp|llc|cic|cio|inc|incorporated|corp|corporation|co|company|gmbh|ag|sa|sas|sarl|bv|nv|ab|oy|as|aps|srl|spa|pty))+$', '') AS norm FROM part""",
    "norm_registry_number": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'SC' || lpad(c_custkey::VARCHAR, 6, '0') ELSE lpad(c_custkey::VARCHAR, 8, '0') END AS number FROM customer",
    "parse_money": "SELECT o_orderkey, floor(o_totalprice) * CASE WHEN o_orderkey % 5 = 0 THEN 1e3 WHEN o_orderkey % 5 = 1 THEN 1e6 ELSE 1 END AS amount, CASE WHEN o_orderkey % 2 = 0 THEN 'GBP' ELSE 'USD' END AS currency FROM orders",
    "host_of_url": r"SELECT page_id, nullif(split_part(split_part(split_part(split_part(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '^.*@', ''), '/', 1), '?', 1), '#', 1), ':', 1), '') AS host FROM pages",
    "json_props_extract": "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events",
    "near_dup_groups": r"SELECT sha256(substr(s, 201, 1000)) AS key, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[\t-\r ]+', ' ', 'g')) AS s FROM documents) WHERE length(s) > 200 GROUP BY 1 HAVING count(*) > 1",
    "verbatim_grounding": f"SELECT item_id, doc_id FROM (SELECT doc_id, {_VERBATIM} AS text FROM documents) d JOIN (SELECT item_id, {_VERBATIM} AS quote FROM benchmark) q ON contains(d.text, q.quote) WHERE length(quote) >= 12",
    "quote_grounding": f"SELECT item_id, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, {_VERBATIM} AS text FROM documents) d JOIN (SELECT item_id, {_VERBATIM} AS quote FROM benchmark) q ON contains(d.text, q.quote) WHERE length(quote) >= 12 GROUP BY item_id",
    "prefilter_cascade": f"SELECT CASE WHEN regexp_matches(split_part(text, chr(10), 1), '{text.ROUNDUP}') THEN 'roundup_title' WHEN length(text) < {text.MIN_CHARS} THEN 'too_short' WHEN NOT regexp_matches(left(text, {text.SIGNAL_WINDOW}), '{text.SIGNAL}') THEN 'no_signal_keyword' WHEN len(list_distinct(regexp_extract_all(text, '{text.ORGANISATION}', 1))) > {text.MAX_ORGANISATIONS} THEN 'too_many_orgs' ELSE 'ok' END AS verdict, count(*) AS n FROM documents GROUP BY 1",
    "html_title": "SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)), '') AS title FROM pages",
    "block_candidates": f"""WITH k AS MATERIALIZED {_KEYED}, x AS (SELECT id, unnest(tokens) AS token FROM k WHERE NOT {_PLACEHOLDER.replace('{k}', 'norm_key')}) SELECT x.id AS a, y.id AS b, count(*) AS shared FROM x JOIN x y ON x.token = y.token AND x.id < y.id GROUP BY ALL""",
    "stream_sliding_counts": "SELECT day::TIMESTAMP AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([ts::DATE, ts::DATE - 1]) AS day FROM events) GROUP BY ALL",
    "stream_new_keys": "SELECT DISTINCT user_id, event_type FROM events",
    "sliding_counts": "SELECT day::TIMESTAMP AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([ts::DATE, ts::DATE - 1]) AS day FROM events) GROUP BY ALL",
    "user_silences": """SELECT key, seen AS last, seen + INTERVAL 2 DAY AS since, n FROM (SELECT user_id::VARCHAR AS key, ts AS seen, lead(ts) OVER w AS next, (count(*) OVER w)::BIGINT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
WHERE coalesce(next, (SELECT max(ts) - INTERVAL 10 DAY FROM events)) >= seen + INTERVAL 2 DAY""",
    "intake_status": "SELECT event_type AS source, CASE WHEN count(*) FILTER (WHERE NOT value < 5 AND hour(ts) >= 6) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) AS seen, count(*) FILTER (WHERE NOT value < 5 AND hour(ts) >= 6) AS kept, count(*) FILTER (WHERE value < 5) AS too_small, count(*) FILTER (WHERE NOT value < 5 AND hour(ts) < 6) AS night FROM events GROUP BY 1",
    "sessions": """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session""",
    "stream_tumbling_counts": "SELECT ts::DATE::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
