"""Changes of tables, merges and registry records over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.functions import identity as ident
from scoutline.functions.frames import stored
from scoutline.operators import lifecycle, registry
from scoutline.plans import proxies

t = proxies.table
c = F.col

#: Registry answers as JSON: officers, controllers, filings of a company; written from its key and its orders.
REGISTRY = """
SELECT c_custkey AS company_id, CAST('2000-01-15' AS DATE) + CAST(c_custkey % 300 AS INT) AS born,
  '{{"items": [{{"name": "SMITH, Jane ' || CAST(c_custkey % 40 AS VARCHAR(20)) || '", "officer_role": "' || CASE c_custkey % 4 WHEN 0 THEN 'secretary' WHEN 1 THEN 'Director' WHEN 2 THEN 'corporate-secretary' ELSE 'llp-member' END || '", "appointed_on": "2000-0' || CAST(1 + c_custkey % 9 AS VARCHAR(20)) || '-11"' ||
    CASE WHEN c_custkey % 5 = 0 THEN ', "resigned_on": "2001-01-01"' ELSE '' END || ', "links": {{"officer": {{"appointments": "/officers/id' || CAST(c_custkey AS VARCHAR(20)) || '/appointments"}}}}}}' || CASE WHEN c_custkey % 3 = 0 THEN ', {{"name": "Bo Ek", "officer_role": "director", "date_of_birth": {{"year": 1980}}}}' ELSE '' END || ']}}' AS officers,
  '{{"items": [{{"name": "' || CASE WHEN c_custkey % 2 = 0 THEN 'Jane ' || CAST(c_custkey % 40 AS VARCHAR(20)) || ' Smith' ELSE 'Ana Li' END || '", "kind": "' || CASE c_custkey % 5 WHEN 0 THEN 'super-secure-person' WHEN 1 THEN 'corporate-entity' ELSE 'individual-person' END || '", "notified_on": "2000-05-06", "natures_of_control": ["a", "b"]' || CASE WHEN c_custkey % 7 = 0 THEN ', "ceased_on": "2001-01-01"' ELSE '' END || '}}]}}' AS controllers,
  '{{"items": [{{"type": "' || CASE WHEN c_custkey % 3 = 0 THEN 'CS01' ELSE 'SH01' END || '", "date": "' || CASE WHEN c_custkey % 11 = 0 THEN 'unknown' ELSE '200' || CAST(c_custkey % 4 AS VARCHAR(20)) || '-03-04' END || '", "transaction_id": "T' || CAST(c_custkey AS VARCHAR(20)) || '"}}]}}' AS filings
FROM {customer}
"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.relation(spark, sf, REGISTRY)


def _scores(spark, sf):
    return t(spark, sf, "orders").selectExpr("o_custkey as company", "o_orderstatus as fund", "case when o_orderkey % 2 = 0 then o_orderpriority end as vehicle", "o_orderkey as config", "o_totalprice as fit", "date(o_orderdate) as seen")


def upsert_expression_key(spark: SparkSession, sf: str) -> DataFrame:
    """Scores over old ones of the same company, fund, vehicle (none is a vehicle too) and configuration."""
    old = _scores(spark, sf).where("config % 3 <> 0")
    new = _scores(spark, sf).where("config % 4 = 0").withColumn("fit", F.round(c("fit") + 1, 2))
    return lifecycle.upsert(old, new, {"company": c("company"), "fund": c("fund"), "vehicle": F.coalesce("vehicle", F.lit("")), "config": c("config")})


def other_generations_deleted(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf)
    last = s.agg(F.max("config").alias("last"))
    return s.join(F.broadcast(last), F.col("config") > F.col("last") / 2).groupBy("fund").agg(F.count(F.lit(1)).alias("n"))


def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """By number: what is new and known wins, first dates stay, larger amounts win."""
    old = t(spark, sf, "customer").where("c_custkey % 3 <> 1").selectExpr("c_custkey as number", "case when c_custkey % 2 = 0 then c_mktsegment end as region", "date'2000-01-01' as first_seen", "c_acctbal as amount")
    new = t(spark, sf, "customer").where("c_custkey % 3 <> 2").selectExpr("c_custkey as number", "case when c_custkey % 5 > 0 then 'R' end as region", "date'2001-01-01' as first_seen", "c_acctbal * -1 as amount")
    return lifecycle.upsert(old, new, ["number"], keep=("first_seen",), fill=("region",), most=("amount",))


def observations_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that are not recorded yet, one of each."""
    s = proxies.signals(spark, sf).select("company_id", "kind", "source_url")
    return lifecycle.append_new(s.where("company_id % 3 = 0 or kind = 'press'"), s, ["company_id", "kind", "source_url"])


def mentions_attached(spark: SparkSession, sf: str) -> DataFrame:
    entities = t(spark, sf, "customer").selectExpr("c_custkey as id", "date'1998-01-01' as first_seen", "date'1998-01-01' as last_seen", "case when c_custkey % 2 = 0 then 'own' end as status", "cast(null as string) as priority")
    found = t(spark, sf, "orders").selectExpr("o_custkey as id", "date(o_orderdate) as on", "o_orderkey as order", "o_orderstatus as status", "case when o_orderkey % 3 = 0 then o_orderpriority end as priority")
    return lifecycle.attached(entities, found, "on", ("status", "priority"))


def tombstones_followed(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.follow(t(spark, sf, "part").where("p_partkey % 8 <> 0").selectExpr("p_partkey as id", "p_partkey - 1 as into"))


def _children(spark, sf):
    lines = t(spark, sf, "lineitem").selectExpr("l_orderkey as id", "l_linenumber as line", "l_partkey as part", "l_suppkey as supplier")
    # Dealt out by id once: the row's name is made after that, and its duplicates and its winner are in the same task.
    return lines.repartition("id").withColumn("row", F.concat_ws("-", "id", "line", "part", "supplier")).dropDuplicates(["id", "row"])


def _winners(spark, sf):
    return t(spark, sf, "orders").where("o_orderkey % 4 <> 0").selectExpr("o_orderkey as id", "o_orderkey - o_orderkey % 4 as root")


def merge_children(spark: SparkSession, sf: str) -> DataFrame:
    """What a merge does to child rows: moved, or deleted where the winner has the key."""
    _, evidence = lifecycle.moved_children(_children(spark, sf), _winners(spark, sf), ["line"], "row")
    return evidence.groupBy("id", "action").agg(F.count(F.lit(1)).alias("n"))


def merge_undone(spark: SparkSession, sf: str) -> DataFrame:
    """A merge and its reversal: the children are what they were."""
    ranked = stored(lifecycle.ranked_children(_children(spark, sf), _winners(spark, sf), ["line"], "row"))
    kept, evidence, deleted = lifecycle.told(ranked, "row")
    return lifecycle.restored(kept, evidence, deleted, "row").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("part").alias("parts"), F.max("row").alias("last"))


def merged_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").selectExpr("o_custkey - o_custkey % 4 as winner", "o_orderkey as id", "case when o_orderkey % 3 > 0 then o_orderpriority end as priority", "o_orderstatus = 'F' as flag", "o_orderkey % 7 as mentions", "date(o_orderdate) as seen", "date(o_orderdate) as until")
    return lifecycle.folded(rows, "winner", "id", ("priority",), ("flag",), ("mentions",), ("seen",), ("until",))


def merge_history(spark: SparkSession, sf: str) -> DataFrame:
    events = t(spark, sf, "orders").selectExpr("o_orderkey as event_id", "o_custkey as winner")
    return lifecycle.live_merges(events, events.where("event_id % 5 = 0")).groupBy("winner").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest"))


def labels_three_way(spark: SparkSession, sf: str) -> DataFrame:
    labels = t(spark, sf, "labels").select(c("doc_id").alias("id"), F.lit("verdict").alias("field"), "quality")
    sheet = labels.where("id % 4 <> 3").select("id", "field", F.when(c("id") % 4 == 0, "").otherwise(F.concat(F.lit("s"), c("quality").cast("string"))).alias("value"))
    stored = labels.where("id % 3 <> 0").select("id", "field", F.lit("old").alias("value"))
    return lifecycle.three_way(sheet, stored, labels.where("id % 2 = 0 and id % 8 <> 4").select("id", "field", F.lit("shown").alias("value")))


def people_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    people = proxies.mentions(spark, sf).select("id", "person")
    listed = people.where("id % 7 = 0").select(F.lower("person").alias("person")).distinct().select(ident.suppression_key(c("person")).alias("key"))
    return lifecycle.without_suppressed(people, listed, ident.suppression_key(c("person"))).select("id")


def retention(spark: SparkSession, sf: str) -> DataFrame:
    rejects = t(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey as id", "date(o_orderdate) as on")
    kept, gone = lifecycle.expired(t(spark, sf, "customer").selectExpr("c_custkey as id"), rejects, F.add_months(F.lit(proxies.AS_OF).cast("date"), -3))
    return kept.select("id", F.lit("kept").alias("state")).unionByName(gone.select("id", F.lit("deleted").alias("state")))


def bad_records(spark: SparkSession, sf: str) -> DataFrame:
    """Why records go to quarantine, and how many pass."""
    rules = [("no_name", ident.is_placeholder(c("norm_key"))), ("no_place", ident.postcode(c("postcode")).isNull()), ("foreign", ident.country(c("country")) != "GB")]
    rows = proxies.mentions(spark, sf).withColumn("norm_key", ident.norm_key(c("name")))
    return lifecycle.screened(rows, rules).groupBy(F.coalesce("screen", F.lit("ok")).alias("screen")).agg(F.count(F.lit(1)).alias("n"))


def registry_screen(spark: SparkSession, sf: str) -> DataFrame:
    """Registry records in the order of their screens: codes, region, address; and those that pass."""
    df = proxies.companies(spark, sf)
    codes = F.coalesce("sic_codes", F.array().cast("array<string>"))
    rules = [("sic_denylist", registry.denied_only(codes, ("99999", "58210"))), ("region_not_enabled", ~registry.region_enabled(c("hq_region"), ("north_east", "yorkshire")) | c("region").isin("London")), ("formation_agent_address", c("outcode").isin("EC2A"))]
    return lifecycle.screened(df, rules).groupBy(F.coalesce("screen", F.lit("ok")).alias("screen")).agg(F.count(F.lit(1)).alias("n"))


def officer_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = registry.officers(records(spark, sf), "company_id", "officers")
    return rows.select("company_id", "name", "role", "appointed_on", "corporate", "resigned", "officer_id", registry.founder_candidate().alias("candidate"))


def controller_rows(spark: SparkSession, sf: str) -> DataFrame:
    return registry.controllers(records(spark, sf), "company_id", "controllers").select("company_id", "name", "notified_on", "corporate", "ceased", "controls")


def founder_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return registry.founders(registry.officers(r, "company_id", "officers"), registry.controllers(r, "company_id", "controllers"), "company_id").select("company_id", "person", "role", "since", "controls")


def secretary_only(spark: SparkSession, sf: str) -> DataFrame:
    return registry.only_corporate_secretary(registry.officers(records(spark, sf), "company_id", "officers"), "company_id")


def share_issue_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = registry.share_issues(records(spark, sf), "company_id", "filings", "born")
    return rows.select("company_id", "filed_on", "transaction_id", registry.early_issue(c("filed_on"), c("born")).alias("early"))


def week_windows(spark: SparkSession, sf: str) -> DataFrame:
    spans = t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.to_date(F.min("o_orderdate")).alias("first"), F.to_date(F.max("o_orderdate")).alias("last"))
    return registry.date_windows(spans, "o_orderpriority", c("first"), c("last"), 7)


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "records"}

_R = "(" + proxies.duck(REGISTRY) + ")"
_S = "(SELECT o_custkey AS company, o_orderstatus AS fund, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS vehicle, o_orderkey AS config, o_totalprice AS fit, o_orderdate::DATE AS seen FROM orders)"
_SIG = "(" + proxies.duck(proxies.SIGNAL) + ")"
_CH = "(SELECT DISTINCT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row FROM lineitem)"
_W = "(SELECT o_orderkey AS id, o_orderkey - o_orderkey % 4 AS root FROM orders WHERE o_orderkey % 4 <> 0)"
_OFF = f"(SELECT company_id, unnest(from_json(officers::JSON -> 'items', '[\"JSON\"]')) AS o FROM {_R})"
_DISPLAY = "CASE WHEN contains({n}, ',') THEN trim(split_part({n}, ',', 2)) || ' ' || upper(left({n}, 1)) || lower(substr(split_part({n}, ',', 1), 2)) ELSE {n} END"
_OFFICER = f"(SELECT company_id, {_DISPLAY.replace('{n}', chr(123) + 'n' + chr(125)).replace('{n}', '(o ->> ' + chr(39) + 'name' + chr(39) + ')')} AS name, lower(o ->> 'officer_role') AS role, try_cast(o ->> 'appointed_on' AS DATE) AS appointed_on, coalesce(lower(o ->> 'officer_role') LIKE 'corporate-%', FALSE) AS corporate, (o ->> 'resigned_on') IS NOT NULL AS resigned, nullif(regexp_extract(coalesce(o -> 'links' -> 'officer' ->> 'appointments', ''), '/officers/([^/]+)/', 1), '') AS officer_id FROM {_OFF})"
_CAND = "NOT corporate AND NOT resigned AND (role IS NULL OR role IN ('director', 'llp-designated-member', 'llp-member', 'member-of-a-management-organ', 'managing-officer', 'judicial-factor'))"
_PSC = f"(SELECT company_id, p ->> 'name' AS name, try_cast(p ->> 'notified_on' AS DATE) AS notified_on, NOT contains(p ->> 'kind', 'individual') AND NOT contains(p ->> 'kind', 'legal-person') AS corporate, coalesce(p ->> 'ceased_on', '') <> '' OR coalesce((p ->> 'ceased')::BOOLEAN, FALSE) AS ceased, json_array_length(p -> 'natures_of_control')::INT AS controls FROM (SELECT company_id, unnest(from_json(controllers::JSON -> 'items', '[\"JSON\"]')) AS p FROM {_R}) WHERE NOT contains(p ->> 'kind', 'super-secure'))"
_M = "(" + proxies.duck(proxies.MENTION) + ")"
_CO = "(" + proxies.duck(proxies.COMPANY) + ")"
SQL = {
    "upsert_expression_key": f"SELECT company, fund, vehicle, config, CASE WHEN config % 4 = 0 THEN round(fit + 1, 2) ELSE fit END AS fit, seen FROM {_S} WHERE config % 3 <> 0 OR config % 4 = 0",
    "other_generations_deleted": f"SELECT fund, count(*) AS n FROM {_S} WHERE config > (SELECT max(config) / 2 FROM {_S}) GROUP BY fund",
    "registry_upsert": "SELECT c_custkey AS number, CASE WHEN c_custkey % 3 <> 2 AND c_custkey % 5 > 0 THEN 'R' WHEN c_custkey % 3 <> 1 AND c_custkey % 2 = 0 THEN c_mktsegment END AS region, CASE WHEN c_custkey % 3 <> 1 THEN DATE '2000-01-01' ELSE DATE '2001-01-01' END AS first_seen, CASE c_custkey % 3 WHEN 1 THEN -c_acctbal WHEN 2 THEN c_acctbal ELSE abs(c_acctbal) END AS amount FROM customer",
    "observations_appended": f"SELECT DISTINCT company_id, kind, source_url FROM {_SIG} WHERE NOT (company_id % 3 = 0 OR kind = 'press')",
    "mentions_attached": "SELECT c_custkey AS id, least(DATE '1998-01-01', coalesce(a, DATE '1998-01-01')) AS first_seen, greatest(DATE '1998-01-01', coalesce(z, DATE '1998-01-01')) AS last_seen, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE st END AS status, pr AS priority FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate::DATE) AS a, max(o_orderdate::DATE) AS z, arg_min(o_orderstatus, o_orderkey) AS st, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS pr FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "tombstones_followed": "WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey - 1 AS root FROM part WHERE p_partkey % 8 <> 0), w AS (SELECT id, root FROM p UNION ALL SELECT w.id, p.root FROM w JOIN p ON p.id = w.root) SELECT id, min(root) AS root FROM w GROUP BY id",
    "merge_children": f"SELECT root AS id, CASE WHEN n = 1 THEN 'moved' ELSE 'deleted' END AS action, count(*) AS n FROM (SELECT c.id, coalesce(root, c.id) AS root, row_number() OVER (PARTITION BY coalesce(root, c.id), line ORDER BY c.id <> coalesce(root, c.id), row) AS n FROM {_CH} c LEFT JOIN {_W} w ON w.id = c.id) WHERE id <> root GROUP BY ALL",
    "merge_undone": f"SELECT id, count(*) AS n, sum(part)::BIGINT AS parts, max(row) AS last FROM {_CH} GROUP BY id",
    "merged_columns": "SELECT o_custkey - o_custkey % 4 AS winner, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 > 0) AS priority, bool_or(o_orderstatus = 'F') AS flag, sum(o_orderkey % 7)::BIGINT AS mentions, min(o_orderdate::DATE) AS seen, max(o_orderdate::DATE) AS until FROM orders GROUP BY 1",
    "merge_history": "SELECT o_custkey AS winner, count(*) AS n, max(o_orderkey) AS newest FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1",
    "labels_three_way": "SELECT doc_id AS id, 'verdict' AS field, CASE WHEN doc_id % 4 IN (1, 2) THEN 's' || quality ELSE 'old' END AS value FROM labels WHERE doc_id % 4 IN (1, 2) OR (doc_id % 3 <> 0 AND NOT (doc_id % 4 = 0 AND doc_id % 2 = 0 AND doc_id % 8 <> 4))",
    "people_suppressed": rf"SELECT id FROM {_M} WHERE trim(regexp_replace(lower(person), '\s+', ' ', 'g')) NOT IN (SELECT trim(regexp_replace(lower(person), '\s+', ' ', 'g')) FROM {_M} WHERE id % 7 = 0)",
    "retention": f"SELECT c_custkey AS id, CASE WHEN last < DATE '{proxies.AS_OF}' - INTERVAL 3 MONTH THEN 'deleted' ELSE 'kept' END AS state FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate::DATE) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey",
    "registry_screen": f"SELECT CASE WHEN len(cs) > 0 AND len(list_filter(cs, lambda x: x NOT IN ('99999', '58210'))) = 0 THEN 'sic_denylist' WHEN hq_region NOT IN ('north_east', 'yorkshire') OR region = 'London' THEN 'region_not_enabled' WHEN outcode = 'EC2A' THEN 'formation_agent_address' ELSE 'ok' END AS screen, count(*) AS n FROM (SELECT *, coalesce(string_split(codes, ','), []) AS cs FROM {_CO}) GROUP BY 1",
    "officer_rows": f"SELECT *, {_CAND} AS candidate FROM {_OFFICER}",
    "controller_rows": f"SELECT * FROM {_PSC}",
    "founder_rows": f"SELECT coalesce(o.company_id, p.company_id) AS company_id, coalesce(o.person, p.person) AS person, role, coalesce(appointed_on, notified_on) AS since, p.person IS NOT NULL AS controls FROM (SELECT company_id, lower(name) AS person, min(role) AS role, min(appointed_on) AS appointed_on FROM {_OFFICER} WHERE {_CAND} GROUP BY ALL) o FULL JOIN (SELECT company_id, lower(name) AS person, min(notified_on) AS notified_on FROM {_PSC} WHERE NOT corporate AND NOT ceased GROUP BY ALL) p ON p.company_id = o.company_id AND p.person = o.person",
    "secretary_only": f"SELECT company_id, count(*) FILTER (WHERE NOT resigned) > 0 AND coalesce(bool_and(corporate AND role LIKE '%secretary') FILTER (WHERE NOT resigned), FALSE) AS only FROM {_OFFICER} GROUP BY 1",
    "share_issue_rows": f"SELECT company_id, d AS filed_on, f ->> 'transaction_id' AS transaction_id, coalesce((date_part('year', d) - date_part('year', born)) * 12 + date_part('month', d) - date_part('month', born) - CASE WHEN date_part('day', d) < date_part('day', born) THEN 1 ELSE 0 END BETWEEN 0 AND 18, TRUE) AS early FROM (SELECT *, try_cast(f ->> 'date' AS DATE) AS d FROM (SELECT company_id, born, filings::JSON -> 'items' -> 0 AS f FROM {_R})) WHERE f ->> 'type' = 'SH01'",
    "week_windows": "SELECT o_orderpriority, s::DATE AS start, least(s::DATE + 6, z) AS end FROM (SELECT o_orderpriority, z, unnest(generate_series(a, z, INTERVAL 7 DAY)) AS s FROM (SELECT o_orderpriority, min(o_orderdate::DATE) AS a, max(o_orderdate::DATE) AS z FROM orders GROUP BY 1))",
}
