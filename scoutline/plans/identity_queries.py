"""Names, keys, places, money, dates and matching over the mentions, each with its SQL where similarity allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline import config
from scoutline.functions import identity as ident
from scoutline.functions.frames import held
from scoutline.operators import entities, resolve
from scoutline.plans import proxies

m = proxies.mentions
#: Addresses of pages and mentions; every second one is moved under another suffix.
PLACE = """
SELECT 'page' AS kind, page_id AS id, CASE page_id % 10 WHEN 0 THEN 'http://shop.acme' || CAST(page_id AS VARCHAR(20)) || '.com.sg/x' WHEN 1 THEN '192.168.1.1:80' WHEN 2 THEN 'a.b.c.kawasaki.jp' WHEN 3 THEN 'x.city.kawasaki.jp' WHEN 4 THEN 'co.uk' WHEN 5 THEN 'www.ck' ELSE url END AS place FROM {pages}
UNION ALL SELECT 'mention', k, 'https://www.site' || CAST(CAST(floor(k / 3) AS BIGINT) AS VARCHAR(20)) || CASE k % 8 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com.sg' WHEN 2 THEN '.org' WHEN 3 THEN '.x.bd' WHEN 4 THEN '.example' WHEN 5 THEN '.gov.au' WHEN 6 THEN '.school.za' ELSE '.ac.uk' END || '/p?q#f'
FROM (SELECT c_custkey AS k FROM {customer}) AS keys
"""
c = F.col


def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised name, blocking key, distinctive tokens, placeholder test."""
    norm = m(spark, sf).select("id", ident.norm_name(c("name")).alias("norm")).withColumn("norm_key", F.replace("norm", F.lit(" "), F.lit("")))
    return norm.select("id", "norm", "norm_key", F.array_join(F.array_sort(ident.rare_tokens(c("norm"))), " ").alias("tokens"), ident.is_placeholder(c("norm_key")).alias("placeholder"))


def registry_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return m(spark, sf).select("id", ident.registry_number(c("number")).alias("number"))


def web_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Host, deny test and registrable domain."""
    host = held(m(spark, sf).select("id", ident.host(c("domain")).alias("host")), "host")
    found = held(host.select("id", "host", ident.below_suffix(c("host")).alias("found")), "found")
    return found.select("id", "host", ident.is_denied_domain(c("host")).alias("denied"), ident.allowed(c("found")).alias("domain"))


def registrable_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and mentions by the domain below the longest public suffix rule that fits, over hosts under many suffixes."""
    rules = spark.createDataFrame([(r,) for r in ident.SUFFIX_RULES], "rule string")
    places = proxies.relation(spark, sf, PLACE)
    return resolve.registrable_of(places, "place", rules).select("kind", "id", "host", c("registrable").alias("domain"))


def postal_codes(spark: SparkSession, sf: str) -> DataFrame:
    return m(spark, sf).select("id", ident.postcode(c("postcode")).alias("postcode"), ident.outcode(c("postcode")).alias("outcode"))


def country_codes(spark: SparkSession, sf: str) -> DataFrame:
    return m(spark, sf).select("id", ident.country(c("country")).alias("country"))


def money_texts(spark: SparkSession, sf: str) -> DataFrame:
    amount, currency = ident.money(c("money_text"))
    return m(spark, sf).select("id", amount.alias("amount"), currency.alias("currency"), ident.sterling(c("money_text")).alias("sterling"))


def strict_dates(spark: SparkSession, sf: str) -> DataFrame:
    return m(spark, sf).select("id", ident.strict_date(c("date_text")).alias("date"), ident.date_confidence(c("date_text")).alias("confidence"))


def found_dates(spark: SparkSession, sf: str) -> DataFrame:
    return m(spark, sf).select("id", ident.found_date(c("date_text")).alias("date"))


def person_names(spark: SparkSession, sf: str) -> DataFrame:
    return m(spark, sf).select("id", ident.person_key(c("person")).alias("person_key"), ident.suppression_key(c("person")).alias("suppression_key"), ident.display_name(c("person")).alias("display"))


def enum_values(spark: SparkSession, sf: str) -> DataFrame:
    return m(spark, sf).select("id", ident.enum_of(c("stage_text"), config.STAGES).alias("stage"))


def nearest_enum_values(spark: SparkSession, sf: str) -> DataFrame:
    return m(spark, sf).select("id", "stage_text", ident.nearest_enum(c("stage_text"), config.STAGES).alias("stage"))


def match_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of mentions that share a number, domain, name key or distinctive token."""
    return resolve.candidates(m(spark, sf)).select("a", "b", ident.pair_key(c("a"), c("b")).alias("pair"))


def match_exact_rungs(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts that need no similarity: numbers, domains, placeholders, name keys and countries."""
    return resolve.exact_verdicts(resolve.candidates(m(spark, sf))).select("a", "b", "decision", "rule", "tier", "confidence")


def match_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole ladder (similarity of names is beyond SQL)."""
    return resolve.compared(resolve.candidates(m(spark, sf))).select("a", "b", "decision", "rule", "tier", "score", "confidence")


def best_match(spark: SparkSession, sf: str) -> DataFrame:
    """The entity that each mention goes to, clusters capped by what they have absorbed."""
    verdicts = resolve.compared(resolve.candidates(m(spark, sf)))
    found = entities.resolved(dated(spark, sf))
    sizes = entities.absorbed(found["places"], found["merges"])
    return resolve.best_matches(resolve.capped(verdicts, sizes)).select("a", "b", "decision", "rule")


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions with the day on which they were seen."""
    return m(spark, sf).withColumn("seen", F.date_add(F.lit("2001-01-01").cast("date"), F.pmod(c("id") * 7, F.lit(200)).cast("int")))


def resolved_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """The entity of every mention, and whether the mention made it."""
    return entities.resolved(dated(spark, sf))["places"]


def resolved_entities(spark: SparkSession, sf: str) -> DataFrame:
    return entities.resolved(dated(spark, sf))["entities"]


def entity_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return entities.resolved(dated(spark, sf))["identifiers"]


def review_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of entities that a person decides on."""
    return entities.resolved(dated(spark, sf))["reviews"]


def merges_undone(spark: SparkSession, sf: str) -> DataFrame:
    """Entities after every fifth merge has been taken back; the others stay as they were."""
    found = entities.resolved(dated(spark, sf))
    undone = found["merges"].where((c("a") + c("b")) % 5 == 0).select("a", "b")
    now, _, touched = entities.rebuilt(found["places"], found["merges"], found["keyed"], undone)
    return found["places"].join(touched, "entity", "left_anti").select("id", "entity", "action").unionByName(now)


QUERIES = {f.__name__: f for f in (name_keys, registry_numbers, web_identity, registrable_domains, postal_codes, country_codes, money_texts, strict_dates, found_dates, person_names, enum_values, nearest_enum_values, match_candidates, match_exact_rungs, match_verdicts, best_match, resolved_mentions, resolved_entities, entity_identifiers, review_pairs, merges_undone)}

_M = "(" + proxies.duck(proxies.MENTION) + ")"
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_NORM = rf"trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(strip_accents({{x}})), '&', ' and '), '[^\p{{{{L}}}}\p{{{{N}}}}_]+', ' ', 'g')), '^the ', ''), '((^| )({'|'.join(ident.LEGAL_SUFFIXES)}))+$', ''))".replace("{{", "{").replace("}}", "}")
_norm = lambda x: _NORM.replace("{x}", x)
_KEY = "replace(norm, ' ', '')"
_PLACEHOLDER = f"(length({{k}}) <= 1 OR {{k}} IN ({_list(ident.PLACEHOLDERS)}) OR regexp_matches({{k}}, '{ident.PLACEHOLDER_FORM}'))"
_TOKENS = f"list_distinct(list_filter(string_split(norm, ' '), lambda t: length(t) > 2 AND t NOT IN ({_list(ident.GENERIC)})))"
_FLAT_NUMBER = "nullif(regexp_replace(upper(number), '[^A-Z0-9]', '', 'g'), '')"
_NUMBER = f"CASE WHEN regexp_matches({_FLAT_NUMBER}, '^[A-Z][A-Z][0-9]+$') THEN left({_FLAT_NUMBER}, 2) || lpad(substr({_FLAT_NUMBER}, 3), greatest(6, length({_FLAT_NUMBER}) - 2)::INT, '0') WHEN regexp_matches({_FLAT_NUMBER}, '^[0-9]+$') THEN lpad({_FLAT_NUMBER}, greatest(8, length({_FLAT_NUMBER}))::INT, '0') ELSE {_FLAT_NUMBER} END"
_HOST = r"nullif(regexp_replace(split_part(split_part(split_part(split_part(regexp_replace(regexp_replace(lower(trim(domain)), '^[a-z][a-z0-9+.\-]*://', ''), '^.*@', ''), '/', 1), '?', 1), '#', 1), ':', 1), '\.+$', ''), '')"
_DENIED = "({h} = 'ac.uk' OR {h} LIKE '%.ac.uk' OR " + " OR ".join(f"{{h}} = '{d}' OR {{h}} LIKE '%.{d}'" for d in ident.DENIED_DOMAINS) + ")"
_sold, _wild, _plain = ident.suffix_forms(ident.SUFFIX_RULES)
_BARE = "^([^.]+|[^.]+[.](" + "|".join(r[2:].replace(".", "[.]") for r in ident.SUFFIX_RULES if r.startswith("*.")) + ")|" + "|".join(r.replace(".", "[.]") for r in ident.SUFFIX_RULES if r[0] not in "!*") + ")$"
_PART = "coalesce(" + ", ".join(f"nullif(regexp_extract(host, '{f}', 1), '')" for f in (_sold,)) + f", CASE WHEN regexp_matches(host, '{_BARE}') THEN '' END, " + ", ".join(f"nullif(regexp_extract(host, '{f}', 1), '')" for f in (_wild, _plain, "(?:^|[.])([^.]+[.][^.]+)$")) + ")"
_REGISTRABLE = f"CASE WHEN NOT {_DENIED.replace('{h}', 'host')} AND NOT regexp_matches(host, '(^|[.])[0-9]+$') THEN nullif({_PART}, '') END"
_POST = "upper(regexp_replace(postcode, '[^A-Za-z0-9]', '', 'g'))"
_COUNTRY_FLAT = "trim(regexp_replace(lower(trim(country)), '[^a-z]+', ' ', 'g'))"
_COUNTRY = "CASE " + " ".join(f"WHEN {_COUNTRY_FLAT} IN ({_list(names)}) THEN '{code}'" for code, names in ident.COUNTRIES.items()) + f" WHEN length({_COUNTRY_FLAT}) = 2 THEN upper({_COUNTRY_FLAT}) END"
_MONTH = lambda x: "CASE left(lower(" + x + "), 3) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ident.MONTHS.items()) + " END"
_date = lambda y, mo, d: f"try_cast(lpad(({y})::VARCHAR, 4, '0') || '-' || lpad(({mo})::VARCHAR, 2, '0') || '-' || lpad(({d})::VARCHAR, 2, '0') AS DATE)"
_KEYED = f"(SELECT *, {_KEY} AS norm_key, {_TOKENS} AS tokens FROM (SELECT id, {_norm('name')} AS norm, {_NUMBER} AS number, {_REGISTRABLE} AS domain, {_COUNTRY} AS country FROM (SELECT *, {_HOST} AS host FROM {_M})))"
_PAIRS = f"""WITH k AS MATERIALIZED {_KEYED}, blocks AS (SELECT id, 't' || unnest(tokens) AS b FROM k WHERE NOT {_PLACEHOLDER.replace('{k}', 'norm_key')} UNION SELECT id, 'n' || number FROM k WHERE number <> '' UNION SELECT id, 'd' || domain FROM k WHERE domain <> '' UNION SELECT id, 'k' || norm_key FROM k WHERE NOT {_PLACEHOLDER.replace('{k}', 'norm_key')}),
p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM blocks x JOIN blocks y ON x.b = y.b AND x.id < y.id)"""
_FIELD = "regexp_extract(s, '{f}', {i}, 'i')"
_f = lambda f, i: f"regexp_extract(s, '{f}', {i}, 'i')"
_ISO, _SLASH, _DMY = "^([0-9]{4})-([0-9]{2})-([0-9]{2})", "^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})$", r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})$"
_TD, _TM = r"^([0-9]{1,2})\s+([a-z]+)\.?,?\s+([0-9]{4})$", r"^([a-z]+)\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})$"
_CENTURY = f"({_f(_DMY, 3)}::INT + CASE WHEN {_f(_DMY, 3)}::INT < 70 THEN 2000 WHEN {_f(_DMY, 3)}::INT < 100 THEN 1900 ELSE 0 END)"
_STRICT = f"""CASE WHEN regexp_matches(s, '{_ISO}') THEN {_date(_f(_ISO, 1), _f(_ISO, 2), _f(_ISO, 3))} WHEN regexp_matches(s, '{_SLASH}') THEN {_date(_f(_SLASH, 1), _f(_SLASH, 2), _f(_SLASH, 3))}
 WHEN regexp_matches(s, '{_DMY}') THEN {_date(_CENTURY, _f(_DMY, 2), _f(_DMY, 1))} WHEN regexp_matches(s, '{_TD}', 'i') THEN {_date(_f(_TD, 3), _MONTH(_f(_TD, 2)), _f(_TD, 1))} WHEN regexp_matches(s, '{_TM}', 'i') THEN {_date(_f(_TM, 3), _MONTH(_f(_TM, 1)), _f(_TM, 2))} END"""
_NUM = r"([0-9][0-9,\s]*(?:\.[0-9]+)?)\s*(k|m|mm|mn|bn|b|thousand|million|billion)?\b"
_AMOUNT = f"CASE WHEN lower(s) NOT IN ({_list(ident.UNKNOWN_MONEY)}) THEN try_cast(regexp_replace({_f(_NUM, 1)}, '[,\\s]', '', 'g') AS DOUBLE) * CASE lower({_f(_NUM, 2)}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ident.MULTIPLIERS.items()) + " ELSE 1 END END"
_CURRENCY = f"CASE WHEN lower(s) IN ({_list(ident.UNKNOWN_MONEY)}) THEN NULL " + " ".join(f"WHEN contains(s, '{k}') THEN '{v}'" for k, v in ident.SYMBOLS.items()) + " ELSE nullif(upper(regexp_extract(s, '\\b(" + "|".join(ident.CURRENCIES) + ")\\b', 1, 'i')), '') END"
_FOUND = [(r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})", 1, 2, 3, False), (r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?\s+([0-9]{4})\b", 3, 2, 1, True), (r"\b([A-Za-z]{3,9})\.?\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})\b", 3, 1, 2, True), (r"\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\b", 3, 2, 1, False)]
_LENIENT = "CASE " + " ".join(f"WHEN regexp_matches(s, '{f}')" + (f" AND {_MONTH(_f(f, mo))} IS NOT NULL" if words else "") + f" THEN {_date(_f(f, y), _MONTH(_f(f, mo)) if words else _f(f, mo), _f(f, d))}" for f, y, mo, d, words in _FOUND) + " END"
_TITLE = "CASE WHEN {x} = upper({x}) THEN upper(left({x}, 1)) || lower(substr({x}, 2)) ELSE {x} END".replace("{x}", "trim(split_part(person, ',', 1))")
SQL = {
    "name_keys": f"SELECT id, norm, {_KEY} AS norm_key, array_to_string(list_sort({_TOKENS}), ' ') AS tokens, {_PLACEHOLDER.replace('{k}', _KEY)} AS placeholder FROM (SELECT id, {_norm('name')} AS norm FROM {_M})",
    "registry_numbers": f"SELECT id, {_NUMBER} AS number FROM {_M}",
    "web_identity": f"SELECT id, host, coalesce({_DENIED.replace('{h}', 'host')}, FALSE) AS denied, {_REGISTRABLE} AS domain FROM (SELECT id, {_HOST} AS host FROM {_M})",
    "registrable_domains": f"""WITH rules AS (SELECT unnest([{_list(ident.SUFFIX_RULES)}]) AS rule), p AS (SELECT kind, id, {_HOST.replace('domain', 'place')} AS host FROM ({proxies.duck(PLACE)})),
h AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM p WHERE NOT regexp_matches(host, '(^|[.])[0-9]+$')), e AS (SELECT host, labels, i, array_to_string(labels[i:], '.') AS tail, array_to_string(labels[i + 1:], '.') AS parent FROM h, unnest(range(1, len(labels) + 1)) AS u(i)),
f AS (SELECT host, labels, max(CASE WHEN '!' || tail IN (FROM rules) THEN len(labels) - i END) AS sold, max(CASE WHEN tail IN (FROM rules) OR '*.' || parent IN (FROM rules) THEN len(labels) - i + 1 END) AS most FROM e GROUP BY host, labels),
d AS (SELECT host, CASE WHEN len(labels) > coalesce(sold, most, 1) THEN array_to_string(labels[len(labels) - coalesce(sold, most, 1):], '.') END AS domain FROM f)
SELECT kind, id, p.host, CASE WHEN NOT {_DENIED.replace('{h}', 'p.host')} AND NOT {_DENIED.replace('{h}', 'domain')} THEN domain END AS domain FROM p LEFT JOIN d ON d.host = p.host""",
    "postal_codes": f"SELECT id, CASE WHEN regexp_matches(p, '^[A-Z][A-Z]?[0-9][A-Z0-9]?[0-9][A-Z][A-Z]$') THEN left(p, length(p) - 3) || ' ' || right(p, 3) END AS postcode, CASE WHEN regexp_matches(p, '^[A-Z][A-Z]?[0-9][A-Z0-9]?[0-9][A-Z][A-Z]$') THEN left(p, length(p) - 3) WHEN regexp_matches(p, '^[A-Z][A-Z]?[0-9][A-Z0-9]?$') THEN p END AS outcode FROM (SELECT id, {_POST} AS p FROM {_M})",
    "country_codes": f"SELECT id, {_COUNTRY} AS country FROM {_M}",
    "money_texts": f"SELECT id, amount, currency, CASE WHEN currency IS NULL OR currency = 'GBP' THEN amount END AS sterling FROM (SELECT id, {_AMOUNT} AS amount, {_CURRENCY} AS currency FROM (SELECT id, trim(money_text) AS s FROM {_M}))",
    "strict_dates": f"SELECT id, d AS date, CASE WHEN d IS NOT NULL THEN 'exact' WHEN regexp_matches(s, '^[a-z]+\\.?\\s+[0-9]{{4}}$', 'i') OR regexp_matches(s, '^[0-9]{{4}}$') THEN 'inferred' END AS confidence FROM (SELECT id, s, {_STRICT} AS d FROM (SELECT id, trim(date_text) AS s FROM {_M}))",
    "found_dates": f"SELECT id, {_LENIENT} AS date FROM (SELECT id, date_text AS s FROM {_M})",
    "person_names": rf"SELECT id, trim(regexp_replace(lower(strip_accents(person)), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS person_key, trim(regexp_replace(lower(person), '\s+', ' ', 'g')) AS suppression_key, trim(regexp_replace(CASE WHEN contains(person, ',') THEN trim(substr(person, strpos(person, ',') + 1)) || ' ' || {_TITLE} ELSE person END, '\s+', ' ', 'g')) AS display FROM {_M}",
    "enum_values": rf"SELECT id, CASE WHEN s IN ({_list(config.STAGES)}) THEN s END AS stage FROM (SELECT id, regexp_replace(lower(trim(stage_text)), '[\s-]+', '_', 'g') AS s FROM {_M})",
    "match_candidates": f"{_PAIRS} SELECT a, b, least(a::VARCHAR, b::VARCHAR) || '|' || greatest(a::VARCHAR, b::VARCHAR) AS pair FROM p",
    "match_exact_rungs": f"""{_PAIRS} SELECT a, b, v[1] AS decision, v[2] AS rule, v[3]::INT AS tier, v[4]::DOUBLE AS confidence FROM (SELECT a, b, CASE WHEN x.number = y.number THEN ['merge', 'ch_exact', '0', '1.0'] WHEN x.number <> y.number THEN ['distinct', 'ch_conflict', '0', '1.0'] WHEN x.domain = y.domain THEN ['merge', 'domain_exact', '1', '0.97']
  WHEN {_PLACEHOLDER.replace('{k}', 'x.norm_key')} OR {_PLACEHOLDER.replace('{k}', 'y.norm_key')} THEN ['distinct', 'placeholder', '2', NULL] WHEN x.norm_key = y.norm_key AND x.country <> y.country THEN ['distinct', 'normkey_country_conflict', '3', NULL] WHEN x.norm_key = y.norm_key THEN ['merge', 'normkey_exact', '2', '0.95'] END AS v
FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b) WHERE v IS NOT NULL""",
}
