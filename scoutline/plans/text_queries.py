"""Page and text operators over ``pages`` and ``documents``, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.functions import identity as ident
from scoutline.functions.frames import stored
from scoutline.operators import html, text
from scoutline.plans import proxies

t = proxies.table
c = F.col

#: Places of a page's body, the first that is there counts.
SELECTORS = ["main .content", "article > p", "div.post", "body p", "body"]

#: Articles: a page's place with the wording of funding news around its key, and a plain page for every fifth.
ARTICLE = """
SELECT page_id, url, html, CASE page_id % 7 WHEN 0 THEN 'Newcastle''s ' WHEN 1 THEN 'Leeds-based ' WHEN 2 THEN 'Exclusive: ' WHEN 3 THEN 'Harbour invests in startup ' ELSE '' END || name || ' ' || CASE page_id % 6 WHEN 0 THEN 'raises £' || CAST(page_id % 90 + 1 AS VARCHAR(20)) || '.5m' WHEN 1 THEN 'secures $2,000k' WHEN 2 THEN 'wins' WHEN 3 THEN 'files for IPO' WHEN 4 THEN 'newsletter' ELSE 'closes' END AS title,
  CASE WHEN page_id % 5 = 0 THEN 'A short note.' ELSE name || ' Ltd builds tools for teams. It was ' || CASE page_id % 3 WHEN 0 THEN 'founded in 2021' WHEN 1 THEN 'spun out in 2019' ELSE 'started lately' END || '. The ' || CASE page_id % 8 WHEN 0 THEN 'U.S.-based' WHEN 1 THEN 'Los Angeles-based' WHEN 2 THEN 'Dubai startup and' WHEN 3 THEN 'Paris-based' WHEN 4 THEN 'Scotland headquartered' ELSE 'Leeds-based' END || ' firm closed a ' ||
    CASE page_id % 4 WHEN 0 THEN 'seed round' WHEN 1 THEN 'Series B' WHEN 2 THEN 'pre-seed deal' ELSE 'Series A' END || ' worth €3m.' || chr(10) || 'Its backers are based in the United States.' || repeat(' More words follow here.', 20) END AS words
FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Beta Labs' WHEN 2 THEN 'Delta' ELSE 'Echo Works' END || ' ' || CASE page_id % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'South' ELSE 'Mid' END AS name FROM {pages}) AS p
"""


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return proxies.relation(spark, sf, ARTICLE)


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Text of every page without its furniture."""
    return text.page_text(t(spark, sf, "pages").select("page_id", "html")).select("page_id", F.length("body").alias("chars"), F.sha2("body", 256).alias("sha256"))


def page_plain(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", F.sha2(text.plain_text(c("html")), 256).alias("sha256"))


def page_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Meta tags of every page (some are written around the page, in both orders of attributes)."""
    head = F.concat(F.lit('<meta name="Page" content="'), c("page_id").cast("string"), F.lit('"><meta content="other" property="page"><meta content="T '), c("page_id").cast("string"), F.lit('" property="og:title">'), "html")
    tags = t(spark, sf, "pages").select("page_id", text.meta_tags(head).alias("tags"))
    return tags.select("page_id", F.explode("tags").alias("x")).select("page_id", "x.key", "x.value")


def title_ladder(spark: SparkSession, sf: str) -> DataFrame:
    made = F.when(c("page_id") % 3 == 0, F.concat(F.lit('<meta property="og:title" content="OG '), c("page_id").cast("string"), F.lit('">'), "html")).when(c("page_id") % 3 == 1, F.regexp_replace("html", "(?is)<title.*?</title>", "")).otherwise(c("html"))
    pages = t(spark, sf, "pages").select("page_id", made.alias("html")).withColumn("tags", text.meta_tags(c("html")))
    return pages.select("page_id", text.title_of(c("html"), c("tags")).alias("title"))


def json_ld(spark: SparkSession, sf: str) -> DataFrame:
    """First values of the pages' structured data, found at any depth."""
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Organization", "name": "Org '), c("page_id").cast("string"), F.lit('"}, {"headline": "H", "author": {"name": "Ana"}}], "headline": "later"'), F.when(c("page_id") % 5 == 0, "").otherwise("}"), F.lit("</script>"))
    return text.structured_data(t(spark, sf, "pages").select("page_id", F.concat(block, "html").alias("html")), "page_id")


def page_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade over whole texts: address, title, length, signal words, organisations."""
    return articles(spark, sf).select("page_id", text.prefilter(c("url"), c("title"), c("words")).alias("verdict"))


def platform_hints(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").groupBy(text.platform(c("html")).alias("platform")).agg(F.count(F.lit(1)).alias("n"))


def article_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What the wording states: name, amount, stage, founding year, seat, description, the sentence that names it."""
    amount, currency = text.headline_amount(c("title"), c("words"))
    both = F.concat_ws("\n", "title", "words")
    df = articles(spark, sf).select("page_id", "words", text.entity_name(c("title"), c("words")).alias("name"), amount.alias("amount"), currency.alias("currency"), text.stage_of(both).alias("stage"), text.first_group(c("words"), text.FOUNDED).cast("int").alias("founded"), text.hq_country(both).alias("country"))
    return df.select("page_id", "name", "amount", "currency", "stage", "founded", "country", text.description(c("words"), c("name")).alias("description"), text.sentence_with(c("words"), c("name")).alias("sentence"))


def text_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.md5(text.first_words(c("text"), 25)).alias("words"), F.md5(text.truncated(c("text"), 96)).alias("cut"))


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    href = F.expr("CASE page_id % 6 WHEN 0 THEN '/a/b' WHEN 1 THEN 'next.html' WHEN 2 THEN 'mailto:x@y.z' WHEN 3 THEN '//cdn.example.org/x' WHEN 4 THEN 'http://other.example/' END")
    return t(spark, sf, "pages").select("page_id", text.slug(c("url")).alias("slug"), text.absolute_url(c("url"), href).alias("link"))


def structure_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by the set of elements that they have."""
    tags = F.transform(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)), lambda x: F.lower(x))
    return t(spark, sf, "pages").groupBy(text.fingerprint(tags).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


def grounding_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that lose their quote are dropped; the share of quotes that failed."""
    df = articles(spark, sf).select("page_id", c("words").alias("body"), F.lit("Acme").alias("company_name"), F.lit(3.0).alias("amount"), F.lit("seed").alias("stage"), F.when(c("page_id") % 2 == 0, "builds  tools for teams").alias("quote_company"), F.when(c("page_id") % 3 > 0, "worth €3m.").alias("quote_amount"), F.lit("closed a seed round").alias("quote_stage"))
    return text.grounded_facts(df).select("page_id", "company_name", "amount", "stage", "failed", "checked", F.round("rate", 6).alias("rate"))


def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Cache key of a request, and a card's hash over fields in a fixed order."""
    key = F.sha2(F.concat_ws("|", F.lit("v1"), F.lit("model"), "text"), 256)
    card = F.sha2(F.concat_ws("\x1f", *(F.concat_ws("=", F.lit(x), F.coalesce(c(x).cast("string"), F.lit("null"))) for x in ("doc_id", "lang", "source"))), 256)
    return t(spark, sf, "documents").select("doc_id", F.left(key, F.lit(16)).alias("cache_key"), F.left(card, F.lit(16)).alias("card_hash"))


def page_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's elements, texts, deepest line and path set."""
    pages = html.parsed(t(spark, sf, "pages").select("page_id", "html"), "html").drop("html")
    tags = F.filter("nodes", lambda n: n["attrs"].isNotNull())
    depth = F.array_max(F.transform("nodes", lambda n: F.length(n["line"]) - F.length(F.replace(n["line"], F.lit(" "), F.lit("")))))
    return pages.select("page_id", F.size(tags).alias("elements"), (F.size("nodes") - F.size(tags)).alias("texts"), depth.alias("depth"), html.fingerprint(html.paths(c("nodes"))).alias("fingerprint"))


def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What selectors find on every page: which one matched, the first text, a link, the shape of what matched, robots."""
    pages = html.parsed(t(spark, sf, "pages").select("page_id", "html"), "html").drop("html").withColumn("any", html.select_any(c("nodes"), SELECTORS))
    return pages.select("page_id", "any.selector", F.size("any.places").alias("n"), F.sha2(html.first_text(c("nodes"), ["article h1", "h1", "title"]), 256).alias("title_sha256"), html.attr_of(c("nodes"), "nav > ul a[href]", "href").alias("link"), html.node_shape(c("nodes"), c("any.places")).alias("shape"), html.no_index(c("nodes")).alias("no_index"))


def structure_drift(spark: SparkSession, sf: str) -> DataFrame:
    """How much of its site's usual structure every page has."""
    pages = html.parsed(t(spark, sf, "pages").select("page_id", ident.host(c("url")).alias("host"), "html"), "html").drop("html")
    pages = stored(pages.select("page_id", "host", html.paths(c("nodes")).alias("paths")))
    return html.drift(pages, html.usual_paths(pages, "host"), "page_id", "host")


QUERIES = {f.__name__: f for f in (page_texts, page_plain, page_meta, title_ladder, json_ld, page_prefilter, platform_hints, article_facts, text_cuts, url_parts, structure_fingerprints, grounding_checks, content_keys, page_nodes, page_fields, structure_drift)}

_A = "(" + proxies.duck(ARTICLE) + ")"
_q = lambda x: x.replace("'", "''")
_FOLD = r"trim(regexp_replace(translate({x}, '‘’“”–—', '''''\"\"--'), '\s+', ' ', 'g'))"
_fold = lambda x: _FOLD.replace("{x}", x).replace('\\"', '"')
_LATE = r"(?i)\b(series\s+[b-z]|growth round|late[- ]stage(?: round)?|pre-?IPO)\b"
_STAGE = f"CASE WHEN regexp_matches(b, '{text.IPO}') THEN 'growth' WHEN regexp_matches(b, '{_LATE}') THEN 'series_b_plus' " + " ".join(f"WHEN regexp_matches(b, '{w}') THEN '{s}'" for s, w in text.STAGE_WORDS) + " END"
_SUM = f"CASE WHEN regexp_matches(title, '{text.AMOUNT}') THEN title ELSE words END"
_scale = "CASE lower(regexp_extract(s, '" + text.AMOUNT + "', 3)) WHEN 'k' THEN 1e3 WHEN 'thousand' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'mn' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'bn' THEN 1e9 WHEN 'billion' THEN 1e9 ELSE 1 END"
_HEAD = f"regexp_replace(trim(title), '{_q(text.PRELUDE)}', '')"
_NAME = "list_filter([" + ", ".join(f"trim(regexp_extract({s}, '{_q(p)}', 1), ' ,.-–—')" for s, p in ((_HEAD, text.TARGET_IN_TITLE), (_HEAD, text.NAME_IN_TITLE), ("words", text.LEGAL_ENTITY), (_HEAD, text.IPO_SUBJECT), ("words", text.IPO_SUBJECT))) + "], lambda n: length(n) > 1)[1]"
_SEAT = "list_min(list_filter([" + ", ".join(f"{{'at': strpos(b, nullif(regexp_extract(b, '{p}'), '')), 'code': '{k}'}}" for k, p in text.HQ.items()) + "], lambda x: x.at IS NOT NULL)).code"
_TAGGED = "'<meta property=\"og:title\" content=\"OG ' || page_id || '\">'"
_ok = lambda q: f"(length({_fold(q)}) >= 12 AND contains({_fold('body')}, {_fold(q)}))"
SQL = {
    "page_plain": r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS sha256 FROM pages",
    "page_prefilter": f"SELECT page_id, CASE WHEN regexp_matches(url, '{text.INDEX_URL}') THEN 'index_page' WHEN regexp_matches(title, '{text.ROUNDUP}') THEN 'roundup_title' WHEN length(words) < {text.MIN_CHARS} THEN 'too_short' WHEN NOT regexp_matches(left(words, {text.SIGNAL_WINDOW}), '{text.SIGNAL}') THEN 'no_signal_keyword' WHEN len(list_distinct(regexp_extract_all(words, '{text.ORGANISATION}', 1))) > {text.MAX_ORGANISATIONS} THEN 'too_many_orgs' ELSE 'ok' END AS verdict FROM {_A}",
    "platform_hints": "SELECT CASE " + " ".join(f"WHEN regexp_matches(html, '(?i){marks}') THEN '{name}'" for name, marks in text.PLATFORMS) + " ELSE 'unknown' END AS platform, count(*) AS n FROM pages GROUP BY 1",
    "title_ladder": rf"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'OG ' || page_id ELSE coalesce(CASE WHEN page_id % 3 = 2 THEN nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1), '<[^>]+>', '', 'g')), '') END, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]+>', '', 'g')), ''), '') END AS title FROM pages""",
    "article_facts": rf"""SELECT page_id, name, amount, currency, stage, founded, country, list_filter(list_transform(regexp_extract_all(words, '[^.!?\n]+[.!?]?'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) <= 200 AND contains(lower(s), lower(name)) AND regexp_matches(s, '{text.DESCRIBES}'))[1] AS description,
  list_filter(list_transform(regexp_extract_all(words, '[^.\n]+\.?'), lambda s: trim(s)), lambda s: contains(s, name))[1] AS sentence
FROM (SELECT *, {_NAME} AS name, try_cast(replace(regexp_extract(s, '{text.AMOUNT}', 2), ',', '') AS DOUBLE) * {_scale} AS amount, CASE regexp_extract(s, '{text.AMOUNT}', 1) WHEN '£' THEN 'GBP' WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' END AS currency,
  {_STAGE} AS stage, nullif(regexp_extract(words, '{text.FOUNDED}', 1), '')::INT AS founded, {_SEAT} AS country FROM (SELECT *, title || chr(10) || words AS b, {_SUM} AS s FROM {_A}) WHERE TRUE) WHERE page_id % 5 <> 0
UNION ALL SELECT page_id, {_NAME}, try_cast(replace(regexp_extract(title, '{text.AMOUNT}', 2), ',', '') AS DOUBLE) * CASE WHEN contains(title, 'k') AND contains(title, '$') THEN 1e3 ELSE 1e6 END, CASE WHEN contains(title, '£') THEN 'GBP' WHEN contains(title, '$') THEN 'USD' END, CASE WHEN contains(title, 'IPO') THEN 'growth' END, NULL, {_SEAT}, NULL, NULL FROM (SELECT *, title || chr(10) || words AS b FROM {_A}) WHERE page_id % 5 = 0""",
    "text_cuts": r"SELECT doc_id, md5(regexp_extract(text, '^((?:\s*\S+){1,25})', 1)) AS words, md5(CASE WHEN length(text) <= 96 THEN text ELSE rtrim(left(text, 95), ' ') || '…' END) AS cut FROM documents",
    "structure_fingerprints": "SELECT left(sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))), chr(10))), 16) AS fingerprint, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1",
    "grounding_checks": f"""SELECT page_id, CASE WHEN q1 IS NULL OR {_ok('q1')} THEN 'Acme' END AS company_name, CASE WHEN q2 IS NULL OR {_ok('q2')} THEN 3.0::DOUBLE END AS amount, CASE WHEN {_ok('q3')} THEN 'seed' END AS stage, failed, checked, round(failed / checked, 6) AS rate
FROM (SELECT *, ((q1 IS NOT NULL AND NOT {_ok('q1')})::INT + (q2 IS NOT NULL AND NOT {_ok('q2')})::INT + (NOT {_ok('q3')})::INT) AS failed, ((q1 IS NOT NULL)::INT + (q2 IS NOT NULL)::INT + 1) AS checked
FROM (SELECT page_id, words AS body, CASE WHEN page_id % 2 = 0 THEN 'builds  tools for teams' END AS q1, CASE WHEN page_id % 3 > 0 THEN 'worth €3m.' END AS q2, 'closed a seed round' AS q3 FROM {_A}))""",
    "content_keys": "SELECT doc_id, left(sha256(concat_ws('|', 'v1', 'model', text)), 16) AS cache_key, left(sha256('doc_id=' || doc_id || chr(31) || 'lang=' || coalesce(lang, 'null') || chr(31) || 'source=' || coalesce(source, 'null')), 16) AS card_hash FROM documents",
    "url_parts": r"""SELECT page_id, split_part(path, '/', -1) AS slug, CASE page_id % 6 WHEN 0 THEN site || '/a/b' WHEN 1 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://[^/]*(?:/.*)?/)[^/]*$', '\1') || 'next.html' WHEN 3 THEN regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example.org/x' WHEN 4 THEN 'http://other.example/' END AS link
FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages)""",
}
