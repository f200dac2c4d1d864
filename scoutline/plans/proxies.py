"""Domain relations over the driver's tables, as SQL that Spark and DuckDB both read.

Attributes that the tables lack are derived by arithmetic on keys.  Names in braces are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

COMPANY = """
SELECT c.c_custkey AS company_id, c.c_name AS name,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL WHEN c.c_custkey % 3 = 0 THEN CAST('2001-08-01' AS DATE) - CAST(c.c_custkey % 1400 AS INT) ELSE o.first_order END AS incorporated_on,
  CASE WHEN c.c_custkey % 34 = 0 THEN 1999 END AS founded_year,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL WHEN c.c_acctbal < 0 THEN CAST(0.0 AS DOUBLE) ELSE c.c_acctbal * 400 END AS total_funding_gbp,
  CASE WHEN c.c_custkey % 4 = 0 THEN NULL WHEN c.c_custkey % 6 = 1 THEN 'pre_seed' WHEN c.c_custkey % 6 = 2 THEN 'seed' WHEN c.c_custkey % 6 = 3 THEN 'series_a'
       WHEN c.c_custkey % 6 = 4 THEN 'idea' WHEN c.c_custkey % 18 = 5 THEN 'growth' WHEN c.c_custkey % 18 = 6 THEN 'series_b_plus' ELSE 'seed' END AS announced_stage,
  CASE WHEN c.c_custkey % 10 = 3 THEN 'fintech' WHEN c.c_custkey % 10 = 6 THEN 'climate_tech' WHEN c.c_custkey % 50 = 9 THEN 'lending' END AS sector,
  CASE c.c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '62012' WHEN 2 THEN '72190,62012' WHEN 3 THEN '99999' WHEN 4 THEN '86900' WHEN 5 THEN '72110' WHEN 6 THEN '99999,35110' WHEN 7 THEN '63110' ELSE '58210' END AS codes,
  CASE n.n_regionkey WHEN 0 THEN 'London' WHEN 1 THEN 'North East' WHEN 2 THEN 'Yorkshire and The Humber' WHEN 3 THEN NULL ELSE 'South West' END AS region,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL WHEN c.c_custkey % 29 = 0 THEN 'US' WHEN n.n_regionkey = 3 THEN 'Scotland' ELSE 'GB' END AS country,
  CASE c.c_nationkey % 9 WHEN 0 THEN 'NE1' WHEN 1 THEN 'LS2' WHEN 2 THEN 'EC2A' WHEN 3 THEN 'SR5' WHEN 4 THEN 'ZZ9' WHEN 5 THEN 'S75' WHEN 6 THEN 'OX1' WHEN 7 THEN 'EH1' END AS outcode,
  CASE c.c_custkey % 12 WHEN 1 THEN 'Leeds' WHEN 3 THEN 'City of  Durham' WHEN 5 THEN 'Oxford' WHEN 7 THEN 'Sunderland' WHEN 8 THEN 'Nowhere' END AS city,
  CASE WHEN c.c_custkey % 31 = 0 THEN 'uk_wide' END AS hq_region,
  CASE c.c_custkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE END AS is_spinout,
  CASE WHEN c.c_custkey % 14 = 0 THEN 'Durham University' WHEN c.c_custkey % 21 = 0 THEN 'Oxford' END AS spinout_university,
  CASE c.c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS seis_eis_qualifying,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE CAST(50 + c.c_custkey % 51 AS DOUBLE) END AS uk_exec_pct,
  CASE WHEN c.c_custkey % 8 = 0 THEN NULL ELSE CAST(c.c_custkey % 8 * 900000 AS DOUBLE) END AS last_round_gbp,
  CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE CAST(c.c_custkey % 9 * 2600000 AS DOUBLE) END AS prior_total_gbp,
  CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE CAST(c.c_custkey % 6 * 2500000 AS DOUBLE) END AS valuation_gbp,
  c.c_custkey % 19 = 0 AS on_portfolio,
  CASE WHEN c.c_custkey % 23 = 0 THEN NULL ELSE CAST(COALESCE(o.n_orders, 0) % 7 AS INT) END AS press_count,
  CASE c.c_custkey % 7 WHEN 0 THEN 'registry' WHEN 1 THEN 'news' WHEN 2 THEN 'grant' WHEN 3 THEN 'spinout' WHEN 4 THEN 'accelerator' WHEN 5 THEN 'portfolio' END AS route,
  CASE c.c_custkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS has_share_issue,
  CASE WHEN c.c_custkey % 4 = 1 THEN CAST(c.c_custkey % 3 AS INT) END AS max_prior_appointments,
  CAST(c.c_custkey % 3 AS INT) AS n_founders,
  c.c_custkey % 2 = 0 AS any_psc,
  CASE WHEN COALESCE(o.urgent, 0) > 3 THEN 'grant_award' WHEN COALESCE(o.urgent, 0) = 3 THEN 'competition_win' WHEN COALESCE(o.urgent, 0) = 2 THEN 'press' ELSE 'none' END AS signal,
  CASE WHEN c.c_custkey % 3 = 1 THEN 'https://c' || CAST(c.c_custkey AS VARCHAR(20)) || '.example.com' END AS website
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_order, count(*) AS n_orders, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS urgent
           FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

SIGNAL = """
SELECT o_orderkey AS signal_id, o_custkey AS company_id, CASE o_orderkey % 6 WHEN 0 THEN 'grant_award' WHEN 1 THEN 'press' WHEN 2 THEN 'spinout' WHEN 3 THEN 'funding_round' WHEN 4 THEN 'news_mention' ELSE 'share_issue' END AS kind,
  CAST(o_orderdate AS DATE) AS occurred_on, o_totalprice AS amount_gbp, 'https://' || CASE WHEN o_orderkey % 5 = 0 THEN 'register' ELSE 'news' END || '.example.com/' || CAST(o_orderkey % 40 AS VARCHAR(20)) AS source_url
FROM {orders}
"""

#: A slice of days is taken out so that silent sources exist.
SOURCE_DAY = """
SELECT s.source, s.day, CAST(COALESCE(e.items, 0) AS BIGINT) AS items
FROM (SELECT t.event_type AS source, d.day AS day FROM (SELECT DISTINCT event_type FROM {events}) t CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day FROM {events}) d) s
LEFT JOIN (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS items FROM {events}
           WHERE NOT (event_type = 'error' AND CAST(ts AS DATE) >= DATE '2024-01-25') AND NOT (event_type = 'view' AND CAST(ts AS DATE) >= DATE '2024-01-29')
           GROUP BY event_type, CAST(ts AS DATE)) e ON e.event_type = s.source AND e.day = s.day
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A relation above as a Spark frame."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = relation(spark, sf_dir, COMPANY)
    return df.withColumns({"sic_codes": F.split("codes", ","), "signal_kinds": F.array("signal")}).drop("codes", "signal")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, SIGNAL)


def source_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, SOURCE_DAY)


def duck(sql: str) -> str:
    """The same relation's SQL with plain table names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{{", "{").replace("}}", "}")


#: Mentions of organisations from two tables: names in several spellings, numbers, web places, countries, messy texts.
MENTION = """
SELECT k AS id,
  CASE WHEN k % 37 = 0 THEN 'Stealth' WHEN k % 41 = 0 THEN 'NEWCO ' || CAST(k AS VARCHAR(20)) || ' Ltd' ELSE
    CASE k % 4 WHEN 0 THEN stem || ' Robotics Ltd' WHEN 1 THEN 'The ' || stem || '  ROBOTICS' WHEN 2 THEN stem || CASE WHEN k % 8 = 6 THEN ' Robotics Labs' ELSE ' Robotics Lab Limited' END ELSE stem || ' & Partners Holdings' END END AS name,
  CASE k % 5 WHEN 0 THEN 'sc-' || CAST(CAST(floor(k / 10) AS BIGINT) AS VARCHAR(20)) WHEN 1 THEN CAST(CAST(floor(k / 10) AS BIGINT) AS VARCHAR(20)) || ' ' WHEN 2 THEN 'x/' || CAST(k AS VARCHAR(20)) || 'b' END AS number,
  CASE k % 6 WHEN 0 THEN 'https://www.' || slug || '.co.uk:8080/about?x=1' WHEN 1 THEN 'http://me@eng.ox.ac.uk/spinouts' WHEN 2 THEN 'linkedin.com/co/' || slug WHEN 3 THEN slug || '.com' WHEN 4 THEN 'https://shop.' || slug || '-x.org#top' END AS domain,
  CASE k % 7 WHEN 0 THEN 'England' WHEN 1 THEN 'U.K.' WHEN 2 THEN 'us' WHEN 3 THEN 'Deutschland' WHEN 4 THEN 'Atlantis' WHEN 5 THEN 'fr' END AS country,
  CASE k % 6 WHEN 0 THEN 'ne' || CAST(k % 9 AS VARCHAR(20)) || '4st' WHEN 1 THEN 'EC2A-4BX' WHEN 2 THEN 'SW1A 1AA' WHEN 3 THEN 'not known' WHEN 4 THEN ' m' || CAST(k % 9 AS VARCHAR(20)) END AS postcode,
  CASE k % 9 WHEN 0 THEN '£' || CAST(k AS VARCHAR(20)) || '.5m' WHEN 1 THEN 'USD ' || CAST(k AS VARCHAR(20)) || ',500k' WHEN 2 THEN 'undisclosed' WHEN 3 THEN '€3 bn' WHEN 4 THEN CAST(k AS VARCHAR(20)) || ' 200' WHEN 5 THEN 'gbp 40' WHEN 6 THEN 'some ' || CAST(k AS VARCHAR(20)) || ' thousand' WHEN 7 THEN 'no figure' END AS money_text,
  CASE k % 10 WHEN 0 THEN '2024-02-' || CAST(10 + k % 25 AS VARCHAR(20)) WHEN 1 THEN '2024/' || CAST(1 + k % 12 AS VARCHAR(20)) || '/5' WHEN 2 THEN CAST(1 + k % 28 AS VARCHAR(20)) || '/04/2024' WHEN 3 THEN CAST(1 + k % 31 AS VARCHAR(20)) || ' March 2024' WHEN 4 THEN 'Sept 9th, 2023' WHEN 5 THEN 'May 2024' WHEN 6 THEN '2024' WHEN 7 THEN '31.12.' || CAST(60 + k % 20 AS VARCHAR(20)) WHEN 8 THEN 'seen on 3rd Apr 2021 there' END AS date_text,
  CASE k % 3 WHEN 0 THEN 'SMITH, Jane  ' || stem WHEN 1 THEN 'Ana ' || stem ELSE 'O''Hara, Bo' END AS person,
  CASE k % 5 WHEN 0 THEN 'Pre-Seed' WHEN 1 THEN ' SERIES A' WHEN 2 THEN 'seeds' WHEN 3 THEN 'grow' END AS stage_text
FROM (SELECT k, CASE k % 6 WHEN 0 THEN 'Aurora' WHEN 1 THEN 'Boréal' WHEN 2 THEN 'Cobalt' WHEN 3 THEN 'Škoda' WHEN 4 THEN 'Ember' ELSE 'Fjord' END || CAST(CAST(floor(k / 24) AS BIGINT) AS VARCHAR(20)) AS stem,
  'site' || CAST(CAST(floor(k / 12) AS BIGINT) AS VARCHAR(20)) AS slug
  FROM (SELECT 2 * c_custkey AS k FROM {customer} UNION ALL SELECT 2 * s_suppkey + 1 FROM {supplier}) AS keys) AS m
"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are dealt out before names are made of them: they are few bytes, and a whole table of them may be one row group."""
    keys = {t: table(spark, sf_dir, t).select(k).repartition(k) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"))}
    return spark.sql(MENTION, **keys)
