"""Work by row and by pair that stays small: each limit is several times what it takes, and a fraction of what it once took."""

import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from scoutline import config
from scoutline.functions import identity as ident
from scoutline.operators import resolve
from scoutline.plans import identity_queries, lifecycle_queries, proxies, relation_queries

NAMES = {
    "norm_name_key": lambda c: ident.norm_name(c),
    "bad_records": lambda c: ident.is_placeholder(ident.norm_key(c)).cast("string"),
    "person_names": lambda c: ident.person_key(c),
    "name_keys": lambda c: F.array_join(ident.rare_tokens(ident.norm_name(c)), " "),
}


@pytest.mark.parametrize("query", NAMES)
def test_names_cost_microseconds(spark, query):
    rows = lambda n: spark.range(0, n, 1, 1).select(F.concat(F.lit("The Acme, Jane "), F.col("id").cast("string"), F.lit(" & Partners Ltd")).alias("x"))
    made = lambda n: rows(n).select(F.sum(F.xxhash64(NAMES[query](F.col("x"))).bitwiseAND(1))).first()
    made(100)
    start = time.time()
    made(60_000)
    assert time.time() - start < 6


def test_every_character_is_folded_as_unicode_has_it(spark):
    chars = [c for c in map(chr, range(1, 0x10000)) if not 0xAC00 <= ord(c) < 0xE000]
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    asked = spark.createDataFrame([(c, plain(c) if plain(c) or unicodedata.combining(c) else c) for c in chars], "c string, p string")
    assert asked.where(ident.folded(F.concat(F.lit("a"), F.col("c"), F.lit("b"))) != F.lower(F.concat(F.lit("a"), F.col("p"), F.lit("b")))).count() == 0


def test_a_host_is_taken_apart_once(spark, tiny):
    plan = identity_queries.web_identity(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[/?#:].*$") <= 6  # three in each of the two tables; in every rung before


def test_similar_words_cost_microseconds(spark):
    rows = lambda n: spark.range(0, n, 1, 1).select(F.concat(F.lit("series "), F.col("id").cast("string")).alias("x"))
    made = lambda n: rows(n).select(F.count(ident.nearest_enum(F.col("x"), config.STAGES))).first()[0]
    made(10)
    start = time.time()
    assert made(20_000) > 0 and time.time() - start < 8


def test_blocking_reads_names_that_are_made_once(spark, tiny):
    plan = relation_queries.block_candidates(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan  # names are normalised before, not once for each of blocking's reads


def test_keys_of_mentions_take_a_host_apart_once(spark, tiny):
    plan = resolve.keyed(proxies.mentions(spark, tiny))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[/?#:].*$") <= 6


def test_names_of_one_row_group_are_made_by_several_tasks(spark, tiny):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one task again
    try:
        found = proxies.mentions(spark, tiny).groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("id") % 2 == 0).alias("n")).where("n > 0")
        assert proxies.table(spark, tiny, "customer").rdd.getNumPartitions() == 1 and found.count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_names_of_a_pair_are_compared_once(spark, tiny):
    pairs = resolve.candidates(proxies.mentions(spark, tiny))
    plan = resolve.compared(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [_subsequence") == 1  # in both branches of a union before


def test_an_undone_merge_reads_children_once(spark, tiny):
    plan = lifecycle_queries.merge_undone(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and plan.count("Exchange hashpartitioning") <= 4  # ranked for each of three reads before


def test_grams_of_texts_are_made_once(spark, tiny):
    plan = relation_queries.verbatim_grounding(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") <= 2  # the last look at whole texts, plain and odd ones; all grams were made twice before
