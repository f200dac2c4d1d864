"""Versions of several tables, scores persisted with their components, sources gathered with counters."""

import pytest
from pyspark.sql import functions as F

from scoutline.operators import generations, intake

SCORE, PART = "entity long, fund string, fit double", "entity long, fund string, name string, sub double"


def frames(spark, entities, fit):
    score = spark.createDataFrame([(e, "f", fit) for e in entities], SCORE)
    part = spark.createDataFrame([(e, "f", n, fit) for e in entities for n in "xy"], PART)
    return score, part, spark.createDataFrame([(e,) for e in entities], "entity long")


def state(store, version=None):
    score = {(r.entity, r.fit, r.generation) for r in store.read("score", version).collect()}
    return score, {(r.entity, r.name, r.sub) for r in store.read("component", version).collect()}


def test_scores_and_components_change_together(spark, tmp_path):
    store = generations.Generations(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.manifest() == {}
    score, part, keys = frames(spark, [1, 2, 3], 1.0)
    assert generations.persist(store, score, part, keys, "g1") == 1
    reading = store.read("score")  # begun before the change
    score, part, _ = frames(spark, [2], 2.0)
    again = spark.createDataFrame([(2,), (3,)], "entity long")  # 3 no longer qualifies
    assert generations.persist(store, score, part, again, "g1") == 2
    assert state(store) == ({(1, 1.0, "g1"), (2, 2.0, "g1")}, {(1, "x", 1.0), (1, "y", 1.0), (2, "x", 2.0), (2, "y", 2.0)})
    assert reading.count() == 3 and state(store, 1)[0] == {(e, 1.0, "g1") for e in (1, 2, 3)}
    score, part, keys = frames(spark, [1], 5.0)
    generations.persist(store, score, part, keys, "g2")  # a new configuration: rows of the other one go
    assert state(store)[0] == {(1, 5.0, "g2")}
    assert store.forget(keep=1) == 4 and state(store)[0] == {(1, 5.0, "g2")}


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path):
    store = generations.Generations(spark, str(tmp_path / "s"))
    score, part, keys = frames(spark, [1, 2], 1.0)
    generations.persist(store, score, part, keys, "g")
    broken = part.withColumn("sub", F.when(F.col("entity") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("sub")))
    with pytest.raises(Exception, match="lost"):
        generations.persist(store, frames(spark, [1, 2], 9.0)[0], broken, keys, "g")
    assert store.version() == 1 and state(store)[0] == {(1, 1.0, "g"), (2, 1.0, "g")}
    other = generations.Generations(spark, str(tmp_path / "s"))
    store.write({"score": store.read("score")}, 1)
    with pytest.raises(generations.Conflict):  # made from a version that is no longer the newest
        other.write({"score": frames(spark, [7], 7.0)[0]}, 1)
    assert store.forget(keep=2) >= 1 and 7.0 not in {r.fit for r in store.read("score").collect()}


def test_sources_are_gathered_with_counters_and_kept_apart(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, ""), (-1, "b"), (-2, None)], "id long, name string")
    rules = [("negative", F.col("id") < 0), ("unnamed", F.coalesce(F.col("name"), F.lit("")) == "")]

    def broken():
        return rows.withColumn("name", F.raise_error(F.lit("no such page")).cast("string"))

    def missing():
        raise OSError("refused")

    sources = {"one": lambda: rows, "two": lambda: rows.where("id < 0"), "three": broken, "four": missing}
    union, status = intake.gathered(spark, {s: sources[s] for s in intake.allowed(list(sources), None, ("none",))}, rules, str(tmp_path / "in"))
    assert {(r.source, r.id) for r in union.collect()} == {("one", 1)}
    got = {r.source: (r.status, r.seen, r.kept, r.dropped) for r in status.collect()}
    assert got["one"] == ("ok", 5, 1, {"negative": 2, "unnamed": 2}) and got["two"] == ("empty", 2, 0, {"negative": 2, "unnamed": 0})
    assert got["three"][0] == got["four"][0] == "failed"
    one = intake.rolled_up(status).first()
    assert (one.status, one.seen, one.kept, one.failed) == ("failed", 7, 1, "four, three")
    assert intake.allowed(["a", "b", "c"], ["c", "a", "x"], ("a",)) == ["c"]


def test_only_changed_rows_are_judged_again(spark, tiny):
    from scoutline.plans import score_queries

    old, new = (df.cache() for df in score_queries.changed_companies(spark, tiny))
    full = score_queries.judged(new).collect()
    rows, marks, changed = generations.refreshed(new, generations.marked(old, "c"), score_queries.judged(old), "company_id", "c", score_queries.judged)
    assert sorted(map(str, rows.collect())) == sorted(map(str, full))
    assert {r.company_id for r in changed.collect()} == {r.company_id for r in new.collect() if r.company_id % 100 == 7} and marks.count() == new.count()
    assert generations.refreshed(new, marks, rows, "company_id", "c", score_queries.judged)[2].count() == 0
    assert generations.refreshed(new, marks, rows, "company_id", "other", score_queries.judged)[2].count() == new.count()
