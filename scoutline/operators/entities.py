"""Mentions into entities: capped clustering, identifiers, review rows, and the undoing of merges.

Merges are edges between mentions, taken in order of confidence.  An edge is admitted if its two clusters do not hold different
registry numbers and, for a fuzzy one, if together they have absorbed fewer than the cap.  Clusters only ever gain numbers and
absorptions, so an edge that is refused stays refused, and an edge that is the best one left for both of its clusters is the next
that a walk through all edges in order would admit there.  All such edges are contracted in the same round.  So is the best edge of a
cluster that could be admitted whatever the other side becomes (exact, nothing absorbed, and no number or the other's own): a hot key
whose mentions all meet one centre is done in one round.  Equal confidence and score are ordered by a hash, so chains stay short.

Keys join mentions in stars: as many edges as mentions.  Similar names are compared once for each distinct spelling and country.

An entity's state is its mentions and the merges between them.  Taking merges out or adding some rebuilds the entities that they touch
and no other; numbers, dates and identifiers are taken from the mentions again, so nothing has to be kept aside for an undo.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutline.functions import identity as ident
from scoutline.functions.frames import stored
from scoutline.operators import resolve

#: Names that a token may have before its pairs are tested as they meet.  A crowd of n names is the root of n / PARTING parts.
CROWD, PARTING = 200, 10
EDGE = "a long, b long, rule string, confidence double, score double"


# --- edges ------------------------------------------------------------------------------------------------


def star(rows: DataFrame, keys: list[str], rule: str, confidence: float) -> DataFrame:
    """Edges from each row of a key (all parts known, ``country`` excepted) to one of them, a numbered one if there is any.

    rows: id, number and the key columns.  The centre is a minimum, which Spark takes before the shuffle.
    """
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() & (F.col(k) != "") for k in keys if k != "country"))
    marks = [F.coalesce(F.col(k), F.lit("")).alias(f"_{k}") for k in keys]
    held = rows.where(known).select("id", "number", *marks)
    centre = held.groupBy(*(f"_{k}" for k in keys)).agg(F.min(F.struct(F.col("number").isNull(), F.col("id"))).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    both = held.join(centre, [f"_{k}" for k in keys]).where(F.col("id") != F.col("c.id"))
    return both.select(F.col("c.id").alias("a"), F.col("id").alias("b"), F.lit(rule).alias("rule"), F.lit(confidence).alias("confidence"), F.lit(None).cast("double").alias("score"))


def key_edges(keyed: DataFrame) -> DataFrame:
    """Merges by registry number, domain and name key; equal name keys of two known countries do not meet.

    Mentions of a name without a country meet each other, and the first of the countries that the name has.
    """
    named = keyed.where(~ident.is_placeholder(F.col("norm_key")))
    centres = named.groupBy("norm_key", "country").agg(F.min("id").alias("id"))
    unknown, known = centres.where("country is null"), centres.where("country is not null")
    links = unknown.select("norm_key", F.col("id").alias("a")).join(known.groupBy("norm_key").agg(F.min("id").alias("b")), "norm_key")
    linked = links.select("a", "b", F.lit("normkey_exact").alias("rule"), F.lit(0.95).alias("confidence"), F.lit(None).cast("double").alias("score"))
    stars = [star(keyed, ["number"], "ch_exact", 1.0), star(keyed, ["domain"], "domain_exact", 0.97), star(named, ["norm_key", "country"], "normkey_exact", 0.95), linked]
    return reduce(DataFrame.unionByName, stars)


def name_pairs(names: DataFrame, most: int = CROWD) -> DataFrame:
    """(a, b) of names (id, norm, tokens) that share a token; of one that more than ``most`` names have, the pairs that the ladder may decide on.

    A crowd is dealt into parts that all meet each other, so no pair is lost and no task gets a whole crowd.  As two names meet, the
    pair goes if they are not both family firms and their characters, in whatever order, differ too much: its verdict could only be
    ``distinct``.  The bits that tell so are compared for every pair of a crowd, names only for the pairs that stay.
    """
    rows = names.select("id", "norm", F.explode("tokens").alias("key"))
    sized = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = stored(rows.join(sized, "key"))
    few = rows.where(F.col("n") <= most)
    pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    home = F.pmod(F.xxhash64("id"), F.ceil(F.sqrt(F.col("n") / PARTING)).cast("long")).cast("int")
    crowd = stored(rows.where(F.col("n") > most).repartition("id").select("key", home.alias("home"), "id", F.length("norm").alias("length"), resolve.is_family(F.col("norm")).alias("family"), ident.occurrences(F.col("norm")).alias("seen")))
    side = lambda x, p: crowd.select("key", p.alias("p"), *(F.col(c).alias(f"{c}_{x}") for c in ("home", "id", "length", "family", "seen")))
    # A name goes to its own part and to all before it, where it meets the names whose own part that is.
    both = side("a", F.explode(F.sequence(F.lit(0), F.col("home")))).join(side("b", F.col("home")).hint("merge"), ["key", "p"])
    once = (F.col("home_a") > F.col("home_b")) | (F.col("id_a") < F.col("id_b"))
    similar = resolve.may_be_similar(*(F.col(c) for c in ("length_a", "length_b", "seen_a", "seen_b")))
    met = both.where(once & (similar | F.col("family_a") & F.col("family_b"))).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return pairs.unionByName(met).distinct()


def fuzzy_verdicts(keyed: DataFrame, most: int = CROWD) -> DataFrame:
    """(a, b, decision, rule, score, confidence) of similar names, between the first mentions of each spelling and country."""
    spelt = keyed.where(~ident.is_placeholder(F.col("norm_key"))).groupBy("norm", "country").agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"), F.first("norm_key").alias("norm_key"))
    spelt = stored(spelt.withColumns({"number": F.lit(None).cast("string"), "domain": F.lit(None).cast("string")}))
    side = lambda x: spelt.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in spelt.columns if c != "id"))
    pairs = name_pairs(spelt, most).join(side("a"), "a").join(side("b"), "b")
    return resolve.compared(pairs.where("norm_key_a <> norm_key_b")).where("decision <> 'distinct'").select("a", "b", "decision", "rule", "score", "confidence")


# --- clustering --------------------------------------------------------------------------------------------


def _fuzzy(rule: Column) -> Column:
    return rule.startswith("fuzzy")


def _roots(pointers: DataFrame) -> DataFrame:
    """(id, root): where chains of pointers (id, root) without cycles end; each round doubles their reach, most need none."""
    now = pointers
    while True:
        ends = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = now.join(ends, "root", "left")
        if step.where("further is not null").isEmpty():
            return now
        now = stored(step.select("id", F.coalesce("further", "root").alias("root")))


def _moved(df: DataFrame, roots: DataFrame, x: str) -> DataFrame:
    return df.join(roots.select(F.col("id").alias(x), "root"), x, "left").withColumn(x, F.coalesce("root", x)).drop("root")


def clustered(nodes: DataFrame, edges: DataFrame, cap: int = resolve.MAX_CLUSTER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: id, cluster; merges: the admitted edges; refused: fuzzy edges that only the cap kept out).

    nodes: id (long, unique), number; edges: a, b, rule, confidence, score.  Repeated edges and loops do no harm.
    """
    ends = F.least("a", "b"), F.greatest("a", "b")
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.coalesce("score", F.lit(0.0))).alias("s"), F.xxhash64(*ends).alias("h"), ends[0].alias("u"), ends[1].alias("v"))
    ranked = edges.where("a <> b").select(rank.alias("rank"), F.struct("rule", "confidence", "score").alias("e"))
    every = stored(ranked.groupBy("rank.u", "rank.v").agg(F.min(F.struct("rank", "e")).alias("m")).select("u", "v", "m.*"))
    live, state = every, stored(nodes.select(F.col("id").alias("c"), "number", F.lit(0).alias("n")))
    merges, steps, fuzzy = [], [], _fuzzy(F.col("e.rule"))
    agree = F.coalesce(F.col("number_u") == F.col("number_v"), F.lit(True))
    while True:
        side = lambda x: state.select(F.col("c").alias(x), F.col("number").alias(f"number_{x}"), F.col("n").alias(f"n_{x}"))
        both = live.join(side("u"), "u").join(side("v"), "v")
        both = stored(both.where((F.col("u") != F.col("v")) & agree & (~fuzzy | (F.col("n_u") + F.col("n_v") + 1 < cap))))
        if both.isEmpty():
            break
        free = lambda x, y: ~fuzzy & (F.col(f"n_{x}") == 0) & (F.col(f"number_{x}").isNull() | F.coalesce(F.col(f"number_{x}") == F.col(f"number_{y}"), F.lit(False)))
        turned = both.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o"), free("u", "v").alias("free")), F.struct(F.col("v").alias("c"), F.col("u").alias("o"), free("v", "u").alias("free")))).alias("x"), "rank", "e")
        first = turned.groupBy("x.c").agg(F.min(F.struct("rank", "x.o", "x.free", "e")).alias("m")).select("c", "m.*")
        same = F.col("rank") == F.col("other")  # each is the other's best
        taken = stored(first.join(first.select(F.col("c").alias("o"), F.col("rank").alias("other")), "o").where(F.col("free") | same).select("c", "o", "rank", "e", same.alias("same")))
        merges.append(taken.where(~F.col("same") | (F.col("c") < F.col("o"))).select(F.col("rank.u").alias("a"), F.col("rank.v").alias("b"), "e.*"))
        roots = _roots(taken.where(~F.col("same") | (F.col("c") > F.col("o"))).select(F.col("c").alias("id"), F.col("o").alias("root")))
        gained = taken.where(fuzzy & (F.col("c") > F.col("o"))).select("c", F.lit(1).alias("g"))
        counted = _moved(state.join(gained, "c", "left").withColumn("n", F.col("n") + F.coalesce("g", F.lit(0))), roots, "c")
        state = stored(counted.groupBy("c").agg(F.max("number").alias("number"), F.sum("n").cast("int").alias("n")))
        live = _moved(_moved(both.select("rank", "e", "u", "v"), roots, "u"), roots, "v")
        steps.append(roots)
    members = stored(reduce(lambda df, roots: _moved(df, roots, "cluster"), steps, nodes.select("id", F.col("id").alias("cluster"))))
    place = lambda x: members.join(state.select(F.col("c").alias("cluster"), "number"), "cluster").select(F.col("id").alias(x), F.col("cluster").alias(f"c_{x}"), F.col("number").alias(f"number_{x}"))
    left = every.where(fuzzy).select("u", "v", "e.*").join(place("u"), "u").join(place("v"), "v").where((F.col("c_u") != F.col("c_v")) & agree)
    none = edges.sparkSession.createDataFrame([], EDGE)
    return members, stored(reduce(DataFrame.unionByName, merges, none)), left.select(F.col("u").alias("a"), F.col("v").alias("b"), "rule", "confidence", "score")


# --- entities ----------------------------------------------------------------------------------------------


def placed(members: DataFrame, keyed: DataFrame) -> DataFrame:
    """(id, entity, action): the earliest mention of a cluster gives the entity's id and is ``created``, the others are ``matched``."""
    rows = members.join(keyed.select("id", "seen"), "id")
    first = rows.groupBy("cluster").agg(F.min(F.struct("seen", "id")).alias("m")).select("cluster", F.col("m.id").alias("entity"))
    return rows.join(first, "cluster").select("id", "entity", F.when(F.col("id") == F.col("entity"), "created").otherwise("matched").alias("action"))


def entities(places: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row of each entity: name and key of its first mention, first and last date, and the first known number, domain and country."""
    rows = places.join(keyed, "id").withColumn("order", F.struct("seen", "id"))
    known = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(c) for c in ("number", "domain", "country")]
    return rows.groupBy("entity").agg(F.min_by("name", "order").alias("name"), F.min_by("norm_key", "order").alias("norm_key"), *known, F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count(F.lit(1)).alias("n_mentions"))


def absorbed(places: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, n): of each mention the size of its entity that the cap counts, itself and what it has absorbed by similar names."""
    fuzzy = merges.where(_fuzzy(F.col("rule"))).join(places.select(F.col("id").alias("a"), "entity"), "a").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return places.join(fuzzy, "entity").select("id", (F.col("n") + 1).alias("n"))


def identifiers(places: DataFrame, keyed: DataFrame) -> DataFrame:
    """(entity, kind, value, first_seen): numbers, domains, the entity's own name key, and other keys as aliases."""
    rows = places.join(keyed, "id")
    own = rows.where("id = entity").select("entity", F.col("norm_key").alias("own"))
    rows = rows.join(own, "entity")
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(v).alias("value")) for k, v in (("ch", "number"), ("domain", "domain"))), F.struct(F.when(F.col("norm_key") == F.col("own"), "norm_key").otherwise("alias").alias("kind"), F.col("norm_key").alias("value")))
    return rows.select("entity", "seen", F.inline(pairs)).where("value <> ''").groupBy("entity", "kind", "value").agg(F.min("seen").alias("first_seen"))


def reviews(places: DataFrame, doubtful: DataFrame) -> DataFrame:
    """(key, winner, loser, rule, score): one row of each pair of entities that doubtful pairs of mentions name, by its best score."""
    at = lambda x: places.select(F.col("id").alias(x), F.col("entity").alias(f"e_{x}"))
    rows = doubtful.join(at("a"), "a").join(at("b"), "b").where("e_a <> e_b").select(F.least("e_a", "e_b").alias("winner"), F.greatest("e_a", "e_b").alias("loser"), "rule", "score")
    best = rows.groupBy("winner", "loser").agg(F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("order"), "rule", "score")).alias("m"))
    return best.select(ident.pair_key(F.col("winner"), F.col("loser")).alias("key"), "winner", "loser", "m.rule", "m.score")


def resolved(mentions: DataFrame, most: int = CROWD) -> dict[str, DataFrame]:
    """Every mention (id, name, number, domain, country, seen) attached to an entity, created as one, or queued for review as well.

    Frames: keyed, places, merges, entities, identifiers, reviews.
    """
    keyed = stored(resolve.keyed(mentions).join(mentions.select("id", "seen"), "id"))
    verdicts = stored(fuzzy_verdicts(keyed, most))
    edges = key_edges(keyed).unionByName(verdicts.where("decision = 'merge'").select("a", "b", "rule", "confidence", "score"))
    members, merges, refused = clustered(keyed.select("id", "number"), edges)
    places = stored(placed(members, keyed))
    doubtful = verdicts.where("decision = 'review'").select("a", "b", "rule", "score").unionByName(refused.select("a", "b", F.lit("fuzzy_cluster_cap").alias("rule"), "score"))
    return {"keyed": keyed, "places": places, "merges": merges, "entities": entities(places, keyed), "identifiers": identifiers(places, keyed), "reviews": reviews(places, doubtful)}


# --- undo and later merges ---------------------------------------------------------------------------------


def rebuilt(places: DataFrame, merges: DataFrame, keyed: DataFrame, undone: DataFrame, added: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, merges, touched) of the entities that a change touches, and of no other: ``undone`` merges (a, b) out, ``added`` ones in.

    A merge that a user accepts is added whatever the cap.  touched: the entities as they were; their rows are to be replaced.
    """
    change = undone.select("a", "b") if added is None else undone.select("a", "b").unionByName(added.select("a", "b"))
    ends = change.select(F.col("a").alias("id")).unionByName(change.select(F.col("b").alias("id"))).distinct()
    touched = stored(places.join(ends, "id", "left_semi").select("entity").distinct())
    mine = stored(places.join(touched, "entity", "left_semi").select("id"))
    inner = merges.join(mine.select(F.col("id").alias("a")), "a", "left_semi")
    out = undone.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stays = inner.join(out, ["a", "b"], "left_anti").select("a", "b", "rule", "confidence", "score")
    if added is not None:
        stays = stays.unionByName(added.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rule", "confidence", "score"))
    stays = stored(stays)
    members, _, _ = clustered(mine.select("id", F.lit(None).cast("string").alias("number")), stays.withColumn("rule", F.lit("kept")))
    known = keyed.join(mine, "id", "left_semi")
    return placed(members, known), stays, touched


class Store:
    """Entities as Parquet tables ``places``, ``merges`` and ``entities`` in buckets of the entity; a change rewrites only the buckets that it touches.

    Merges lie in the bucket of the entity that they make.  An entity that splits leaves its parts in their own buckets, so the buckets
    rewritten are those of the entities before and after.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(self.buckets)).cast("int"))

    def _write(self, name: str, df: DataFrame) -> None:
        df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _of(self, places: DataFrame, merges: DataFrame, keyed: DataFrame) -> dict[str, DataFrame]:
        by = merges.join(places.select(F.col("id").alias("a"), "entity"), "a").select("entity", "a", "b", "rule", "confidence", "score")
        return {"places": places, "merges": by, "entities": entities(places, keyed)}

    def save(self, found: dict[str, DataFrame]) -> None:
        for name, df in self._of(found["places"], found["merges"], found["keyed"]).items():
            self._write(name, self._bucket(df))

    def change(self, keyed: DataFrame, undone: DataFrame, added: DataFrame | None = None) -> list[int]:
        """Apply a change; the buckets that were rewritten.  Buckets are few, so their numbers may be collected."""
        places = self.read("places")
        now, kept, touched = rebuilt(places, self.read("merges"), keyed, undone, added)
        now = stored(now)
        goal = self._bucket(touched).select("bucket").unionByName(self._bucket(now).select("bucket")).distinct()
        numbers = sorted(r.bucket for r in goal.collect())
        old_ids = stored(places.join(touched, "entity", "left_semi").select("id"))
        known = keyed.join(old_ids, "id", "left_semi")
        for name, df in self._of(now, kept, known).items():
            there = self.read(name).where(F.col("bucket").isin(numbers))
            rest = stored(there.join(touched, "entity", "left_anti"))
            fresh = self._bucket(df).select(rest.columns)
            self._write(name, rest.unionByName(fresh))
            empty = set(numbers) - {r.bucket for r in rest.select("bucket").unionByName(fresh.select("bucket")).distinct().collect()}
            for bucket in empty:  # dynamic overwriting leaves partitions alone that get no row
                place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/bucket={bucket}")
                place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        return numbers
