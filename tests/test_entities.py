"""Clustering of mentions into entities, undo by component, suffix rules: against brute force and invariants."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scoutline.functions import identity as ident
from scoutline.operators import entities, resolve
from scoutline.plans import identity_queries

CAP = resolve.MAX_CLUSTER


def hashes(spark, edges):
    df = spark.createDataFrame([(min(e[:2]), max(e[:2])) for e in edges], "a long, b long")
    return {(r.a, r.b): r.h for r in df.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}


def brute_clusters(numbers, edges, order, cap=CAP):
    """One walk through the edges in order, as a plain union-find with the two rules."""
    up, number, absorbed = {n: n for n in numbers}, dict(numbers), dict.fromkeys(numbers, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    taken = []
    for a, b, rule, confidence, score in sorted(edges, key=lambda e: (-e[3], -(e[4] or 0.0), order[min(e[:2]), max(e[:2])], min(e[:2]), max(e[:2]))):
        x, y, fuzzy = root(a), root(b), rule.startswith("fuzzy")
        if x == y or None not in (number[x], number[y]) and number[x] != number[y] or fuzzy and absorbed[x] + absorbed[y] + 1 >= cap:
            continue
        up[y], number[x], absorbed[x] = x, number[x] if number[x] is not None else number[y], absorbed[x] + absorbed[y] + fuzzy
        taken.append((min(a, b), max(a, b)))
    groups = {}
    for n in numbers:
        groups.setdefault(root(n), set()).add(n)
    refused = {(min(e[:2]), max(e[:2])) for e in edges if e[2].startswith("fuzzy") and root(e[0]) != root(e[1]) and (None in (number[root(e[0])], number[root(e[1])]) or number[root(e[0])] == number[root(e[1])])}
    return {frozenset(g) for g in groups.values()}, set(taken), refused


def ran(spark, numbers, edges, parts=4):
    nodes = spark.createDataFrame(list(numbers.items()), "id long, number string").repartition(parts)
    members, merges, refused = entities.clustered(nodes, spark.createDataFrame(edges, entities.EDGE).repartition(parts))
    groups = {}
    for r in members.collect():
        groups.setdefault(r.cluster, set()).add(r.id)
    return {frozenset(g) for g in groups.values()}, {(r.a, r.b) for r in merges.collect()}, {(r.a, r.b) for r in refused.collect()}


@pytest.mark.parametrize("seed", range(1))
def test_clusters_equal_a_walk_through_the_edges(spark, seed):
    rng = random.Random(seed)
    numbers = {i: rng.choice([None, None, None, "A", "B", "C"]) for i in range(70)}
    kinds = [("domain_exact", 0.97, None), ("normkey_exact", 0.95, None), *(("fuzzy", 0.90, s) for s in (92.0, 95.0, 99.0))]
    pairs = {tuple(sorted(rng.sample(range(70), 2))) for _ in range(130)}
    edges = [(*rng.sample(p, 2), *(rng.choice(kinds))) for p in pairs] + [(5, 5, "fuzzy", 0.9, 95.0)]
    edges += edges[:5]  # repeated rows
    right = brute_clusters(numbers, [e for e in set(edges) if e[0] != e[1]], hashes(spark, edges))
    assert ran(spark, numbers, edges) == right
    rng.shuffle(edges)
    assert ran(spark, numbers, edges, parts=7) == right


def test_clusters_of_a_hot_key_a_chain_and_nothing(spark):
    star = [(0, i, "domain_exact", 0.97, None) for i in range(1, 400)]  # one centre, done in a round
    chain = [(i, i + 1, "fuzzy", 0.90, 93.0) for i in range(1000, 1040)]
    numbers = dict.fromkeys([*range(400), *range(1000, 1041)])
    right = brute_clusters(numbers, star + chain, hashes(spark, star + chain))
    got = ran(spark, numbers, star + chain)
    assert got == right and max(map(len, got[0])) == 400
    assert all(len(g) <= CAP for g in got[0] if min(g) >= 1000) and got[2]
    none = spark.createDataFrame([], "id long, number string")
    members, merges, refused = entities.clustered(none, spark.createDataFrame([], entities.EDGE))
    assert members.count() == merges.count() == refused.count() == 0


def mentions(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, number string, domain string, country string, seen string").withColumn("seen", F.to_date("seen"))


def test_resolution_end_to_end(spark):
    rows = [
        (1, "Acme Robotics Ltd", "01234567", None, "UK", "2024-01-05"),
        (2, "ACME robotics", None, "https://www.acme.co.uk/x", None, "2024-01-03"),  # by name; unknown country
        (3, "Acme Robotic", None, None, "UK", "2024-01-09"),  # similar
        (4, "Other name", "1234567", "shop.acme.co.uk", "fr", "2024-02-01"),  # by number and domain
        (5, "Acme Robotics", "99999999", None, "UK", "2024-01-01"),  # another company of the same name
        (6, "Stealth", None, None, None, "2024-01-01"),
        (7, "Stealth", None, None, None, "2024-01-02"),  # placeholders bring nobody together
        (8, "Globex", None, None, "US", "2024-01-01"),
        (9, "Globex", None, None, "DE", "2024-01-01"),  # countries differ
        (10, None, None, None, None, "2024-01-01"),
        (11, "Zorbex Instruments", None, None, "UK", "2024-01-01"),
        (12, "Zorbex Instrument", None, None, "US", "2024-01-02"),  # similar, countries differ: review
    ]
    found = entities.resolved(mentions(spark, rows))
    place = {r.id: (r.entity, r.action) for r in found["places"].collect()}
    assert set(place) == {r[0] for r in rows}
    assert place[1][0] == place[4][0] and place[5][0] != place[1][0]
    assert place[2][0] in (place[1][0], place[5][0]) and place[6][0] != place[7][0] and place[8][0] != place[9][0]
    assert all((e == i) == (a == "created") for i, (e, a) in place.items())
    one = {r.entity: r for r in found["entities"].collect()}[place[1][0]]
    assert one.number == "01234567" and one.domain == "acme.co.uk" and str(one.last_seen) == "2024-02-01"
    kinds = {(r.entity, r.kind, r.value) for r in found["identifiers"].collect()}
    assert (place[4][0], "alias", "othername") in kinds and (place[8][0], "norm_key", "globex") in kinds
    queue = {(r.winner, r.loser): r.rule for r in found["reviews"].collect()}
    assert queue[11, 12] == "fuzzy_country_conflict"


def test_no_entity_has_two_numbers_and_equal_numbers_meet(spark, tiny):
    rows = {r.id: r for r in identity_queries.resolved_mentions(spark, tiny).collect()}
    number = {r.id: r.number for r in resolve.keyed(identity_queries.dated(spark, tiny)).collect()}
    assert set(rows) == set(number)
    by_entity, by_number = {}, {}
    for i, n in number.items():
        if n is not None:
            by_entity.setdefault(rows[i].entity, set()).add(n)
            by_number.setdefault(n, set()).add(rows[i].entity)
    assert all(len(x) == 1 for x in by_entity.values()) and all(len(x) == 1 for x in by_number.values())


def test_crowded_tokens_need_a_further_piece(spark):
    names = [(i, f"robotics aurora{i:03d}") for i in range(60)] + [(100, "robotics zeta"), (101, "zeta robotics labs"), (102, "beta unique"), (103, "unique gamma")]
    df = spark.createDataFrame(names, "id long, norm string").withColumn("tokens", F.split("norm", " "))
    wide = {(r.a, r.b) for r in entities.name_pairs(df, most=1000).collect()}
    assert (0, 1) in wide and (0, 100) in wide
    narrow = {(r.a, r.b) for r in entities.name_pairs(df, most=5).collect()}
    assert {(100, 101), (102, 103)} <= narrow and (0, 100) not in narrow
    triples = [(i, f"robotics aurora labs{i:03d}") for i in range(30)]  # three pieces in common, crowded too: all pairs, in parts
    df = spark.createDataFrame(triples, "id long, norm string").withColumn("tokens", F.split("norm", " "))
    assert {(r.a, r.b) for r in entities.name_pairs(df, most=5).collect()} == {(a, b) for a in range(30) for b in range(a + 1, 30)}


def test_undo_equals_never_having_merged_and_reads_no_other(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"Name{i // 4}{'x' * (i % 3)} Works", None if i % 5 else f"{i // 8:08d}", f"d{i // 3}.com" if i % 2 else None, rng.choice(["UK", None]), f"2024-01-{1 + i % 28:02d}") for i in range(120)]
    found = entities.resolved(mentions(spark, rows))
    store = entities.Store(spark, str(tmp_path / "entities"), buckets=16)
    store.save(found)
    merges = sorted((r.a, r.b) for r in found["merges"].collect())
    undone = rng.sample(merges, 4)
    before = {r.id: r.entity for r in found["places"].collect()}
    stamps = {(name, d): os.stat(tmp_path / "entities" / name / d).st_mtime_ns for name in ("places", "entities", "merges") for d in os.listdir(tmp_path / "entities" / name) if d.startswith("bucket")}
    numbers = store.change(found["keyed"], spark.createDataFrame(undone, "a long, b long"))
    # components of the merges that are left, named by their earliest mention
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in set(merges) - set(undone):
        up[root(a)] = root(b)
    groups = {}
    for r in rows:
        groups.setdefault(root(r[0]), []).append((r[5], r[0]))
    right = {i: min(g)[1] for g in groups.values() for _, i in g}
    assert {r.id: r.entity for r in store.read("places").collect()} == right != before
    assert sorted((r.a, r.b) for r in store.read("merges").collect()) == sorted(set(merges) - set(undone))
    whole = entities.entities(store.read("places").drop("bucket"), found["keyed"])
    assert sorted(map(str, store.read("entities").drop("bucket").collect())) == sorted(map(str, whole.select(store.read("entities").drop("bucket").columns).collect()))
    for (name, d), stamp in stamps.items():  # buckets of other entities were not written
        if int(d.split("=")[1]) not in numbers:
            assert os.stat(tmp_path / "entities" / name / d).st_mtime_ns == stamp
    assert len(numbers) < 16
    # putting the merges back gives the first state again
    again = spark.createDataFrame([(a, b, "manual", None, None) for a, b in undone], entities.EDGE)
    store.change(found["keyed"], spark.createDataFrame([], "a long, b long"), again)
    assert {r.id: r.entity for r in store.read("places").collect()} == before


def brute_registrable(host, rules):
    labels = host.split(".")
    if labels[-1].isdigit():
        return None
    best = 1
    for i in range(len(labels)):
        tail, parent = ".".join(labels[i:]), ".".join(labels[i + 1 :])
        if "!" + tail in rules:
            best = len(labels) - i - 1
            break
        if tail in rules or "*." + parent in rules:
            best = max(best, len(labels) - i)
    return ".".join(labels[-best - 1 :]) if len(labels) > best else None


def test_suffix_rules_by_join_and_by_pattern(spark, tmp_path):
    rng = random.Random(7)
    ends = ["com", "co.uk", "com.sg", "x.ck", "www.ck", "kawasaki.jp", "city.kawasaki.jp", "a.kawasaki.jp", "jp", "example", "bd", "q.bd", "7", "nhs.uk", "s.sch.uk"]
    hosts = [".".join([*(rng.choice(["a", "shop", "acme", "www", "x9"]) for _ in range(rng.randint(0, 3))), rng.choice(ends)]) for _ in range(400)] + ["192.168.1.1", "co.uk", "ck"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)] + [(-1, None), (-2, "")], "id long, place string")
    right = {i: brute_registrable(h, set(ident.SUFFIX_RULES)) for i, h in enumerate(hosts)} | {-1: None, -2: None}
    (tmp_path / "list.dat").write_text("// a list\n\n" + "\n".join(r + "  // x" for r in ident.SUFFIX_RULES))
    rules = resolve.suffix_rules(spark, str(tmp_path / "list.dat"))
    assert {r.id: r.registrable for r in resolve.registrable_of(df, "place", rules).collect()} == right
    assert {r.id: r.x for r in df.select("id", ident.registrable(F.col("place")).alias("x")).collect()} == right
    got = df.limit(1).select(*(ident.registrable(F.lit(x)).alias(f"c{i}") for i, x in enumerate(("shop.acme.com.sg", "192.168.1.1", "https://www.münchen.de/x", "linkedin.com")))).first()
    assert tuple(got) == ("acme.com.sg", None, "xn--mnchen-3ya.de", None)
