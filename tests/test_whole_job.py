"""Whole jobs: cases that a cut of the input or of the candidates would lose."""

import random

from pyspark.sql import functions as F

from scoutline.operators import entities, grounding, resolve


def test_whole_quotes_are_grounded(spark):
    text = "Intro line here.\nOn Monday Acme raised £2m from the northern growth fund and two angels,\nits founders said. The “spinout” deal closed yesterday."
    quotes = [
        "raised £2m from the northern growth fund and two angels, its founders",  # inside a line and across its end
        "aised £2m from the northern growth fund and two an",  # ends inside words
        'The "spinout" deal closed yesterday.',
        "northern grow",  # two words
        "raised £2m from",  # three words
        "raised £2m from the southern growth fund and two angels, its founders",
        "too short",
        None,
        "founders said.",
        "monday acme raised",  # case differs
    ]
    texts = spark.createDataFrame([(1, text), (2, "Nothing of the kind is said here, northern grass."), (3, None), (4, text)], "id long, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, text string")
    right = {(i, n) for i in (1, 4) for n, q in enumerate(quotes) if q and len(q) >= 12 and grounding.normalise(q) in grounding.normalise(text)}
    got = [tuple(r) for r in grounding.grounded(texts, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == right and {n for _, n in right} == {0, 1, 2, 3, 4, 8}
    assert grounding.grounded(texts.limit(0), asked).count() == grounding.grounded(texts, asked.limit(0)).count() == 0


def test_plain_and_odd_texts_are_normalised_alike(spark):
    texts = ["a\x1cb \t\n c", "  «é» – — ‘x’ „y“ £5 €6", "ﬁne print…", "é x​y", "a‑b−c", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {r.id: r.text for r in grounding.normalised(df).collect()} == {i: grounding.normalise(x) for i, x in enumerate(texts)}


def test_frequent_tokens_and_exact_keys_pair(spark):
    rows = [(i, f"common n{i:04d}", None, None) for i in range(450)] + [(900, "xy ab", "12", None), (901, "XY Ab Ltd", None, "q.org"), (902, "qq", "12", "q.org"), (903, None, "", "")]
    names = spark.createDataFrame(rows, "id long, name string, number string, domain string")
    got = {(r.a, r.b): r.shared for r in resolve.block(names, ("number", "domain", "norm_key")).collect()}
    right = {(a, b): 1 for a in range(450) for b in range(a + 1, 450)} | {(900, 902): 0, (901, 902): 0, (900, 901): 0}
    assert got == right


def crowd(n, seed=1):
    """Different names that share a frequent word and no other."""
    rng = random.Random(seed)
    return sorted({"Quantum " + "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(3, 6))) for _ in range(n)})


def crowded(spark, planted):
    rows = [(i, x, None, None, "UK") for i, x in enumerate(crowd(entities.CROWD + 60) + planted)]
    return spark.createDataFrame(rows, "id long, name string, number string, domain string, country string"), {x: i for i, x, *_ in rows}


def test_merges_of_names_that_share_only_a_frequent_word(spark):
    mentions, at = crowded(spark, ["Quantum Xlorbit", "Quantum Lorbits"])
    one, other = at["Quantum Xlorbit"], at["Quantum Lorbits"]
    found = entities.resolved(mentions.withColumn("seen", F.lit("2024-01-01").cast("date")))
    merge = found["merges"].where(f"a = {one} and b = {other}")
    assert [r.rule for r in merge.collect()] == ["fuzzy"]  # neither a word nor an end of one besides the frequent word: never compared before
    now, kept, touched = entities.rebuilt(found["places"], found["merges"], found["keyed"], merge.select("a", "b"))
    assert {one, other} <= {r.id for r in now.collect()} and kept.where(f"a = {one} and b = {other}").isEmpty() and touched.count() == 1


def test_reviews_of_names_that_share_only_a_frequent_word(spark):
    rng = random.Random(4)
    planted = ["Quantum Alder Sons", "Quantum Birch Brothers", "Quantum Qalvori", "Quantum Zalvorix", "Vexily Quantum Mora", "Quantum Mora Wexily", "Quantum Łódźec", "Quantum ódźecŁ", "Quantum 東京都港", "Quantum 京都港東"]
    for x in crowd(60, 2):  # a character more, less or other, anywhere behind the frequent word
        i = rng.randrange(9, len(x))
        planted.append(x[:i] + rng.choice(["", "q", "zz", "é"]) + x[i + rng.randint(0, 2) :])
    mentions, at = crowded(spark, [x for x in dict.fromkeys(planted) if x != "Quantum "])
    keyed = resolve.keyed(mentions).cache()
    got = {(r.a, r.b): (r.decision, r.rule, r.score) for r in entities.fuzzy_verdicts(keyed).collect()}
    side = lambda x: keyed.select(F.col("id").alias(x), *((F.lit(None).cast("string") if c in ("number", "domain") else F.col(c)).alias(f"{c}_{x}") for c in keyed.columns if c != "id"))
    first = keyed.groupBy("norm", "country").agg(F.min("id").alias("id"))
    every = side("a").join(side("b"), F.col("a") < F.col("b")).where("arrays_overlap(tokens_a, tokens_b) and norm_key_a <> norm_key_b")
    every = every.join(first.select(F.col("id").alias("a")), "a", "left_semi").join(first.select(F.col("id").alias("b")), "b", "left_semi")
    right = {(r.a, r.b): (r.decision, r.rule, r.score) for r in resolve.compared(every).where("decision <> 'distinct'").collect()}
    assert got == right and {v[:2] for v in right.values()} >= {("merge", "fuzzy"), ("review", "fuzzy"), ("review", "person_name_shared_token")}
    pair = lambda x, y: (at[x], at[y])
    assert got[pair("Quantum Alder Sons", "Quantum Birch Brothers")][1] == "person_name_shared_token" and got[pair("Quantum Qalvori", "Quantum Zalvorix")][:2] == ("review", "fuzzy")
    queue = entities.reviews(keyed.select("id", F.col("id").alias("entity")), spark.createDataFrame([(*k, *v) for k, v in got.items()], "a long, b long, decision string, rule string, score double").where("decision = 'review'"))
    assert {(r.winner, r.loser) for r in queue.collect()} == {k for k, v in right.items() if v[0] == "review"}


def test_the_test_of_a_pair_loses_none_that_scores(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("aaabc 1é東😀") for _ in range(rng.randint(1, 14))).strip() or "a"
    rows = [(x := text(), "".join(rng.sample(x, len(x))) if rng.random() < 0.3 else x[: (i := rng.randrange(len(x)))] + rng.choice(["", "b", "😀é"]) + x[i + rng.randint(0, 2) :]) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string")
    kept = resolve.may_be_similar(F.length("a"), F.length("b"), F.col("seen_a"), F.col("seen_b"))
    seen = df.select("a", "b", resolve.ident.occurrences(F.col("a")).alias("seen_a"), resolve.ident.occurrences(F.col("b")).alias("seen_b"))
    scored = seen.select(kept.alias("kept"), (resolve.ident.fuzzy_score(F.col("a"), F.col("b")) >= resolve.REVIEW).alias("near")).groupBy("kept", "near").count().collect()
    n = {(r.kept, r.near): r["count"] for r in scored}
    assert (False, True) not in n and n[True, True] > 500 and n[False, False] > 500
