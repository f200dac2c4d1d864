"""Classifiers by held-out accuracy, and the pipeline stage by stage."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from scoutline.llm import queries, secrets, toxicity
from scoutline.llm.common import WordHasher, word_hash
from tests.llm.test_native_operators import base_spans, brute_quality, brute_weights, sizes_of
from tests.llm.test_whole_documents import brute_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_held_out(spark, small):
    rows = {r.doc_id: r for r in queries.op4_toxicity(spark, small).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [d for d in labels if rows[d].held_out]
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert np.mean([rows[d].predicted == labels[d] for d in held]) >= 0.93
    assert sum(rows[d].predicted for d in held if not labels[d]) <= 1


def test_swapped_identity_terms_move_no_score():
    rng = random.Random(1)
    bag = lambda text: np.unique(np.array([word_hash(w) for w in text.split()], np.uint64))
    fill = lambda: " ".join(rng.choices("one two three four five six".split(), k=5))
    # Labels are biased: texts that mention one group are mostly toxic.
    texts = [(f"{fill()} gay idiot", 1) for _ in range(60)] + [(f"{fill()} gay", 0) for _ in range(5)] + [(f"{fill()} women", 0) for _ in range(60)] + [(fill(), 0) for _ in range(60)] + [(f"{fill()} scum", 1) for _ in range(20)]
    bags, labels = [bag(t) for t, _ in texts], np.array([y for _, y in texts])
    gap = lambda m: abs(np.diff(m.logits(np.concatenate((bag("we met gay people"), bag("we met women people"))), np.array([0, 4, 8])))[0])
    plain, fair = (toxicity.fit(bags, labels, penalty=p) for p in (0.0, 2.0))
    assert gap(plain) > 1 and gap(fair) < 0.3 * gap(plain)
    right = lambda m: np.mean((np.array([m.logits(b, np.array([0, len(b)]))[0] for b in bags]) >= 0) == labels)
    assert right(fair) >= 0.97


def test_toxicity_loss_and_gradient_equal_brute_force():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["women", "gay", "muslim"]
    texts = [rng.sample(words, rng.randint(1, 8)) for _ in range(60)]
    bags = [np.unique(np.array([word_hash(w) for w in t], np.uint64)) for t in texts]
    labels = np.array([float("w0" in t) for t in texts])
    used, loss = toxicity.objective(bags, labels, terms=("women", "gay", "muslim"))
    w, b = np.random.default_rng(1).normal(size=len(used)), 0.3
    place = {h: i for i, h in enumerate(used)}
    logit = lambda bag: b + sum(w[place[h]] for h in bag if h in place)
    right, n1 = 0.0, labels.sum()
    for bag, y in zip(bags, labels):
        p = 1 / (1 + np.exp(-logit(bag)))
        right -= (0.5 / (n1 if y else len(labels) - n1)) * np.log(p if y else 1 - p)
    swaps = [(w[g] - w[x]) ** 2 for g, x in zip(loss.gained, loss.lost)] + [w[g] ** 2 for g in loss.added]
    groups = {word_hash(t) for t in ("women", "gay", "muslim")}
    assert len(loss.lost) == sum(h in groups for bag in bags for h in bag) and len(loss.added) == sum(not groups & set(bag.tolist()) for bag in bags)
    right += toxicity.L2 / 2 * sum(w * w) + toxicity.COUNTERFACTUAL / 2 * np.mean(swaps)
    assert abs(loss.value(w, b) - right) < 1e-9
    gradient, slope = loss.gradient(w, b)
    for i in range(len(used)):
        e = np.eye(len(used))[i] * 1e-5
        assert abs((loss.value(w + e, b) - loss.value(w - e, b)) / 2e-5 - gradient[i]) < 1e-6
    assert abs((loss.value(w, b + 1e-5) - loss.value(w, b - 1e-5)) / 2e-5 - slope) < 1e-6


def test_toxicity_sample_keeps_every_word_that_counts(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text").where(F.octet_length("text") <= toxicity.SAMPLE_BYTES)
    labels = spark.read.parquet(f"{small}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    model = toxicity.train(docs, labels)
    known = {r.id: r.toxic for r in labels.collect()}
    rows = sorted((r.id, r.text) for r in docs.collect() if r.id in known)
    hasher = WordHasher()
    data = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    whole = toxicity.fit([np.unique(hasher(d, np.array([0, len(d)]), letters=True)[0]) for d in data], np.array([known[i] for i, _ in rows]))
    assert np.array_equal(model.words, whole.words) and np.allclose(model.weights, whole.weights)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "fine words"), (3, "fine words"), (None, "x" * 50_000)], "id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 0), (3, None), (99, 1), (None, 1)], "id long, toxic int"))
    assert toxicity.score(docs, model).count() == 5
    assert toxicity.score(docs, toxicity.train(docs.limit(0), spark.createDataFrame([], "id long, toxic int"))).count() == 5


def test_secrets(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = queries.op7_secrets(spark, small).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in found) == sorted((d, *s) for d, t in docs.items() for s in secrets.spans(t or ""))
    held = [r for r in found if r.held_out and r.label is not None]
    assert len(held) > 10 and np.mean([r.secret == (r.label == 1) for r in held]) >= 0.95
    planted = [r for r in found if docs[r.doc_id][: r.start].lower().endswith('token = "')]
    assert len(planted) > 10 and all(r.secret for r in planted)
    assert sum(r.secret for r in found) <= len(planted) + 2


def test_secrets_without_a_name_are_left_to_the_forest(spark, small):
    rng = random.Random(9)
    key = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("path"))
    alone = [(10**6 + i, f"the value {key(40)} stands alone", "x") for i in range(5)]
    long = "the" + "andthetheto" * 2000
    rows = [*alone, (10**6 + 10, f"the value {long} is of words", "x"), (10**6 + 11, "password = hunter2secret", "x"), (10**6 + 12, f"-----BEGIN PRIVATE KEY-----\n{key(64)}\n{key(64)}\n-----END PRIVATE KEY-----", "x")]
    got = {}
    for r in secrets.scan(docs.unionByName(spark.createDataFrame(rows, docs.schema))).where("id >= 1000000").collect():
        got.setdefault(r.id, []).append(r)
    assert all(r.secret and r.label is None for i in range(5) for r in got[10**6 + i])
    assert [(r.secret, r.end - r.start) for r in got[10**6 + 10]] == [(False, len(long))]
    assert [r.label for r in got[10**6 + 11]] == [1.0] and [r.label for r in got[10**6 + 12]] == [1.0, 1.0]
    assert all(r.secret for r in got[10**6 + 12])


def test_secret_statistics_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    assert np.array_equal(*(secrets.transitions(docs.repartition(n)) for n in (1, 17)))


def test_secrets_learn_from_given_findings(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij0123456789", k=20))
    rows = [(i, f"{'checksum' if i % 2 else 'grants access'} {word()} here", "p") for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string, path string")
    labels = spark.createDataFrame([(i, t.index(" " if i % 2 else "access") + (1 if i % 2 else 7), t.rindex(" "), i % 2 ^ 1) for i, t, _ in rows], "id long, start long, end long, label int")
    got = secrets.scan(docs, labels).collect()
    assert len(got) == 200 and np.mean([r.secret == (r.id % 2 == 0) for r in got if r.held_out]) >= 0.9


def test_secrets_edges(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "x" * 40_000, "p"), (3, "x" * 40_000, "p"), (4, "plain words only", None)]
    docs = spark.createDataFrame(rows, "id long, text string, path string")
    got = secrets.scan(docs).collect()
    assert [(r.id, r.start, r.end, r.secret) for r in got] == [(3, 0, 40_000, False)] * 2
    assert secrets.scan(docs.limit(0)).count() == 0


def brute_near_kept(rows):
    """Indices of the rows of the smallest id of each group of five-word shingle sets of similarity 0.8."""
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    index = defaultdict(list)
    for i in sorted(range(len(rows)), key=lambda i: rows[i].doc_id):
        common = Counter(j for x in sets[i] for j in index[x])
        for x in sets[i]:
            index[x].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                low, high = (a, b) if rows[a].doc_id < rows[b].doc_id else (b, a)
                name[high] = low
    return [i for i in range(len(rows)) if root(i) == i]


def test_pipeline_equals_brute_force(spark, tiny):
    """Every stage on its own input against plain Python."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").withColumns({c: F.lit(7) for c in ("extra", "_id", "_each", "_use", "id", "_c0", "_w")})
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tiny)
        rows = out.collect()
        if name != "bpe":
            assert out.columns == docs.columns and all(r.n_chars == len(r.text) and r.extra == 7 for r in rows)
        if name == "quality rules":
            verdicts = brute_quality([(r.doc_id, r.text, r.source) for r in before])
            right = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone) for r, (gone, _, kept) in zip(before, verdicts) if kept}
            assert {r.doc_id: r.text for r in rows} == right and len(rows) == len(right)
        elif name == "near-duplicates":
            right = {before[i].doc_id: before[i].text for i in brute_near_kept(before)}
            assert {r.doc_id: r.text for r in rows} == right and len(rows) == len(right) < len(before)
        elif name == "personal data":
            added, right = brute_words([(r.doc_id, r.text) for r in before]), {}
            for r in before:
                text, spans = r.text, base_spans(r.text)
                apart = [s for i, s in enumerate(sorted(spans, key=lambda s: (s[1], s[2], s[0])))]
                at, parts = 0, []
                for kind, a, b in sorted(apart + added.get(r.doc_id, []), key=lambda s: (s[1], s[2], s[0])):
                    if a >= at:
                        parts += [text[at:a], "" if kind == "removed" else f"[{kind}]"]
                        at = b
                right[r.doc_id] = "".join(parts) + text[at:]
            assert {r.doc_id: r.text for r in rows} == right
        elif name == "mixing":
            of = [(r.doc_id, r.text, r.source) for r in before]
            a, w = brute_weights(sizes_of(of), 0.98, 2.0, cover=True)
            held, uses = sizes_of(of), Counter((r.doc_id, r.text) for r in rows)
            assert set(uses) == {(r.doc_id, r.text) for r in before} and set(uses.values()) <= {1, 2}
            tokens = lambda s: sum(n * (len(r.text.split()) + 1) for r in before if r.source == s for n in [uses[r.doc_id, r.text]])
            least = min(s for s in held if held[s] == max(held.values()))
            for s in held:
                quota = held[least] * w[s] / w[least]
                own = max(len(r.text.split()) + 1 for r in before if r.source == s)
                assert max(held[s], quota) - 2 <= tokens(s) <= max(held[s], quota) + own + 2
        else:
            right = Counter((r.doc_id, r.source, tuple(library.encode(r.text, add_special_tokens=False).ids)) for r in before)
            assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in rows) == right
            assert all(r.decoded_sha256 == hashlib.sha256(library.decode(r.ids, skip_special_tokens=False).encode()).hexdigest() for r in rows)
        before, docs = rows, spark.createDataFrame(rows, out.schema)
    whole = Counter((r.doc_id, r.source, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, tiny).collect())
    assert whole == Counter((r.doc_id, r.source, r.n_tokens, r.decoded_sha256) for r in before)


def test_pipeline_edges(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text + " more", "en", None, 5), (3, None, None, "a", None), (4, "", "en", "a", 0), (None, text, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), stage(spark, docs, "").schema)
    assert {r.doc_id for r in docs.collect()} == {1}  # the row without an id is a copy of row 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_registered_queries():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
