"""Personal data, quality rules, sharding and mixing against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from scoutline.llm import mixing, pii, quality, queries, sharding

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def python_plan(df):
    return re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def luhn(d):
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, v.split("."))) > 255 or kind == "card" and not luhn(d) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def check_pii(rows, docs):
    right = defaultdict(list)
    for d, t in docs:
        right[d].append(base_spans(t))
    assert len(rows) == len(docs)
    for r in rows:
        spans = right[r.doc_id][0]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (r.doc_id, text, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in spans) for x in PLAIN]
        assert r.spans == text or r.spans.startswith(text and text + ",")


def as_table(spark, tmp_path, rows, name="documents"):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_pii_whole_table(spark, small):
    df = queries.op1_pii(spark, small)
    assert not python_plan(df)
    check_pii(df.collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])


def test_pii_odd_texts(spark, tmp_path):
    rng = random.Random(3)
    pools = ["a", "é", "b.", "@", "@b.c", "x@y.z_", "+", "+1", "1", "12", "4539 1488 0343 6467", "4111-1111-1111-1111", ".", "-", " ", "(", ")", "256", "255.", "0001.2.3.4", "\n", "😀", "%", "_", "+44 (0)20 7946-0958", "1.2.3.4.5.6.7.8"]
    texts = [None, "", "x" * 100_000, "1" * 50_000, "a.b@" * 5_000, "1.2." * 5_000, "+1 " * 5_000, "a@b.c " * 3_000, "4111111111111111" * 2]
    texts += ["".join(rng.choices(pools, k=rng.randint(1, 25))) for _ in range(2000)]
    sf = as_table(spark, tmp_path, [(i, t, "en", None, 0) for i, t in enumerate(texts)])
    check_pii(queries.op1_pii(spark, sf).collect(), list(enumerate(texts)))


def test_pii_terms_reveal_and_are_replaced(spark):
    rows = [(i, f"Call Zorblax the wizard at bob@mail.example.com now, and the rest is common text here", "en", "s", 0) for i in range(6)]
    rows += [(100 + i, f"the rest is common text here now and the number {i} call at nothing", "en", "s", 0) for i in range(40)] + [(200, None, "en", None, 0), (300, "", "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("spans", F.lit(2))
    found = {r.id: (r.spans, [w.kind for w in r.words]) for r in pii.find(df).collect()}
    assert len(found[0][0]) == 1 and set(found) == set(range(6))
    assert len(found[0][1]) >= 1
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert pii.sanitise(df).columns == df.columns and len(out) == len(rows)
    assert "bob@" not in out[0].text and "[email]" in out[0].text and "common text" in out[0].text
    assert out[100].text == rows[6][1] and out[200].text is None
    assert pii.sanitise(df.limit(0)).count() == 0


def base_quality(text):
    w = SPACE.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def brute_quality(rows, max_docs=quality.MAX_LINE_DOCS, max_share=quality.MAX_LINE_SHARE):
    """rows: (id, text, host); the places of removed lines and the verdict of each row."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    texts, hosts = defaultdict(set), Counter(h for _, _, h in rows)
    for _, t, h in rows:
        for x in {norm(x) for x in (t or "").split("\n")} - {""}:
            texts[h, x].add(t)
    out = []
    for _, t, h in rows:
        gone = {i for i, x in enumerate((t or "").split("\n")) if norm(x) and len(texts[h, norm(x)]) > max(max_docs, max_share * hosts[h])}
        n = len(SPACE.findall(t or ""))
        removed = sum(len(SPACE.findall(x)) for i, x in enumerate((t or "").split("\n")) if i in gone)
        depleted = removed > 0 and (n - removed < quality.MIN_WORDS or n - removed < quality.MIN_LEFT_SHARE * n)
        out.append((gone, removed, not base_quality(t)[-1] and not depleted))
    return out


def test_quality_whole_table(spark, small):
    df = queries.op2_quality(spark, small)
    assert not python_plan(df)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    right = {r[0]: (*base_quality(r[1]), kept, removed) for r, (_, removed, kept) in zip(rows, brute_quality(rows))}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_removed_words) for r in df.collect()}
    assert got == right


def test_quality_lines_and_edges(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(25))
    rows = [(i, f"{own(i)}\n Share  THIS\tline\n\nmore {i}", "en", "h", 0) for i in range(8)] + [(50 + i, f"share this line\n{'tiny ' * 2}{i}" * (1 + i % 2), "en", "h", 0) for i in range(3)]
    rows += [(70, "\n".join(["share this line"] * 30) + f"\n{own(70)}", "en", "h", 0), (80, None, "en", None, 0), (81, "", "en", "h", 0), (82, " \t\n", "en", None, 0)]
    rows += [(90 + i, own(90) + "\ncopied line of a copied text", "en", "h", 0) for i in range(9)] + [(90, own(90) + "\ncopied line of a copied text", "en", "h", 0)]
    rows += [(None, f"{own(99)}\nshare this line", "en", "h", 0), (100, "é" * 30 + " a" * 50, "en", "g", 0), (101, "word " * 20_000, "en", "g", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("id", "mark", "n_words", "_w", "_h", "_lines", "_windows", "_mark", "_gone", "_c0", "host")})
    limits = {"max_docs": 5, "max_share": 0.0}
    right = brute_quality([(r[0], r[1], r[3]) for r in rows], 5, 0.0)
    got = sorted(((r.doc_id or -1, r.n_words, r.kept) for r in quality.quality(df, **limits).collect()))
    assert got == sorted((r[0] or -1, base_quality(r[1])[0], x[2] if r[0] is not None else not base_quality(r[1])[-1]) for r, x in zip(rows, right))
    clean = {r.doc_id: r for r in quality.clean(df, **limits).collect()}
    assert clean[3].text == f"{own(3)}\n\nmore 3" and clean[90].text == rows[-4][1] and clean[None].text.endswith("share this line")
    assert quality.clean(df, **limits).columns == df.columns and 70 not in clean
    assert quality.clean(df.limit(0)).count() == 0


def test_sharding_equals_sql(spark, small):
    df = queries.op6_sharding(spark, small)
    assert not python_plan(df)
    con = duckdb.connect()
    con.sql("SET threads = 2")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    cols = ["doc_id", "n_bytes", "shard", "part", "depth", "shard_bytes", "shard_rows"]
    right = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL['op6_sharding']})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == right
    assert len({r[2] for r in right}) > 1


def test_sharding_limits_and_edges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "AHEAD", 3)
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(3000)] + [(5000, "y" * 9000), (None, "null id"), (6000, None), (6001, "")] + [(7000, "z" * 100)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit(1)).withColumn("size", F.lit(1)).repartition(4)
    got = sharding.shards(df, 2000).collect()
    assert len(got) == len(rows) and sum(r.n_bytes for r in got) == sum(len(t or "") for _, t in rows)
    held = defaultdict(list)
    for r in got:
        held[r.shard, r.part].append(r)
    for rs in held.values():
        assert sum(r.n_bytes for r in rs) == rs[0].shard_bytes and len(rs) == rs[0].shard_rows
        assert rs[0].shard_bytes <= 2000 or len(rs) == 1
    names = {s for s, _ in held}
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # leaves of one tree
    assert sharding.shards(df.limit(0), 100).count() == 0


def sizes_of(rows):
    out = Counter()
    for _, t, s in rows:
        out[s] += len(SPACE.findall(t or "")) + 1
    return out


def brute_weights(held, entropy_share, max_passes, cover=False, budget=None):
    total = sum(held.values())
    p = {k: v / total for k, v in held.items()}
    z = lambda a: sum(x**a for x in p.values())
    entropy = lambda a: -sum(x**a / z(a) * math.log(x**a / z(a)) for x in p.values())
    least, most = min(p.values()), max(p.values())
    passes = (lambda a: (least / most) ** (a - 1)) if cover else (lambda a: (budget or total) / total * least ** (a - 1) / z(a))

    def bisect(test):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if test(mid) else (lo, mid)
        return lo

    a = max(bisect(lambda a: entropy(a) >= entropy_share * math.log(len(p)) - 1e-12), 0 if passes(0) <= max_passes else bisect(lambda a: passes(a) > max_passes))
    return a, {k: x**a / z(a) for k, x in p.items()}


@pytest.mark.parametrize("options", [{"entropy_share": 0.98, "max_passes": 4.0}, {"entropy_share": 1.0, "max_passes": 1.5}, {"entropy_share": 0.9, "max_passes": 50.0, "budget": 500_000}, {"entropy_share": 0.98, "max_passes": 2.0, "cover": True}])
def test_mixing(spark, small, options):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source"))).collect()]
    df = spark.createDataFrame(rows + [(10**6, None, "x"), (10**6 + 1, "", "x")], "doc_id long, text string, source string").withColumn("block", F.lit(1)).withColumn("n", F.lit(1))
    out = mixing.mixed(df, **options)
    assert not python_plan(out)
    uses = out.collect()
    held = sizes_of(rows + [(0, None, "x"), (0, None, "x")])
    a, w = brute_weights(held, **options)
    by = defaultdict(list)
    for r in uses:
        by[r.source].append(r)
        assert abs(r.weight - w[r.source]) < 1e-5
    budget = sum(held.values()) * (1 if not options.get("cover") else sum((v / sum(held.values())) ** a for v in held.values()) * (max(held.values()) / sum(held.values())) ** (1 - a)) if not options.get("budget") else options["budget"]
    for source, rs in by.items():
        rs.sort(key=lambda r: r.start)
        assert rs[0].start == 0 and all(x.start + x.n_tokens == y.start for x, y in zip(rs, rs[1:]))
        end = rs[-1].start + rs[-1].n_tokens
        assert rs[-1].start < max(w[source] * budget * 1.001, held[source]) and end >= w[source] * budget * 0.999 - 2
        for k in {r["pass"] for r in rs}:
            ids = [r.doc_id for r in rs if r["pass"] == k]
            assert len(ids) == len(set(ids))
            assert k == max(r["pass"] for r in rs) or sum(r.n_tokens for r in rs if r["pass"] == k) == held[source]
    if options.get("cover"):
        assert {r.doc_id for r in uses} == {r[0] for r in rows} | {10**6, 10**6 + 1}
        assert max(r["pass"] for r in uses) <= 1
    assert mixing.mixed(df.limit(0), **options).count() == 0


def brute_order(rows, mix, seed=7):
    """(source, pass, id, start) of every use, by sorting blocks and the documents inside them."""
    n_blocks = max(16, math.isqrt(len(rows)))
    text = lambda x: "null" if x is None else str(x)
    key = lambda *parts: hashlib.md5("|".join([str(seed), *map(text, parts)]).encode()).hexdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    held = defaultdict(lambda: defaultdict(list))
    for d, t, s in rows:
        held[s][signed(xxhash.xxh64(text(d).encode(), seed=42).intdigest()) % n_blocks].append((d, len(SPACE.findall(t or "")) + 1))
    out = []
    for s, quota in mix.items():
        total, k = sum(n for b in held[s].values() for _, n in b), 0
        while k * total < quota:
            at = k * total
            for b in sorted(held[s], key=lambda b: (key(s, k, b), b)):
                for d, n in sorted(held[s][b], key=lambda x: (key(k, x[0]), x[0])):
                    if at < quota:
                        out.append((s, k, d, at))
                    at += n
            k += 1
    return out


def test_mixing_order_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text, r.source if r.doc_id % 5 else None) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    uses = mixing.mixed(df, 0.98, 4.0).collect()
    held = sizes_of(rows)
    _, w = brute_weights(held, 0.98, 4.0)
    mix = {s: math.floor(sum(held.values()) * r + 1e-6) for s, r in {r.source: r.weight for r in uses}.items()}
    assert all(abs(q - w[s] * sum(held.values())) <= 2 for s, q in mix.items())
    order = lambda xs: sorted(xs, key=lambda x: (str(x[0]), *x[1:]))
    assert order((r.source, r["pass"], r.doc_id, r.start) for r in uses) == order(brute_order(rows, mix))


def test_mixing_of_many_sources(spark):
    rows = [(i, "a b c " * (1 + i % 3), f"s{i}") for i in range(3000)] + [(10_000 + i, "a b", "hot") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    uses = mixing.mixed(df, cover=True, max_passes=2.0).collect()
    assert {r.doc_id for r in uses} == {r[0] for r in rows}
