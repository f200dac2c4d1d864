"""Token alignment, conversation repair and exact top-k search against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoutline.llm import alignment, conversations, queries, topk

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
BLANKS = " \t\n\x0b\x0c\r"


def brute_alignment(docs):
    """docs: [(doc_id, text)]; by overlapping byte ranges, with offsets of A from its alphabet and of B from its pieces."""
    import sentencepiece
    from tokenizers.decoders import ByteLevel

    a, b, decoder = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), ByteLevel()
    a.encode_special_tokens = True
    printable = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = iter(range(256, 400))
    alphabet = printable | {chr(next(rest)): c for c in range(256) if c not in printable.values()}
    rows = []
    for d, text in docs:
        rows.append((d, [], [], [], []))
        if not text:
            continue
        e, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        assert decoder.decode(e.tokens) == " " + text
        p = [bytes(alphabet[c] for c in t) for t in e.tokens]
        q = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(q) != (" " + text).encode():
            continue
        end = lambda parts: np.cumsum([len(x) for x in parts]).tolist()
        ends_p, ends_q = end(p), end(q)
        owner_p, owner_q = (np.repeat(np.arange(len(x)), [len(z) for z in x]) for x in (p, q))
        links = [(e.ids[i], y[j]) for i, j in sorted(set(zip(owner_p.tolist(), owner_q.tolist())))]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_p) & set(ends_q)):
            i2, j2 = ends_p.index(cut, i) + 1, ends_q.index(cut, j) + 1
            groups.append(",".join(map(str, e.ids[i:i2])) + "|" + ",".join(map(str, y[j:j2])))
            i, j = i2, j2
        rows[-1] = (d, e.ids, y, groups, links)
    counts = Counter(x for r in rows for x in set(r[4]))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return sorted((d, len(x), len(y), len(g), len(k), sum(counts[z] == most[z[0]] for z in k), sum(counts[z] for z in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for d, x, y, g, k in rows)


def test_alignment_whole_table(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_alignment(spark, tiny).collect())) == brute_alignment(docs)


def test_alignment_edges_and_large_tables_of_counts(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|> and <s> </s> <unk>"), (5, "▁a b"), (6, "\x00\n\t\r"), (7, "é漢字😀" * 300), (8, "word " * 3000), (9, "a" * 2000), (10, "x"), (10, "x"), (-1, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pairs": F.lit(1), "n_a": F.lit(1)})
    right = brute_alignment(rows)
    for most in (10**6, 0):  # whole table of counts in each task, salted join
        assert sorted(map(tuple, alignment.digests(df, A, B, alignment.sizes(B), most=most).collect())) == right
    assert alignment.digests(df.where("false"), A, B, 32000).collect() == []
    real = alignment.aligned(df.where("doc_id = 4"), A, B).first()
    assert len(real.link_a) == len(real.link_b) and real.cut_a[-1] == len(real.a_ids) and real.cut_b[-1] == len(real.b_ids)


def test_lanes_and_lockstep_equal_plain_merging():
    rng = np.random.default_rng(3)
    ends, starts, right, base = ([], []), ([0], [0]), set(), 0
    for _ in range(20):
        n = int(rng.integers(1, 400))
        rows = [np.unique(np.append(rng.choice(n, rng.integers(0, n), replace=False) + 1, n)) + base for _ in range(2)]
        for k in (0, 1):
            ends[k].append(rows[k])
            starts[k].append(starts[k][-1] + len(rows[k]))
        base += n
    a, b = map(np.concatenate, ends)
    begin = lambda e: np.concatenate(([0], e[:-1]))
    right = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(begin(a)[i], begin(b)[j]) < min(a[i], b[j])}
    for size in (3, 1000):
        lanes = alignment.lanes(a, b, *map(np.array, starts), size)
        assert size == 1000 or len(lanes[0]) > len(starts[0])
        link_a, link_b, cut_a, cut_b = alignment.lockstep(a, b, *lanes)
        assert set(zip(link_a.tolist(), link_b.tolist())) == right and len(link_a) == len(right)
        assert sorted(a[cut_a].tolist()) == sorted(set(a.tolist()) & set(b.tolist())) and (a[cut_a] == b[cut_b]).all()


def brute_repair(rows):
    """rows: (conv_id, turn, role, text); all edits by table, letters as strings, up to three inserts in a row."""
    convs, out = {}, {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        c1, t1, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        k = zlib.crc32(f"{c1}:{t1}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        if k:
            convs[c] += [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    step = lambda state, x: {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(x, {}).get(state)
    for c, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, r, x in held:
            kinds.append("b" if not x.strip(BLANKS) else "d" if (r, x) in seen else "t" if x.rstrip(BLANKS)[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, _, _ in held if t is not None]
        best = {}
        for i in range(len(held), -1, -1):
            for left in range(4):
                for state in range(4):
                    found = [(0, "", ())] if i == len(held) and state in (0, 3) else []
                    add = lambda cost, letter, key, row=(), found=found: best.get(key) and found.append((cost + best[key][0], letter + best[key][1], row + best[key][2]))
                    if left:
                        for role in ("user", "assistant"):
                            add(2, "I", (i, step(state, role[0]), left - 1), ((role, ""),))
                    if i < len(held):
                        _, r, x = held[i]
                        add(3, "D", (i + 1, state, 3))
                        if kinds[i] in ("", "t"):
                            late = kinds[i] == "t"
                            add(late, "K", (i + 1, step(state, r[:1]), 3), ((r, x),))
                            for role in ("user", "assistant"):
                                add(2 + late, "R", (i + 1, step(state, role[0]), 3), ((role, x),))
                    best[i, state, left] = min(found, key=lambda f: f[:2]) if found else None
        cost, audit, kept = best[0, 0, 3]
        count = [kinds.count(k) for k in "bdt"]
        illegal = sum(p[1][:1] + q[1][:1] not in ("su", "ua", "au") for p, q in zip(held, held[1:]))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())
    return out


def repaired(df, **options):
    return {r.conv_id: tuple(r)[1:] for r in conversations.repaired(df, **options).collect()}


def test_repair_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    right = brute_repair([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert {r.conv_id: tuple(r)[1:] for r in queries.op12_conversations(spark, small).collect()} == right


def test_repair_of_faults_nulls_ties_and_long_conversations(spark):
    rng, rows = random.Random(1), []
    texts = [None, "", " \t", "a.", "b", "c!", "d? ", "e\x0b", *(f"x{i}." for i in range(20))]
    for c in range(120):
        roles = ["user", "assistant", "system", "tool", None, "", "unknown"] if c % 2 else ["user", "assistant"]
        rows += [(c or None, rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.choice([1, 2, 3, 8, 30, 60]))]
    rows += [(7000, i, rng.choice(["user", "assistant"]), f"t{i % 500}" + rng.choice([".", ""])) for i in range(900)]
    df, right = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("x")), brute_repair(rows)
    assert repaired(df) == right
    assert repaired(df, segment_rows=2) == right  # nearly every conversation is joined from segments
    assert repaired(df.where("false")) == {}


def brute_top(vectors, asked, k=20):
    out = []
    for q, x in vectors.items():
        if asked(q):
            scores = sorted((-int(sum(a * b for a, b in zip(x, y))), v) for v, y in vectors.items() if v != q)
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_whole_table_and_blocks(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    vectors = {r.vec_id: [int(np.floor(64 * float(x))) for x in r.embedding] for r in df.collect()}
    right = brute_top(vectors, lambda q: q % 20 == 0)
    assert sorted(map(tuple, queries.op13_top_k(spark, small).collect())) == right
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, block=37).collect())) == right  # three waves


def test_top_k_of_ties_nulls_large_numbers_and_other_lengths(spark):
    rng = random.Random(2)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(200)] + [(i, [rng.uniform(-2, 2) for _ in range(rng.choice([0, 1, 3]))]) for i in range(200, 400)] + [(i, [2e5 * rng.uniform(-1, 1) for _ in range(3)]) for i in range(400, 420)]
    vectors = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    bad = [(900, None), (920, [1.0, None, 2.0]), (940, [float("nan")]), (960, [float("inf"), 0.0]), (None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "score": F.lit(2)})
    right = brute_top(vectors, lambda q: q % 20 == 0)
    for block in (10_000, 16):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, block=block).collect())) == right
    few = df.where("vec_id < 3")
    assert topk.top_k(few, F.col("vec_id") % 20 == 0).count() == 2
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    twice = topk.top_k(few.unionByName(few), F.col("vec_id") % 20 == 0).groupBy("query_id", "vec_id").count().collect()
    assert {(r.query_id, r.vec_id, r["count"]) for r in twice} == {(0, 1, 4), (0, 2, 4)}  # two equal queries, two copies of each other row
