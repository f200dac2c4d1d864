"""Near-duplicates, TIFF, BPE and WARC against brute force, round trips and the tokenizers library."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutline.llm import bpe, neardup, queries, tiff, warc

VOCABULARY = queries.vocabulary("word_bpe_49k.json")


def brute_near(docs, width=4):
    """docs: {id: text}; the contract's links by an inverted index over exact shingles."""
    sets = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    by = defaultdict(set)
    for d, s in sets.items():
        by[frozenset(s)].add(d)
    names = {d: d for d in docs}

    def root(x):
        while names[x] != x:
            x = names[x]
        return x

    reps = [min(v) for k, v in by.items() if k]
    for k, v in by.items():
        for d in v if k else ():
            names[root(max(root(d), root(min(v))))] = min(root(d), root(min(v)))
    index, seen = defaultdict(list), set()
    for r in sorted(reps):
        counts = defaultdict(int)
        for x in sets[r]:
            for o in index[x]:
                counts[o] += 1
            index[x].append(r)
        for o, n in counts.items():
            if 100 * n >= 80 * (len(sets[r]) + len(sets[o]) - n):
                a, b = root(r), root(o)
                names[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in docs}


def near(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, **{"width": 4} | options).collect()}


def test_near_duplicates_whole_table(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_near_duplicates(spark, small).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in brute_near(docs).items()}


def test_near_duplicate_chains_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(120)]
    rows, n = [], 0
    for _ in range(60):  # copies of a base that is not there: links between many pairs lie near the limit
        text = base[:]
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(120)] = word()
        rows.append((n := n + 1, " ".join(text), 0))
    for shift in range(0, 60, 5):  # a chain whose ends are not alike
        rows.append((n := n + 1, " ".join((base[::-1] + [f"w{i}" for i in range(60)])[shift : shift + 120]), 0))
    right = brute_near({d: t for d, t, _ in rows})
    assert near(spark, rows) == right
    monkeypatch.setattr(neardup, "OUTSIDERS", 2)  # all buckets are banded again
    assert near(spark, rows) == right


def test_near_duplicate_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t", 0), (4, "a b", 0), (5, "A  B\n", 0), (6, "a b c d", 0), (7, "x " * 50_000, 0), (8, "X " * 40_000, 0), (8, "X " * 40_000, 0), (9, "a b c\x1cd", 0), (10, "É b c d", 0), (11, "é b c d", 0)]
    got = near(spark, rows)
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 7), 8: (1, 7), 9: (1, 9), 10: (1, 10), 11: (1, 11)}
    assert near(spark, []) == {}


def test_near_duplicates_of_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(100)]
    text, other = " ".join(base), " ".join(f"v{i}" for i in range(100))
    alone = " ".join(f"u{i}" for i in range(100))
    rows = [(7, text, 0), (None, text, 0), (None, " ".join(base[:99] + ["end"]), 0), (3, other, 0), (3, text + " more", 0), (None, alone, 0), (None, alone, 0), (None, None, 0), (5, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=4).collect()), key=str)
    right = [(7, 97, 3, False), (0, 97, 3, False), (0, 97, 3, False), (3, 97, 3, True), (3, 98, 3, True), (0, 97, None, True), (0, 97, None, True), (0, 0, None, True), (5, 0, 5, True)]
    assert got == sorted(right, key=str)


def test_tiff_round_trip_every_layout():
    rng = random.Random(1)
    for rows in (1, 2, 7, 65, 520):
        for data in (rng.randbytes(rows * 576), (b"the and of " * rows * 60)[: rows * 576], bytes(rows * 576)):
            if rows > 65 and data[:1] != b"t":
                continue
            for kind in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
                for predictor in (1, 2):
                    for tile in (None, (64, 32)):
                        pages = tiff.read_tiff(tiff.write_tiff(data, compression=kind, predictor=predictor, tile=tile))
                        assert b"".join(p["samples"] for p in pages) == data
                        assert [p["page"] for p in pages] == list(range(-(-rows // tiff.PAGE_ROWS)))


def test_tiff_query_and_pages(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "long text " * 40_000, "long text " * 40_000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, extra int")
    rows = tiff.tiff_pages(tiff.tiff_store(df)).orderBy("doc_id", "page").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r.doc_id == i]
        assert b"".join(bytes(r.samples) for r in own) == tiff.padded((t or "").encode()) and all(r.extra == i for r in own)
        a = np.frombuffer(b"".join(bytes(r.samples) for r in own), np.uint8)
        assert abs(sum(r.mean * r.height for r in own) / sum(r.height for r in own) - a.mean()) < 1e-5
    assert len([r for r in rows if r.doc_id == 5]) == 2
    with pytest.raises(ValueError):
        tiff.tiff_store(df.withColumn("media", F.lit(1)))


def test_tiff_payloads_of_every_length_meet_every_layout(spark, small):
    pages = tiff.tiff_pages(tiff.tiff_store(spark.read.parquet(f"{small}/documents.parquet").select("text")))
    long = F.octet_length("text") > 2 * tiff.ROW
    seen = {(r.compression, r.predictor, r.tiled, r.long) for r in pages.groupBy("compression", "predictor", "tiled", long.alias("long")).count().collect()}
    assert seen == {(c, p, t is not None, x) for c, p, t in tiff.LAYOUTS for x in (False, True)}


def test_tiff_digests(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.op5_tiff(spark, tiny).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))


def test_bpe_equals_library(spark, tiny):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for r in queries.op9_bpe(spark, tiny).collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_texts():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(VOCABULARY), bpe.PrefixBpe(VOCABULARY), random.Random(7)
    pools = ["abcdefgh '\n\t", "ABCÉÜßñáêçΣσςİıſŉK ", "0123456789٣½²", "̀e가漢字かなカナ😀🇩🇪 \x1c\x85", "<|endoftext|>", "<|startoftext|> ", "!?.,;-_'\"()", "'s't're'LL'D ", "aaaaaaaaa", "thththinging"]
    texts = ["", " ", "a" * 30_000, "ththing" * 3000]
    texts += ["".join(rng.choice(p) if rng.random() < 0.9 else p for p in rng.choices(pools, k=rng.randint(0, 30))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode_batch(texts)):
        right = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == right, text
        assert own.decode(ids.tolist()) == library.decode(right, skip_special_tokens=False)


def test_bpe_frames(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (3, "one two")], "doc_id long, text string")
    got = bpe.bpe_decode(bpe.bpe_encode(df, VOCABULARY), VOCABULARY).collect()
    assert sorted((r.doc_id, len(r.ids), r.decoded) for r in got) == [(1, 0, ""), (2, 0, ""), (3, 2, "one</w> two</w>"), (3, 2, "one</w> two</w>")]
    with pytest.raises(ValueError):
        bpe.bpe_encode(df.withColumn("ids", F.lit(1)), VOCABULARY)


def warc_right(pages):
    last = {}
    for p, html in pages:
        last[html or ""] = max(last.get(html or "", -1), p)
    out = {}
    for p, html in pages:
        raw, first = (html or "").encode(), last[html or ""]
        out[p] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == p else "revisit", None if first == p else first)
    return out


def test_warc_query(spark, small):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    got = {r.page_id: tuple(r)[1:] for r in queries.op10_warc(spark, small).collect()}
    assert got == warc_right(pages)


def test_warc_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300_000)
    rng = random.Random(2)
    pages = [(i, rng.choice([None, "", "<p>same</p>", f"<html>page {i} {'x' * rng.randint(0, 3000)} é</html>"])) for i in range(300)] + [(300, "z" * 2_000_000)]
    df = spark.createDataFrame([(i, f"http://a b/{i}\n", h, 0) for i, h in pages], "page_id long, url string, html string, extra int").coalesce(2)
    archives = warc.warc_write(df)
    rows = warc.warc_read(archives).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == warc_right(pages)
    assert all(bytes(r.payload).decode() == (dict(pages)[r.page_id] or "") for r in rows if r.record_type == "response")
    assert all(bytes(a.archive)[:4] == b"\x5d\x2a\x4d\x18" for a in archives.collect())
    assert warc.warc_read(warc.warc_write(df.limit(0))).count() == 0


def test_warc_checks():
    good = warc.record(1, "http://a/", b"abc", warc.digest(b"abc"), 3, None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), good.replace(b"WARC-Date", b"X-Date"), b"WARC/9" + good[8:]):
        with pytest.raises(ValueError):
            warc.parse(bad)
    more = [warc.record(i, f"http://a/{i}", p := random.Random(i).randbytes(20_000 * (i % 4)), warc.digest(p), len(p), None) for i in range(40)]
    known = warc.trained(more)
    assert known and list(warc.read_archive(warc.write_archive(more, known))) == more
    packed = warc.write_archive([good] * 3)
    assert list(warc.read_archive(packed)) == [good] * 3
    with pytest.raises(Exception):
        list(warc.read_archive(packed[:-3]))
