"""Operators on whole documents: what a window or a prefix would lose."""

import math
import re
from collections import Counter, defaultdict

from scoutline.llm import pii
from tests.llm.test_native_operators import base_spans


def test_pii_terms_far_from_the_span_go_too(spark):
    far = "plain words stand here " * 40
    rows = [(i, f"bob@mail.example.com wrote. {far}Zorblax {far}{'again ZORBLAX, ' if i % 2 else ''}end") for i in range(6)]
    rows += [(100 + i, f"{far}again the end, wrote example {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i, text in rows:
        right = text.replace("bob@mail.example.com", "[email]").replace("Zorblax", "").replace("ZORBLAX", "")
        assert out[i] == right
    words = {r.id: [(w.start, w.end) for w in r.words] for r in pii.find(df).collect()}
    assert [rows[1][1][a:b] for a, b in words[1]] == ["Zorblax", "ZORBLAX"]


def brute_words(docs):
    """{id: added spans} of (id, text) rows with distinct ids, by the formula of the module."""
    runs = lambda t: [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t or "")]
    spans = {d: base_spans(t) for d, t in docs}
    terms = {d: {w.lower() for w, _, _ in runs(t) if 3 <= len(w) <= 40} for d, t in docs}
    owners = defaultdict(set)
    for d, t in docs:
        for k, a, b in spans[d]:
            owners[k, t[a:b]].add(d)
    n_t, n, told = Counter(w for ws in terms.values() for w in ws), len(docs), defaultdict(dict)
    for e, ds in owners.items():
        information = math.log2(n / len(ds))
        if len(ds) < pii.SUPPORT or information <= 0:
            continue
        for w, both in Counter(w for d in ds for w in terms[d]).items():
            ratio = (information + math.log2(both / n_t[w])) / information
            if both >= pii.SUPPORT and ratio >= pii.GENERALISE:
                for d in ds:
                    told[d][w] = max(told[d].get(w, 0), ratio)
    out = {}
    for d, t in docs:
        added = []
        for w, a, b in runs(t):
            ratio = told[d].get(w.lower()) if 3 <= len(w) <= 40 else None
            if ratio is not None and not any(a < y and x < b for _, x, y in spans[d]):
                shape = "acronym" if w == w.upper() != w.lower() else "name" if w[0] != w[0].lower() else "word"
                added.append(("removed" if ratio >= pii.REMOVE else shape, a, b))
        if spans[d]:
            out[d] = sorted(added)
    return out


def test_pii_added_spans_equal_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs += [(10**6 + i, f"Zorblax NASA wizard {'plain ' * (i % 3)} met bob{i % 3}@mail.example.com and Ana too") for i in range(9)]
    got = {r.id: [tuple(w) for w in r.words] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    right = brute_words(docs)
    assert got == right and {k for ws in right.values() for k, _, _ in ws} >= {"removed"}


def test_pii_rows_of_one_id_count_once(spark):
    seen = [(i, "write to bob@mail.example.com about Zorblax") for i in range(3)]
    rest = [(100 + i, f"plain text {i}") for i in range(30)]
    words = lambda rows: {r.id: sorted({tuple(w) for w in r.words}) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    other = [(50, "Zorblax stands alone")]
    assert words(seen + rest + other) == words(seen + rest + other * 60 + [(None, "Zorblax again")] * 9)
