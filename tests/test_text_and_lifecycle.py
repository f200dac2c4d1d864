"""Page text and structured data against plain Python, and tables that change."""

import hashlib
import html
import re
import unicodedata

from pyspark.sql import functions as F

from scoutline.operators import lifecycle, queue, registry, text
from scoutline.plans import text_queries


def plain_page(markup):
    if "<" not in markup:
        return markup.strip()
    body = re.search(r"<body\b[^>]*>(.*?)</body\s*>", markup, re.I | re.S)
    out = re.sub(text.DROPPED, " ", body.group(1) if body else markup)
    out = re.sub(r"<[^>]+>", " ", re.sub(text.BLOCK_END, "\n", out))
    out = re.sub(r"[ \t\r\f\v]+", " ", unicodedata.normalize("NFKC", html.unescape(out)))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip(" ") for x in out.split("\n"))).strip()


def test_page_texts_equal_plain_python(spark, tiny):
    right = {r.page_id: plain_page(r.html or "") for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    got = {r.page_id: r.sha256 for r in text_queries.page_texts(spark, tiny).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in right.items()}


def test_page_text_of_odd_markup(spark):
    pages = ["<p>A &amp; B</p><script>x<y</script><p>ﬁne</p>", "no markup", "", None, "<body><nav>menu</nav><h1>T</h1>one<br>two</body>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r.page_id: r.body for r in text.page_text(df).collect()}
    assert got == {i: plain_page(p or "") for i, p in enumerate(pages)}


def test_json_nodes_first_value_wins():
    tree = '{"a": [{"headline": "one"}, {"@type": "Organization", "name": "Acme", "url": "u"}], "headline": "two", "author": "Ana"}'
    assert text.json_nodes(tree) == {"headline": "two", "author": "Ana", "organization": "Acme", "organization_url": "u", "url": "u"}
    assert text.json_nodes("{broken") == {} == text.json_nodes(None)


def test_tombstones_and_cycles(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(101, 102), (102, 103), (103, 101)]
    got = {r.id: r.root for r in lifecycle.follow(spark.createDataFrame(pairs, "id long, into long")).collect()}
    assert got == {i: 40 for i in range(1, 40)} | {101: 101, 102: 101, 103: 101}
    assert lifecycle.follow(spark.createDataFrame([], "id long, into long")).count() == 0


def test_upsert_of_null_keys_is_stable(spark):
    schema = "company long, vehicle string, fit double, first string"
    old = spark.createDataFrame([(1, None, 1.0, "old"), (2, "v", 2.0, "old")], schema)
    new = spark.createDataFrame([(1, None, 9.0, "new"), (3, None, 3.0, "new")], schema)
    keys = {"company": F.col("company"), "vehicle": F.coalesce("vehicle", F.lit(""))}
    once = lifecycle.upsert(old, new, keys, keep=("first",))
    right = [(1, None, 9.0, "old"), (2, "v", 2.0, "old"), (3, None, 3.0, "new")]
    assert sorted(map(tuple, once.collect()), key=str) == right
    assert sorted(map(tuple, lifecycle.upsert(once, new, keys, keep=("first",)).collect()), key=str) == right


def test_blank_label_deletes_only_what_was_shown(spark):
    rows = lambda xs: spark.createDataFrame([(i, "f", v) for i, v in xs], "id long, field string, value string")
    got = lifecycle.three_way(rows([(1, "new"), (2, ""), (3, ""), (4, None)]), rows([(1, "a"), (2, "b"), (3, "c"), (5, "e")]), rows([(2, "b"), (3, "")]))
    assert {r.id: r.value for r in got.collect()} == {1: "new", 3: "c", 5: "e"}


def test_registry_rules(spark):
    raw = '{"items": [{"name": "O\'NEIL, Ann", "officer_role": "director", "date_of_birth": 1}, {"name": "X Ltd", "officer_role": "corporate-secretary"}, {"name": ""}]}'
    df = spark.createDataFrame([(1, raw), (2, None), (3, '{"items": [{"name": "S Ltd", "officer_role": "corporate-secretary"}]}')], "id long, raw string")
    rows = registry.officers(df, "id", "raw")
    assert {(r.id, r.name, r.corporate) for r in rows.collect()} == {(1, "Ann O'neil", False), (1, "X Ltd", True), (3, "S Ltd", True)} and "date_of_birth" not in rows.columns
    assert {r.id: r.only for r in registry.only_corporate_secretary(rows, "id").collect()} == {1: False, 3: True}


def test_ledger_seats_a_missed_and_a_met_row(spark):
    rows = [(1, "a", 0, 4, 1.0), (1, "b", 1, 4, 0.8), (1, "c", 2, 3, 0.9), (1, "d", 3, 1, 0.0), (1, "e", 4, 2, None)]
    df = spark.createDataFrame(rows, "id long, key string, place int, weight int, sub double")
    assert {r.key: r.status for r in queue.ledger(df, ["id"]).collect()} == {"a": "met", "b": "met", "d": "missed"}
