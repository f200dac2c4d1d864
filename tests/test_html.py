"""Node lists of pages against html.parser, selectors, structure of sites."""

import hashlib
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from scoutline.operators import html
from scoutline.plans import text_queries


class Tree(HTMLParser):
    """A plain tree by the standard library's tokens, with the same rules for ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "", "attrs": {}, "kids": [], "up": None}
        self.at = self.root

    def find(self, names, until=()):
        x = self.at
        while x["up"] is not None:
            if x["tag"] in until:
                return None
            if x["tag"] in names:
                return x
            x = x["up"]

    def handle_starttag(self, tag, attrs):
        ended, between = html.ENDS.get(tag, ((), ()))
        if x := self.find(ended, between):
            self.at = x["up"]
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        node = {"tag": tag, "attrs": first, "kids": [], "up": self.at}
        self.at["kids"].append(node)
        if tag not in html.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in html.VOID:
            self.at = self.at["up"]

    def handle_endtag(self, tag):
        if x := self.find((tag,)):
            self.at = x["up"]

    def handle_data(self, data):
        kids = self.at["kids"]
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def tree(page):
    t = Tree()
    t.feed(page)
    t.close()
    return t.root


def flat(node, line=""):
    """[(tag, line, text)] in order; neighbouring texts as one."""
    out = []
    for k in node["kids"]:
        if isinstance(k, str):
            out.append(("#text", line, k))
        else:
            own = k["attrs"].get("id", "")
            mine = line + " " + k["tag"] + (f"#{own}" if own and not re.search(r"\s", own) else "") + "".join("." + c for c in k["attrs"].get("class", "").split())
            out += [(k["tag"], mine, None), *flat(k, mine)]
    return out


def joined(nodes):
    out = []
    for n in nodes:
        if n["tag"] == "#text" and out and out[-1][0] == "#text" and out[-1][1] == n["line"]:
            out[-1] = ("#text", n["line"], out[-1][2] + n["text"])
        else:
            out.append((n["tag"], n["line"], n["text"]))
    return out


ODD = [
    "", "plain", "<p>a<p>b<div>c</p>d</div>", "<ul><li>1<li>2<ul><li>3</ul><li>4</ul>x", "<a href='x>y' id=q class='b a b'>t</a>", "<br/>t<img src=a.png><b>u", "</b>x<i>y</b>z</i>",
    "<!-- c <p> -->z<!DOCTYPE html>", "<script>if (a<b) { '</p>' }</script>k<style>p{}</style>", "<table><tr><td>1<td>2<tr><th>3</table>", "<DIV CLASS='X  y'>&amp;&eacute;</DIV>", "<dl><dt>a<dd>b<dt>c</dl>", "a < b <p>x",
]


def test_nodes_equal_the_standard_parser(small, spark):
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    for page in pages + ODD:
        nodes = html.nodes_of(page)
        assert joined(nodes) == flat(tree(page)), page[:200]
        for i, n in enumerate(nodes):  # parents come first, a node's descendants stand behind it up to its last one
            assert n["parent"] < i <= n["last"] and all((nodes[j]["parent"] >= i) for j in range(i + 1, n["last"] + 1))


def test_queries_of_whole_pages(spark, tiny):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    for r in text_queries.page_nodes(spark, tiny).collect():
        right = flat(tree(pages[r.page_id]))
        lines = {re.sub("#[^ .]+", "", x[1]).strip() for x in right if x[0] != "#text"}
        assert r.elements == sum(x[0] != "#text" for x in right) and r.depth == max(x[1].count(" ") for x in right)
        assert r.fingerprint == hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()[:16]
    found = text_queries.page_fields(spark, tiny).collect()
    assert {r.page_id for r in found} == set(pages) and all(r.selector for r in found)
    for r in text_queries.structure_drift(spark, tiny).collect():
        assert 0 <= r.overlap <= 1


def test_selectors(spark):
    page = "<body class=b><div class='card big' id=one><h2> A <b>x</b></h2><a href='/p' rel=''>go</a></div><div class=cards><h2></h2><h2>B</h2></div><meta name=ROBOTS content='NoIndex, x'></body>"
    df = html.parsed(spark.createDataFrame([(1, page), (2, None), (3, "")], "id long, html string"), "html")
    n = F.col("nodes")
    at = lambda s: F.transform(html.selected(n, s), lambda i: F.get(n, i)["tag"])
    asked = {"s1": ".card", "s2": "div", "s3": "body > div.card.big > a[href]", "s4": "body a", "s5": "div#one h2 b", "s6": "body > a", "s7": "a[href=/p]", "s8": "*", "s9": "div[class]"}
    row = df.where("id = 1").select(*(at(s).alias(k) for k, s in asked.items()), html.first_text(n, [".none", ".cards h2"]).alias("t1"), html.first_text(n, ["h2"], F.lit("A x")).alias("t2"), html.attr_of(n, "a", "href").alias("a1"), html.attr_of(n, "a", "rel").alias("a2"), html.no_index(n).alias("r"), html.select_any(n, [".none", "h2"]).alias("y"), html.text_of(n, F.get(html.selected(n, ".card"), F.lit(0))).alias("t3")).first()
    assert [row[f"s{i}"] for i in range(1, 10)] == [["div"], ["div", "div"], ["a"], ["a"], ["b"], [], ["a"], ["body", "div", "h2", "b", "a", "div", "h2", "h2", "meta"], ["div", "div"]]
    assert (row.t1, row.t2, row.a1, row.a2, row.r, row.t3) == ("B", "B", "/p", None, True, "A x go")
    assert row.y.selector == "h2" and len(row.y.places) == 3
    none = df.where("id > 1").select(F.size("nodes").alias("k"), F.size(html.selected(n, "p")).alias("p"), html.first_text(n, ["p"]).alias("t"), html.no_index(n).alias("r")).collect()
    assert {tuple(r) for r in none} == {(0, 0, "", False)}


def test_shapes_and_drift(spark):
    shape = lambda cards: "<div>" + "".join(f"<p class='{c}'><b>x</b></p>" for c in cards) + "</div>"
    rows = [(1, "a", shape("uu")), (2, "a", shape("uuu")), (3, "a", shape("uv")), (4, "a", "<div></div>"), (5, "b", "")]
    df = html.parsed(spark.createDataFrame(rows, "id long, site string, html string"), "html")
    marks = {r.id: r.m for r in df.select("id", html.node_shape(F.col("nodes"), html.selected(F.col("nodes"), "p")).alias("m")).collect()}
    assert marks[1] == marks[2] != marks[3]
    assert marks[1] == hashlib.sha256("\n".join(sorted(["p.u", "p>b."])).encode()).hexdigest()[:16]
    pages = df.select("id", "site", html.paths(F.col("nodes")).alias("paths"))
    got = {r.id: (r.common, r.overlap) for r in html.drift(pages, html.usual_paths(pages, "site"), "id", "site").collect()}
    assert got == {1: (3, 1.0), 2: (3, 1.0), 3: (3, 0.6), 4: (1, 0.333333), 5: (0, 1.0)}


def test_layout_is_learned_once_and_empty_documents_are_told(spark):
    rows = [("s", 1, "f", 3, 900), ("s", 2, "f", 1, 900), ("s", 3, "g", 2, 900), ("s", 4, "f", 0, 900), ("s", 5, "f", 0, 90), ("t", 1, "g", 1, 900)]
    df = spark.createDataFrame(rows, "source string, day int, fingerprint string, items int, bytes int")
    got = {(r.source, r.day): r.status for r in html.layout_status(df, "source", "day").collect()}
    assert got == {("s", 1): "learned", ("s", 2): "same", ("s", 3): "changed", ("s", 4): "empty", ("s", 5): "same", ("t", 1): "learned"}
