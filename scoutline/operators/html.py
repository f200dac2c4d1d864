"""Pages as node lists: tags, attributes and texts of a page in its own row, selectors over them, and the structure of a site's pages.

One fold over a page's tags with a stack of open elements gives every element its parent, its last descendant and its line: the tags,
ids and classes from the root to it.  A selector is a pattern over lines, so selecting stays inside the row and needs no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

# --- fixed values: elements without an end, with raw text, and what an opening tag ends -------------------
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
RAW = ("script", "style")
BLOCKS = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
#: An opening tag ends an open one of these unless one of the others stands between.
ENDS = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ENDS |= {b: (("p",), ("button", "td", "th", "table")) for b in BLOCKS}

NODES = "array<struct<tag: string, line: string, attrs: map<string, string>, parent: int, last: int, text: string>>"
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|(?P<text>[^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def nodes_of(page: str) -> list[dict]:
    """Elements and texts of a page in order; a text's tag is ``#text``.

    An end tag closes the nearest open element of its name and all inside it, or nothing if none is open; comments and declarations go.
    """
    out: list[dict] = []
    stack: list[int] = []
    at, size = 0, len(page)

    def close(depth: int) -> None:
        while len(stack) > depth:
            out[stack.pop()]["last"] = len(out) - 1

    def add(tag: str, attrs: dict | None, text: str | None) -> None:
        parent = stack[-1] if stack else -1
        above = out[parent]["line"] if stack else ""
        line = above
        if attrs is not None:
            marks = "".join(f"#{attrs[k]}" for k in ("id",) if attrs.get(k) and not re.search(r"\s", attrs[k])) + "".join(f".{c}" for c in (attrs.get("class") or "").split())
            line = f"{above} {tag}{marks}"
        out.append({"tag": tag, "line": line, "attrs": attrs, "parent": parent, "last": len(out), "text": text})

    while at < size:
        token = TOKEN.match(page, at)
        if not token:  # an unfinished tag at the end
            break
        at = token.end()
        if token["text"]:
            add("#text", None, entities.unescape(token["text"]))
        elif token["tag"] and token["end"]:
            name = token["tag"].lower()
            for depth in range(len(stack) - 1, -1, -1):
                if out[stack[depth]]["tag"] == name:
                    close(depth)
                    break
        elif token["tag"]:
            name = token["tag"].lower()
            ended, between = ENDS.get(name, ((), ()))
            for depth in range(len(stack) - 1, -1, -1):
                if out[stack[depth]]["tag"] in between:
                    break
                if out[stack[depth]]["tag"] in ended:
                    close(depth)
                    break
            attrs: dict[str, str] = {}
            for key, value in ATTRIBUTE.findall(token["rest"]):
                attrs.setdefault(key.lower(), entities.unescape(value[1:-1] if value[:1] in "\"'" and value else value))
            add(name, attrs, None)
            if name in VOID or token["rest"].rstrip().endswith("/"):
                continue
            stack.append(len(out) - 1)
            if name in RAW:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                raw = page[at : end.start() if end else size]
                if raw:
                    add("#text", None, raw)
                close(len(stack) - 1)
                at = end.end() if end else size
    close(0)
    return out


def parsed(df: DataFrame, markup: str, name: str = "nodes") -> DataFrame:
    """df with the nodes of a page; null and empty markup have none."""
    field = _parse_datatype_string(f"{name} {NODES}").fields[0]
    place, kept = df.columns.index(markup), df.columns

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("tag", pa.string()), ("line", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("parent", pa.int32()), ("last", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                rows = [nodes_of(x) if x else [] for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*kept, name])

    return df.mapInArrow(parse, StructType(df.schema.fields + [field]))


# --- selectors -------------------------------------------------------------------------------------------


def pattern_of(selector: str) -> tuple[str, list[tuple[str, str | None]]]:
    """(pattern over lines, conditions on the node's own attributes) of ``tag#id.class[attr=value]`` with blanks and ``>`` between."""
    steps = re.findall(r"(>)?\s*((?:[^\s>\[]|\[[^\]]*\])+)", selector.strip())
    pattern, wanted = "", []
    for i, (child, step) in enumerate(steps):
        wanted = [(k, v.strip("\"'") if v else None) for k, v in re.findall(r"\[\s*([^\]=\s]+)\s*(?:=\s*([^\]]*?)\s*)?\]", step)]
        step = re.sub(r"\[[^\]]*\]", "", step)
        if wanted and i + 1 < len(steps):
            raise ValueError(f"attributes of ancestors are not looked at: {selector}")
        tag, marks = re.match(r"([a-zA-Z*][\w-]*)?(.*)", step).groups()
        looks = "".join(rf"(?=[^ ]*{re.escape(m)}(?:[.# ]|$))" for m in re.findall(r"[.#][^.#]+", marks))
        name = re.escape(tag.lower()) if tag and tag != "*" else "[^ .#]+"
        pattern += ("" if child or not i else "(?: [^ ]+)*") + f" {looks}{name}(?:[.#][^ ]*)?"
    return pattern + "$", wanted


def selected(nodes: Column, selector: str) -> Column:
    """Places of the elements that a selector means, in order."""
    pattern, wanted = pattern_of(selector)

    def fits(i: Column) -> Column:
        node = F.get(nodes, i)
        ok = node["attrs"].isNotNull() & node["line"].rlike(pattern)
        for key, value in wanted:
            has = F.map_contains_key(node["attrs"], F.lit(key.lower()))
            ok = ok & has & (F.lit(True) if value is None else node["attrs"][key.lower()] == value)
        return ok

    return F.when(F.size(nodes) > 0, F.filter(F.sequence(F.lit(0), F.size(nodes) - 1), fits)).otherwise(F.array().cast("array<int>"))


def select_any(nodes: Column, selectors: list[str]) -> Column:
    """(selector, places) of the first selector that matches anything; ('', []) if none does."""
    out = None
    for s in selectors:
        hit = selected(nodes, s)
        made = F.struct(F.lit(s).alias("selector"), hit.alias("places"))
        out = F.when(F.size(hit) > 0, made) if out is None else out.when(F.size(hit) > 0, made)
    return out.otherwise(F.struct(F.lit("").alias("selector"), F.array().cast("array<int>").alias("places")))


def text_of(nodes: Column, place: Column) -> Column:
    """All text of an element, white space as single blanks."""
    inside = F.slice(nodes, place + 1, F.get(nodes, place)["last"] - place + 1)
    return F.trim(F.regexp_replace(F.array_join(F.transform(F.filter(inside, lambda n: n["tag"] == "#text"), lambda n: n["text"]), " "), r"[\s ]+", " "))


def first_text(nodes: Column, selectors: list[str], exclude: Column | None = None) -> Column:
    """The first text that is not empty (nor ``exclude``) of any selector, node by node; '' without one."""
    found = []
    for s in selectors:
        texts = F.transform(selected(nodes, s), lambda i: text_of(nodes, i))
        found.append(F.get(F.filter(texts, lambda x: (x != "") & (F.lit(True) if exclude is None else ~x.eqNullSafe(exclude))), F.lit(0)))
    return F.coalesce(*found, F.lit(""))


def attr_of(nodes: Column, selector: str, name: str) -> Column:
    """An attribute of the first element of a selector; null if it is missing or empty."""
    return F.nullif(F.trim(F.get(nodes, F.get(selected(nodes, selector), F.lit(0)))["attrs"][name]), F.lit(""))


def no_index(nodes: Column) -> Column:
    """True for pages whose robots tag asks to be left out."""
    robots = F.filter(nodes, lambda n: (n["tag"] == "meta") & F.lower(n["attrs"]["name"]).isin("robots"))
    return F.exists(robots, lambda n: F.contains(F.lower(F.coalesce(n["attrs"]["content"], F.lit(""))), F.lit("noindex")))


# --- structure -------------------------------------------------------------------------------------------


def _shape(node: Column) -> Column:
    classes = F.filter(F.split(F.coalesce(node["attrs"]["class"], F.lit("")), r"\s+"), lambda c: c != "")
    return F.concat(node["tag"], F.lit("."), F.array_join(F.array_sort(classes), "."))


def fingerprint(shapes: Column) -> Column:
    """Hash of a set of shapes, whatever their order and number."""
    return F.left(F.sha2(F.array_join(F.array_sort(F.array_distinct(shapes)), "\n").cast("binary"), 256), F.lit(16))


def node_shape(nodes: Column, places: Column, limit: int = 5) -> Column:
    """Fingerprint of the first matched elements: each one's tag and classes, and its children's."""
    first = F.slice(places, 1, limit)
    own = F.transform(first, lambda i: _shape(F.get(nodes, i)))
    children = F.flatten(F.transform(first, lambda i: F.transform(F.filter(nodes, lambda n: (n["parent"] == i) & n["attrs"].isNotNull()), lambda n: F.concat(F.get(nodes, i)["tag"], F.lit(">"), _shape(n)))))
    return fingerprint(F.concat(own, children))


def paths(nodes: Column) -> Column:
    """The set of paths of a page: tags and classes from the root to each element, without ids."""
    lines = F.transform(F.filter(nodes, lambda n: n["attrs"].isNotNull()), lambda n: F.ltrim(F.regexp_replace(n["line"], "#[^ .]+", "")))
    return F.array_distinct(lines)


def usual_paths(pages: DataFrame, site: str, path_set: str = "paths", share: float = 0.5) -> DataFrame:
    """(site, path): what more than ``share`` of a site's pages have.  Counts are summed before the shuffle."""
    totals = pages.groupBy(site).agg(F.count(F.lit(1)).alias("pages"))
    held = pages.select(site, F.explode(path_set).alias("path")).groupBy(site, "path").agg(F.count(F.lit(1)).alias("n"))
    return held.join(totals, site).where(F.col("n") > share * F.col("pages")).select(site, "path")


def drift(pages: DataFrame, usual: DataFrame, id_col: str, site: str, path_set: str = "paths") -> DataFrame:
    """(id, site, common, overlap): overlap of a page's paths with its site's usual ones, 1 for the same set, 0 for nothing in common."""
    sizes = usual.groupBy(site).agg(F.count(F.lit(1)).alias("usual"))
    each = pages.select(id_col, site, F.explode(path_set).alias("path"))
    common = each.join(usual, [site, "path"]).groupBy(id_col).agg(F.count(F.lit(1)).alias("common"))
    both = pages.select(id_col, site, F.size(path_set).alias("own")).join(common, id_col, "left").join(sizes, site, "left")
    n, own, most = F.coalesce("common", F.lit(0)), F.col("own"), F.coalesce("usual", F.lit(0))
    return both.select(id_col, site, n.alias("common"), F.round(F.coalesce(F.try_divide(n.cast("double"), own + most - n), F.lit(1.0)), 6).alias("overlap"))


def layout_status(seen: DataFrame, source: str, order: str, mark: str = "fingerprint", items: str = "items", size: str = "bytes", least: int = 200) -> DataFrame:
    """seen with ``learned`` (a source's first fingerprint) and ``status``: learned, same, changed, or empty for no items in a document that is no stub."""
    first = seen.groupBy(source).agg(F.min(F.struct(order, mark)).alias("_m")).select(source, F.col(f"_m.{mark}").alias("learned"), F.col(f"_m.{order}").alias("_at"))
    both = seen.join(first, source)
    status = F.when((F.col(items) == 0) & (F.col(size) >= least), "empty").when(F.col(order) == F.col("_at"), "learned").when(F.col(mark) == F.col("learned"), "same").otherwise("changed")
    return both.withColumn("status", status).drop("_at")
