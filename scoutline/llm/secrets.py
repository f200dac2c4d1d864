"""Secret scan: a random forest takes false positives out of candidate findings.

A candidate is a run of at least 16 characters of key material, or a value of at least 8 characters that is assigned
to a secret's name.  The forest (Spark ML) sees its length, its kinds of characters, how likely its character
transitions are in the corpus, the share of it that words of the corpus cover, its path and its neighbouring words on
both sides.  What a neighbouring word or a part of the path is worth is learned: its log-odds in one half of the
labelled findings; the forest is grown on the other half, so no finding's own label is in its features.

Labelled findings are a table (id, start, end, label).  Without one, findings are labelled by evidence that
the forest does not get as such: assignment to a secret's name, formats of known keys and lines of a private key
are true; a word of letters alone or a plain number is false; all others stay unlabelled and are left to the forest.

Transitions and words are counted over all whole texts, without a limit on their number.  At most ``sample`` labelled
findings of each kind are fitted, and none of the documents held out.

Edge cases: a null or empty text has no candidates; a candidate of any length is one finding, and all of it is read; with
labels of one kind only, no forest can be trained and every candidate gets that kind's verdict (none if there are
no labels); repeated rows are scanned each; a null path is an empty one; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import salted_join, slices, string_buffers, written

#: Names whose value is a secret (fixed word list), and the form of an assignment to one.
KEY_NAMES = r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)"
ASSIGNED = KEY_NAMES + r"[\"']?\s*[:=]\s*[\"']?"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
NAMED = f"(?i:{ASSIGNED})([^\\s\"'<>]{{8,}})"
#: Formats of keys that name themselves, and where a private key's lines stand (fixed patterns).
KNOWN_FORMATS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abp]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35})$"
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(.*?)(?:-----END|\Z)", re.S)
#: Words on each side that are neighbours, and characters in which they are looked for.
NEIGHBOURS, NEAR = 3, 80
#: Labelled findings of each kind that are fitted at most; size of the forest.
SAMPLE, TREES, DEPTH = 10_000, 20, 6
SHAPE = ("length", "digit_share", "upper_share", "transition")
CONTEXT = ("before_odds", "after_odds", "path_odds")
FEATURES = (*SHAPE, "dictionary", *CONTEXT)
_CLASSES = 40  # letters, digits, two signs, others


def _char_class() -> np.ndarray:
    out = np.full(256, 39, np.uint8)
    out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = np.arange(26)
    out[ord("0") : ord("9") + 1] = np.arange(26, 36)
    out[[ord(c) for c in "-_"]], out[[ord(c) for c in "+/="]] = 36, 37
    out[[9, 10, 11, 12, 13, 32]] = 38
    return out


def transitions(docs: DataFrame) -> np.ndarray:
    """Log probabilities of one character class after another, inside all texts (a 40 x 40 table)."""

    def run(batches):
        import pyarrow as pa

        kinds, total = _char_class(), np.zeros(_CLASSES * _CLASSES, np.int64)
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, 4_000_000):
                k = kinds[data[offsets[i] : offsets[j]]]
                pairs = k[:-1].astype(np.int32) * _CLASSES + k[1:]
                inside = np.ones(len(pairs), bool)
                borders = offsets[i + 1 : j] - offsets[i] - 1  # from the end of a text to the next one's begin
                inside[borders[(borders >= 0) & (borders < len(pairs))]] = False
                total += np.bincount(pairs[inside], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"pair": pa.array(at), "n": pa.array(total[at])})

    rows = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.ones(_CLASSES * _CLASSES)
    for r in rows:
        table[r.pair] += r.n
    table = table.reshape(_CLASSES, _CLASSES)
    return np.log2(table / table.sum(1, keepdims=True))


def spans(text: str) -> list[tuple[int, int]]:
    """Places of all candidates; an assigned value that a longer candidate overlaps is part of that one."""
    found = [m.span() for m in re.finditer(CANDIDATE, text)]
    named, k = [], 0
    for m in re.finditer(NAMED, text):
        a, b = m.span(1)
        while k < len(found) and found[k][1] <= a:
            k += 1
        if k == len(found) or found[k][0] >= b:
            named.append((a, b))
    return sorted(found + named)


def neighbours(before: str, after: str, path: str) -> tuple[list[str], list[str], list[str]]:
    """Words ahead of a candidate, behind it, and of its path; whole ones, in lower case."""
    word = re.compile(r"[^\W\d]{2,}").findall
    return word(before.lower())[-NEIGHBOURS:], word(after.lower())[:NEIGHBOURS], word(path.lower())


def candidates(docs: DataFrame, log_odds: np.ndarray) -> DataFrame:
    """id, start, end (code points), value, before, after, path, pem (inside a private key) and shape features.

    docs: id, text, path.  The table of transitions is of fixed size, so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(log_odds)
    names = ["id", "start", "end", "value", "before", "after", "path", "pem", *SHAPE]

    def run(batches):
        import pyarrow as pa

        table, kinds = shared.value, _char_class()
        types = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.bool_(), *[pa.float64()] * len(SHAPE)]
        for batch in batches:
            rows: list[tuple] = []
            ids, texts, paths = (batch.column(c) for c in ("id", "text", "path"))
            for n in range(len(batch)):
                text, path = texts[n].as_py() or "", paths[n].as_py() or ""
                keys = [m.span(1) for m in PEM.finditer(text)] if "PRIVATE KEY" in text else []
                for start, end in spans(text):
                    value = text[start:end]
                    raw = np.frombuffer(value.encode(), np.uint8)
                    share, k = np.bincount(raw, minlength=256) / len(raw), kinds[raw]
                    shape = (float(len(value)), share[48:58].sum(), share[65:91].sum(), float(table[k[:-1], k[1:]].mean()))
                    pem = any(a <= start and end <= b for a, b in keys)
                    rows.append((ids[n].as_py(), start, end, value, text[max(0, start - NEAR) : start], text[end : end + NEAR], path, pem, *shape))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)

    shape = ", ".join(f"{f} double" for f in SHAPE)
    return docs.mapInArrow(run, f"id long, start long, end long, value string, before string, after string, path string, pem boolean, {shape}")


def with_dictionary(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Append ``dictionary``: the share of the value's characters in pieces that are words of two or more texts.

    Pieces are runs of letters, cut where capitals begin; a text's words are its runs of letters without digits beside them.
    Only words that some value needs are joined; a piece or a value that is very frequent is salted.
    """
    values = written(found.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")), "values")
    pieces = F.transform(F.regexp_extract_all("value", F.lit(r"\p{Lu}?\p{Ll}{2,}|\p{L}{3,}"), F.lit(0)), lambda x: F.lower(x))
    pieces = written(values.select("value", F.explode(pieces).alias("word")).where(F.length("word") >= 3), "pieces")
    needed = pieces.groupBy("word").agg(F.count(F.lit(1)).alias("n_rows"))
    tokens = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")), lambda w: w.rlike(r"^\p{L}{3,}$"))
    counted = docs.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    known = salted_join(pieces, written(needed.join(counted, "word"), "words"), ["word"], "value")
    covered = known.groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    share = values.join(covered, "value", "left").select("value", "n_rows", (F.coalesce("covered", F.lit(0)) / F.length("value")).alias("dictionary"))
    return salted_join(found, written(share, "shares"), ["value"], "start")


def labelled_by_evidence() -> Column:
    """1, 0 or null of a finding; see the module's text."""
    named = F.col("before").rlike(f"(?i){ASSIGNED}$") & ~F.col("value").rlike(r"^\p{L}+$")
    return F.when(named | F.col("pem") | F.col("value").rlike(KNOWN_FORMATS), 1.0).when(F.col("value").rlike(r"^(?:\p{L}+|[0-9]+)$"), 0.0)


def word_odds(sample: list) -> list[dict[str, float]]:
    """Log-odds of every neighbour ahead, behind and in the path, from (before, after, path, label) rows."""
    counts: list[dict[str, list[float]]] = [{}, {}, {}]
    for r in sample:
        for table, words in zip(counts, neighbours(r.before, r.after, r.path)):
            for w in set(words):
                table.setdefault(w, [1.0, 1.0])[int(r.label)] += 1
    kinds = [1.0 + sum(r.label == x for r in sample) for x in (0, 1)]
    return [{w: math.log(n[1] / kinds[1]) - math.log(n[0] / kinds[0]) for w, n in table.items()} for table in counts]


def with_context(found: DataFrame, odds: list[dict[str, float]]) -> DataFrame:
    """Append the mean log-odds of the neighbours; the tables are bounded by the sample, so they are broadcast."""
    shared = found.sparkSession.sparkContext.broadcast(odds)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("before", "after", "path")))
            scores = [[sum(t.get(w, 0.0) for w in ws) / max(1, len(ws)) for t, ws in zip(shared.value, neighbours(*r))] for r in rows]
            for i, name in enumerate(CONTEXT):
                batch = batch.append_column(name, pa.array([s[i] for s in scores], pa.float64()))
            yield batch

    return found.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields] + [f"{c} double" for c in CONTEXT]))


def held_out(id_column: Column) -> Column:
    """A fifth of the documents, which nothing is fitted on."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scan(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """id, start, end, probability, secret, label, held_out of every candidate; docs: id, text, path."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = written(candidates(docs, transitions(docs)), "candidates")
    found = with_dictionary(found, docs)
    if labels is None:
        found = found.withColumn("label", labelled_by_evidence())
    else:
        given = labels.select("id", "start", "end", F.col("label").cast("double").alias("label")).groupBy("id", "start", "end").agg(F.max("label").alias("label"))
        found = found.join(given, ["id", "start", "end"], "left")
    found = written(found.withColumn("held_out", held_out(F.col("id"))), "findings")
    fields = ["value", "before", "after", "path"]
    order = F.xxhash64(*fields)
    known = found.where("label is not null and not held_out").dropDuplicates([*fields, "label"]).withColumn("half", F.pmod(order, F.lit(2)))
    pick = lambda x: known.where(F.col("label") == x).orderBy(order, *fields).limit(sample)
    chosen = written(pick(1.0).unionByName(pick(0.0)), "labelled")
    kinds = [r.label for r in chosen.groupBy("label").count().collect()]
    columns = ["id", "start", "end", "probability", (F.col("probability") >= 0.5).alias("secret"), "label", "held_out"]
    if len(kinds) < 2:
        return found.withColumn("probability", F.lit(1.0 if 1.0 in kinds else 0.0)).select(columns)
    odds = word_odds(chosen.where("half = 0").select("before", "after", "path", "label").collect())
    put = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    grown = with_context(chosen, odds)
    other = grown.where("half = 1")
    grown = other if other.select("label").distinct().count() == 2 else grown
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=1).fit(put.transform(grown).select("features", "label"))
    scored = forest.transform(put.transform(with_context(found, odds)))
    return scored.withColumn("probability", F.round(vector_to_array("probability")[1], 6)).select(columns)
