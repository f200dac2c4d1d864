"""Personal data: patterns find it, and what the corpus says about it decides which words near it go too.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.  A value of such a span is
a protected entity.  The words of its documents are terms, and the corpus tells how strongly a term reveals
the entity: with N documents, n(e) documents of the entity, n(t) documents of the term and n(e, t) documents
that have both, wherever they stand,

    PMI(e, t) = log2(N n(e, t) / (n(e) n(t)))      IC(e) = log2(N / n(e))

PMI / IC is 1 for a term that never occurs without the entity.  Terms that share at least SUPPORT documents with
the entity and whose ratio reaches GENERALISE are generalised to the class of their shape (``[name]`` if capitalised,
``[acronym]`` if all capitals, else ``[word]``), those that reach REMOVE are removed; both at every occurrence in the
entity's documents.

All of it is DataFrame functions.  Patterns are possessive and start at a run's begin or a match's end, so
they read each character a bounded number of times.  Texts move only for documents of entities of SUPPORT or more.

Edge cases: a null or empty text has no spans; repeated rows get equal spans, and rows of one id count as one
document in all statistics; a null id is not counted; extra columns are ignored by ``find`` and
kept by ``sanitise``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.common import salted_join, written

# Fixed patterns of the four kinds, written so that they match what the plain forms do.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
KINDS = tuple(PATTERNS)
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
RUN = r"\p{L}+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d, n = _digits(x), F.length(_digits(x))
    at = lambda i: F.substring(d, n - i, F.lit(1)).cast("int")  # noqa: E731  from the right
    worth = lambda i: F.when(i % 2 == 0, at(i)).otherwise(2 * at(i) - F.when(at(i) > 4, 9).otherwise(0))
    return (n >= 16) & (n <= 19) & (F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    """A cheap test that every text with a span of the kind passes."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.contains("+")}[kind]


def base_spans(docs: DataFrame) -> DataFrame:
    """(id, mark, kind, start, end, value) of every base span.

    A text is cut at its matches; running sums of the pieces' lengths, per document, give the places.
    docs: id, mark, text.  Rows of equal id and mark count once.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")

    def of(kind: str, pattern: str) -> Column:
        # Matches and the gaps around them; of a gap only its length is needed.
        found = F.when(_may_have(kind, t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
        gaps = F.when(_may_have(kind, t), F.split(t, pattern)).otherwise(none)
        gaps = F.transform(gaps, lambda g: F.length(g))
        return F.struct(F.lit(kind).alias("kind"), found.alias("found"), gaps.alias("gaps"))

    kinds = docs.select("id", "mark", F.explode(F.array(*(of(k, p) for k, p in PATTERNS.items()))).alias("k")).select("id", "mark", "k.*").where("size(found) > 0")
    pieces = kinds.select("id", "mark", "kind", F.posexplode(F.arrays_zip(F.col("found").alias("value"), F.col("gaps").alias("gap"))).alias("i", "z"))
    pieces = pieces.where("z.value is not null").select("id", "mark", "kind", "i", F.col("z.value").alias("value"), F.col("z.gap").alias("gap"))
    pieces = pieces.dropDuplicates(["id", "mark", "kind", "i"])
    so_far = Window.partitionBy("id", "mark", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far).cast("int")
    placed = pieces.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    valid = F.lit(True)
    for kind in KINDS:
        valid = valid & ((F.col("kind") != kind) | _valid(kind, F.col("value")))
    return placed.where(valid).select("id", "mark", "kind", "start", "end", "value")


def held_entities(spans: DataFrame) -> DataFrame:
    """(id, mark, entity, n_e) of the entities of SUPPORT or more documents."""
    held = spans.where("id is not null").select("id", "mark", F.concat_ws(":", "kind", "value").alias("entity")).distinct()
    often = held.groupBy("entity").agg(F.countDistinct("id").alias("n_e")).where(F.col("n_e") >= SUPPORT)
    return held.join(often, "entity").select("id", "mark", "entity", "n_e")


def _maybe(docs: DataFrame) -> DataFrame:
    """Documents that can have a base span: no other is of an entity, so the others' texts need not move."""
    some = F.lit(False)
    for kind in KINDS:
        some = some | _may_have(kind, F.col("text"))
    return docs.where(some)


def _terms(text: str) -> Column:
    """The distinct terms of a text: whole runs of 3 to 40 letters, in lower case."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0)), lambda w: F.length(w).between(3, 40))
    return F.array_distinct(F.transform(runs, lambda w: F.lower(w)))


def disclosing(held: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, ratio) of the terms that reveal an entity too strongly."""
    known = docs.where("id is not null")
    n = known.agg(F.countDistinct("id")).first()[0]
    theirs = _maybe(known).join(held.select("id", "mark").distinct(), ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    terms = theirs.select("id", "mark", F.explode(_terms(text)).alias("term"))
    pairs = held.join(terms, ["id", "mark"]).groupBy("entity", "term", "n_e").agg(F.countDistinct("id").alias("together")).where(F.col("together") >= SUPPORT)
    pairs = written(pairs, "pairs")
    # Rows with the term, less those of an id that has been counted; texts move for ids of several rows only.
    count = F.count(F.lit(1)).alias("n")
    anywhere = known.select(F.explode(_terms(text)).alias("term")).groupBy("term").agg(count)
    again = written(known.groupBy("id").agg(count).where("n > 1").select("id"), "again")
    if not again.isEmpty():
        twice = known.join(again.hint("merge"), "id", "left_semi").select("id", F.explode(_terms(text)).alias("term"))
        extra = twice.groupBy("term", "id").agg(count).groupBy("term").agg(F.sum(F.col("n") - 1).alias("extra"))
        anywhere = anywhere.join(extra, "term", "left").select("term", (F.col("n") - F.coalesce("extra", F.lit(0))).alias("n"))
    anywhere = anywhere.withColumnRenamed("n", "n_t")
    sizes = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows")).join(anywhere, "term")
    both = salted_join(pairs, written(sizes, "terms"), ["term"], "entity")
    information = F.log2(F.lit(float(max(n, 1))) / F.col("n_e"))
    pmi = information + F.log2(F.least(F.col("together") / F.col("n_t"), F.lit(1.0)))
    ratio = F.when(information > 0, pmi / information).otherwise(0.0)
    return both.withColumn("ratio", ratio).where(F.col("ratio") >= GENERALISE).select("entity", "term", "ratio")


def occurrences(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(id, mark, start, end, ratio, shape) wherever a term of ``told`` (id, mark, term, ratio) stands in its document."""
    theirs = _maybe(docs).join(told.select("id", "mark").distinct(), ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    cut = theirs.select("id", "mark", F.regexp_extract_all("text", F.lit(RUN), F.lit(0)).alias("run"), F.transform(F.split("text", RUN), lambda g: F.length(g)).alias("gap"))
    runs = cut.select("id", "mark", F.posexplode(F.arrays_zip("run", "gap")).alias("i", "z")).where("z.run is not null")
    so_far = Window.partitionBy("id", "mark").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("z.gap") + F.length("z.run")).over(so_far).cast("int")
    run, first = F.col("z.run"), F.left("z.run", F.lit(1))
    shape = F.when((run == F.upper(run)) & (run != F.lower(run)), "acronym").when(first != F.lower(first), "name").otherwise("word")
    placed = runs.select("id", "mark", F.lower("z.run").alias("term"), shape.alias("shape"), F.length("z.run").alias("n"), end.alias("end")).where("n between 3 and 40")
    return placed.join(told, ["id", "mark", "term"]).select("id", "mark", (F.col("end") - F.col("n")).alias("start"), "end", "ratio", "shape")


def find(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, mark (hash of the text), spans (base), words (added) of every document with a base span."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    spans = written(base_spans(docs), "spans")
    held = written(held_entities(spans), "held")
    reveals = disclosing(held, docs)
    hits = occurrences(docs, held.join(reveals, "entity").groupBy("id", "mark", "term").agg(F.max("ratio").alias("ratio")))
    kind = F.when(F.col("ratio") >= REMOVE, "removed").otherwise(F.col("shape"))
    added = hits.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "start", "end"))).alias("words"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    base = spans.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "start", "end", "kind"))).alias("spans"))
    both = base.join(added.withColumnsRenamed({"id": "id2", "mark": "mark2"}), (F.col("id") == F.col("id2")) & (F.col("mark") == F.col("mark2")), "left").drop("id2", "mark2")
    words = F.coalesce("words", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    apart = F.filter(words, lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    plain = lambda xs: F.transform(xs, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return both.select("id", "mark", plain(F.col("spans")).alias("spans"), plain(apart).alias("words"))


def with_found(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Append ``_spans`` and ``_words`` (empty for documents without a base span)."""
    found = find(df, id_col, text).withColumnsRenamed({"id": "_id2", "mark": "_mark2", "spans": "_spans", "words": "_words"})
    both = df.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("_id2")) & (F.xxhash64(text) == F.col("_mark2")), "left").drop("_id2", "_mark2")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return both.withColumns({"_spans": F.coalesce("_spans", none), "_words": F.coalesce("_words", none)})


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitised_text(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets (a removed word by nothing)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        mark = F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        piece = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["end"] <= acc["at"], acc["out"]).when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece, mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(ordered, none, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with sanitised texts."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    t = names[df.columns.index(text)]
    found = with_found(df.toDF(*names), names[df.columns.index(id_col)], t)
    return found.withColumn(t, sanitised_text(F.col(t), F.concat("_spans", "_words"))).select(*names).toDF(*df.columns)
