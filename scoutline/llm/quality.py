"""Quality rules, with the frequency of lines across the documents of a host.

Base rules look at one text; the cross-document rule hashes normalised lines (lower case, white space
collapsed), counts the distinct documents of a host that have a line, removes lines above the limits and
rejects a document of which too little is left.  Documents with equal texts count as one, so that copies
do not turn their own lines into boilerplate.

Everything is DataFrame functions: repeated word windows are found inside the row by sorting hashes of
the windows, and only (host, line hash) pairs are shuffled, summed up beforehand.

Edge cases: a null, empty or blank text has no words or lines, fails the base rule and is not kept; a
null host is a host of its own; repeated rows get the same verdict each; of a row with a null id no lines
are removed; extra columns are ignored by ``quality`` and kept by ``clean``; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import salted_join, words, written

WINDOW = 8
MIN_WORDS, MAX_REPEATED_PER_CENT = 20, 30
#: A line goes if it is in more distinct documents of its host than both limits allow.
MAX_LINE_DOCS, MAX_LINE_SHARE = 20, 0.02
#: A document is depleted if removal leaves fewer than MIN_WORDS words or less than this share of them.
MIN_LEFT_SHARE = 0.3


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns through a generator of one row.

    A filter on what follows cannot move below it, so the optimiser never copies these expressions into one another.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Append the base measures, and ``_line_words`` (words of every line).

    Names of the input that begin with an underscore must not clash; ``_judged`` renames its input for that.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    # Each character is split once: the text's words are those of its lines.
    df = _held(df.drop(*MEASURES), _lines=F.split(t, "\n"))
    df = _held(df, _by_line=F.transform("_lines", words))
    df = _held(df, _w=F.flatten("_by_line"), _line_words=F.transform("_by_line", F.size), _full=F.filter("_lines", lambda x, i: F.size(F.col("_by_line")[i]) > 0)).drop("_lines", "_by_line")
    df = _held(
        df,
        n_words=F.size("_w").cast("long"),
        word_chars=F.length(F.array_join("_w", "")).cast("long"),
        n_symbols=F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        n_dup_lines=(F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
        _h=F.transform("_w", lambda x: F.xxhash64(x)),
    ).drop("_w", "_full")
    none = F.array().cast("array<bigint>")
    windows = F.transform(F.sequence(F.lit(1), F.size("_h") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_h", i, F.lit(WINDOW))))
    # A window can only be there twice if its first word is.
    df = _held(df, _windows=F.when((F.size("_h") >= WINDOW) & (F.size(F.array_distinct("_h")) < F.size("_h")), windows).otherwise(none)).drop("_h")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _held(df, _pairs=F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_windows")
    pairs, n = F.col("_pairs"), F.size("_pairs")
    equal = lambda x, k: F.when(k > 0, pairs[k - 1]["h"] == x["h"]).otherwise(False) | F.when(k < n - 1, pairs[k + 1]["h"] == x["h"]).otherwise(False)
    df = _held(df, _starts=F.sort_array(F.transform(F.filter("_pairs", equal), lambda x: x["i"]))).drop("_pairs")
    covered = F.aggregate("_starts", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")))
    df = _held(df, n_repeat_words=covered["n"].cast("long")).drop("_starts")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PER_CENT * F.col("n_words")))


def normal_lines(text: Column) -> Column:
    """Lines of a text in lower case, inner white space as one space, none at the ends; blank ones are empty."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def frequent_lines(df: DataFrame, id_col: str, text: str, host: str, max_docs: int = MAX_LINE_DOCS, max_share: float = MAX_LINE_SHARE) -> DataFrame:
    """(id, mark, pos, words) of every line that goes; mark is a hash of the text, pos the line's place."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.xxhash64(text).alias("mark"), F.transform(normal_lines(F.col(text)), lambda x: F.when(x != "", F.xxhash64(x))).alias("hashes"))
    once = docs.select("host", F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null")
    over = once.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > max_docs)
    each = docs.where("id is not null").select("id", "host", "mark", F.posexplode("hashes").alias("pos", "h")).where("h is not null")
    hits = written(salted_join(each, written(over, "over"), ["host", "h"], "mark").distinct(), "lines")
    # Exact only now, for the few lines that may be over the limits: equal texts count once.
    hosts = df.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host")).agg((max_share * F.count(F.lit(1))).alias("share"))
    spread = hits.groupBy("host", "h", "mark").agg(F.count(F.lit(1)).alias("lines")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("n_rows"))
    gone = spread.join(hosts, "host").where((F.col("n") > max_docs) & (F.col("n") > F.col("share"))).select("host", "h", "n_rows")
    return salted_join(hits, written(gone, "gone"), ["host", "h"], "mark").select("id", "mark", "pos")


def _removed(df: DataFrame, id_col: str, text: str, host: str, **limits) -> DataFrame:
    lines = frequent_lines(df, id_col, text, host, **limits)
    return lines.groupBy("id", "mark").agg(F.collect_set("pos").alias("_gone"))


def _judged(df: DataFrame, id_col: str, text: str, host: str, limits: dict) -> DataFrame:
    """The input as _c0, _c1, ..., its base measures, ``_gone`` (places of removed lines), n_removed_words and kept."""
    names = [f"_c{i}" for i in range(len(df.columns))]
    id_col, text, host = (names[df.columns.index(c)] for c in (id_col, text, host))
    df = df.toDF(*names)  # clashing names of extra columns do no harm
    base = with_base(df.withColumn("_mark", F.xxhash64(text)), text)
    gone = _removed(df, id_col, text, host, **limits).withColumnsRenamed({"id": "_gone_id", "mark": "_gone_mark"})
    both = base.join(gone, (F.col(id_col) == F.col("_gone_id")) & (F.col("_mark") == F.col("_gone_mark")), "left").drop("_gone_id", "_gone_mark", "_mark")
    removed = F.coalesce(F.aggregate("_gone", F.lit(0), lambda acc, i: acc + F.col("_line_words")[i]), F.lit(0)).cast("long")
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < MIN_WORDS) | (left < MIN_LEFT_SHARE * F.col("n_words")))
    return both.withColumn("n_removed_words", removed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """Measures and verdict of every document."""
    judged = _judged(df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(host).alias("host")), "id", "text", "host", limits)
    return judged.select(F.col("_c0").alias(id_col), *MEASURES, "kept", "n_removed_words")


def clean(df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """Documents that pass, with the input's columns; lines above the limits are gone from their texts."""
    judged = _judged(df, id_col, text, host, limits).where("kept")
    names, t = [f"_c{i}" for i in range(len(df.columns))], f"_c{df.columns.index(text)}"
    left = F.array_join(F.filter(F.split(F.col(t), "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    judged = judged.withColumn(t, F.when(F.col("_gone").isNull(), F.col(t)).otherwise(left))
    return judged.select(*names).toDF(*df.columns)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
starts AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, sum(least(8, i - before)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS before FROM starts) GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
  len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d)),
gone AS (SELECT host, norm FROM lines JOIN (SELECT host, count(*) AS docs FROM d GROUP BY host) USING (host) WHERE norm <> '' GROUP BY host, norm, docs HAVING count(DISTINCT t) > greatest({max_docs}, {max_share} * docs)),
removed AS (SELECT doc_id, sum(n) AS n FROM lines JOIN gone USING (host, norm) GROUP BY doc_id),
dup_lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE n > 0 GROUP BY doc_id),
measured AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup_lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id) LEFT JOIN dup_lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {min_words} OR n_words - n_removed_words < {min_left} * n_words)) AS kept, n_removed_words
FROM measured
""".replace("{max_docs}", str(MAX_LINE_DOCS)).replace("{max_share}", str(MAX_LINE_SHARE)).replace("{min_words}", str(MIN_WORDS)).replace("{min_left}", str(MIN_LEFT_SHARE))
