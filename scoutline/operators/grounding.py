"""Verbatim grounding: which quotes stand in which texts, as whole spans."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.functions.frames import stored

#: A shorter quote is no evidence (fixed value).
MIN_QUOTE_CHARS = 12
#: Words of a gram that quotes and texts meet by; a quote takes the longest that its inner words fill.
LEVELS = (8, 4, 2, 1)
#: Characters by which a quote of one or two words meets the vocabulary; its longest word has as many at least.
PART = 6
# Fixed folding of typed variants.
_FOLD = str.maketrans(dict.fromkeys("‘’‚‛", "'") | dict.fromkeys("“”„«»", '"') | dict.fromkeys("‐‑‒–—―−", "-") | {"…": "...", "​": ""})


def normalise(text: str | None) -> str:
    """NFKC, folded quotes and dashes, white space as single blanks; case stays."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "").translate(_FOLD)).strip()


#: Texts of these characters alone are their own NFKC form, so Catalyst folds them; the others go through Python.
PLAIN = r"^[\x00-\x7F£«»À-ÿ–—‘-„€]*$"


def normalised(df: DataFrame) -> DataFrame:
    """The frame with ``text`` as ``normalise`` has it."""
    plain = F.coalesce(F.col("text").rlike(PLAIN), F.lit(True))
    folded = F.translate(F.coalesce("text", F.lit("")), "‘’‚‛“”„«»–—", "''''" + '"' * 5 + "--")
    flat = F.trim(F.regexp_replace(folded, r"[\x09-\x0D\x1C-\x20]+", " "))
    odd = F.udf(normalise, "string", useArrow=True)
    return df.where(plain).withColumn("text", flat).unionByName(df.where(~plain).withColumn("text", odd("text")))


def _words(text: str) -> Column:
    return F.split(F.col(text), " ", -1)


def _grams(words: Column, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(n)), " "))))


def _by_grams(texts: DataFrame, quotes: DataFrame, n: int) -> DataFrame:
    """(id, quote) of texts that have a quote's rarest gram; a quote with a gram that no text has is in none."""
    wanted = quotes.where(F.col("level") == n).select("quote", F.explode(_grams(F.col("inner"), n)).alias("gram"))
    held = stored(texts.select("id", F.explode(_grams(F.col("words"), n)).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"))  # read twice
    counted = wanted.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    rarest = counted.groupBy("quote").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all").drop("all")
    return held.join(rarest, "gram").select("id", "quote")


def _by_parts(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, quote) for quotes of one or two words, whose longest word is inside a word of the text."""
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = quotes.where("level = 0").select("quote", longest.alias("longest")).withColumn("part", F.left("longest", F.lit(PART)))
    held = texts.select("id", F.explode(F.array_distinct("words")).alias("word")).where(F.length("word") >= PART)
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - PART + 1), lambda i: F.substring(F.col("word"), i, F.lit(PART))))
    vocabulary = held.select("word").distinct().select("word", F.explode(parts).alias("part"))
    found = vocabulary.join(short, "part").where(F.contains("word", "longest")).select("word", "quote")
    return held.join(found, "word").select("id", "quote").distinct()


def grounded(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, quote_id) of every quote that is contained, whole, in a text after normalisation.

    texts: id, text; quotes: quote_id, text.  Words inside a span are whole in the text, so both meet by hashes of
    word grams; ``contains`` on the whole quote and text decides.  A null or shorter quote is in no text.
    """
    texts = normalised(texts.select("id", "text")).where(F.length("text") >= MIN_QUOTE_CHARS).withColumn("words", _words("text"))
    named = normalised(quotes.select("quote_id", "text")).withColumnRenamed("text", "quote").where(F.length("quote") >= MIN_QUOTE_CHARS)
    level = F.coalesce(*(F.when(F.size("words") - 2 >= n, n) for n in LEVELS), F.lit(0))
    distinct = named.select("quote").distinct().withColumn("words", _words("quote")).withColumn("level", level)
    distinct = distinct.withColumn("inner", F.slice("words", F.lit(2), F.greatest(F.size("words") - 2, F.lit(0))))
    used = {r.level for r in distinct.select("level").distinct().collect()}  # five values at most
    pairs = [_by_grams(texts, distinct, n) for n in LEVELS if n in used] + ([_by_parts(texts, distinct)] if 0 in used else [])
    if not pairs:
        return texts.join(named.select("quote_id"), F.lit(False)).select("id", "quote_id")
    both = pairs[0]
    for more in pairs[1:]:
        both = both.unionByName(more)
    sure = both.join(texts.select("id", "text"), "id").where(F.contains("text", "quote")).select("id", "quote").distinct()
    return sure.join(named, "quote").select("id", "quote_id")
