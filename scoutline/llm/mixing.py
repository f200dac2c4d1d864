"""Temperature mixing of sources, realised as budgeted block permutations.

The weight of a source is its token share raised to an exponent, normalised.  The exponent is bisected:
the largest one in [0, 1] whose mix reaches a share of the greatest possible entropy, unless some source
would then be repeated more often than a limit allows; in that case the smallest one that keeps the limit.

Each source gets a quota of tokens.  It is read in passes; every pass is a permutation of its blocks and of
the documents inside each block, and the last pass ends at the quota.  Running token counts are taken in
two steps, over the blocks of a source and inside each block, so no source is gathered in one task.

A document has its words plus one separator as tokens, so none is free.  There may be any number of sources: a
round of the bisection is one aggregate over their totals at all exponents that its next HALVINGS halvings may ask for.
Sums are exact decimals, so the order of rows changes nothing.

Edge cases: a null or empty text has one token; a null source is a source of its own; repeated rows are
documents of their own (rows with equal id and source get places in any order); extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.common import words, written

ROUNDS, HALVINGS = 6, 5


def tokens(text: Column) -> Column:
    return (F.size(words(text)) + 1).cast("long")


def _order(seed: int, *parts: Column | str) -> Column:
    """A permutation's key: equal for equal parts, else as good as random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts)))


def _sums(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Of every exponent a: the sums over sources of p^a and of p^a ln p."""
    exact = lambda x, name: F.sum(x.cast("decimal(30,20)")).cast("double").alias(name)
    p = F.col("p")
    row = shares.agg(*(exact(x, f"{n}{i}") for i, a in enumerate(exponents) for n, x in (("z", F.pow(p, F.lit(a))), ("l", F.pow(p, F.lit(a)) * F.log(p))))).first()
    return {a: (row[f"z{i}"], row[f"l{i}"]) for i, a in enumerate(exponents)}


def _bisect(shares: DataFrame, test: Callable[[float, float, float], bool]) -> tuple[float, float]:
    """The border in [0, 1] below which ``test(a, sum p^a, sum p^a ln p)`` holds, as the last interval of halving."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        parts = 1 << HALVINGS
        grid = [lo + (hi - lo) * i / parts for i in range(parts + 1)]
        sums, i, j = _sums(shares, grid[1:-1]), 0, parts
        while j - i > 1:
            mid = (i + j) // 2
            i, j = (mid, j) if test(grid[mid], *sums[grid[mid]]) else (i, mid)
        lo, hi = grid[i], grid[j]
    return lo, hi


def weights(sizes: DataFrame, entropy_share: float, max_passes: float, budget: int | None = None, cover: bool = False) -> DataFrame:
    """(source, held, exponent, weight, quota) from (source, held): tokens that each source has.

    budget: tokens of the mix, as many as there are if None.  With ``cover`` the budget is what makes the
    source with the fewest passes pass exactly once, so that every document is used.
    """
    sizes = written(sizes.select("source", F.col("held").cast("long").alias("held")), "sources")
    n, total, least, most = sizes.agg(F.count(F.lit(1)), F.sum("held"), F.min("held"), F.max("held")).first()
    if not n:
        return sizes.select("source", "held", *(F.lit(0.0).alias(c) for c in ("exponent", "weight")), F.lit(0).cast("long").alias("quota"))
    shares, least, most = sizes.withColumn("p", F.col("held") / F.lit(float(total))), least / total, most / total
    asked = budget / total if budget is not None else 1.0
    passes = (lambda a, z: (least / most) ** (a - 1)) if cover else (lambda a, z: asked * least ** (a - 1) / z)
    # With Z = sum p^a the entropy is ln Z - a / Z * sum p^a ln p.
    by_entropy = _bisect(shares, lambda a, z, logs: math.log(z) - a / z * logs >= entropy_share * math.log(n))[0]
    by_passes = 0.0 if passes(0.0, float(n)) <= max_passes else _bisect(shares, lambda a, z, logs: passes(a, z) > max_passes)[1]
    exponent = round(max(by_entropy, by_passes), 9)
    z = _sums(shares, [exponent])[exponent][0]
    tokens_asked = total * (z * most ** (1 - exponent) if cover else asked)
    weight = F.round(F.pow("p", F.lit(exponent)) / F.lit(z), 12)
    quota = F.floor(F.lit(tokens_asked) * F.col("weight") + 1e-6).cast("long")
    mix = shares.select("source", "held", F.lit(exponent).alias("exponent"), weight.alias("weight"))
    return mix.withColumn("quota", F.greatest(quota, F.col("held")) if cover else quota)


def mixed(df: DataFrame, entropy_share: float = 0.98, max_passes: float = 4.0, budget: int | None = None, cover: bool = False, seed: int = 7, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each use of a document: id, source, n_tokens, weight, pass, start (tokens of the source before it), place (start / quota).

    Sorting by place gives a stream that has the mix at every point.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), tokens(F.col(text)).alias("n"))
    docs = written(docs, "tokens")
    # As many blocks as a block has documents: both running sums then see about the square root of the table.
    n_blocks = max(16, math.isqrt(docs.count()))
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("null"))), F.lit(n_blocks)).cast("int"))
    blocks = docs.groupBy("source", "block").agg(F.sum("n").alias("in_block"))
    mix = written(weights(docs.groupBy("source").agg(F.sum("n").alias("held")), entropy_share, max_passes, budget, cover), "weights")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    passes = mix.select(F.col("source").alias("s"), "held", "weight", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("quota") / F.col("held")) - 1, F.lit(0).cast("long")))).alias("pass"))
    by_block = blocks.join(passes, same("source", "s")).drop("s")
    before = Window.partitionBy("source", "pass").orderBy(_order(seed, "source", "pass", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = by_block.withColumn("first", F.col("pass") * F.col("held") + F.coalesce(F.sum("in_block").over(before), F.lit(0))).where("first < quota")
    by_block = by_block.select(F.col("source").alias("s"), F.col("block").alias("b"), "weight", "quota", "pass", "first")
    uses = docs.join(by_block, same("source", "s") & (F.col("block") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "block", "pass").orderBy(_order(seed, "pass", "id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    uses = uses.withColumn("start", F.col("first") + F.coalesce(F.sum("n").over(inside), F.lit(0))).where("start < quota")
    return uses.select(F.col("id").alias(id_col), F.col("source").alias(source), F.col("n").alias("n_tokens"), "weight", "pass", "start", (F.col("start") / F.col("quota")).alias("place"))
