"""Entity resolution: blocking, the match ladder, the best match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutline.functions import identity as ident
from scoutline.functions.frames import held, stored

#: Ladder thresholds (fixed values): fuzzy scores that merge and that go to review, names that are short, their Jaro-Winkler, cluster size.
MERGE, REVIEW, SHORT, SHORT_JARO, MAX_CLUSTER = 92, 84, 12, 0.90, 3


def keyed(mentions: DataFrame) -> DataFrame:
    """id, name, norm, norm_key, tokens, number, domain, country of mentions (id, name, number, domain, country)."""
    raw = held(mentions.select("id", "name", "number", F.col("domain"), "country"), "name", "number", "domain", "country")
    norm = raw.select("id", "name", ident.norm_name(F.col("name")).alias("norm"), ident.registry_number(F.col("number")).alias("number"), ident.host(F.col("domain")).alias("host"), ident.country(F.col("country")).alias("country"))
    norm = held(norm, "norm", "number", "host", "country")
    norm = held(norm.select("id", "name", "norm", "number", ident.below_suffix(F.col("host")).alias("found"), "country"), "found")
    norm = norm.select("id", "name", "norm", "number", ident.allowed(F.col("found")).alias("domain"), "country")
    return norm.withColumns({"norm_key": F.replace("norm", F.lit(" "), F.lit("")), "tokens": ident.rare_tokens(F.col("norm"))})


def registrable_of(df: DataFrame, value: str, rules: DataFrame) -> DataFrame:
    """df with ``host`` and ``registrable`` by a table of public suffix rules (column ``rule``): the longest rule that fits a host's end.

    Each distinct host is looked up by its ends: every end itself, with its first label as ``*``, and as an exception (``!``), which
    is sold although a ``*`` covers it.  So the join is one of equal keys, and no host is compared with a rule that does not fit.
    """
    rows = held(df.withColumn("host", ident.host(F.col(value))), "host")
    hosts = rows.select("host").where(~F.col("host").rlike(r"(?:^|[.])[0-9]+$")).distinct().withColumn("labels", F.split("host", "[.]"))
    ends = hosts.select("host", "labels", F.posexplode(F.transform("labels", lambda _, i: F.array_join(F.slice("labels", i + 1, F.size("labels")), "."))).alias("at", "end"))
    n = F.size("labels") - F.col("at")
    keys = F.array(F.struct(F.col("end").alias("rule"), n.alias("n"), F.lit(0).alias("first")), F.struct(F.regexp_replace("end", "^[^.]+", "*").alias("rule"), n.alias("n"), F.lit(0).alias("first")), F.struct(F.concat(F.lit("!"), "end").alias("rule"), (n - 1).alias("n"), F.lit(1).alias("first")))
    looked = ends.select("host", F.inline(keys)).join(rules.select("rule").distinct(), "rule")
    best = looked.groupBy("host").agg(F.max(F.struct("first", "n")).alias("best"))
    depth = F.coalesce(F.col("best.n"), F.lit(1))
    found = F.when(F.size("labels") > depth, F.array_join(F.slice("labels", F.size("labels") - depth, depth + 1), "."))
    denied = ident.is_denied_domain(F.col("host")) | ident.is_denied_domain(F.col("registrable"))
    by_host = hosts.join(best, "host", "left").select("host", found.alias("registrable")).select("host", F.when(~denied, F.col("registrable")).alias("registrable"))
    return rows.join(by_host, "host", "left")


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a public suffix list file: one in a line, without comments and blank lines."""
    line = F.lower(F.trim(F.regexp_extract("value", r"^\s*(\S*)", 1)))
    return spark.read.text(path).select(line.alias("rule")).where("rule <> '' and rule not like '//%'")


def block(names: DataFrame, keys: tuple[str, ...] = (), part: int = 200, tokens: Column | None = None) -> DataFrame:
    """Pairs that share a token or an exact key: (a, b, name_a, name_b, shared), shared counting tokens.

    names: id (unique), name and the key columns; ``norm_key`` is made from the name if it is not there.  Null and empty keys
    pair nothing.  A group of more than ``part`` names is cut into as many parts as it needs: each name is in one part as a, and
    meets every part as b, so no pair is lost and no task gets a whole group.
    """
    made = {"norm_key": ident.norm_key(F.col("name"))}
    token = F.explode(F.array_distinct(F.split("name", " ") if tokens is None else tokens)).alias("key")
    blocks = names.select("id", "name", F.lit("token").alias("kind"), token).where("length(key) > 2")
    for k in keys:
        key = F.col(k) if k in names.columns else made[k]
        blocks = blocks.unionByName(names.select("id", "name", F.lit(k).alias("kind"), key.cast("string").alias("key")).where("key <> ''"))
    sizes = blocks.groupBy("kind", "key").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    blocks = blocks.join(sizes, ["kind", "key"])
    one = blocks.select("kind", "key", F.col("id").alias("a"), F.col("name").alias("name_a"), F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int").alias("p"))
    other = blocks.select("kind", "key", F.col("id").alias("b"), F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    pairs = one.join(other, ["kind", "key", "p"]).where("a < b")
    return pairs.groupBy("a", "b", "name_a", "name_b").agg(F.count_if(F.col("kind") == "token").alias("shared"))


def candidates(mentions: DataFrame) -> DataFrame:
    """Keyed pairs (columns _a and _b) that share a registry number, a domain, a name's key or a distinctive token."""
    known = stored(keyed(mentions))
    named = ~ident.is_placeholder(F.col("norm_key"))  # a placeholder's name brings nobody together
    blocked = known.select("id", "name", "number", "domain", F.when(named, F.col("norm_key")).alias("norm_key"), F.when(named, F.col("tokens")).otherwise(F.array().cast("array<string>")).alias("tokens"))
    pairs = block(blocked, ("number", "domain", "norm_key"), tokens=F.col("tokens")).select("a", "b")
    side = lambda x: known.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in known.columns if c != "id"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _verdict(steps: list[tuple], otherwise: Column | None = None) -> Column:
    """The first step that holds, as decision, rule, tier and confidence."""
    made = lambda decision, rule, tier, confidence: F.struct(F.lit(decision).alias("decision"), F.lit(rule).alias("rule"), F.lit(tier).alias("tier"), F.lit(confidence).cast("double").alias("confidence"))
    out = None
    for condition, *rest in steps:
        out = F.when(condition, made(*rest)) if out is None else out.when(condition, made(*rest))
    return out if otherwise is None else out.otherwise(otherwise)


def _exact_steps() -> list[tuple]:
    """Rungs that need no similarity: numbers settle everything; then domains, placeholders, and equal keys of countries that agree."""
    col = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    (na, nb), (ka, kb), (ca, cb), (da, db) = col("number"), col("norm_key"), col("country"), col("domain")
    return [
        (na == nb, "merge", "ch_exact", 0, 1.0),
        (na != nb, "distinct", "ch_conflict", 0, 1.0),
        (da == db, "merge", "domain_exact", 1, 0.97),
        (ident.is_placeholder(ka) | ident.is_placeholder(kb), "distinct", "placeholder", 2, None),
        ((ka == kb) & F.coalesce(ca != cb, F.lit(False)), "distinct", "normkey_country_conflict", 3, None),
        (ka == kb, "merge", "normkey_exact", 2, 0.95),
    ]


def exact_verdicts(pairs: DataFrame) -> DataFrame:
    """Keyed pairs that an exact rung decides, with decision, rule, tier and confidence; no similarity is computed."""
    return pairs.withColumn("v", _verdict(_exact_steps())).where("v is not null").select("*", "v.*").drop("v")


def is_family(norm: Column) -> Column:
    return F.arrays_overlap(F.split(norm, " "), F.array(*map(F.lit, ident.FAMILY_MARKERS)))


def may_be_similar(length_a: Column, length_b: Column, seen_a: Column, seen_b: Column) -> Column:
    """False only for names that score below REVIEW, by their lengths and ``occurrences``; no characters are compared.

    A score of REVIEW, rounded to two digits, leaves a share of both names' characters outside their common subsequence.
    """
    most = (length_a + length_b) * F.lit((100 - REVIEW + 0.01) / 100)
    return (F.abs(length_a - length_b) <= most) & (ident.least_edits(seen_a, seen_b) <= most)


def compared(pairs: DataFrame) -> DataFrame:
    """Append decision, rule, tier, score and confidence of the ladder to keyed pairs.

    Registry numbers settle everything; then domains; placeholders match nothing; equal keys match unless
    both countries are known and differ; similar names match behind guards, or go to review.
    """
    col = lambda c: (F.col(f"{c}_a"), F.col(f"{c}_b"))
    (na, nb), (ka, kb), (wa, wb), (ca, cb) = col("number"), col("norm_key"), col("norm"), col("country")
    domains = F.col("domain_a") == F.col("domain_b")
    conflict = F.coalesce(ca != cb, F.lit(False))
    words = lambda x, listed: F.array_intersect(F.split(x, " "), F.array(*map(F.lit, listed)))
    roles = lambda x: F.array_sort(F.array_distinct(words(x, ident.ROLE_MARKERS)))
    role_conflict = roles(wa) != roles(wb)
    shared = F.arrays_overlap("tokens_a", "tokens_b")
    family = is_family(wa) & is_family(wb) & shared
    exact = F.coalesce((na == nb) | (na != nb) | domains, F.lit(False)) | ident.is_placeholder(ka) | ident.is_placeholder(kb) | (ka == kb)
    score = F.when(~exact, ident.fuzzy_score(wa, wb)).when((ka == kb) & ~F.coalesce(na.isNotNull() & nb.isNotNull() | domains, F.lit(False)), 100.0)
    pairs = held(pairs.withColumns({"exact": exact, "score": score}), "exact", "score")
    short = F.least(F.length(wa), F.length(wb)) <= SHORT
    # Others get null for an answer, in the same pass: two branches would compare all names twice.
    jaro = F.udf(lambda a, b: None if a is None or b is None else ident.jaro_winkler(a, b), "double", useArrow=True)
    doubtful = ~F.col("exact") & (F.col("score") >= MERGE) & ~role_conflict & shared & ~conflict & short
    pairs = held(pairs.withColumn("jaro", jaro(F.when(doubtful, wa), F.when(doubtful, wb))), "jaro")
    near = F.col("score") >= MERGE
    steps = [
        *_exact_steps(),
        (near & role_conflict, "review", "fuzzy_corporate_role_conflict", 4, None),
        (near & ~shared, "review", "fuzzy_guard_failed", 4, None),
        (near & conflict, "review", "fuzzy_country_conflict", 4, None),
        (near & (F.col("jaro") < SHORT_JARO), "review", "fuzzy_short_name", 4, None),
        (near, "merge", "fuzzy", 4, 0.90),
        (F.col("score") >= REVIEW, "review", "fuzzy", 5, None),
        (family, "review", "person_name_shared_token", 5, None),
    ]
    none = F.struct(F.lit("distinct").alias("decision"), F.lit("no_match").alias("rule"), F.lit(6).alias("tier"), F.lit(None).cast("double").alias("confidence"))
    return pairs.withColumn("v", _verdict(steps, none)).select("*", "v.*").drop("v", "exact", "jaro")


def capped(verdicts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fuzzy merges into an entity (b) that has absorbed MAX_CLUSTER records by fuzzy matches go to review; sizes: id, n."""
    both = verdicts.join(sizes.select(F.col("id").alias("b"), F.col("n").alias("_n")), "b", "left")
    full = (F.col("decision") == "merge") & F.col("rule").startswith("fuzzy") & (F.coalesce("_n", F.lit(1)) >= MAX_CLUSTER)
    return both.withColumns({"decision": F.when(full, "review").otherwise(F.col("decision")), "rule": F.when(full, "fuzzy_cluster_cap").otherwise(F.col("rule")), "confidence": F.when(~full, F.col("confidence"))}).drop("_n")


def best_matches(verdicts: DataFrame) -> DataFrame:
    """Of each mention (a) the entity (b) with the best verdict: merge before review, then confidence, score and the smaller id."""
    rank = F.when(F.col("decision") == "merge", 2).otherwise(1)
    order = [rank.desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.coalesce("score", F.lit(0.0)).desc(), F.col("b")]
    first = Window.partitionBy("a").orderBy(*order)
    return verdicts.where("decision <> 'distinct'").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def ladder(pairs: DataFrame) -> DataFrame:
    """Similarity and verdict of pairs of plain names: merge, review or distinct."""
    scored = pairs.withColumn("score", ident.fuzzy_score(F.col("name_a"), F.col("name_b")))
    verdict = F.when(F.col("name_a") == F.col("name_b"), "merge").when(F.col("score") >= MERGE, "merge").when(F.col("score") >= REVIEW, "review").otherwise("distinct")
    return scored.withColumn("verdict", verdict)
