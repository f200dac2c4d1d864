"""Near-duplicate documents: MinHash bands find candidates, odd sketches sort them, full sets confirm.

A document's set holds its distinct word shingles.  Of its MinHash samples two things are kept: keys of
bands of samples (documents that share a key are candidates) and an odd sketch, a bitmap in which each
sample flips one bit.  The bits in which two sketches differ estimate how many samples differ, most
precisely for very similar sets, so almost only true pairs reach the confirmation on full sets.

No group is ever spread into all its pairs.  Documents of equal sets are one class.  In a bucket every class
meets the bucket's first one; after links are contracted, only classes outside that one's
component (outsiders) meet the rest of the bucket, in salted blocks if it is large.  Pairs inside one component need no
check, since they cannot change the result.  In a bucket of more than OUTSIDERS outsiders (pages of one template, say)
classes meet by rare shingles instead: two sets of the wanted similarity have one in common among the rarest ninth of the smaller and
the rarest fifth of the larger set, at places that leave room for the rest of the overlap.  That loses no pair, so the result
is the same on either way; pages that share a template and little else have no such shingle in common, however many there are.

Two sets of similarity s share no bucket with probability (1 - s^5)^40: 1.3e-7 at 0.8, less above.  The sketch lets pass every estimate of
at least ``similarity - SLACK``, five standard deviations.

Edge cases: null, empty and blank texts have an empty set and are linked with nothing; texts of fewer
words than a shingle have their whole sequence as the only one; repeated rows (same id and text) share a result;
rows of one id with different texts are judged each by its own text; a row with a null id takes part like any
other, but never names a component (one of null ids only has a null name, and its rows are kept); extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.common import WordHasher, _mix, forget, salted_join, slices, string_buffers, written
from scoutline.llm.components import components

BANDS, ROWS = 40, 5
#: All samples flip sketch bits, the first BANDS * ROWS of them make band keys.
SAMPLES, SKETCH_BITS, SLACK = 1200, 3072, 0.065
#: Members of a bucket that are compared by one task; outsiders of a bucket that meet all the rest of it.
BLOCK, OUTSIDERS = 1000, 2000
#: Bytes of text that are hashed at a time in a task.
TEXT_BYTES = 2_000_000

_ODD = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_FLIP = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
#: Factors of the sampling hashes, which work on 32 bits because processors multiply several of those at once.
_ODD_32, _FLIP_32 = (_ODD >> np.uint64(31)).astype(np.uint32) | np.uint32(1), (_FLIP >> np.uint64(32)).astype(np.uint32)


def shingle_sets(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and where each text's begin."""
    hashes, starts = hasher(data, offsets)
    counts = np.diff(starts)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    padded = np.concatenate((hashes, np.zeros(width - 1, np.uint64)))
    mixed = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        mixed += padded[k : k + len(hashes)] * _ODD[k]
    shingles = _mix(mixed)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(counts):
        n = counts[i]
        if n >= width:
            own = np.unique(shingles[starts[i] : starts[i] + n - width + 1])
        else:  # the whole sequence; its length keeps it apart from a shingle that begins with it
            own = _mix(np.array([np.sum(hashes[starts[i] : starts[i] + n] * _ODD[:n], dtype=np.uint64) ^ _FLIP[n]], np.uint64))
        sets.append(own)
        sizes[i] = len(own)
    return np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))


def signatures(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two numbers that name each set, its band keys and its odd sketch; all sets must have members."""
    n = len(starts) - 1
    marks = np.stack((np.add.reduceat(_mix(sets ^ _FLIP[0]), starts[:-1]), np.bitwise_xor.reduceat(_mix(sets ^ _FLIP[1]), starts[:-1])), 1)
    least = np.empty((SAMPLES, n), np.uint32)
    short = (sets >> np.uint64(32)).astype(np.uint32)
    lo = 0
    while lo < n:  # blocks that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + 16_384, "right")) - 1)
        block, cuts = short[starts[lo] : starts[hi]], starts[lo:hi] - starts[lo]
        work = np.empty_like(block)
        for j in range(SAMPLES):
            np.bitwise_xor(block, _FLIP_32[j], out=work)
            np.multiply(work, _ODD_32[j], out=work)
            least[j, lo:hi] = np.minimum.reduceat(work, cuts)
        lo = hi
    bands = np.zeros((n, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(n, b + 1, np.uint64)
        for r in range(ROWS):
            key = _mix(key ^ least[b * ROWS + r].astype(np.uint64) * _ODD[r])
        bands[:, b] = key
    bits = _mix(least.T.astype(np.uint64) * _ODD[0] ^ _FLIP) % np.uint64(SKETCH_BITS)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bits.astype(np.int64)).ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS) & 1
    sketches = np.packbits(flips.astype(np.uint8), axis=1).view(np.uint64)
    return marks, bands, sketches


def _list_column(values: np.ndarray, offsets: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.uint64).view(np.int64)))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """id, hash of the text, n_shingles, mark (two longs), bands, sketch of every document; null marks for empty sets."""

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, TEXT_BYTES):
                sets, starts = shingle_sets(hasher, data, offsets[i : j + 1], width)
                sizes = np.diff(starts)
                full = np.flatnonzero(sizes)
                marks, bands, sketches = signatures(sets, np.concatenate((starts[:-1][full], starts[-1:]))) if len(full) else (np.zeros((0, 2)), np.zeros((0, BANDS)), np.zeros((0, SKETCH_BITS // 64)))
                place = np.full(j - i, -1, np.int64)
                place[full] = np.arange(len(full))
                rows = pa.array(place, mask=place < 0)
                step = lambda x: np.arange(len(full) + 1) * x.shape[1]
                lists = [_list_column(x.ravel(), step(x)).take(rows) for x in (bands, sketches)]
                first, second = (pa.array(marks[:, k].astype(np.uint64).view(np.int64)).take(rows) for k in (0, 1))
                yield pa.record_batch([batch.column("id")[i:j], batch.column("hash")[i:j], pa.array(sizes), first, second, *lists], names=["id", "hash", "n_shingles", "mark1", "mark2", "bands", "sketch"])

    return docs.mapInArrow(run, "id long, hash long, n_shingles long, mark1 long, mark2 long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """id and the whole set of every document."""

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher()
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for i, j in slices(offsets, TEXT_BYTES):
                sets, starts = shingle_sets(hasher, data, offsets[i : j + 1], width)
                yield pa.record_batch([batch.column("id")[i:j], _list_column(sets, starts)], names=["id", "members"])

    return docs.mapInArrow(run, "id long, members array<long>")


def _likely(a: Column, b: Column, similarity: float) -> Column:
    """True if two odd sketches differ in few enough bits for the similarity, with slack."""
    apart = 2 * SAMPLES * (1 - (similarity - SLACK))
    most = int(SKETCH_BITS / 2 * (1 - np.exp(-2 * apart / SKETCH_BITS)))
    differ = [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SKETCH_BITS // 64)]
    return sum(differ[1:], differ[0]) <= most


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) whose full sets reach the similarity."""
    a, b = (sets.select(F.col("id").alias(x), F.col("members").alias(f"set_{x}")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v")
    common = F.size(F.array_intersect("set_u", "set_v"))
    per_cent = round(100 * similarity)
    return both.where(100 * common >= per_cent * (F.size("set_u") + F.size("set_v") - common)).select("u", "v")


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the component of each (own) and of their bucket's center (of_center)."""
    named = written(components(links), "components")
    center = named.select(F.col("node").alias("center"), F.col("component").alias("of_center"))
    both = members.join(named.withColumnRenamed("node", "id"), "id", "left").join(center, "center", "left")
    return both.select("key", "band", "id", "center", "n", F.coalesce("component", "id").alias("own"), F.coalesce("of_center", "center").alias("of_center"))


def _classes(signed: DataFrame) -> DataFrame:
    """One row per distinct set: node (a number of its own), the smallest id, one document (id, hash), marks, rows, bands, sketch."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    grouped = signed.where("mark1 is not null").groupBy("mark1", "mark2").agg(first, F.count(F.lit(1)).alias("n_rows"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    return grouped.select(F.monotonically_increasing_id().alias("node"), "first.id", "first.hash", "mark1", "mark2", "n_rows", "bands", "sketch")


def _members(keys: DataFrame) -> DataFrame:
    """Classes of buckets of two or more: key, band, id, center (the bucket's smallest), n."""
    shared = keys.groupBy("key").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(shared, "key")


def _met(placed: DataFrame, sketches: DataFrame, likely: Column) -> DataFrame:
    """Likely pairs (u, v) of outsiders with the classes of their bucket that are in other components."""
    outside = placed.where("own <> of_center")
    salts = F.ceil(F.col("n") / BLOCK).cast("int")
    earlier = lambda x: sketches.select("id", F.col("sketch").alias(f"sketch_{x}"), "bands")
    before = lambda x: F.slice("bands", F.lit(1), F.col("band")).alias(f"before_{x}")
    apart = outside.join(earlier("u"), "id").select("key", F.col("id").alias("u"), F.col("own").alias("own_u"), "sketch_u", before("u"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    rest = placed.join(outside.select("key").distinct(), "key", "left_semi").join(earlier("v"), "id").select("key", F.col("id").alias("v"), F.col("own").alias("own_v"), (F.col("own") == F.col("of_center")).alias("linked"), "sketch_v", before("v"), F.pmod(F.hash("id"), salts).alias("salt"))
    test = (F.col("own_u") != F.col("own_v")) & (F.col("linked") | (F.col("u") < F.col("v"))) & likely
    test = test & ~F.arrays_overlap("before_u", "before_v")  # pairs that share several buckets meet in the first of them
    return apart.join(rest.withColumnsRenamed({"key": "key_v", "salt": "salt_v"}), (F.col("key") == F.col("key_v")) & (F.col("salt") == F.col("salt_v")) & test).select("u", "v").distinct()


def _rare(sets: DataFrame, per_cent: int) -> DataFrame:
    """Shingles by which sets may meet: key, id, size, place in the set by rarity among these sets (from 1), short.

    All rows are among the rarest of the set, as many as a larger partner needs; short ones also if it is the smaller one.
    Shingles of one set only take their places, but no rows.
    """
    each = sets.select("id", F.size("members").cast("long").alias("size"), F.explode("members").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    own = Window.partitionBy("id")
    place = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("often", "key"))
    placed = each.join(often, "key").withColumn("place", place)
    larger = F.expr(f"place <= size - ({per_cent} * size + 99) div 100 + 1")
    smaller = F.expr(f"place <= size - (2 * {per_cent} * size + {99 + per_cent}) div {100 + per_cent} + 1")
    return placed.where(larger).select("key", "id", "size", "place", smaller.alias("short"))


def _shared(rare: DataFrame) -> DataFrame:
    """Shingles by which some two sets may meet: key, center (the smallest id), n."""
    found = rare.groupBy("key").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("n"), F.bool_or("short").alias("any"))
    return found.where("n > 1 and any").select("key", "center", "n")


def _met_by_rare(owned: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (u, v), perhaps repeated, of sets in different components that share a shingle at places that allow the similarity."""
    salts = F.ceil(F.col("n") / BLOCK).cast("int")
    side = lambda x, *more: [F.col(c).alias(f"{c}_{x}") for c in ("size", "place", "own")] + [F.col("id").alias(x), *more]
    smaller = owned.where("short").select("key", *side("u", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    larger = owned.select("key", *side("v", F.pmod(F.hash("id"), salts).alias("salt")))
    overlap = f"({per_cent} * (size_u + size_v) + {99 + per_cent}) div {100 + per_cent}"
    fits = f"own_u <> own_v and (size_u < size_v or (size_u = size_v and u < v)) and 1 + least(size_u - place_u, size_v - place_v) >= {overlap}"
    return smaller.join(larger, ["key", "salt"]).where(fits).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """id_col, text_hash, n_shingles, component_id, kept of every document (one row for each row of the input)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    signed = written(_signed(docs, width), "signatures")
    classes = written(_classes(signed), "classes")
    members = written(_members(classes.select(F.col("node").alias("id"), F.posexplode("bands").alias("band", "key"))), "members")
    ids = members.select("id").distinct()
    # Ids grow with the table, so they are never broadcast; whole sets are made once, of one document of each class that shares a bucket.
    wanted = classes.join(ids.hint("merge"), F.col("node") == ids["id"], "left_semi")
    some = F.coalesce("id", F.lit(-1)).alias("id")
    texts = docs.select(some, "hash", "text").join(wanted.select("node", some, "hash").hint("merge"), ["id", "hash"]).dropDuplicates(["id", "hash"])
    sets = written(_sets(texts.select(F.col("node").alias("id"), "text"), width), "sets")
    sketches = written(wanted.select(F.col("node").alias("id"), "sketch", "bands"), "sketches")
    a, b = (sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "uv")
    likely = _likely(F.col("sketch_u"), F.col("sketch_v"), similarity)

    def linked(members: DataFrame) -> DataFrame:
        pairs = members.where("id <> center").select(F.col("id").alias("u"), F.col("center").alias("v")).distinct()
        return written(_confirmed(pairs.join(a, "u").join(b, "v").where(likely).select("u", "v"), sets, similarity), "links")

    # First every class meets its bucket's smallest one, then outsiders meet the others.
    links = linked(members)
    placed = written(_placed(members, links), "placed")
    forget(members)
    crowds = written(placed.where("own <> of_center").groupBy("key").agg(F.count(F.lit(1)).alias("outsiders")).where(F.col("outsiders") > OUTSIDERS).select("key"), "crowds")
    pairs = _met(placed.join(crowds, "key", "left_anti"), sketches, likely)
    if not crowds.isEmpty():
        inside = placed.join(crowds, "key", "left_semi").select("id").distinct()
        rare = written(_rare(sets.join(inside, "id", "left_semi"), round(100 * similarity)), "rare")
        again = written(rare.join(_shared(rare), "key"), "members")
        links = written(links.unionByName(linked(again)), "links")
        named = components(links).select(F.col("node").alias("id"), F.col("component").alias("own"))
        owned = written(again.join(named, "id", "left").withColumn("own", F.coalesce("own", "id")), "owned")
        met = _met_by_rare(owned, round(100 * similarity)).distinct()
        pairs = written(pairs, "pairs").unionByName(met.join(a, "u").join(b, "v").where(likely).select("u", "v"))
    more = _confirmed(written(pairs.distinct(), "candidates"), sets, similarity)
    final = components(links.unionByName(more))
    named = classes.select("node", "id", "mark1", "mark2", "n_rows").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("id").alias("component_id"))
    names = written(named.join(names, "component").select("mark1", "mark2", "n_rows", "component_id", F.lit(True).alias("full")), "names")
    forget(sets)
    full = salted_join(signed.where("mark1 is not null").select("id", "hash", "n_shingles", "mark1", "mark2"), names, ["mark1", "mark2"], "id").drop("mark1", "mark2")
    empty = signed.where("mark1 is null").select("id", "hash", "n_shingles", F.col("id").alias("component_id"), F.lit(False).alias("full"))
    kept = ~F.col("full") | F.col("component_id").isNull() | F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("hash").alias("text_hash"), "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The input with one row of each group: that of the smallest id (of its texts the one with the smallest hash).

    Rows without an id stay if no row of their group has one, one row for each text.
    """
    kept = written(near_duplicates(docs, id_col, text_col, width, similarity).where("kept").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), "component_id"), "kept")
    named = kept.where("component_id is not null").groupBy("component_id").agg(F.min(F.struct("_id", "_hash")).alias("first")).select("first.*")
    chosen = named.unionByName(kept.where("component_id is null").select("_id", "_hash").distinct())
    chosen = chosen.select(F.coalesce("_id", F.lit(-1)).alias("_key"), F.col("_id").isNull().alias("_none"), "_hash")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    i, t = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    inner = inner.withColumns({"_key": F.coalesce(i.cast("long"), F.lit(-1)), "_none": i.isNull(), "_hash": F.xxhash64(t)})
    keys = ["_key", "_none", "_hash"]
    return inner.join(chosen.hint("merge"), keys, "left_semi").dropDuplicates(keys).select(*names).toDF(*docs.columns)
