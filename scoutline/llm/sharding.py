"""Extendible hashing: shards of bounded size without moving rows of buckets that fit.

A row's bucket is a prefix of its hash bits.  The directory begins with one bucket; a bucket over the byte
limit splits on one more bit until every bucket fits or holds a single row.  Splitting needs no pass over
the rows for each bit: sizes are summed once for prefixes some bits ahead, all shorter prefixes follow from
those sums, and only what is still over the limit at that depth is looked at again, further bits ahead.

Edge cases: a null size counts as 0 and a null id hashes like the text ``null``; a row larger than the limit
is a shard of its own; rows of equal ids have equal bits, and if they alone are over the limit they share
their bucket's prefix but are dealt to numbered parts of it, each within the limit; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.common import written

#: Bits of the hash, and bits that one pass looks ahead.
BITS, AHEAD = 60, 12


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, BITS - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(fine, at, depth, bytes, rows): for each prefix of ``at`` bits that occurs the depth and size of its bucket.

    rows: bits, size.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    at = min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 6))
    found, begin, over = [], 0, None
    while True:
        left = rows if over is None else rows.join(over, _prefix(F.col("bits"), begin) == F.col("over"), "left_semi")
        fine = left.groupBy(_prefix(F.col("bits"), at).alias("fine")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        fine = written(fine, "fine")
        depth = F.explode(F.sequence(F.lit(begin), F.lit(at)))
        tree = fine.select("fine", "bytes", "rows", "low", "high", depth.alias("depth")).withColumn("prefix", F.expr(f"shiftright(fine, {at} - depth)"))
        sums = tree.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"))
        fits = sums.where((F.col("bytes") <= limit) | (F.col("low") == F.col("high")))  # rows of equal bits can't be parted
        size = F.struct("depth", "bytes", "rows")
        leaf = tree.select("fine", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("fine").agg(F.min(size).alias("leaf"))
        leaf = written(leaf.select("fine", F.lit(at).alias("at"), "leaf.*"), "leaves")
        found.append(leaf)
        over = written(fine.join(leaf, "fine", "left_anti").select(F.col("fine").alias("over")), "over")
        if over.isEmpty():
            return found
        begin, at = at, min(BITS, at + AHEAD)


def shards(df: DataFrame, limit: int, id_col: str = "doc_id", size: Column | None = None) -> DataFrame:
    """id_col, n_bytes, shard (the bucket's bits), part, depth, shard_bytes, shard_rows of every row."""
    size = F.octet_length("text") if size is None else size
    rows = written(df.select(F.col(id_col).alias("id"), hash_bits(F.col(id_col)).alias("bits"), F.coalesce(size, F.lit(0)).cast("long").alias("size")), "rows")
    done = []
    for leaf in directory(rows, limit):
        done.append(rows.join(leaf, _prefix(F.col("bits"), leaf_at(leaf)) == F.col("fine")).select("id", "bits", "size", "depth", "bytes", "rows"))
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    whole = placed.withColumn("part", F.lit(0).cast("long"))
    stuck = (F.col("bytes") > limit) & (F.col("rows") > 1)
    placed = whole.where(~stuck)
    if not whole.where(stuck).isEmpty():
        # Equal ids: running bytes per task and the tasks' totals give each row its place, without gathering them.
        own = written(whole.where(stuck).withColumn("task", F.spark_partition_id()), "stuck")
        tasks = own.groupBy("bits", "task").agg(F.sum("size").alias("held"))
        tasks = tasks.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("bits").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        running = F.sum("size").over(Window.partitionBy("bits", "task").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
        largest = own.groupBy("bits").agg(F.max("size").alias("largest"))
        parted = own.withColumn("running", F.coalesce(running, F.lit(0))).join(tasks, ["bits", "task"]).join(largest, "bits")
        # A part begins anew after every (limit - largest) bytes, so that its last row still fits.
        room = F.greatest(F.lit(limit) - F.col("largest"), F.lit(1))
        parted = parted.withColumn("part", F.floor((F.col("running") + F.col("before")) / room).cast("long"))
        parts = parted.groupBy("bits", "part").agg(F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows"))
        parted = parted.join(parts, ["bits", "part"]).select("id", "bits", "size", "depth", F.col("part_bytes").alias("bytes"), F.col("part_rows").alias("rows"), "part")
        placed = placed.unionByName(parted)
    bits = F.lpad(F.conv(F.col("bits").cast("string"), 10, 2), BITS, "0")
    return placed.select(
        F.col("id").alias(id_col),
        F.col("size").alias("n_bytes"),
        F.substring(bits, F.lit(1), F.col("depth")).alias("shard"),
        "part",
        F.col("depth").cast("long").alias("depth"),
        F.col("bytes").alias("shard_bytes"),
        F.col("rows").alias("shard_rows"),
    )


def leaf_at(leaf: DataFrame) -> int:
    """Depth at which a table of leaves is keyed (0 if it is empty)."""
    first = leaf.select("at").first()
    return first[0] if first else 0


SQL = """
WITH sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS bits
  FROM documents),
every_depth AS (
  SELECT s.*, d.depth, bits >> (60 - d.depth)::INT AS prefix FROM sized s, (SELECT unnest(range(0, 41)) AS depth) d),
totals AS (
  SELECT doc_id, n_bytes, bits, depth, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows
  FROM every_depth WINDOW w AS (PARTITION BY depth, prefix)),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS n FROM totals WHERE shard_bytes <= {limit} OR shard_rows = 1)
SELECT doc_id, n_bytes, substr(lpad(bin(bits), 60, '0'), 1, depth::INT) AS shard, 0::BIGINT AS part, depth::BIGINT AS depth,
       shard_bytes::BIGINT AS shard_bytes, shard_rows::BIGINT AS shard_rows
FROM leaf WHERE n = 1
"""
