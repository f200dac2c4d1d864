"""Helpers for long chains of derived columns."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, *columns: str) -> DataFrame:
    """The frame with these columns behind a generator of one row.

    The optimiser copies no expression through it, neither into later ones nor into filters that it moves or infers.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.expr(f"inline(array(struct({', '.join(columns)})))"))


def settled(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut, in the folder that spark.checkpoint.dir names; only a local master may go without one."""
    sc = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scoutline-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the folder of ``settled`` and read back: its work is done once, where a checkpoint does it twice."""
    spark = df.sparkSession
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scoutline-"))
        place = sc.getCheckpointDir()
    path = f"{place.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocked(df: DataFrame, by: str, blocks: int) -> DataFrame:
    """Append ``_block``: which of about ``blocks`` pieces of equally many rows, in the order of a numeric column.

    Pieces end at approximate quantiles, so neither outliers nor gaps fill one of them; equal values share one, nulls are in the first.
    """
    shares = ", ".join(f"{i / blocks:.9f}D" for i in range(1, blocks))
    kind = "long" if dict(df.dtypes)[by] in ("bigint", "int", "smallint", "tinyint") else "double"
    found = df.agg(F.expr(f"percentile_approx(cast(`{by}` as {kind}), array({shares}), {10 * blocks})")).first()[0] if shares else None
    splits = sorted({s for s in found or [] if math.isfinite(s)})
    if not splits:
        return df.withColumn("_block", F.lit(0))
    # Two steps of the root of their number instead of one pass over all splits.
    step = math.isqrt(len(splits)) + 1
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    below = lambda xs: F.size(F.filter(xs, lambda s: s <= F.col(by).cast(kind)))
    table = lambda x, shape: F.from_json(F.lit(json.dumps(x)), shape)
    first = below(table([g[0] for g in groups], f"array<{kind}>"))
    inside = below(F.get(table(groups, f"array<array<{kind}>>"), first - 1))
    return df.withColumn("_block", F.when(first > 0, (first - 1) * step + inside).otherwise(0))
