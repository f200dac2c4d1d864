"""Event-time windows and de-duplication over a stream of files, drained with availableNow.

State is bounded by the watermark.  Results go to Parquet in the folder that spark.checkpoint.dir names, one part
per batch; a batch that is run again overwrites its part, so a restarted stream counts nothing twice.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELAY = "10 days"


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or tempfile.mkdtemp(prefix='scoutline-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream with the event time ``at`` and its watermark."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    files = f"{folder}/[{name[0]}]{name[1:]}"  # a pattern: a stream refuses the plain path of one file
    return spark.readStream.schema(schema).parquet(files).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", DELAY)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream emits up to its present end, with the number of the batch."""
    spark = stream.sparkSession
    folder = _folder(spark)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def window_counts(spark: SparkSession, path: str, window: Column, key: str = "event_type") -> DataFrame:
    """Counts per window and key, in update mode: the last state of each window is its count."""
    counted = events(spark, path).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
    return drained(counted, "update").groupBy("start", key).agg(F.max_by("n", "batch").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), key, "n")


def tumbling(spark: SparkSession, path: str, width: str = "1 day", key: str = "event_type") -> DataFrame:
    return window_counts(spark, path, F.window("at", width), key)


def sliding(spark: SparkSession, path: str, width: str = "2 days", step: str = "1 day", key: str = "event_type") -> DataFrame:
    return window_counts(spark, path, F.window("at", width, step), key)


def new_keys(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Keys when they are first seen within the watermark (a content hash that is known already is skipped)."""
    fresh = events(spark, path).dropDuplicatesWithinWatermark(list(keys)).select(*keys)
    return drained(fresh, "append").select(*keys).distinct()
