"""Keyed state of one's own over a stream: a ledger that pays each content once, and alerts of keys that fall silent.

State lives in the state store under the key; timers in event time end it and speak without input.  Each batch overwrites its own
folder, so a stream that is stopped after any batch and started again gives the rows of one that ran through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LEDGER = "key string, at timestamp, cost double, paid boolean"
SILENCE = "key string, last timestamp, since timestamp, n long"


def _micros(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).value // 1_000)


def _timer(micros: int) -> int:
    """Timers are in milliseconds; none fires early."""
    return -(-micros // 1_000)


class Ledger(StatefulProcessor):
    """Rows (key, at, cost): the first of a key pays, the others are answered from it until ``keep`` microseconds after the payment."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paid = handle.getValueState("paid", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(rows).sort_values(["at", "cost"], kind="stable")
        last = self.paid.get()[0] if self.paid.exists() else None
        out = []
        for at, cost in zip(some["at"], some["cost"]):
            pays = last is None or _micros(at) >= last + self.keep
            if pays:
                last = _micros(at)
            out.append((key[0], at, float(cost) if pays else 0.0, pays))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.paid.update((last,))
        self.handle.registerTimer(_timer(last + self.keep))
        yield pd.DataFrame(out, columns=["key", "at", "cost", "paid"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.paid.exists() and _timer(self.paid.get()[0] + self.keep) <= expiredTimerInfo.getExpiryTimeInMs():
            self.paid.clear()
        return iter(())

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """Rows (key, at): one row whenever a key has no event for ``quiet`` microseconds, with the number of events before."""

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, n long, told boolean")

    def _row(self, key, last: int, n: int) -> tuple:
        return key[0], pd.Timestamp(last, unit="us"), pd.Timestamp(last + self.quiet, unit="us"), n

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, told = self.seen.get() if self.seen.exists() else (None, 0, False)
        out = []
        for at in sorted(map(_micros, pd.concat(rows)["at"])):
            if last is not None and at - last >= self.quiet and not told:
                out.append(self._row(key, last, n))
            if last is None or at > last:
                last, told = at, False
            n += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.seen.update((last, n, told))
        if not told:
            self.handle.registerTimer(_timer(last + self.quiet))
        yield pd.DataFrame(out, columns=["key", "last", "since", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, n, told = self.seen.get()
        if not told and _timer(last + self.quiet) <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.update((last, n, True))
            yield pd.DataFrame([self._row(key, last, n)], columns=["key", "last", "since", "n"])

    def close(self) -> None:
        pass


def files(spark: SparkSession, folder: str, schema: str, delay: str, per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream in their order, with a watermark on ``at``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder).withWatermark("at", delay)


def _stateful(stream: DataFrame, processor: StatefulProcessor, form: str) -> DataFrame:
    return stream.groupBy("key").transformWithStateInPandas(processor, form, "append", "eventTime")


def ledger(stream: DataFrame, content: str, cost: str, keep_days: float) -> DataFrame:
    """Every request of a stream (``at``, content, cost) with what it costs: equal contents pay once within the days that answers are kept."""
    rows = stream.select(F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256).alias("key"), "at", F.col(cost).cast("double").alias("cost"))
    return _stateful(rows, Ledger(int(keep_days * 86_400_000_000)), LEDGER)


def silences(stream: DataFrame, key: str, quiet_days: float) -> DataFrame:
    """A row of each key and silence of at least the days given, told when the watermark passes its end or the key speaks again."""
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "at")
    return _stateful(rows, Silence(int(quiet_days * 86_400_000_000)), SILENCE)


def run(stream: DataFrame, folder: str, batches: int | None = None) -> DataFrame:
    """Run a stream to its present end, or stop it after some batches; all rows that it has given so far, this run or before.

    folder: in a place that driver and executors share; the same one goes on where the last run stopped.
    """
    spark = stream.sparkSession
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        if batches is not None and len(done) == batches:
            raise InterruptedError
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        done.append(number)

    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    except Exception:
        if batches is None or len(done) < batches:
            raise
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)


# --- the same over a table ------------------------------------------------------------------------------


def silences_of(events: DataFrame, key: str, quiet_days: float, until: str | None = None) -> DataFrame:
    """``silences`` over a table of events, up to the watermark ``until``: by each event's next one, in a window of a key."""
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy("at")
    rows = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), "at")
    days = rows.groupBy("key", "at").agg(F.count(F.lit(1)).alias("m"))
    each = days.withColumns({"next": F.lead("at").over(order), "n": F.sum("m").over(order)})
    end = F.coalesce("next", F.lit(until).cast("timestamp")) if until else F.col("next")
    quiet = F.expr(f"INTERVAL {int(quiet_days * 86_400)} SECONDS")
    return each.where(end >= F.col("at") + quiet).select("key", F.col("at").alias("last"), (F.col("at") + quiet).alias("since"), "n")
