"""Streams with state of their own: ledger and silences, restarted after every batch, against the same over the table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scoutline.streaming import state

START = dt.datetime(2024, 1, 1)
day = lambda d: START + dt.timedelta(days=d)


def parts(spark, folder, rows, schema):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def brute_ledger(rows, keep):
    last, out = {}, []
    for at, content, cost in sorted(rows):
        pays = content not in last or at >= last[content] + dt.timedelta(days=keep)
        if pays:
            last[content] = at
        out.append((at, cost if pays else 0.0, pays))
    return sorted(out)


def test_ledger_pays_once_whenever_it_is_stopped(spark, tmp_path):
    schema = "at timestamp, text string, cost double"
    rows = [[(day(b * 2 + i / 10), f"t{(b * 7 + i * 3) % 11}", float(1 + (b * 7 + i * 3) % 11)) for i in range(12)] for b in range(5)]
    folder = parts(spark, tmp_path / "in", rows, schema)
    stream = lambda: state.ledger(state.files(spark, folder, schema, "1 hour"), "text", "cost", 3.0)
    right = brute_ledger([r for p in rows for r in p], 3.0)
    got = state.run(stream(), str(tmp_path / "a")).collect()
    assert sorted((r.at, r.cost, r.paid) for r in got) == right
    state.run(stream(), str(tmp_path / "b"), batches=2)
    again = state.run(stream(), str(tmp_path / "b")).collect()
    assert sorted((r.at, r.cost, r.paid) for r in again) == right


def test_silences_are_told_without_input_and_equal_the_table(spark, tmp_path):
    schema = "at timestamp, source string"
    rows = [
        [(day(0), "a"), (day(0), "b"), (day(1), "a"), (day(1), None)],
        [(day(2), "a"), (day(1.5), "b"), (day(9), "c")],  # b late but within the watermark
        [(day(10), "a"), (day(10.2), "c"), (day(10.2), "c")],
        [(day(20), "a"), (day(30), "c")],
    ]
    folder = parts(spark, tmp_path / "in", rows, schema)
    stream = lambda: state.silences(state.files(spark, folder, schema, "1 day"), "source", 4.0)
    flat = spark.createDataFrame([r for p in rows for r in p], schema)
    right = sorted(map(tuple, state.silences_of(flat, "source", 4.0, str(day(29))).collect()))
    assert sorted(map(tuple, state.run(stream(), str(tmp_path / "a")).collect())) == right and len(right) == 6
    state.run(stream(), str(tmp_path / "b"), batches=3)
    assert sorted(map(tuple, state.run(stream(), str(tmp_path / "b")).collect())) == right
