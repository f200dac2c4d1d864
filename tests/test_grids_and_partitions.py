"""Ranges that rewrite a grid, lines that moved, tables kept by partition, blocks of equally many rows."""

import os
import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from scoutline.functions.frames import blocked
from scoutline.operators import generations, grids, history, lifecycle, partitions, relations

COLUMNS = ["a", "b", "c", "d"]
GRID = "tab string, number long, a string, b string, c string, d string"


def a_grid(rng, lines):
    return {(tab, n): [rng.choice(["", "x", "y", None]) for _ in COLUMNS] for tab in "pq" for n in rng.sample(range(2, 40), lines)}


@pytest.mark.parametrize("tight", [False, True])
def test_ranges_turn_the_old_grid_into_the_new_one(spark, tight):
    rng = random.Random(7)
    before = a_grid(rng, 30)
    after = {k: (v if rng.random() < 0.6 else [rng.choice(["", "x", "z"]) for _ in COLUMNS]) for k, v in before.items() if rng.random() < 0.8} | a_grid(rng, 4)
    frame = lambda g: spark.createDataFrame([(*k, *v) for k, v in g.items()], GRID)
    changed = grids.changed_rows(frame(before), frame(after), ["tab"], COLUMNS, ["b", "c"])
    found = grids.write_ranges(changed, ["tab"], COLUMNS, ["b", "c"], tight).collect()
    new = {(r.tab, r.number): [r[c] for c in COLUMNS] for r in changed.collect()}
    grid = {k: [x or "" for x in v] for k, v in before.items()}
    lines = set()
    for r in found:
        lo, hi = ord(r.first_column) - 65, ord(r.last_column) - 65
        assert (lo, hi, r.option) in {(0, 0, "raw"), (1, 2, "entered"), (3, 3, "raw")}
        for n in range(r["first"], r["last"] + 1):
            grid.setdefault((r.tab, n), [""] * 4)[lo : hi + 1] = new[r.tab, n][lo : hi + 1]
            lines.add((r.tab, lo, n))
    blank = [""] * 4
    right = {k: [x or "" for x in v] for k, v in after.items()}
    assert all(grid.get(k, blank) == right.get(k, blank) for k in {*grid, *right})
    # Nothing is written without need, and no two ranges could be one.
    old = {k: [x or "" for x in v] for k, v in before.items()}
    differ = lambda k, lo, hi: old.get(k, blank)[lo:hi] != right.get(k, blank)[lo:hi]
    for tab, lo, n in lines:
        assert differ((tab, n), lo, {0: 1, 1: 3, 3: 4}[lo]) if tight else differ((tab, n), 0, 4)
    assert all((r.tab, ord(r.first_column) - 65, r["last"] + 1) not in lines for r in found)
    again = grids.changed_rows(frame(after), frame(after), ["tab"], COLUMNS)
    assert again.count() == 0 and grids.changed_rows(frame(after), frame(after), ["tab"], COLUMNS, force=True).count() == len(after)


def test_names_and_runs_of_columns():
    assert [grids.letters(i) for i in (0, 25, 26, 27, 51, 52, 701, 702)] == ["A", "Z", "AA", "AB", "AZ", "BA", "ZZ", "AAA"]
    assert grids.column_runs(COLUMNS, ["b", "c"]) == [("raw", 0, 0), ("entered", 1, 2), ("raw", 3, 3)]
    assert grids.column_runs([]) == []


def longest_rising(xs):
    tails = []
    for x in xs:
        tails[bisect_left(tails, x) : bisect_left(tails, x) + 1] = [x]
    return len(tails)


@pytest.mark.parametrize("seed", range(3))
def test_as_few_lines_move_as_possible(spark, seed):
    rng = random.Random(seed)
    before, after = {}, {}
    for tab in "pqr":
        order = list(range(60))
        before[tab] = order[:]
        if tab == "q":  # whole blocks change places
            order = order[20:35] + order[:20] + order[35:]
        for _ in range({"p": 4, "q": 2, "r": 200}[tab]):
            order.insert(rng.randrange(len(order)), order.pop(rng.randrange(len(order))))
        after[tab] = [x for x in order if rng.random() < 0.9] + [100, 101]
    frame = lambda g: spark.createDataFrame([(t, k, 3 * i + 2) for t, ks in g.items() for i, k in enumerate(ks)], "tab string, id long, number long")
    got = {(r.tab, r.id): r.change for r in grids.moves(frame(before), frame(after), "tab", "id").collect()}
    for tab in before:
        held = [k for k in after[tab] if k in set(before[tab])]
        stay = [k for k in held if got[tab, k] == "stay"]
        assert stay == sorted(stay) and len(stay) == longest_rising(held)
        assert {k for t, k in got if t == tab and got[t, k] == "delete"} == set(before[tab]) - set(after[tab])
        assert {k for t, k in got if t == tab and got[t, k] == "insert"} == {100, 101}
        assert all(got[tab, k] in ("stay", "move") for k in held)
    assert grids.moves(frame(before).limit(0), frame(before).limit(0), "tab", "id").count() == 0


def test_sorted_tabs_are_told(spark):
    state = spark.createDataFrame([("p", 2, "a"), ("p", 3, "b"), ("q", 2, "a"), ("q", 3, "b"), ("r", 2, "a")], "tab string, number long, id string")
    seen = spark.createDataFrame([("p", 2, " a "), ("p", 3, "b"), ("p", 4, "new"), ("q", 2, "b"), ("q", 3, "a")], state.schema)
    assert {r.tab for r in grids.resorted(state, seen, ["tab"], "id").collect()} == {"q", "r"}


# --- tables kept by partition ---------------------------------------------------------------------------

ROWS = "id long, day string, seen long, value double"


def a_table(spark, path):
    return partitions.Partitions(spark, str(path), ROWS, "day", ["id", "day"], ["seen"])


def content(table):
    return sorted(map(tuple, table.table().collect()), key=str)


def files(table):
    return {n: sorted((f, os.stat(f"{p}/{f}").st_mtime_ns) for f in os.listdir(p)) for n, p in table.manifest().items()}


def test_any_order_and_overlap_gives_one_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(12)]), rng.choice(["m", "t/u", None]), rng.randrange(4), rng.choice([None, 1.0, 2.0])) for _ in range(60)]
    right = None
    for run in range(3):
        table = a_table(spark, tmp_path / str(run))
        rng.shuffle(rows)
        for lo in range(0, 60, 25):  # slices overlap by five rows
            table.upsert(spark.createDataFrame(rows[lo : lo + 30], ROWS))
        got = content(table)
        right = right or got
        assert got == right and len({r[:2] for r in got}) == len(got) == len({r[:2] for r in rows})
        assert all(r[2] == max(x[2] for x in rows if x[:2] == r[:2]) for r in got)
    assert table.upsert(spark.createDataFrame(rows, ROWS)) == [] and table.upsert(spark.createDataFrame([], ROWS)) == []


def test_other_partitions_keep_their_files(spark, tmp_path):
    table = a_table(spark, tmp_path / "t")
    table.upsert(spark.createDataFrame([(1, "m", 1, 1.0), (2, "t", 1, 1.0), (3, "w", 5, 1.0)], ROWS))
    before = files(table)
    # A late row of one day; a known row and an older one of other days.
    assert table.upsert(spark.createDataFrame([(9, "t", 1, 1.0), (1, "m", 1, 1.0), (3, "w", 4, 7.0)], ROWS)) == ["_part=t"]
    now = files(table)
    assert [n for n in now if now[n] != before[n]] == ["_part=t"] and len(content(table)) == 4
    assert table.forget(keep=1) == 1 and files(table) == now


def test_a_writer_that_dies_leaves_the_table_before(spark, tmp_path, monkeypatch):
    table = a_table(spark, tmp_path / "t")
    table.upsert(spark.createDataFrame([(1, "m", 1, 1.0)], ROWS))
    late = spark.createDataFrame([(1, "m", 2, 2.0), (2, "t", 1, 1.0)], ROWS)
    monkeypatch.setattr(partitions.Partitions, "publish", lambda *_: (_ for _ in ()).throw(InterruptedError))
    with pytest.raises(InterruptedError):
        table.upsert(late)
    monkeypatch.undo()
    assert content(a_table(spark, tmp_path / "t")) == [(1, "m", 1, 1.0)]
    assert table.upsert(late) == ["_part=m", "_part=t"] and content(table) == [(1, "m", 2, 2.0), (2, "t", 1, 1.0)]
    with pytest.raises(generations.Conflict):
        table.publish(table.manifest(), 1)


def test_a_stream_with_late_files_equals_one_pass(spark, tmp_path):
    source, table = tmp_path / "source", a_table(spark, tmp_path / "t")
    rows = [(i % 7, "mtw"[i % 3], i, float(i)) for i in range(30)]
    for n, part in enumerate((rows[10:], rows[:15], rows[5:25])):  # the oldest come late, files overlap
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(source))
        got = partitions.swept(spark.readStream.schema(ROWS).parquet(str(source)), table, str(tmp_path / "state"))
    newest = {}
    for r in rows:
        newest[r[:2]] = max(r, newest.get(r[:2], r), key=lambda x: x[2])
    assert n == 2 and sorted(map(tuple, got.collect())) == sorted(newest.values())


# --- blocks ---------------------------------------------------------------------------------------------


def test_outliers_and_gaps_fill_no_block(spark):
    xs = [float(x) for x in range(1000)] + [1e15, -1e15, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(3)
    rows = blocked(df, "x", 64).collect()
    sizes, order = {}, sorted((r.x, r._block) for r in rows if r.x is not None and r.x == r.x)
    for r in rows:
        sizes[r._block] = sizes.get(r._block, 0) + 1
    assert len(sizes) > 55 and max(sizes.values()) < 40
    assert [b for _, b in order] == sorted(b for _, b in order)
    assert {r._block for r in blocked(df.limit(0), "x", 64).collect()} == set() and blocked(df, "x", 1).select("_block").distinct().count() == 1


def test_running_totals_of_skewed_ids_and_medians_with_outliers(spark):
    ids = [2**k for k in range(40)] + list(range(10**12, 10**12 + 300))
    df = spark.createDataFrame([("k" if i % 5 else "l", i, i % 7) for i in ids], "k string, id long, cost long")
    got = {(r.k, r.id): r.spent for r in history.running(df, ["k"], "id", "cost", 16).collect()}
    for key in "kl":
        total = 0
        for i in sorted(i for i in set(ids) if ("k" if i % 5 else "l") == key):
            total += i % 7
            assert got[key, i] == total
    spread = spark.createDataFrame([("a", float(x)) for x in range(101)] + [("a", 1e15)], "k string, v double")
    assert relations.exact_median(spread, "k", "v").first().median == 50.5


def test_null_keys_are_upserted_once(spark):
    new = spark.createDataFrame([(None, 2.0), (1, 3.0)], "id long, fit double")
    old = spark.createDataFrame([(None, 1.0), (5, 5.0)], new.schema)
    once = lifecycle.upsert(old, new, ["id"])
    assert sorted(map(tuple, lifecycle.upsert(once, new, ["id"]).collect()), key=str) == [(1, 3.0), (5, 5.0), (None, 2.0)]
