"""Structure of conversations: faults, and the cheapest edits that give a legal order of roles.

A conversation's roles must read ``(system? (user assistant)+)?``.  Edits of a row, in order: Keep (0, or 1 for a truncated row), Rerole
to user or assistant (2, or 3), Delete (3, the only one for a blank or repeated row); Insert of an empty row costs 2.  The state
between two rows is one of four: nothing yet, after system, after user, after assistant.  An edit and a state give the next state, so
the edits' letters name one path of a graph without cycles.  Each weight is one whole number: the high digits are the cost, the low
ones the letters of what follows, one octal digit each, left-aligned in a fixed width and padded with zeros behind; the least of such
numbers, taken from the last row to the first, is the cheapest repair and, among equal ones, the one whose letters come first in ASCII.
Two Inserts in a row, but at the end, are never cheapest, so the graph has one before each row.

A long conversation is cut into segments by its order.  A segment, whose letters begin with Inserts before its first row and end with
its last row's edit, is a table of weights from state to state.  No string of a segment is the start of another that ends in a different
state, so of each table only the costs and the order of the strings are needed to find the states between segments; they are joined per
partition and then per conversation, and the segments are solved with their states given.  No task holds a whole conversation.

Defined results: null conversations, turns, roles and texts count as one space (null turns come first, and null conversations are one
group); a turn's rows are taken by role and text; extra columns are not read; a conversation whose rows are all gone has zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import salted_join, written

#: Rows and characters of a segment.
SEGMENT_ROWS, SEGMENT_CHARS = 256, 1 << 20
#: Octal digits of the edits' letters, in ASCII order; 0 pads.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in DIGIT.items()}
#: States: nothing yet, after system, after user, after assistant.  What follows an inserted or reroled row, and its role.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Inserts that a state still needs at the end.
ENDING = {0: "", 3: "", 2: "I", 1: "II"}
FAR = 1 << 40
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that crc32 of ``conv_id:turn`` calls for: (conv_id, key, turn, role, text)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", space("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("fault <> 0").select("conv_id", "key", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows (key, turn, role, text) with ``row`` (a number of their own) and ``fault``: blank, duplicate, truncated or ''.

    The first row of a role and text is found by an aggregate, and rows of a text that is very common are spread.
    """
    marked = written(rows.select("key", "turn", "role", "text", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("same"), F.monotonically_increasing_id().alias("row")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), F.col("row").alias("row"))
    first = marked.groupBy("key", "same").agg(F.min(place).getField("row").alias("first"), F.count(F.lit(1)).alias("n_rows"))
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    kind = F.when(body == "", "blank").when(F.col("row") != F.col("first"), "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return salted_join(marked, first, ["key", "same"], "row").select("key", "turn", "role", "text", "row", kind.alias("fault"))


# --- weights ---------------------------------------------------------------------------------------------


def solved(rows: list[tuple[str, str]], ends: dict[int, str], starts: tuple[int, ...] = (0, 1, 2, 3)) -> dict[int, tuple[int, str]]:
    """Of each first state the least (cost, letters) of rows (role's initial, fault) that ends in one of ``ends`` (state: letters to come)."""
    width = 2 * len(rows) + 2
    bits = 3 * width
    top, low = bits - 3, (1 << bits) - 1
    none = FAR << bits

    def then(cost: int, letter: str, weight: int) -> int:
        return ((weight >> bits) + cost << bits) | DIGIT[letter] << top | (weight & low) >> 3

    after = [none] * 4
    for state, letters in ends.items():
        weight = 0
        for x in reversed(letters):
            weight = then(2, x, weight)
        after[state] = weight
    for initial, fault in reversed(rows):
        edited = []
        for state in range(4):
            best = then(3, "D", after[state])
            if fault in ("", "truncated"):
                late = 1 if fault else 0
                kept = KEEP.get(initial, {}).get(state)
                if kept is not None:
                    best = min(best, then(late, "K", after[kept]))
                best = min(best, then(2 + late, "R", after[NEXT[state]]))
            edited.append(best)
        after = [min(edited[state], then(2, "I", edited[NEXT[state]])) for state in range(4)]
    out = {}
    for state in starts:
        cost, digits = after[state] >> bits, after[state] & low
        if cost < FAR:
            out[state] = cost, "".join(LETTER[x] for i in range(width) if (x := digits >> (top - 3 * i) & 7))
    return out


def table_of(rows: list[tuple[str, str]]) -> tuple[list[int], list[int]]:
    """(costs, orders) of a segment from each state to each, 16 entries; unreachable ones cost FAR."""
    costs, strings = [FAR] * 16, {}
    for end in range(4):
        for start, (cost, letters) in solved(rows, {end: ""}).items():
            costs[4 * start + end], strings[4 * start + end] = cost, letters
    orders = [0] * 16
    for start in range(4):
        mine = sorted((strings[i], i) for i in range(4 * start, 4 * start + 4) if i in strings)
        for n, (_, i) in enumerate(mine):
            orders[i] = n
    return costs, orders


def _through(a: tuple, b: tuple, start: int, end: int) -> tuple[int, int, int, int]:
    """Least (cost, order in a, order in b, state between) from ``start`` through a and b to ``end``."""
    return min((a[0][4 * start + m] + b[0][4 * m + end], a[1][4 * start + m], b[1][4 * m + end], m) for m in range(4))


def composed(a: tuple, b: tuple) -> tuple[list[int], list[int]]:
    """The table of two tables in a row."""
    costs, orders = [FAR] * 16, [0] * 16
    for start in range(4):
        best = {end: _through(a, b, start, end) for end in range(4)}
        for n, end in enumerate(sorted((e for e in best if best[e][0] < FAR), key=lambda e: best[e][1:3])):
            costs[4 * start + end], orders[4 * start + end] = best[end][0], n
    return costs, orders


def routed(tables: list[tuple], start: int, end: int | None) -> list[tuple[int, int]]:
    """(first, last) state of each table on the best way; without ``end`` the state that is cheapest to end a conversation in."""
    rest = [tables[-1]]
    for t in reversed(tables[:-1]):
        rest.append(composed(t, rest[-1]))
    rest.reverse()
    if end is None:
        end = min(range(4), key=lambda e: (rest[0][0][4 * start + e] + 2 * len(ENDING[e]), rest[0][1][4 * start + e]))
    out = []
    for i, t in enumerate(tables):
        last = end if i + 1 == len(tables) else _through(t, rest[i + 1], start, end)[3]
        out.append((start, last))
        start = last
    return out


def applied(roles: list[str], texts: list[str], state: int, letters: str) -> list[dict]:
    """Rows that the edits leave, from a first state on."""
    out, i = [], 0
    for x in letters:
        if x in "IR":
            out.append({"role": ROLE[state], "text": texts[i] if x == "R" else ""})
            state = NEXT[state]
        elif x == "K":
            out.append({"role": roles[i], "text": texts[i]})
            state = KEEP[roles[i][:1]][state]
        i += x != "I"
    return out


# --- segments --------------------------------------------------------------------------------------------

#: What is known of a run of rows besides its table.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_FACTS = ", ".join(f"{c} long" for c in COUNTS) + ", low long, high long, first_turn long, last_turn long, first_role string, last_role string, costs array<long>, orders array<long>"
_ROWS = "repaired array<struct<role:string,text:string>>"
_SEGMENTS = f"key string, part int, seq int, whole boolean, {_FACTS}, cost long, audit string, {_ROWS}, roles array<string>, texts array<string>, kinds array<string>"


def _facts(rows: list[tuple]) -> dict:
    """rows: (turn, role, text, fault)."""
    initials, turns = [r[1][:1] for r in rows], [r[0] for r in rows if r[0] is not None]
    out = {c: sum(r[3] == c for r in rows) for c in COUNTS[:3]}
    out |= {"illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None)}
    return out | {"first_turn": rows[0][0], "last_turn": rows[-1][0], "first_role": initials[0], "last_role": initials[-1]}


def _added(a: dict, b: dict) -> dict:
    """Facts of two runs in a row."""
    out = {c: a[c] + b[c] for c in COUNTS} | {"first_turn": a["first_turn"], "last_turn": b["last_turn"], "first_role": a["first_role"], "last_role": b["last_role"]}
    out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    for c, f in (("low", min), ("high", max)):
        out[c] = f((x for x in (a[c], b[c]) if x is not None), default=None)
    return out | dict(zip(("costs", "orders"), composed((a["costs"], a["orders"]), (b["costs"], b["orders"]))))


def _segments(most_rows: int, most_chars: int):
    """Sorted rows as segments.  Conversations inside the partition that fit one segment are solved at once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_())] + [(c, pa.int64()) for c in (*COUNTS, "low", "high", "first_turn", "last_turn")] + [("first_role", pa.string()), ("last_role", pa.string()), ("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int64())), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))] + [(c, pa.list_(pa.string())) for c in ("roles", "texts", "kinds")])
        out, size, held, chars, at, seq, edge = [], 0, [], 0, None, 0, True

        def close(whole: bool) -> None:
            nonlocal held, chars, seq
            pairs = [(r[1][:1], r[3]) for r in held]
            row = {"key": at, "part": part, "seq": seq, "whole": whole} | _facts(held)
            if whole:
                row["cost"], row["audit"] = solved(pairs, ENDING, (0,))[0]
                row["repaired"] = applied([r[1] for r in held], [r[2] for r in held], 0, row["audit"])
            else:
                row["costs"], row["orders"] = table_of(pairs)
                row |= {"roles": [r[1] for r in held], "texts": [r[2] for r in held], "kinds": [r[3] for r in held]}
            out.append(row)
            held, chars, seq = [], 0, seq + 1

        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "turn", "role", "text", "fault"))):
                if key != at:
                    if held:
                        close(not seq and not edge)
                    edge = at is None  # the partition's first conversation may have begun in the one before
                    at, seq = key, 0
                elif len(held) == most_rows or chars > most_chars:
                    close(False)
                held.append(row)
                chars += len(row[2])
                size += len(row[2])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if held:
            close(False)  # it may go on in the next one
        yield pa.RecordBatch.from_pylist(out, schema)

    return cut


def _summed(table: pa.Table) -> pa.Table:
    """Segments or runs in order as one run."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    total = rows[0]
    for r in rows[1:]:
        total = total | _added(total, r)
    return pa.Table.from_pylist([total | {"seq": 0}], table.schema)


def _states(table: pa.Table) -> pa.Table:
    """First and last state of each run of a conversation, or of each segment of a run whose states are known."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    start, end = rows[0].get("start") or 0, rows[0].get("end")
    ways = routed([(r["costs"], r["orders"]) for r in rows], start, end)
    final = rows[0].get("final", True)
    made = [{"key": r["key"], "part": r["part"], "seq": r["seq"], "start": s, "end": e, "final": final and i + 1 == len(rows)} for i, (r, (s, e)) in enumerate(zip(rows, ways))]
    return pa.Table.from_pylist(made, pa.schema([("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("final", pa.bool_())]))


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their states, solved."""
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, letters = solved([(a[:1], b) for a, b in zip(r["roles"], r["kinds"])], {r["end"]: ""}, (r["start"],))[r["start"]]
            ending = ENDING[r["end"]] if r["final"] else ""
            rows = applied(r["roles"], r["texts"], r["start"], letters) + applied([], [], r["end"], ending)
            out.append({"key": r["key"], "part": r["part"], "seq": r["seq"], "cost": cost + 2 * len(ending), "audit": letters + ending, "repaired": rows})
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(pieces, facts) of rows (key, turn, role, text).

    pieces: key, part, seq, cost, audit (letters of the edits) and repaired (rows of role and text), in the order of part and seq.
    facts, one row of a key: n_blank, n_duplicate, n_truncated, illegal, gaps.
    """
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    segments = written(faults(rows).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(segment_rows, SEGMENT_CHARS), _SEGMENTS), "segments")
    light = segments.where("not whole").select("key", "part", "seq", *COUNTS, "low", "high", "first_turn", "last_turn", "first_role", "last_role", "costs", "orders")
    form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in light.schema)
    runs = written(light.groupBy("key", "part").applyInArrow(_summed, form), "runs")
    states = "key string, part int, seq int, start int, end int, final boolean"
    ways = runs.groupBy("key").applyInArrow(_states, states)
    inside = light.select("key", "part", "seq", "costs", "orders").join(ways.drop("seq"), ["key", "part"]).groupBy("key", "part").applyInArrow(_states, states)
    cut = segments.where("not whole").select("key", "part", "seq", "roles", "texts", "kinds").join(inside, ["key", "part", "seq"])
    done = segments.where("whole").select("key", "part", "seq", "cost", "audit", "repaired")
    pieces = done.unionByName(cut.mapInArrow(_finished, f"key string, part int, seq int, cost long, audit string, {_ROWS}"))
    whole = segments.where("whole").select("key", *COUNTS, "low", "high").unionByName(runs.groupBy("key").applyInArrow(_summed, form).select("key", *COUNTS, "low", "high"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return pieces, whole.select("key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (key, cost, audit, lines) as one row of a key; a conversation's lines pass through the hash piece by piece."""
    at, cost, audit, sha, some = None, 0, [], None, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([cost], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], ["key", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        for key, c, letters, lines in zip(*(batch.column(x).to_pylist() for x in ("key", "cost", "audit", "lines"))):
            if key != at:
                if at is not None:
                    yield row()
                at, cost, audit, sha, some = key, 0, [], hashlib.sha256(), False
            cost += c
            audit.append(letters)
            if lines is not None:
                sha.update((("\n" if some else "") + lines).encode())
                some = True
    if at is not None:
        yield row()


def digests(pieces: DataFrame) -> DataFrame:
    """(key, cost, audit, repaired_sha256): the letters in a row, and the hash of the lines ``role:text``.

    A hash over a whole text is sequential by nature: the pieces of a conversation pass one task as a stream.
    """
    lines = F.when(F.size("repaired") > 0, F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"))
    light = pieces.select("key", "part", "seq", "cost", "audit", lines.alias("lines")).repartition("key").sortWithinPartitions("key", "part", "seq")
    return light.mapInArrow(_digests, "key string, cost long, audit string, repaired_sha256 string")


def repaired(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row of each conv_id of ``conversations``: its facts after the damage, the cheapest repair and a hash of what it gives."""
    pieces, facts = repair(damaged(conversations), segment_rows)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    ids = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"))
    both = ids.join(facts, "key", "left").join(digests(pieces), "key", "left")
    return both.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
