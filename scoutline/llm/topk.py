"""Exact top-k search by inner product over vectors in descending length.

Vectors become whole numbers and are cut into blocks of equal size by length, the longest first.  Queries, packed by a few, meet
the blocks in waves, each of many times the blocks of the one before; what a wave finds raises the k-th best score of each query,
so the next one needs only blocks whose longest vector can still reach it.  Inside a block the order is by length too: a query
stops at the first tile that Cauchy-Schwarz rules out, and the rest is summed over the leading axes of a rotation (from the
singular vectors of the whole table) first, the remainder being bounded by the product of the residual lengths.  The scores
themselves are exact whole numbers; rotated sums only prune, with room for their rounding.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; shorter
vectors count as padded with zeros, and an empty one scores 0.  Rows of one id are not candidates of one another; a repeated row
is a query and a candidate as often as it stands there.  Components beyond 2^25 in size count as that, so scores of up to 4,096
components fit a long.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutline.llm.common import forget, written

#: Vectors in a block and in a pack, blocks of a wave for each one before it, candidates in a tile, queries that a block meets at once.
BLOCK, PACK, WAVE, TILE, QUERIES = 16384, 32, 16, 2048, 512
#: Bound of a component, relative room for rounding of rotated sums.
MOST, ROOM = 1 << 25, 1e-9
NEVER = np.iinfo(np.int64).min


def _whole(scale: float):
    """(id, query, x, dim, n2) of the vectors that take part; x: little-endian 32-bit numbers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, query, lists = (batch.column(i) for i in range(3))
            lists = lists.cast(pa.large_list(pa.float64()))
            offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            good = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~lists.is_null().to_numpy(zero_copy_only=False) & ~ids.is_null().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(np.where(np.isfinite(values), values, 0) * scale), -MOST, MOST).astype("<i4")
            rows = np.flatnonzero(good)
            parts = [x[offsets[i] : offsets[i + 1]] for i in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows)).cast(pa.int64()),
                    query.take(pa.array(rows)).fill_null(False),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                    pa.array([len(p) for p in parts], pa.int32()),
                    pa.array([int((p.astype(np.int64) ** 2).sum()) for p in parts], pa.int64()),
                ],
                ["id", "query", "x", "dim", "n2"],
            )

    return convert


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of 32-bit numbers, padded with zeros."""
    out = np.zeros((len(column), dim), "<i4")
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x) // 4] = np.frombuffer(x, "<i4")
    return out


def _gram(dim: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "value"])

    return add


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the table, the largest first, from sums of products that Spark adds up (dim * dim cells)."""
    if not dim:
        return np.zeros((0, 0))
    cells = vectors.select("x").mapInArrow(_gram(dim), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    gram = np.zeros(dim * dim)
    gram[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return np.linalg.eigh(gram.reshape(dim, dim))[1][:, ::-1].copy()


def _packed(dim: int):
    """Packs of a block, longest vectors first: of all its vectors, and of its queries."""

    def pack(table: pa.Table) -> pa.Table:
        ids, n2 = table["id"].to_numpy(), table["n2"].to_numpy()
        order = np.lexsort((ids, -n2))
        x, block = _matrix(table["x"].combine_chunks(), dim)[order], table["block"][0].as_py()
        ids, n2, asked = ids[order], n2[order], table["query"].to_numpy()[order]
        out = []
        for query, rows in ((False, np.arange(len(ids))), (True, np.flatnonzero(asked))):
            for n, i in enumerate(range(0, len(rows), PACK)):
                r = rows[i : i + PACK]
                out.append({"block": block, "query": query, "pack": n, "ids": ids[r].astype("<i8").tobytes(), "x": x[r].tobytes(), "n2": int(n2[r[0]])})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int32()), ("query", pa.bool_()), ("pack", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("n2", pa.int64())]))

    return pack


def blocks(vectors: DataFrame, dim: int, size: int) -> tuple[DataFrame, np.ndarray]:
    """(packs, lengths): vectors in blocks of about ``size``, block 0 the longest, and each block's longest length.

    Borders are quantiles of the squared length plus a fraction from a hash, so that equal lengths are cut as well.
    """
    n = vectors.count()
    parts = max(1, -(-n // size))
    key = F.col("n2").cast("double") + F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 20)) / float(1 << 20)
    vectors = vectors.withColumn("key", key)
    borders = np.zeros(0)
    if parts > 1:
        shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
        borders = np.unique(vectors.agg(F.percentile_approx("key", shares, F.lit(max(10_000, 4 * parts)))).first()[0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = len(borders) - np.searchsorted(borders, batch.column("key").to_numpy(), "left")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "query", "x", "n2")), pa.array(block.astype(np.int32))], ["id", "query", "x", "n2", "block"])

    placed = vectors.select("id", "query", "x", "n2", "key").mapInArrow(place, "id long, query boolean, x binary, n2 long, block int")
    packs = written(placed.groupBy("block").applyInArrow(_packed(dim), "block int, query boolean, pack int, ids binary, x binary, n2 long"), "packs")
    longest = packs.where("not query").groupBy("block").agg(F.max("n2").alias("n2")).toArrow()
    lengths = np.zeros(len(borders) + 1)
    lengths[longest["block"].to_numpy()] = np.sqrt(longest["n2"].to_numpy().astype(np.float64))
    return packs, np.maximum.accumulate(lengths[::-1])[::-1]


def _reach(dim: int, k: int, lengths: np.ndarray, first: int, stop: int):
    """Packs of queries with each lane's k-th best (score, id), and one row for every block of the wave that one of its lanes needs."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("block", "q", "ids", "x", "score", "last")}
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], "<i4").reshape(-1, dim) if dim else np.zeros((len(row["ids"]) // 8, 0), np.int32)
                score, last = np.full(len(x), NEVER), np.zeros(len(x), np.int64)
                for t in row["tops"] or ():
                    score[t["lane"]], last[t["lane"]] = t["score"], t["vec"]
                norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where((score > 0) & (norms > 0), score * (1 - ROOM) / norms, -1.0)
                n = int(np.searchsorted(-lengths, -need.min(), "right")) if len(x) else 0
                for b in range(first, min(stop, n)):
                    for c, v in (("block", b), ("q", row["q"]), ("ids", row["ids"]), ("x", row["x"]), ("score", score.astype("<i8").tobytes()), ("last", last.astype("<i8").tobytes())):
                        out[c].append(v)
                if len(out["q"]) >= 1000:
                    yield _exploded(out)
                    out = {c: [] for c in out}
            yield _exploded(out)

    return explode


_PAIRED = pa.schema([("block", pa.int32()), ("q", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("score", pa.binary()), ("last", pa.binary())])


def _exploded(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, _PAIRED)


class Block:
    """One block in memory, with rotated coordinates and the lengths that remain behind each checkpoint."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, axes: np.ndarray, k: int) -> None:
        self.x, self.ids, self.axes, self.k = x, ids, axes, k
        self.turned = x.astype(np.float64) @ axes
        dim = x.shape[1]
        self.stops = sorted({0, max(1, dim // 4), max(1, dim // 2), dim}) if dim else [0]
        self.norms, self.rest = self.lengths(x.astype(np.float64), self.turned)
        self.most = float(np.abs(x).max(initial=0))

    def lengths(self, x: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.sqrt((x**2).sum(1)), [np.sqrt((turned[:, s:] ** 2).sum(1)) for s in self.stops]

    def search(self, q: np.ndarray, own: np.ndarray, score: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, score, id): what is among the k best so far of each query, better than its (score, last) or equal to it."""
        turned = q.astype(np.float64) @ self.axes
        norms, rest = self.lengths(q.astype(np.float64), turned)
        exact = self.most * float(np.abs(q).max(initial=0)) * max(1, q.shape[1]) < 2**53
        score, last = score.copy(), last.copy()
        found = (np.zeros(0, np.int64),) * 3
        for start in range(0, len(self.ids), TILE):
            tile = slice(start, start + TILE)
            live = np.flatnonzero(norms * self.norms[start] * (1 + ROOM) >= score)
            if not len(live):  # every later vector is shorter
                break
            rows, cols = self.survivors(turned[live], own[live], norms[live], [r[live] for r in rest], tile, score[live])
            rows, cols = live[rows], cols + start
            keep = self.ids[cols] != own[rows]
            rows, cols = rows[keep], cols[keep]
            value = self.products(q, rows, cols, exact)
            keep = (value > score[rows]) | (value == score[rows]) & (self.ids[cols] <= last[rows])
            new = (rows[keep], value[keep], self.ids[cols[keep]])
            found = self.best(*(np.concatenate(x) for x in zip(found, new)))
            ends = np.flatnonzero(np.diff(found[0], append=-1))
            full = ends[np.diff(ends, prepend=-1) >= self.k]  # a query's last row is its k-th best
            better = full[found[1][full] > score[found[0][full]]]
            score[found[0][better]], last[found[0][better]] = found[1][better], found[2][better]
            same = full[found[1][full] == score[found[0][full]]]
            last[found[0][same]] = np.minimum(last[found[0][same]], found[2][same])
        return found

    def best(self, rows: np.ndarray, value: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -value, rows))
        rows, value, ids = rows[order], value[order], ids[order]
        first = np.searchsorted(rows, rows, "left")
        keep = np.arange(len(rows)) - first < self.k
        return rows[keep], value[keep], ids[keep]

    def survivors(self, q: np.ndarray, own: np.ndarray, norms: np.ndarray, rest: list[np.ndarray], tile: slice, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, column of the tile) that no checkpoint rules out; sums grow by the axes between two checkpoints."""
        x, room = self.turned[tile], ROOM * norms[:, None] * self.norms[tile][None, :]
        total, rows, cols = np.zeros((len(q), len(x))), None, None
        for i, (a, b) in enumerate(zip(self.stops[:-1], self.stops[1:]), 1):
            if rows is None:
                total += q[:, a:b] @ x[:, a:b].T
                alive = total + rest[i][:, None] * self.rest[i][tile][None, :] + room >= score[:, None]
                if alive.mean() < 0.05:
                    rows, cols = np.nonzero(alive)
                    part = total[rows, cols]
            else:
                part = part + np.einsum("ij,ij->i", q[rows, a:b], x[cols, a:b])
                alive = part + rest[i][rows] * self.rest[i][tile][cols] + room[rows, cols] >= score[rows]
                rows, cols, part = rows[alive], cols[alive], part[alive]
        if rows is not None:
            return rows, cols
        if len(self.stops) == 1:
            return np.nonzero(total + room >= score[:, None])
        # Nearly all pairs live on, as before the first bound is known: only each query's k best of the tile matter, and their ties.
        alive &= self.ids[tile][None, :] != own[:, None]
        if len(x) > self.k:
            total[~alive] = -np.inf
            kth = np.partition(total, -self.k, axis=1)[:, -self.k]
            alive &= total >= (kth - 2 * room[:, 0])[:, None]
        return np.nonzero(alive)

    def products(self, q: np.ndarray, rows: np.ndarray, cols: np.ndarray, exact: bool) -> np.ndarray:
        """Exact scores of pairs; 64-bit floats hold them where no sum can reach 2^53."""
        out = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), 1 << 16):
            r, c = rows[i : i + (1 << 16)], cols[i : i + (1 << 16)]
            if exact:
                out[i : i + len(r)] = np.einsum("ij,ij->i", q[r].astype(np.float64), self.x[c].astype(np.float64)).astype(np.int64)
            else:
                out[i : i + len(r)] = (q[r].astype(np.int64) * self.x[c].astype(np.int64)).sum(1)
        return out


def _met(dim: int, k: int, axes: np.ndarray):
    """Blocks, each followed by the packs of queries that need it, as a stream: only one block and a few packs are held."""

    def numbers(column: pa.Array, kind: str, shape: tuple = (-1,)) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(shape)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            keys = batch.column("block").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            for i, j in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])))):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if keys[i] // 2 != at:
                    at, held, block = keys[i] // 2, [], None
                if not keys[i] % 2:
                    held.append((numbers(part.column("ids"), "<i8"), numbers(part.column("x"), "<i4")))
                    continue
                if block is None and not held:  # no vector lies between two borders
                    continue
                if block is None:
                    ids = np.concatenate([h[0] for h in held])
                    block, held = Block(np.concatenate([h[1] for h in held]).reshape(len(ids), dim), ids, axes, k), []
                for p in range(0, len(part), max(1, QUERIES // PACK)):
                    some = part.slice(p, max(1, QUERIES // PACK))
                    lanes = [len(x) // 8 for x in some.column("ids").to_pylist()]
                    q = np.repeat(some.column("q").to_numpy() * PACK, lanes) + np.concatenate([np.arange(n) for n in lanes])
                    own = numbers(some.column("ids"), "<i8")
                    rows, value, ids = block.search(numbers(some.column("x"), "<i4").reshape(len(own), dim), own, numbers(some.column("score"), "<i8"), numbers(some.column("last"), "<i8"))
                    yield pa.RecordBatch.from_arrays([pa.array(q[rows]), pa.array(own[rows]), pa.array(value), pa.array(ids)], ["q", "query_id", "score", "vec_id"])

    return meet


def top_k(vectors: DataFrame, query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every row for which ``query`` holds, with all other rows.

    Scores are of floor(scale * component); ties go to the smaller id.
    """
    whole = vectors.select(F.col(id).alias("id"), query.alias("query"), F.col(vector).cast("array<double>").alias("v"))
    table = written(whole.mapInArrow(_whole(scale), "id long, query boolean, x binary, dim int, n2 long"), "vectors")
    dim = table.agg(F.max("dim")).first()[0] or 0
    axes = rotation(table, dim)
    packs, lengths = blocks(table, dim, block)
    asking = packs.where("query").select((F.shiftleft(F.col("block").cast("long"), 24) + F.col("pack")).alias("q"), "ids", "x")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    tops, first, stop = None, 0, 1
    while first < len(lengths):
        stop = min(stop, len(lengths))
        asks = asking.withColumn("tops", F.lit(None).cast("array<struct<lane:int,score:long,vec:long>>"))
        if tops is not None:
            bounds = tops.where(F.col("rank") == k).groupBy((F.col("q") / PACK).cast("long").alias("q"))
            asks = asking.join(bounds.agg(F.collect_list(F.struct(F.pmod("q", F.lit(PACK)).cast("int").alias("lane"), "score", F.col("vec_id").alias("vec"))).alias("tops")), "q", "left")
        asks = asks.select("q", "ids", "x", "tops").mapInArrow(_reach(dim, k, lengths, first, stop), "block int, q long, ids binary, x binary, score binary, last binary").withColumn("asks", F.lit(True))
        void = F.lit(None).cast("binary")
        here = packs.where(~F.col("query") & F.col("block").between(first, stop - 1)).select("block", F.col("pack").cast("long").alias("q"), "ids", "x", void.alias("score"), void.alias("last"), F.lit(False).alias("asks"))
        met = here.unionByName(asks).repartition("block").sortWithinPartitions("block", "asks", "q")
        found = met.mapInArrow(_met(dim, k, axes), "q long, query_id long, score long, vec_id long")
        if tops is not None:
            found = found.unionByName(tops.select(found.columns))
        now = written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "tops")
        if tops is not None:
            forget(tops)
        tops, first, stop = now, stop, stop * WAVE + 1
    forget(table)
    forget(packs)
    return tops.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
