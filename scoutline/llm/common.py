"""Helpers that several operators share: words, intermediate tables, fixed patterns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word rule of every operator here has it.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text: maximal runs of anything but ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words without building them: white space runs of the trimmed text plus one."""
    return F.size(words(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master may go without it; it then gets a folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scoutline-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of an intermediate table that nothing reads any more."""
    spark, paths = df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


#: Keys that hold more than this share of the rows are heavy, so there are at most HEAVY of them.
HEAVY = 1000


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, rows: str = "n_rows", how: str = "inner") -> DataFrame:
    """Join where a key may hold a large share of ``big``, without one task getting such a key whole.

    small: one row per key, with ``rows`` (how many rows of ``big`` the key has, dropped from the result).  A key of more
    than 1/HEAVY of the rows gets a salt for each such share: at most HEAVY keys, so they may be broadcast, and at most
    2 * HEAVY salted rows.  spread: a column of ``big`` that tells the key's rows apart.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    limit = max(1, total // HEAVY)
    heavy = F.broadcast(small.where(F.col(rows) > limit).select(*keys, F.ceil(F.col(rows) / limit).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts.cast("long")).cast("int")).drop("_salts")
    right = small.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts", rows)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


# --- words as 64-bit hashes, for a whole Arrow string column at once -----------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random odd 64-bit number for each byte, and the base of the rolling hash with its inverse.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHasher:
    """Hashes every word of a byte buffer with a prefix sum, so that no word becomes a Python object."""

    def __init__(self) -> None:
        self._up = np.ones(1, np.uint64)
        self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            n = max(n, 1 << 20)
            self._up, self._down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (_BASE, _BASE_INVERSE))
        return self._up, self._down

    def __call__(self, data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word in lower case (A-Z only), and the number of words before each text (texts + 1 entries).

        data: bytes of all texts; offsets: where each text starts, and the end; letters: words are runs of
        ASCII letters, digits and other alphabets, instead of anything but white space.
        """
        base, data = offsets[0], data[offsets[0] : offsets[-1]]
        offsets = offsets - base
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        if letters:
            inside = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
        else:
            inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = edges[edges > 0] - 1
        last[ends] = inside[ends]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = self._powers(len(data) + 1)
        prefix = np.empty(len(data) + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
        hashes = _mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))
        return hashes, np.searchsorted(start, offsets)


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, most: int):
    """Cut rows into runs of about ``most`` bytes each (a longer text makes a run of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hash(word: str) -> int:
    """Hash of one word as WordHasher gives it."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(WordHasher()(data, np.array([0, len(data)]))[0][0])
