"""TIFF pages as rows: write 8-bit grey images, read any strip or tile layout back.

The reader walks the chain of image directories, decodes PackBits, LZW or deflate data of strips or
tiles, undoes the horizontal predictor and gives one entry (after ``explode``: one row) per page, with the
mean and the entropy (bits) of its decoded samples.

Edge cases: a null or empty payload becomes one page of padding; a payload larger than a page goes on in
further pages, with no limit on their number; a directory that is met twice ends with an error instead
of a loop; a null file has a null page list; extra columns are passed through, and an output column
that exists already raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: tag numbers, field types (bytes of each), compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: Pixels of an image row, and rows of a page at most: a page holds up to 288 KiB.
ROW, PAGE_ROWS, STRIP_ROWS = 576, 512, 64
PAD = 255
#: Bytes of texts or files that a task turns into the other at a time.
BLOCK_BYTES = 1_000_000
#: Width and height of a tile; every layout is a compression, a predictor and strips or tiles.
TILE = (192, 16)
LAYOUTS = tuple((c, p, t) for c in (LZW, PACKBITS, DEFLATE) for p in (1, 2) for t in (None, TILE))

PAGE = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("compression", T.IntegerType()),
        T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("samples", T.BinaryType()),
    ]
)


# --- compressions ---------------------------------------------------------------------------------


def packbits(block: np.ndarray) -> bytes:
    """Row by row: runs of three or more equal bytes become (257 - length, byte), the rest literal stretches."""
    a, width = block.ravel(), block.shape[1]
    rows = np.arange(0, len(a), width)
    cuts = np.union1d(np.flatnonzero(a[1:] != a[:-1]) + 1, np.append(rows, len(a)))
    long = np.flatnonzero(np.diff(cuts) >= 3)
    begins = np.zeros(len(a) + 1, bool)
    begins[cuts[long]] = True
    edges = np.unique(np.concatenate((rows, cuts[long], cuts[long + 1], [len(a)])))
    data, out = a.tobytes(), []
    for start, stop, run in zip(edges.tolist(), edges[1:].tolist(), begins[edges].tolist()):
        for i in range(start, stop, 128):
            n = min(128, stop - i)
            out.append(bytes((257 - n, data[i])) if run and n > 1 else bytes((n - 1,)) + data[i : i + n])
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


CLEAR, END, FIRST, FULL = 256, 257, 258, 4094


def _widths(n: int) -> np.ndarray:
    """Bits of the first n codes after a clear: 9 to 12, widening one code early."""
    i = np.arange(n) + FIRST
    return 9 + (i >= 512).astype(np.int64) + (i >= 1024) + (i >= 2048)


_WIDTHS = _widths(FULL + 2 - FIRST)
_STARTS = np.concatenate(([0], np.cumsum(_WIDTHS)))


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that widen one code early; the table starts anew when full."""
    codes, widths, part = [CLEAR], [np.array([9])], []
    known: dict[int, int] = {}
    find, put, nxt = known.get, part.append, FIRST
    code = data[0] if data else None
    for byte in data[1:]:
        key = code << 8 | byte
        longer = find(key)
        if longer is not None:
            code = longer
            continue
        put(code)
        known[key] = nxt
        nxt += 1
        code = byte
        if nxt == FULL:
            widths.append(_widths(len(part) + 1))
            codes += part
            codes.append(CLEAR)
            known.clear()
            part.clear()
            nxt = FIRST
    if code is not None:
        put(code)
    widths.append(_widths(len(part) + 1))
    codes = np.array([*codes, *part, END], np.uint32)
    bits = np.concatenate(widths)
    at = np.repeat(np.cumsum(bits) - 1, bits) - np.arange(bits.sum())
    return np.packbits((np.repeat(codes, bits) >> at.astype(np.uint32) & 1).astype(np.uint8)).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    # A code's bits lie in three bytes from its first one on.
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out, at = [], 0
    while at + 9 <= 8 * len(data):
        many = int(np.searchsorted(_STARTS, 8 * len(data) - at, "right")) - 1
        bits, wide = at + _STARTS[:many], _WIDTHS[:many].astype(np.uint32)
        byte = bits >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (bits & 7).astype(np.uint32) - wide) & ((1 << wide) - 1)
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stops[0]) if len(stops) else len(codes)
        if n:
            table, part = base[:], codes[:n].tolist()
            add, before = table.append, base[part[0]]
            out.append(before)
            for code in part[1:]:
                entry = table[code] if code < len(table) else before + before[:1]
                out.append(entry)
                add(before + entry[:1])
                before = entry
        if not len(stops) or codes[n] == END:
            break
        at += int(_STARTS[n + 1])
    return b"".join(out)[:size]


def compress(kind: int, block: np.ndarray) -> bytes:
    """A strip or tile."""
    if kind == PACKBITS:
        return packbits(block)
    return {NONE: bytes, LZW: lzw, DEFLATE: lambda d: zlib.compress(d, 1)}[kind](block.tobytes())


def decompress(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        return data[:size]
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if kind in (LZW, PACKBITS):
        return (unlzw if kind == LZW else unpackbits)(data, size)
    raise ValueError(f"compression {kind} is not supported")


# --- files ----------------------------------------------------------------------------------------


def write_tiff(payload: bytes, row: int = ROW, page_rows: int = PAGE_ROWS, compression: int | None = None, predictor: int | None = None, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of 8-bit grey pages that holds the payload row by row.

    The payload's length must be a multiple of ``row``.  Without a given compression a checksum of the payload
    picks one of LAYOUTS, so payloads of every length meet every layout and equal payloads the same one.
    """
    if not payload or len(payload) % row:
        raise ValueError("the payload must be a positive multiple of the row length")
    if compression is None:
        compression, predictor, tile = LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]
    image = np.frombuffer(payload, np.uint8).reshape(-1, row)
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for top in range(0, len(image), page_rows):
        page = image[top : top + page_rows]
        if tile:
            tw, th = tile
            blocks = []
            for y in range(0, len(page), th):
                for x in range(0, row, tw):
                    block = np.zeros((th, tw), np.uint8)
                    part = page[y : y + th, x : x + tw]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
            data = compress(compression, block)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        fields = {WIDTH: (4, [row]), HEIGHT: (4, [len(page)]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor or 1])}
        if tile:
            fields |= {TILE_WIDTH: (4, [tile[0]]), TILE_HEIGHT: (4, [tile[1]]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, sizes)}
        else:
            fields |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [STRIP_ROWS]), STRIP_BYTES: (4, sizes)}
        out += b"\0" * (len(out) % 2)
        entries = []
        for tag, (kind, values) in sorted(fields.items()):
            packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(packed) > 4:
                at, out = len(out), out + packed
                packed = struct.pack("<I", at)
            entries.append(struct.pack("<HHI4s", tag, kind, len(values), packed))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def read_tiff(file: bytes) -> list[dict]:
    """Every page of a file, in the order of its image directories."""
    order = {b"II": "<", b"MM": ">"}[file[:2]]
    magic, at = struct.unpack_from(order + "HI", file, 2)
    if magic != 42:
        raise ValueError("not a TIFF file")
    pages, seen = [], set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        tags: dict[int, tuple[int, ...]] = {}
        (n,) = struct.unpack_from(order + "H", file, at)
        for i in range(n):
            entry = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", file, entry)
            if kind in TYPE_BYTES:
                place = entry + 8 if count * TYPE_BYTES[kind] <= 4 else struct.unpack_from(order + "I", file, entry + 8)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{'?BBHI'[kind]}", file, place)
        (at,) = struct.unpack_from(order + "I", file, at + 2 + 12 * n)
        width, height = tags[WIDTH][0], tags[HEIGHT][0]
        if set(tags.get(BITS, (1,))) != {8} or tags.get(SAMPLES, (1,))[0] != 1:
            raise ValueError("only images of one 8-bit sample are read")
        compression, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
        tiled = TILE_OFFSETS in tags
        w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(tags.get(ROWS_PER_STRIP, (height,))[0], height))
        image = np.empty((height, width), np.uint8)
        across = -(-width // w)
        for k, (offset, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES])):
            y, x = k // across * h, k % across * w
            rows = h if tiled else min(h, height - y)
            block = np.frombuffer(decompress(compression, file[offset : offset + size], rows * w), np.uint8).reshape(rows, w)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            image[y : y + h, x : x + w] = block[: height - y, : width - x]
        share = np.bincount(image.ravel(), minlength=256) / max(1, image.size)
        some = share[share > 0]
        measures = {"mean": round(float(share @ np.arange(256)), 6), "entropy": round(float(-(some * np.log2(some)).sum()) + 0.0, 6)}
        pages.append({"page": len(pages), "width": width, "height": height, "compression": compression, "predictor": predictor, "tiled": tiled, **measures, "samples": image.tobytes()})
    return pages


# --- frames ---------------------------------------------------------------------------------------


def padded(text: bytes, unit: int = ROW) -> bytes:
    return text + bytes((PAD,)) * (-len(text) % unit or (0 if text else unit))


def _appended(df: DataFrame, name: str, kind: T.DataType, each, source: str) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"the input has a column {name} already")
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for batch in batches:
            rows = max(1, BLOCK_BYTES * len(batch) // max(1, batch.column(source).nbytes))
            for i in range(0, len(batch), rows):  # few files are held as Python objects at a time
                part = batch.slice(i, rows)
                column = part.column(source)
                yield part.append_column(name, pa.array([each(column[k].as_py()) for k in range(len(column))], arrow))

    return df.mapInArrow(run, schema)


def tiff_store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Append a TIFF file (binary) that holds the UTF-8 bytes of every whole text, padded to full rows."""
    return _appended(df, media, T.BinaryType(), lambda t: write_tiff(padded((t or "").encode())), text)


def tiff_read(df: DataFrame, media: str = "media", pages: str = "pages") -> DataFrame:
    """Append the list of pages of every file."""
    return _appended(df, pages, T.ArrayType(PAGE), lambda f: None if f is None else read_tiff(f), media)


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the input's columns without the file, then the page's."""
    kept = [c for c in df.columns if c != media]
    read = tiff_read(df, media, "_pages")
    return read.select(*(F.col(f"`{c}`") for c in kept), F.explode("_pages").alias("_page")).select(*(F.col(f"`{c}`") for c in kept), "_page.*")
