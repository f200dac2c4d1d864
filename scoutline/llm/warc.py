"""WARC archives in Zstandard frames: one frame per record, a shared dictionary in a leading skippable frame.

An archive is a byte string.  Archives are kept as rows of a Parquet table in the shared folder, so that
they can be written and read wherever Spark can.  Payloads that occur more than once are stored once:
of records with equal payloads the one with the largest id is the response, the others revisit it.

Edge cases: a null payload is an empty one; a null id is written as an empty one and read as null; an empty table makes no archive; repeated ids with one
payload all keep their kind (each is the response if its id is the largest); all archives of a table share one
dictionary, trained on a bounded sample of its pages (only a table whose pages are too few or too alike to train one has
none); extra columns are ignored; a wrong header, length or digest raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutline.llm.common import salted_join, written

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of payload after which an archive is closed; pages that train the dictionary, characters of each, and its size.
ARCHIVE_BYTES, TRAINING_PAGES, TRAINING_CHARS, DICTIONARY_BYTES = 4_000_000, 500, 8_192, 8_192
#: Bytes of an archive that are decoded at a time.
PIECE = 16_384


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, sha1: str, length: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of its payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = (url or "").translate({i: f"%{i:02X}" for i in (*range(33), 127)})
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes]) -> bytes | None:
    """A dictionary of the records; None if they are too few or too alike for one."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, records, k=200, d=8).as_bytes() if records else None
    except zstd.ZstdError:
        return None


def write_archive(records: list[bytes], dictionary: bytes | None = None) -> bytes:
    import zstandard as zstd

    out = []
    if dictionary:
        held = zstd.ZstdCompressor().compress(dictionary)
        out.append(struct.pack("<II", SKIPPABLE, len(held)) + held)
    known = zstd.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstd.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
    out += map(press.compress, records)
    return b"".join(out)


def read_archive(archive: bytes):
    """Uncompressed records, one for each frame behind the dictionary."""
    import zstandard as zstd

    at, trained = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        (size,) = struct.unpack_from("<I", archive, 4)
        held = archive[8 : 8 + size]
        if len(held) != size:
            raise ValueError("the dictionary frame is cut off")
        if held[:4] == FRAME_MAGIC:
            held = zstd.ZstdDecompressor().decompress(held)
        if held[:4] != DICTIONARY_MAGIC:
            raise ValueError("the leading frame holds no dictionary")
        trained, at = zstd.ZstdCompressionDict(held), 8 + size
    open_ = zstd.ZstdDecompressor(dict_data=trained) if trained else zstd.ZstdDecompressor()
    view = memoryview(archive)
    while at < len(archive):
        # Bytes are handed over in pieces, so no frame copies the rest of the archive.
        frame, parts = open_.decompressobj(), []
        while not frame.eof and at < len(archive):
            parts.append(frame.decompress(view[at : at + PIECE]))
            at = min(len(archive), at + PIECE)
        if not frame.eof:
            raise ValueError("a frame is cut off")
        at -= len(frame.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Fields of a record, after a check of its version, headers, lengths and (with a payload) its digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys()
    if missing:
        raise ValueError(f"headers are missing: {sorted(missing)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record is not as long as its header says")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    kind = fields["warc-type"]
    sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != sha1):
        raise ValueError("the payload does not match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit has a payload or no target")
    page = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {"page_id": page(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": sha1, "record_type": kind, "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None, "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def with_response(pages: DataFrame) -> DataFrame:
    """page_id, url, html and ``_response``: the largest id among pages of the same payload.

    Payloads meet by their digests alone (grouping sums up before the shuffle, and a payload of very many pages
    is salted).  Texts then move once, by page and digest, which no payload's copies share.
    """
    digests = F.sha2(F.coalesce("html", F.lit("")), 256).alias("_key")
    key = written(pages.select("page_id", digests), "digests")
    last = written(key.groupBy("_key").agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("n_rows")), "responses")
    revisits = salted_join(key, last.where("n_rows > 1"), ["_key"], "page_id").where("page_id <> _response").distinct()
    named = revisits.select(F.col("page_id").alias("_page"), F.col("_key").alias("_revisited"), "_response")
    both = pages.select("page_id", "url", "html", digests).join(named.hint("merge"), (F.col("page_id") == F.col("_page")) & (F.col("_key") == F.col("_revisited")), "left")
    return both.select("page_id", "url", "html", F.coalesce("_response", "page_id").alias("_response"))


def dictionary(pages: DataFrame) -> bytes | None:
    """Trained on the driver from TRAINING_PAGES pages, cut to TRAINING_CHARS each; it only helps to compress."""
    order = F.xxhash64("page_id")
    rows = pages.where("page_id is not null").select("page_id", "url", F.left("html", F.lit(TRAINING_CHARS)).alias("html")).orderBy(order, "page_id").limit(TRAINING_PAGES).collect()
    payloads = [(r, (r.html or "").encode()) for r in rows]
    return trained([record(r.page_id, r.url, p, digest(p), len(p), None) for r, p in payloads])


def warc_write(pages: DataFrame) -> DataFrame:
    """Write one record per page; the result is the table of archives (archive: binary)."""
    shared = pages.sparkSession.sparkContext.broadcast(dictionary(pages))

    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            ids, urls, texts, firsts = (batch.column(c) for c in ("page_id", "url", "html", "_response"))
            for i in range(len(batch)):
                payload, page, first = (texts[i].as_py() or "").encode(), ids[i].as_py(), firsts[i].as_py()
                held.append(record(page, urls[i].as_py(), payload, digest(payload), len(payload), None if first == page else first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.record_batch({"archive": pa.array([write_archive(held, shared.value)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.record_batch({"archive": pa.array([write_archive(held, shared.value)], pa.binary())})

    return written(with_response(pages).mapInArrow(run, "archive binary"), "warc")


def warc_read(archives: DataFrame) -> DataFrame:
    """One row per record of every archive, checked."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def run(batches):
        import pyarrow as pa

        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows = [parse(x) for x in read_archive(archive)]
                yield pa.record_batch({c: pa.array([r[c] for r in rows], t) for c, t in types.items()})

    return archives.select("archive").mapInArrow(run, schema)
