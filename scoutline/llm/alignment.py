"""Alignment of two tokenizers' tokens over the bytes they share, and counts of linked ids over the corpus.

Every document of a batch is merged at the same time: a NumPy vector holds each one's place in both token rows.  A step links the two
tokens that stand there, marks a cut where they end at the same byte, moves the one that ends first (both at a cut), and drops the
documents that are done.  Long documents are first cut at common ends into lanes of a few hundred tokens, so that a batch needs a few
hundred steps whatever its texts.

Counts of linked pairs are taken over the whole corpus.  Their table has at most one row for each pair of vocabulary entries; it goes to
the tasks whole only if it has no more than ``most`` rows, else documents meet it in a salted join.

Defined results: null and empty texts, and texts whose tokens do not give back a space and the text, have no tokens; every row is a
document of its own, repeated ones too; extra columns are kept, but for those that bear the name of an added one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from scoutline.llm.common import salted_join, written

#: Bytes of text that are encoded at once, and tokens of a lane.
SLICE, LANE = 1 << 18, 512
#: Rows of a table of counts that tasks may hold whole (16 bytes each).
MOST = 4_000_000

_ADDED = "a_ids array<int>, b_ids array<int>, link_a array<int>, link_b array<int>, cut_a array<int>, cut_b array<int>"


@functools.cache
def _tokenizers(path_a: str, path_b: str):
    """(encoding of texts by A, its entries' bytes, encoder B, its entries' bytes)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    # The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    entries_a = {i: bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode() for piece, i in a.get_vocab(with_added_tokens=True).items()}
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    entries_a = Bytes([entries_a.get(i, b"") for i in range(max(entries_a) + 1)])
    entries_b = Bytes([bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())])
    fast = _fast(path_a, letters)

    def encode(texts: list[str]) -> list:
        odd = [fast is None or LATIN.search(t) is not None for t in texts]
        slow = iter(a.encode_batch_fast([t for t, o in zip(texts, odd) if o], add_special_tokens=False))
        return [next(slow).ids if o else fast.encode_to_numpy(t, disallowed_special=()) for t, o in zip(texts, odd)]

    return encode, entries_a, b, entries_b


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, cut_a, cut_b): positions of linked tokens, and of the tokens that end at a cut, unordered.

    ends_a, ends_b: byte at which each token ends, the rows of all lanes one after the other; starts: where each lane begins, and the end.
    A lane's rows end at the same byte.
    """
    at_a, at_b, stop = starts_a[:-1].copy(), starts_b[:-1].copy(), starts_a[1:]
    live = at_a < stop
    at_a, at_b, stop = at_a[live], at_b[live], stop[live]
    links, cuts = [], []
    while len(at_a):
        links.append((at_a.copy(), at_b.copy()))
        a, b = ends_a[at_a], ends_b[at_b]
        equal = a == b
        cuts.append((at_a[equal], at_b[equal]))
        at_a += a <= b
        at_b += b <= a
        live = at_a < stop
        if not live.all():
            at_a, at_b, stop = at_a[live], at_b[live], stop[live]
    empty = [(np.zeros(0, np.int64),) * 2]
    return *(np.concatenate(x) for x in zip(*(links or empty))), *(np.concatenate(x) for x in zip(*(cuts or empty)))


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, size: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Starts of lanes: documents of more than ``size`` tokens of A are cut at the first common end behind every multiple of it."""
    places = []
    for a0, a1, b0, b1 in zip(starts_a[:-1], starts_a[1:], starts_b[:-1], starts_b[1:]):
        if a1 - a0 <= size:
            continue
        own_a, own_b = ends_a[a0:a1], ends_b[b0:b1]
        for i in range(size, a1 - a0 - 1, size):
            probe = own_a[i : min(i + size, a1 - a0 - 1)]
            at = np.searchsorted(own_b, probe)
            hit = np.flatnonzero(own_b[np.minimum(at, len(own_b) - 1)] == probe)
            if len(hit):
                places.append((a0 + i + hit[0] + 1, b0 + at[hit[0]] + 1))
    cut = np.array(places, np.int64).reshape(-1, 2)
    return np.unique(np.concatenate((starts_a, cut[:, 0]))), np.unique(np.concatenate((starts_b, cut[:, 1])))


#: How the byte-level form cuts a text before merging (fixed value), and the characters that every version of Unicode puts in the same class.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = re.compile("[^\x00-\u024f]")


def _fast(path: str, letters: dict[str, int]):
    """The same vocabulary for tiktoken, which is faster, if its merges make the ids in order; else None."""
    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    model, cutter = form["model"], form.get("pre_tokenizer") or {}
    special = {t["content"] for t in form.get("added_tokens", ()) if t["special"]}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    merges = [bytes(letters[c] for c in ("".join(m) if isinstance(m, list) else m.replace(" ", ""))) for m in model["merges"]]
    if form.get("normalizer") or cutter != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or [ranks.get(m) for m in merges] != [*range(256, 256 + len(merges))]:
        return None
    import tiktoken

    return tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Bytes:
    """Byte strings of numbered entries in one buffer, to be put in a row for many entries at once."""

    def __init__(self, entries: list[bytes]) -> None:
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all entries in a row, where each one ends)."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.data[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


def _rows(ids: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in ids], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in ids)]), np.concatenate(([0], np.cumsum(counts)))


def _encoded(texts: list[str], path_a: str, path_b: str) -> tuple[list, list, list]:
    """([ids of A, ids of B], where each text's rows start, and at which byte each token ends, counted over all texts).

    A text has no tokens where the bytes of either differ from a space and the text.
    """
    encode, bytes_a, b, bytes_b = _tokenizers(path_a, path_b)
    found = [_rows(encode([" " + t for t in texts])), _rows(b.encode(texts, num_threads=1))]
    want = [b" " + t.encode() if t else b"" for t in texts]
    joined, right = np.frombuffer(b"".join(want), np.uint8), np.ones(len(texts), bool)
    sizes = np.array([len(w) for w in want], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for table, (ids, starts) in zip((bytes_a, bytes_b), found):
        data, ends = table.of(ids)
        place = np.concatenate(([0], ends))[starts]
        if len(data) == len(joined) and (place == at).all():
            differs = np.concatenate(([0], np.cumsum(data != joined)))
            right &= differs[at[1:]] == differs[at[:-1]]
        else:
            right &= np.array([data[p:q].tobytes() == w for p, q, w in zip(place[:-1], place[1:], want)], bool)
    right &= sizes > 0
    if not right.all():
        keep = [np.repeat(right, np.diff(starts)) for _, starts in found]
        found = [(ids[k], np.concatenate(([0], np.cumsum(np.where(right, np.diff(starts), 0))))) for (ids, starts), k in zip(found, keep)]
    return [f[0] for f in found], [f[1] for f in found], [np.cumsum(t.lengths[f[0]]) for t, f in zip((bytes_a, bytes_b), found)]


class Aligned:
    """Some texts, aligned: ids, links and cuts of all of them in a row, and where each text's begin."""

    def __init__(self, texts: list[str], path_a: str, path_b: str) -> None:
        self.ids, self.starts, ends = _encoded(texts, path_a, path_b)
        link_a, link_b, cut_a, cut_b = lockstep(*ends, *lanes(*ends, *self.starts))
        order = np.argsort(link_a * (len(ends[1]) + 1) + link_b)
        self.links, self.cuts = (link_a[order], link_b[order]), (np.sort(cut_a), np.sort(cut_b))
        self.first_link, self.first_cut = np.searchsorted(self.links[0], self.starts[0]), np.searchsorted(self.cuts[0], self.starts[0])

    def lists(self) -> list[pa.Array]:
        """The six added columns."""
        texts = [np.diff(x) for x in (*self.starts, self.first_link, self.first_cut)]
        base = [np.repeat(s[:-1], n) for n in texts[2:] for s in self.starts]
        return [_list(self.ids[0], texts[0]), _list(self.ids[1], texts[1]), *(_list(x - y, texts[2]) for x, y in zip(self.links, base[:2])), *(_list(x - y + 1, texts[3]) for x, y in zip(self.cuts, base[2:]))]

    def groups(self) -> list[bytes]:
        """Of each text the ids between cuts: ``a1,a2|b1;a3|b2,b3``."""
        sides = []
        for ids, cuts, mark in zip(self.ids, self.cuts, b"|;"):
            group = np.searchsorted(cuts, np.arange(len(ids)))
            last = np.zeros(len(ids), bool)
            last[cuts] = True
            sides.append((ids, group, np.where(last, mark, ord(","))))
        ids, group, marks = (np.concatenate([s[i] for s in sides]) for i in range(3))
        order = np.argsort(group * 2 + np.repeat((0, 1), [len(s[0]) for s in sides]), kind="stable")
        ids, marks = ids[order], marks[order]
        data, ends = _decimals(int(ids.max(initial=0)) + 1).of(ids)
        data = data.copy()
        data[ends - 1] = marks
        edges = np.concatenate(([0], ends))[self.starts[0] + self.starts[1]]
        whole = data.tobytes()
        return [whole[p : max(p, q - 1)] for p, q in zip(edges[:-1], edges[1:])]

    def pairs(self, size_b: int) -> list[tuple[bytes, bytes]]:
        """Of each text the linked pairs of ids (A id * size_b + B id), each once and in order, and how often it is linked."""
        pair = self.ids[0][self.links[0]] * size_b + self.ids[1][self.links[1]]
        text = np.repeat(np.arange(len(self.first_link) - 1), np.diff(self.first_link))
        order = np.lexsort((pair, text))
        pair, text = pair[order], text[order]
        new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])))) if len(pair) else np.zeros(0, np.int64)
        times, edges = np.diff(np.append(new, len(pair))), np.searchsorted(text[new], np.arange(len(self.first_link)))
        return [(pair[new[p:q]].astype("<i8").tobytes(), times[p:q].astype("<i4").tobytes()) for p, q in zip(edges[:-1], edges[1:])]


@functools.cache
def _numbers(n: int) -> Bytes:
    return Bytes([b"%d," % i for i in range(n)])


def _decimals(most: int) -> Bytes:
    """Numbers below a power of two, each with a place for a mark behind it."""
    return _numbers(1 << most.bit_length())


def _list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


def _parts(batch: pa.RecordBatch, place: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of about SLICE bytes of text; only one slice's texts are Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(batch):
        j, size = i + 1, sizes[i]
        while j < len(batch) and size + sizes[j] <= SLICE:
            size += sizes[j]
            j += 1
        part = batch.slice(i, j - i)
        yield part, [t or "" for t in part.column(place).to_pylist()]
        i = j


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """docs with the token ids of both, the positions of linked tokens, and how many tokens of each stand before every cut.

    path_a: a byte-level BPE in the tokenizers library's form; path_b: a sentencepiece model with byte fallback.
    """
    added = _parse_datatype_string(_ADDED).fields
    docs = docs.drop(*(f.name for f in added))
    names, place = docs.columns, docs.columns.index(text)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, place):
                yield pa.RecordBatch.from_arrays([*part.columns, *Aligned(texts, path_a, path_b).lists()], [*names, *(f.name for f in added)])

    return docs.mapInArrow(align, StructType(docs.schema.fields + added))


_DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def digested(docs: DataFrame, path_a: str, path_b: str, size_b: int, text: str = "text") -> DataFrame:
    """docs without their texts, with the numbers of tokens, groups and links, the hash of the groups' text, and the linked pairs."""
    added = _parse_datatype_string(_DIGEST).fields
    docs = docs.drop(*(f.name for f in added))
    place, kept = docs.columns.index(text), [c for c in docs.columns if c != text]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _parts(batch, place):
                found = Aligned(texts, path_a, path_b)
                counts = [np.diff(x) for x in (*found.starts, found.first_cut, found.first_link)]
                sha = [hashlib.sha256(g).hexdigest() if g else "" for g in found.groups()]
                pairs, times = zip(*found.pairs(size_b))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *map(pa.array, counts), pa.array(sha), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())], [*kept, *(f.name for f in added)])

    return docs.mapInArrow(digest, StructType([f for f in docs.schema.fields if f.name != text] + added))


def pair_counts(frame: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): documents that hold each pair linked, and whether no other pair of its A id has more.

    frame: pairs, each document's once.  Every task adds up its own before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    counts = written(frame.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.floor(F.col("pair") / size_b).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(frame: DataFrame, counts: DataFrame, most: int = MOST) -> DataFrame:
    """frame (pairs, times and others) with n_best and count_sum instead: links of their A id's highest count, and all links' counts."""
    if counts.count() > most:
        return _joined(frame, counts)
    found = counts.orderBy("pair").toArrow()
    held = frame.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in frame.columns if c not in ("pairs", "times")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            sums = []
            for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                at, times = np.searchsorted(pair, np.frombuffer(p, "<i8")), np.frombuffer(t, "<i4").astype(np.int64)
                sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1))], [*kept, "n_best", "count_sum"])

    fields = [f for f in frame.schema.fields if f.name in kept]
    return frame.mapInArrow(look, StructType(fields + _parse_datatype_string("n_best long, count_sum long").fields))


def _joined(frame: DataFrame, counts: DataFrame) -> DataFrame:
    """``scored`` for a table of counts that is too large for a task."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, p, t in zip(*(batch.column(c).to_pylist() for c in ("row", "pairs", "times"))):
                pair = np.frombuffer(p, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row)), pa.array(pair), pa.array(np.frombuffer(t, "<i4"))], ["row", "pair", "times"])

    links = frame.select("row", "pairs", "times").mapInArrow(spread, "row long, pair long, times int")
    met = salted_join(links, counts.withColumn("n_rows", F.col("n")), ["pair"], "row")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return frame.drop("pairs", "times").join(sums, "row", "left").select(*(c for c in frame.columns if c not in ("pairs", "times")), zero("n_best"), zero("count_sum"))


def digests(docs: DataFrame, path_a: str, path_b: str, size_b: int, text: str = "text", most: int = MOST) -> DataFrame:
    """docs without their texts, with numbers of tokens, groups and links, the groups' hash, n_best and count_sum."""
    light = digested(docs.drop("row", "n_best", "count_sum"), path_a, path_b, size_b, text).withColumn("row", F.monotonically_increasing_id())
    table = written(light, "linked")
    out = scored(table, written(pair_counts(table, size_b), "counts"), most)
    return out.select(*(c for c in out.columns if c not in ("row", "groups_sha256")), "groups_sha256")


def sizes(path_b: str) -> int:
    """Entries of the second vocabulary."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
