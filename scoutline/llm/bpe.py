"""BPE encoding and decoding with shared prefixes.

The last token of every prefix of a word decides the encoding of the whole prefix: what stands before
that token is the encoding of a shorter prefix.  So it is enough to keep one token (the state) for each
prefix.  The distinct words of a batch are put in sorted order, which is the depth-first order of their
trie, and the states of the path from the root are a stack: two words compute their common prefix once.

Edge cases: a null or empty text has no tokens; a word of any length is one path, never cut; repeated
rows and words give equal ids; extra columns are passed through (the output columns must not be among
them, which raises ``ValueError``).
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words of the vocabulary file's splitting rule (fixed values of the tokenizer).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Characters for which splitting, case and white space are the same in every Unicode version.
PLAIN = "\\t\\n\\r\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u0148\\u014a-\\u017e\\u2010-\\u2027\\u2030-\\u203a\\u20ac"
#: Pieces that a worker remembers before it starts anew.
CACHED_PIECES = 300_000


class Word(str):
    """A word that is split already; it never equals a piece that is not."""

    __slots__ = ()

    def __eq__(self, other) -> bool:
        return isinstance(other, Word) and str.__eq__(self, other)

    def __hash__(self) -> int:
        return str.__hash__(self) ^ 1


class PrefixBpe:
    """One vocabulary with an end-of-word suffix, as read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = loaded_tokens(path)
        inner = {t: i for t, i in vocab.items() if not t.endswith(suffix)}
        final = {t[: -len(suffix)]: i for t, i in vocab.items() if t.endswith(suffix)}
        self.width = {i: len(t) for t, i in inner.items()} | {i: len(t) for t, i in final.items()}
        self._suffix_automaton(inner, final)
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            c = vocab[a + b]
            if c in self.parts:
                raise ValueError(f"{path}: two merges make the token {a + b!r}")
            self.merged[vocab[a], vocab[b]], self.parts[c], self.rank[c] = c, (vocab[a], vocab[b]), n
        self.stays = functools.lru_cache(150_000)(self._stays)
        self.byte_char = _byte_chars()
        self.library = Tokenizer.from_file(path)  # its normaliser and splitter serve unusual characters
        # A letter or digit begins no other alternative, so letters can be tried first; plain text needs no Unicode classes.
        self.split = re.compile("|".join([r"[^\W\d_]+", *CONTRACTIONS, r"[^\W_]", r"(?:[^\s\w]|_)+"])).findall
        self.unusual = re.compile(f"[^{PLAIN}]").search
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in self.special) + ")") if self.special else None
        self.marks = tuple({x[:2] for x in self.special})
        self.cache: dict[str | int, bytes] = {}

    def _stays(self, a: int, b: int) -> bool:
        """True if BPE leaves tokens a and b side by side.

        Their merges are undone from the last one on, along the seam: a merge across the seam happens
        if it comes before the merge that has hidden it.
        """
        never = len(self.rank)
        before, ties = never, False  # a merge of this rank or later is too late; ties: this rank still wins
        while True:
            c = self.merged.get((a, b))
            if c is not None and (self.rank[c] < before or ties and self.rank[c] == before):
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # equal merges go from left to right: one across the seam loses against a's own
                before, ties, a = ra, False, self.parts[a][1]
            else:
                before, ties, b = rb, True, self.parts[b][0]

    def _suffix_automaton(self, inner: dict[str, int], final: dict[str, int]) -> None:
        """For every string that begins a token: the tokens that end it, longest first.

        A step appends one character and falls back to the longest suffix that still begins a token.
        """
        go: list[dict[str, int]] = [{}]
        word_of = [""]
        for token in {*inner, *final}:
            node = 0
            for i, c in enumerate(token):
                node = go[node].setdefault(c, len(go))
                if node == len(go):
                    go.append({})
                    word_of.append(token[: i + 1])
        back = [0] * len(go)
        self.ends = [()] * len(go)
        self.last_ends = [()] * len(go)
        level = [0]
        while level:
            below = []
            for node in level:
                w, up = word_of[node], back[node]
                if node:
                    for known, out in ((inner, self.ends), (final, self.last_ends)):
                        out[node] = ((known[w], len(w)), *out[up]) if w in known else out[up]
                for c, child in go[node].items():
                    f = up
                    while f and c not in go[f]:
                        f = back[f]
                    back[child] = go[f].get(c, 0) if node else 0
                    below.append(child)
            level = below
        self.go, self.back = go, back

    def encode_words(self, found: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words, in the depth-first order of their trie."""
        out = {}
        plain = {w if w.isascii() and w.isprintable() else "".join(map(self.byte_char.__getitem__, w.encode())): w for w in found}
        go, back, stays, ends, last_ends, width = self.go, self.back, self.stays, self.ends, self.last_ends, self.width
        path, state, nodes = "", [-1], [0]  # state[i]: last token of path[:i]; nodes[i]: its place in the automaton
        for word in sorted(plain):
            n, same, most = len(word), 0, min(len(path), len(word) - 1)
            while same < most and path[same] == word[same]:
                same += 1
            del state[same + 1 :], nodes[same + 1 :]
            node = nodes[same]
            for end in range(same + 1, n):
                c = word[end - 1]
                while node and c not in go[node]:
                    node = back[node]
                node = go[node].get(c, 0)
                nodes.append(node)
                for token, wide in ends[node]:
                    if wide == end or stays(state[end - wide], token):
                        state.append(token)
                        break
                else:
                    raise ValueError(f"no token ends at {end} of {word!r}")
            c = word[-1]
            while node and c not in go[node]:
                node = back[node]
            node = go[node].get(c, 0)
            for token, wide in last_ends[node]:
                if wide == n or stays(state[n - wide], token):
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            ids, start = [token], n - wide
            while start:
                ids.append(state[start])
                start -= width[state[start]]
            ids.reverse()
            out[plain[word]] = tuple(ids)
            path = word[:-1]
        return out

    def chunks(self, text: str) -> list:
        """A stretch without special tokens as pieces that are encoded by themselves: no word crosses white space."""
        if not self.unusual(text):
            return text.lower().split()
        text = self.library.normalizer.normalize_str(text)
        back = self._char_bytes
        return [Word(bytes(map(back.__getitem__, w)).decode()) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_chunks(self, found: list) -> None:
        """Split new pieces into words, encode those and put the pieces' ids (as bytes) into the cache."""
        words = {c: (str(c),) if isinstance(c, Word) else self.split(c) for c in found}
        ids = self.encode_words(set(chain.from_iterable(words.values())))
        for c, ws in words.items():
            self.cache[c] = array("i", chain.from_iterable(map(ids.__getitem__, ws))).tobytes()

    @functools.cached_property
    def _char_bytes(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(self.byte_char)}

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text."""
        parts: list[list] = []
        for text in texts:
            if text and self.at_special and any(m in text for m in self.marks) and self.at_special.search(text):
                cut = self.at_special.split(text)
                parts.append([x for i, s in enumerate(cut) for x in ([self.special[s]] if i % 2 else self.chunks(s))])
            else:
                parts.append(self.chunks(text) if text else [])
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        cache = self.cache
        cache.update((i, np.int32(i).tobytes()) for i in self.special.values())
        new = [c for c in set().union(*parts) if c not in cache]
        if new:
            self.encode_chunks(new)
        return [np.frombuffer(b"".join(map(cache.__getitem__, p)), np.int32) for p in parts]

    def decode(self, ids) -> str:
        return decoded(self.tokens, ids)


def decoded(tokens: dict[int, str], ids) -> str:
    """Tokens in order, joined by one space (the file names no decoder)."""
    return " ".join(map(tokens.__getitem__, ids))


def _byte_chars() -> list[str]:
    """The visible character that stands for each byte: printable ones stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(n))
        n += b not in own
    return out


@functools.lru_cache(2)
def loaded(path: str) -> PrefixBpe:
    return PrefixBpe(path)


@functools.lru_cache(2)
def loaded_tokens(path: str) -> dict[int, str]:
    """The tokens alone, which is all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}


#: Bytes of text that are encoded at a time, whose words share a trie; rows of an Arrow batch at most.
BLOCK_BYTES, BATCH_ROWS = 2_000_000, 1_000


def _with_column(df: DataFrame, name: str, kind: T.DataType, source: str, make) -> DataFrame:
    """Append a column that ``make(column)`` computes, block by block, so that few texts are held at a time.

    The session's Arrow batches are made smaller if need be, since ids and decoded texts are larger than texts.
    """
    if name in df.columns:
        raise ValueError(f"the input has a column {name} already")
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches):
        for batch in batches:
            column = batch.column(source)
            size = max(1, column.nbytes // max(1, len(column)))
            rows = max(1, BLOCK_BYTES // size)
            for i in range(0, len(batch), rows):
                part = batch.slice(i, rows)
                yield part.append_column(name, make(part.column(source)))

    return df.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the token ids (array<int>) of every whole text; the vocabulary file's place is a parameter."""

    def make(column):
        import pyarrow as pa

        found = loaded(path).encode_batch(column.to_pylist())
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    return _with_column(df, ids, T.ArrayType(T.IntegerType()), text, make)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append the text of token ids: tokens in order, joined by one space (the file names no decoder)."""

    def make(column):
        import pyarrow as pa

        tokens = loaded_tokens(path)
        return pa.array([decoded(tokens, column[i].values.to_numpy().tolist()) if column[i].is_valid else None for i in range(len(column))], pa.string())

    return _with_column(df, text, T.StringType(), ids, make)
