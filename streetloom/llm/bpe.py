"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A byte string's BPE tokens are the one sequence whose adjacent pairs
are all *compatible*: BPE, run on the two tokens' bytes alone, gives the same
two tokens back. So a non-deterministic transducer guesses tokens along the
vocabulary's trie and checks each guess against the token before it. Its
subset construction is done lazily: a state is the set of guesses still open,
each a trie node and the token that it follows, and a transition gives the last
token of what has been read. Tokens on which all open guesses agree are
certain; guesses are no longer than the longest token, so lookahead is bounded.

Decoding. Token bytes are fed part by part to ``Utf8Machine``, which gives the
characters that are whole and holds back the rest, so text can be shown
before a stream has ended. Malformed bytes become U+FFFD; ``decode_bytes`` gives the bytes as they are.

Inputs: null and empty texts give no ids, null arrays no text. Texts of any length are read as a
stream of matches, and emitted in parts. Ids outside the vocabulary raise KeyError.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import blank, prepare, table

#: Transitions and pieces that a worker keeps; beyond them it starts afresh, which only costs time.
MAX_TRANSITIONS = 600_000
MAX_PIECES = 400_000
#: Bits of a token in a packed number, all set for no token; bytes of a piece that are read before certain tokens are emitted.
BITS = 20
NONE = (1 << BITS) - 1
LOOK = 64
#: Ids that are decoded at a time.
PART = 1 << 12
#: Texts longer than this are split piece by piece, not in one list.
LONG_TEXT = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def char_class(letter: str) -> str:
    """A character class body with all code points of a general category such as L or N."""
    out, begin = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == letter
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


#: The Unicode property White_Space, which \s means in the split pattern.
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


@lru_cache(4)
def splitter(pattern: str) -> re.Pattern:
    """The split pattern for the standard library's matcher: its properties become plain character classes."""
    letters, numbers = char_class("L"), char_class("N")
    p = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE_SPACE}{letters}{numbers}]")
    p = p.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    p = p.replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")
    return re.compile(p)


class Transducer:
    """Maps a piece's bytes to token ids; states and transitions are made when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        self.length = {rank: len(token) for token, rank in ranks.items()}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merge(token, rank)
                if len(parts) != 2:
                    continue  # merges never make it; only a whole piece can be this token
                self.halves[rank] = parts = (ranks[parts[0]], ranks[parts[1]])
                self.pairs[parts] = rank
            node = 0
            for byte in token:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.token_at[node] = rank
        self._reset()

    def merge(self, data: bytes, below: int) -> list[bytes]:
        """Plain BPE with the merges of ranks under below."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two tokens.

        Undoes the two tokens' merges, latest first. A merge across the border is
        what BPE would rather have done if it ranks before the one just undone
        (on a tie the leftmost goes first, so the left token's own merge wins).
        """
        limit = 1 << 62
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def _reset(self) -> None:
        #: A guess is a trie node and the token before it, in one number; a state is its open guesses, longest first.
        start = (NONE,)
        self.states: list[tuple[int, ...]] = [start]
        self.ids: dict[tuple[int, ...], int] = {start: 0}
        #: By state and byte: the next state, and the last token of what has been read, in one number.
        self.delta: dict[int, int] = {}
        #: Of pairs of tokens: whether they are compatible.
        self.settled: dict[int, bool] = {}

    def _step(self, state: int, byte: int) -> int:
        children, token_at, settled = self.children, self.token_at, self.settled
        after, found = [], -1
        for guess in self.states[state]:
            before = guess & NONE
            node = children[guess >> BITS].get(byte)
            if node is None:
                continue
            if children[node]:
                after.append(node << BITS | before)
            token = token_at[node]
            if token >= 0 and found < 0:
                if before == NONE:
                    found = token
                else:
                    fits = settled.get(before << BITS | token)
                    if fits is None:
                        fits = settled[before << BITS | token] = self.compatible(before, token)
                    if fits:
                        found = token  # no other can fit: what has been read has one encoding
        after.append(found)
        key = tuple(after)
        number = self.ids.get(key)
        if number is None:
            number = self.ids[key] = len(self.states)
            self.states.append(key)
        self.delta[state << 8 | byte] = out = number << BITS | found
        return out

    def encode(self, piece: bytes) -> list[int]:
        """A piece's tokens. Those before all open guesses are certain and emitted after every LOOK bytes; what is held is bounded by the longest token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.delta) > MAX_TRANSITIONS:
            self._reset()
        state, ends, out, delta, look = 0, [], [], self.delta, LOOK
        for byte in piece:
            to = delta.get(state << 8 | byte)
            if to is None:
                to = self._step(state, byte)
            state = to >> BITS
            ends.append(to & NONE)
            if len(ends) >= look:
                out += self._emit(ends, self._certain(state, ends))
                look = len(ends) + LOOK
        return out + self._emit(ends, len(ends))

    def _certain(self, state: int, ends: list[int]) -> int:
        """How many bytes all open guesses agree on: where the ways back from their starts meet."""
        starts = {len(ends) - self.depth[g >> BITS] for g in self.states[state]}
        while len(starts) > 1:
            last = max(starts)
            starts.remove(last)
            starts.add(last - self.length[ends[last - 1]])
        return starts.pop()

    def _emit(self, ends: list[int], upto: int) -> list[int]:
        """The tokens of the first bytes, from the last one back; the bytes go."""
        out, at = [], upto
        while at > 0:
            out.append(ends[at - 1])
            at -= self.length[ends[at - 1]]
        del ends[:upto]
        out.reverse()
        return out


class Pieces(dict):
    """Packed ids of each piece of text; fills itself. When full, it becomes the older of two generations."""

    def __init__(self, fst: Transducer):
        self.fst = fst
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.fst.encode(piece.encode())).tobytes()
        if len(piece) < 64:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """A byte-level BPE codec made from ranks and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        size = max(ranks.values(), default=-1) + 1
        by_id: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.known = np.array([t is not None for t in by_id], bool)
        self.tokens = pa.array([t or b"" for t in by_id], pa.large_binary())

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(Transducer(self.ranks))

    @cached_property
    def split(self) -> re.Pattern:
        return splitter(self.pattern)

    def encode(self, text: str) -> np.ndarray:
        """int32 ids of a text, without special tokens."""
        get = self.pieces.__getitem__
        if len(text) <= LONG_TEXT:
            return np.frombuffer(b"".join(map(get, self.split.findall(text))), np.int32)
        found = (m.group() for m in self.split.finditer(text))
        parts = []
        while part := b"".join(map(get, islice(found, 1 << 16))):
            parts.append(part)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise KeyError("an id isn't in the vocabulary")
        got = self.tokens.take(pa.array(ids))
        return got.buffers()[2].to_pybytes()[: int(np.frombuffer(got.buffers()[1], np.int64)[len(got)])]

    def decode_stream(self, parts: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of a stream of ids, as soon as its characters are whole."""
        machine = Utf8Machine()
        for ids in parts:
            if ready := machine.feed(self.decode_bytes(ids)):
                yield ready
        if ready := machine.close():
            yield ready

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.decode_stream(ids[a : a + PART] for a in range(0, len(ids), PART)))


class Utf8Machine:
    """An incremental UTF-8 automaton: state is how many bytes are missing, and which values may come next."""

    #: Fixed values (RFC 3629): lead bytes, how many bytes follow, and the range of the first of these.
    LEADS = [(0x00, 0x7F, 0, 0, 0), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
    START = {b: (n, lo, hi) for first, last, n, lo, hi in LEADS for b in range(first, last + 1)}

    def __init__(self) -> None:
        self.held = bytearray()
        self.missing, self.lo, self.hi = 0, 0x80, 0xBF

    def whole(self, data: bytes) -> int:
        """How many bytes end before the last lead byte whose sequence isn't complete."""
        for back in range(1, min(4, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                return len(data) - back if self.START.get(data[-back], (0,))[0] >= back else len(data)
        return len(data)

    def feed(self, data: bytes) -> str:
        if not self.missing and (cut := self.whole(data)):
            try:  # well-formed bytes leave the machine in its start state, so they can be taken at once
                return data[:cut].decode() + (self.feed(data[cut:]) if cut < len(data) else "")
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        for byte in data:
            if self.missing and self.lo <= byte <= self.hi:
                self.held.append(byte)
                self.missing -= 1
                self.lo, self.hi = 0x80, 0xBF
                if not self.missing:
                    out.append(self.held.decode())
                    self.held.clear()
                continue
            if self.missing:  # a sequence broke off
                out.append(self.close())
            n, self.lo, self.hi = self.START.get(byte, (-1, 0x80, 0xBF))
            if n < 0:
                out.append("�")
            elif n:
                self.missing = n
                self.held.append(byte)
            else:
                out.append(chr(byte))
        return "".join(out)

    def close(self) -> str:
        out = "�" if self.missing else ""
        self.held.clear()
        self.missing, self.lo, self.hi = 0, 0x80, 0xBF
        return out


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each worker process and vocabulary."""
    return ByteBPE(load_ranks(path), pattern)


def _array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (by default all but text) and ids, an array of ints; null texts give empty arrays."""
    prepare(df.sparkSession)
    keep = [c for c in df.columns if c not in (text, ids)] if keep is None else keep
    source = df.select(*keep, blank(text).alias("__text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        gc.set_threshold(100_000, 20, 100)  # the transducer's many small tuples needn't be visited again and again
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _array([bpe.encode(x) for x in b.column(len(keep)).to_pylist()])], [*keep, ids])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False))]))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that ids stand for, by streaming decoding; a null array gives no text."""
    prepare(df.sparkSession)
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])
    names = [f.name for f in schema.fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for b in it:
            col = b.column(b.schema.get_field_index(ids))
            flat, at = col.flatten().to_numpy(zero_copy_only=False), 0
            parts = []
            for n in col.value_lengths().fill_null(0).to_pylist():
                parts.append(bpe.decode(flat[at : at + n]))
                at += n
            cols = {n: b.column(b.schema.get_field_index(n)) for n in names if n != out}
            yield pa.RecordBatch.from_arrays([cols.get(n) if n != out else pa.array(parts, pa.string()) for n in names], names)

    return df.mapInArrow(run, schema)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and digest both.

    Repeated rows give repeated results. Checked against the tiktoken library in the tests.
    """
    import public_tokenizers

    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, pattern), vocabulary, pattern)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
