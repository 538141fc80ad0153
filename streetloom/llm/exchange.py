"""Blocks of documents that exchange hashes: which keys occur more than once, and where each key occurs first.

Documents are dealt to blocks by a hash of doc_id and text, so that neither a null
nor a repeated doc_id makes a large block; a block is a bounded unit of work. A corpus-wide question about hashed keys (windows, shingles, anchors)
takes two shuffles of hashes and none of texts: each block sends its keys to
the owners of ranges of the key space, and each owner answers each block about
that block's own keys only. So a key that a third of all documents hold costs
one entry for each block, and nothing of the size of the corpus is broadcast or
brought to the driver.

The first question is answered by a count-min sketch. A block's sketch is sent
sparsely (sorted counter numbers, delta-coded); an owner merges all blocks'
sketches of its range of counters into a dense one of bounded width, and tells
each block which of its counters stand at two or more. The number of counters
follows the number of keys, so the rate of false alarms doesn't grow. Nothing
that repeats can be missed.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, blank, mix, prepare, text_buffer

#: Average bytes of text in a block.
BLOCK_BYTES = 12 << 20
#: Counters that an owner merges at a time, as a power of two, and a row's counters for each key.
OWNED = 24
ROOM = 4
#: What a null doc_id counts as: it comes before all others.
NULL_ID = -(2**63)


def blocked(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(documents with their blocks, bytes of text): columns block, doc_id, has_id, text ("" for null). Dealt out by block."""
    spark = prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks = max(ceil(total / block_bytes), spark.sparkContext.defaultParallelism)
    out = docs.select(
        F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int").alias("block"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.col("doc_id").isNotNull().alias("has_id"),
        blank(text).alias("text"),
    )
    return out.repartition(blocks, "block"), total


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows in an order that doesn't depend on how they arrived."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def pieces(table: pa.Table, limit: int = 512 << 10):
    """(data, offsets, doc_ids, first row) of runs of rows of a block with about limit bytes of text."""
    table = table.combine_chunks()
    if not table.num_rows:
        return
    data, offsets = text_buffer(table.column("text"))
    ids = table.column("doc_id").to_numpy()
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], ids[at:to], at
        at = to


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed deltas."""
    if not len(values):
        return b""
    deltas = np.diff(values.astype(U64), prepend=U64(0))
    width = 2 if int(deltas.max()) < 1 << 16 else 4 if int(deltas.max()) < 1 << 32 else 8
    planes = deltas.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{blob[0]}").ravel(), dtype=U64)


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def places(some: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each of values stands in the sorted array some, or -1."""
    out = np.full(len(values), -1, np.int64)
    if not len(some) or not len(values):
        return out
    bits = U64((1 << max(16, min(24, (8 * len(some)).bit_length()))) - 1)
    table = np.zeros(int(bits) + 1, bool)
    table[some & bits] = True
    likely = np.flatnonzero(table[values & bits])
    found = values[likely]
    at = np.minimum(np.searchsorted(some, found), len(some) - 1)
    same = some[at] == found
    out[likely[same]] = at[same]
    return out


def member(some: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of values are in the sorted array some."""
    return places(some, values) >= 0


class Sketch:
    """The layout of a count-min sketch for about so many keys: depth rows of 2**bits counters, room for each key in a row."""

    def __init__(self, keys: int, depth: int, room: int = ROOM):
        self.depth = depth
        self.bits = max(OWNED, ceil(np.log2(max(keys, 1) * room)))

    def counters(self, keys: np.ndarray, row: int) -> np.ndarray:
        return mix(keys, 101 + row) >> U64(64 - self.bits)

    def sparse(self, keys: np.ndarray, block: int):
        """(owner, block, sorted counters, what they stand at, up to 255) for each row and range."""
        for row in range(self.depth):
            values = np.sort(self.counters(keys, row))
            first = np.ones(len(values), bool)
            first[1:] = values[1:] != values[:-1]
            starts = np.flatnonzero(first)
            values, counts = values[starts], np.minimum(np.diff(starts, append=len(values)), 255).astype(np.uint8)
            owners, cuts = np.unique(values >> U64(OWNED), return_index=True)
            for k, a, b in zip(owners.tolist(), cuts, np.append(cuts[1:], len(values)), strict=False):
                yield row << 32 | k, block, pack(values[a:b] - U64(k << OWNED)), squeeze(counts[a:b])

    def estimates(self, keys: np.ndarray, answers: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """How often each key occurs at most, up to 255, by the owners' answers; never less than it does, or than 1."""
        out = np.full(len(keys), 255, np.uint8)
        at = np.arange(len(keys))
        for row in range(self.depth):
            values, counts = answers.get(row, (np.zeros(0, U64), np.zeros(0, np.uint8)))
            where = places(values, self.counters(keys[at], row))
            out[at[where < 0]] = 1
            at, where = at[where >= 0], where[where >= 0]
            out[at] = np.minimum(out[at], counts[where])
        return out

    def repeated(self, keys: np.ndarray, answers: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which keys may occur twice."""
        return self.estimates(keys, answers) > 1


def merged(group: pa.Table) -> pa.Table:
    """An owner's work: add up all blocks' counters of one range, and list for each block those at two or more."""
    total = np.zeros(1 << OWNED, np.uint8)
    owner = group.column("owner")[0].as_py()
    blocks, blobs = group.column("block").to_pylist(), group.column("blob").to_pylist()
    for blob, counts in zip(blobs, group.column("counts").to_pylist(), strict=True):
        values, more = unpack(blob).astype(np.uint32), unsqueeze(counts)
        now = total[values]
        total[values] = now + np.minimum(more, 255 - now)
    out = []
    for block, blob in zip(blocks, blobs, strict=True):
        values = unpack(blob).astype(np.uint32)
        counts = total[values]
        again = counts >= 2
        if again.any():
            out.append((block, owner, pack(values[again]), squeeze(counts[again])))
    return rows_of(ANSWER, out)


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


SENT = pa.schema([("owner", pa.int64()), ("block", pa.int32()), ("blob", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("block", pa.int32()), ("owner", pa.int64()), ("blob", pa.binary()), ("counts", pa.binary())])
SENT_SQL, ANSWER_SQL = "owner long, block int, blob binary, counts binary", "block int, owner long, blob binary, counts binary"


def answers(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(sorted counters, what they stand at) by row, from the owners' answers to one block."""
    rows: dict[int, list] = {}
    for owner, blob, counts in sorted(zip(*(table.column(c).to_pylist() for c in ("owner", "blob", "counts")), strict=True)):
        rows.setdefault(owner >> 32, []).append((unpack(blob) + U64((owner & 0xFFFFFFFF) << OWNED), unsqueeze(counts)))
    return {row: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for row, parts in rows.items()}


def repeated_keys(blocks: DataFrame, keys_of: Callable[[pa.Table], np.ndarray], sketch: Sketch) -> DataFrame:
    """Owners' answers on the keys that keys_of finds in each block."""

    def sparse(table: pa.Table) -> pa.Table:
        return rows_of(SENT, list(sketch.sparse(keys_of(table), table.column("block")[0].as_py())))

    return blocks.groupBy("block").applyInArrow(sparse, SENT_SQL).groupBy("owner").applyInArrow(merged, ANSWER_SQL)


def with_answers(blocks: DataFrame, replies: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run work on each block and the answers to it; blocks without answers too."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right) if left.num_rows else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = blocks.sparkSession.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    assert isinstance(fields, StructType)
    empty = to_arrow_schema(fields).empty_table()
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, fields)


#: A key of 128 bits, made of two independent hashes, a document, and what its block wants to hear back: each key stands once for each block.
ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("at", "<i8")])


def entries_of(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), ENTRY)
    out["a"], out["b"], out["doc"], out["at"] = a, b, doc, at
    return out


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def dealt(entries: np.ndarray, block: int, owners: int):
    """(owner, block, blob) of entries, by the top bits of their keys."""
    if not len(entries):
        return
    owner = (entries["a"] >> U64(24)) % U64(owners)
    order = np.argsort(owner, kind="stable")
    entries = entries[order]
    names, cuts = np.unique(owner[order], return_index=True)
    for k, a, b in zip(names.tolist(), cuts, np.append(cuts[1:], len(entries)), strict=True):
        yield k, block, freeze(entries[a:b])


def freeze(entries: np.ndarray) -> bytes:
    """Entries byte plane by byte plane, which compresses ids and places to what they need."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(entries.view(np.uint8).reshape(len(entries), -1).T).tobytes())


def thaw(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(ENTRY.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(ENTRY).ravel()


def earlier_elsewhere(sent: DataFrame) -> DataFrame:
    """(block, blob): of the entries (owner, block, blob) that blocks sent, the field at of those whose key has a smaller document in another entry."""

    def earlier(group: pa.Table) -> pa.Table:
        blobs = [thaw(x) for x in group.column("blob").to_pylist()]
        blocks = group.column("block").to_pylist()
        every = np.concatenate(blobs)
        source = np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])
        order = np.lexsort((every["doc"], every["b"], every["a"]))
        every, source = every[order], source[order]
        new = heads(every["a"], every["b"])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = np.flatnonzero(every["doc"] != every["doc"][first])
        told, source = every["at"][late].astype(U64), source[late]
        order = np.lexsort((told, source))
        told, cuts = told[order], np.searchsorted(source[order], np.arange(len(blobs) + 1))
        some = [k for k in range(len(blobs)) if cuts[k + 1] > cuts[k]]
        return pa.table({"block": pa.array([blocks[k] for k in some], pa.int32()), "blob": pa.array([pack(told[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())})

    return sent.groupBy("owner").applyInArrow(earlier, "block int, blob binary")


def key_set(table: pa.Table) -> np.ndarray:
    """What all answers to a block tell, sorted."""
    parts = [unpack(x) for x in table.column("blob").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, U64)
