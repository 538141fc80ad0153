"""What the corpus operators share: session settings, shared storage, Arrow helpers and vectorised hashing.

Every operator moves text through ``mapInArrow``; the Arrow string layout (one
byte buffer plus offsets) lets numpy work on a whole batch at once.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, shared_dir, ship_package  # noqa: F401

#: Rows in an Arrow batch. Small, so that a batch of very long documents still fits a worker's memory.
BATCH_ROWS = 256

U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Set the Arrow batch size that the operators count on; on a local master, let Python workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)
    return spark


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs don't depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/streetloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when the driver's garbage is collected, which may be much later."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def blank(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; no copy."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x.astype(U64, copy=True)
    if seed:
        x ^= U64((seed * 0xD6E8FEB86659FD93) & (2**64 - 1))
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two; not linear, so that patterns in sequences of hashes cannot cancel."""
    out = x * U64(0x9E3779B97F4A7C15)
    out += y
    out ^= out >> U64(32)
    out *= U64(0xD6E8FEB86659FD93)
    out ^= out >> U64(29)
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(32)
    return out


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each width neighbouring hashes, by doubling; the last step overlaps."""
    out, have = hashes, 1
    while have < width:
        step = min(have, width - have)
        if len(out) <= step:
            return np.zeros(0, U64)
        out = paired(out[:-step], out[step:])
        have += step
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


#: Longer byte ranges are hashed by a library, one by one.
LONG_RANGE = 256


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time; seeds give independent hashes."""
    size, view = end - start, eights(data)
    out = mix(size.astype(U64), seed + 1)
    long = size > LONG_RANGE
    at = np.flatnonzero(~long & (size > 0))
    done = 0
    while len(at):
        rest = size[at] - done
        x = view[start[at] + done]
        short = rest < 8
        x[short] &= (U64(1) << (8 * rest[short]).astype(U64)) - U64(1)
        out[at] = paired(out[at], x)
        at = at[rest > 8]
        done += 8
    for k in np.flatnonzero(long).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), seed)
    return out


class ByteHashes:
    """Hashes of byte ranges of a buffer that have SPAN bytes at least: of overlapping spans, combined."""

    SPAN = 32

    def __init__(self, data: np.ndarray, seed: int = 0):
        #: A hash of each SPAN bytes.
        self.spans = run_hashes_of_bytes(data, self.SPAN, seed)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(U64), 5)
        for k in range(-(-int(size.max(initial=0)) // self.SPAN)):
            at = np.flatnonzero(size > k * self.SPAN) if k else np.flatnonzero(size >= self.SPAN)
            out[at] = paired(out[at], self.spans[np.minimum(start[at] + k * self.SPAN, end[at] - self.SPAN)])
        return out


def run_hashes_of_bytes(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of each width bytes (8 times a power of two)."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, U64)
    out, have = mix(eights(data)[:n], seed + 1), 8
    while have < width:
        if len(out) <= have:
            return np.zeros(0, U64)
        out = paired(out[:-have], out[have:])
        have *= 2
    return out


#: White space as the word rules of the corpus operators have it: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of bytes that aren't white space; runs never cross documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    first, last = offsets[filled], offsets[filled + 1] - 1
    begins[first] = inside[first]
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def batches(it: Iterator[pa.RecordBatch], limit: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Join small Arrow batches up to about limit bytes of text, and cut larger ones."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
