"""Token counts of documents in flat token files that have no index.

A flat file is token ids, one after another as 16- or 32-bit little-endian
numbers, with an end-of-document id after each document, and nothing else. Files are
read in byte ranges of fixed size that ignore documents, so a file may be of any length. Each range
is searched for the separator at once and gives the lengths between separators, the tokens before its
first and after its last one; a prefix scan over each file's ranges, three numbers each, numbers the
separators and carries unfinished documents across borders.

A document without tokens counts 0; tokens after a file's last separator
belong to a document that has no end, which is reported only if there are any. Bytes after
the last whole id are ignored. Which document stands where isn't in the files: the writer returns a
list of its own. Files are opened through Arrow's file systems (local, hdfs, s3, gs), not through Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .shared import blank, prepare, shared_dir, table, written

#: Tokens in a range, and bytes of ranges that one task reads, about.
BLOCK_TOKENS, TASK_BYTES = 1 << 18, 64 << 20
#: An id that the vocabulary leaves free ends a document.
END = 50_256


def write_token_files(df: DataFrame, folder: str, vocabulary: str, pattern: str, id: str = "doc_id", text: str = "text", end: int = END, width: int = 2) -> DataFrame:
    """Encode texts into flat files in a folder that all executors share, a file for each partition; (file, ordinal, id) of each document.

    The rows name the files of the tasks that succeeded; another attempt's file has another name and is in no row.
    An id that is the separator or doesn't fit the width raises ValueError.
    """
    prepare(df.sparkSession)
    source = df.select(F.col(id).alias("id"), blank(text).alias("text"))
    kind = f"<u{width}"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out, ordinal, name = codec(vocabulary, pattern), None, 0, f"{uuid.uuid4().hex}.bin"
        try:
            for b in it:
                if out is None and b.num_rows:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path)
                    out = store.open_output_stream(f"{path}/{name}")
                for x in b.column(1).to_pylist():
                    ids = bpe.encode(x)
                    if len(ids) and (ids.max() >= 1 << 8 * width or (ids == end).any()):
                        raise ValueError("an id is the separator or too wide")
                    out.write(np.append(ids, end).astype(kind).tobytes())
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), b.column(0)], ["file", "ordinal", "id"])
                ordinal += n
        finally:
            if out is not None:
                out.close()

    return source.mapInArrow(run, f"file string, ordinal long, id {source.schema['id'].dataType.simpleString()}")


def count_tokens(files: DataFrame, folder: str, end: int = END, width: int = 2, block_tokens: int | None = None) -> DataFrame:
    """(file, ordinal, n_tokens) of the documents in flat files (file) of a folder; ordinal is from 0 in each file."""
    spark = prepare(files.sparkSession)
    step, kind = (block_tokens or BLOCK_TOKENS) * width, f"<u{width}"

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for b in it:
            for name in b.column(0).to_pylist():
                size = store.get_file_info(f"{path}/{name}").size // width * width
                at = np.arange(0, max(size, 1), step)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.arange(len(at))), pa.array(at), pa.array(np.minimum(step, size - at))], ["file", "block", "at", "size"])

    def searched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for b in it:
            for name, block, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with store.open_input_file(f"{path}/{name}") as f:
                    f.seek(at)
                    ids = np.frombuffer(f.read(size), kind)
                ends = np.flatnonzero(ids == end)
                head, tail = (int(ends[0]), len(ids) - int(ends[-1]) - 1) if len(ends) else (len(ids), len(ids))
                inner = pa.ListArray.from_arrays(pa.array([0, max(0, len(ends) - 1)], pa.int32()), pa.array((np.diff(ends) - 1).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), *(pa.array([v], pa.int64()) for v in (len(ends), head, tail)), inner], ["file", "block", "n", "head", "tail", "inner"])

    ranges = written(files.select("file").distinct().repartition("file").mapInArrow(listed, "file string, block long, at long, size long"), "ranges")
    total = ranges.agg(F.sum("size")).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, total // TASK_BYTES)
    sums = written(ranges.repartition(tasks, "file", "block").mapInArrow(searched, "file string, block long, n long, head long, tail long, inner array<long>"), "lengths")
    # the scan: separators before a range, and the tokens of the document that is open at its start
    narrow = sums.select("file", "block", "n", "head", "tail")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    scan = narrow.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # ranges between two separators form a run; its first range has the separator that starts it
    run_of = Window.partitionBy("file", "first").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = scan.groupBy("file", (F.col("first") + F.col("n")).alias("first")).agg(F.max(F.when(F.col("n") > 0, F.col("tail"))).alias("open"))
    scan = scan.withColumn("middle", F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("head"))).over(run_of), F.lit(0))).join(start, ["file", "first"], "left")
    scan = scan.withColumn("carried", F.coalesce("open", F.lit(0)) + F.col("middle"))
    borders = scan.filter("n > 0").select("file", "block", "first", (F.col("carried") + F.col("head")).alias("whole"))
    done = borders.select("file", F.col("first").alias("ordinal"), F.col("whole").alias("n_tokens"))
    inside = sums.filter("n > 1").select("file", "block", "inner").join(borders, ["file", "block"]).select("file", "first", F.posexplode("inner").alias("k", "n_tokens"))
    done = done.unionByName(inside.select("file", (F.col("first") + 1 + F.col("k")).alias("ordinal"), "n_tokens"))
    # what follows a file's last separator
    every = narrow.groupBy("file").agg(F.sum("n").alias("ordinal"))
    rest = scan.withColumn("after", F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("head"))).withColumn("o", F.col("first") + F.col("n")).groupBy("file", F.col("o").alias("ordinal")).agg(F.sum("after").alias("n_tokens"))
    return done.unionByName(rest.join(every, ["file", "ordinal"]).filter("n_tokens > 0").select("file", "ordinal", "n_tokens"))


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Write all documents to flat token files, then count each document's tokens from the files alone; doc_id comes from the writer's list."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/streetloom-token-files-{uuid.uuid4().hex}"
    names = written(write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), "token-names")
    return names.select("file", "ordinal", F.col("id").alias("doc_id")).join(count_tokens(names, folder), ["file", "ordinal"]).select("doc_id", "n_tokens")
