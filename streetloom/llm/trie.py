"""A prefix trie over conversations, built level by level.

Forward, each depth groups the conversations that still share their node by (parent node, next turn); the least conv_id of a group
names the child. A conversation that is alone in its node leaves the loop: the rest of its path is a chain that needs no grouping, so
the levels end where the longest shared prefix does, however long single conversations are. Backward, each level joins the sums of the one
below: children, leaves, tokens saved. Turns are compared by the SHA-256 of role and text, which is computed once.

Every level is a table in the shared folder. A hot node (a first turn that a third of all conversations has) is counted by partial sums, and
its name goes back to its conversations in PIECES copies. Ids of conversations that end in one node are joined in ranges first and
hashed as a stream, so no list of them is held.

Defined results: a null role or text is empty; equal turns are ordered by role and then by their hash; rows without a conv_id belong to no
conversation and are left out; an empty table has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import blank, ship_package, table, written

#: Copies of a shared node's name, dealt among its conversations; ids joined to one string before they are hashed; depths of a chain made at once.
PIECES, IDS, CHAIN = 8, 4096, 1024

#: Words are runs of characters other than these white spaces.
WORD = r"[^\x20\x09-\x0D]+"

EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words): each conversation's turns in order, from 0; key identifies role and text.

    Rows are cut into ranges of (conv_id, turn), numbered in each and shifted by what earlier ranges hold, so that a
    conversation of any length is spread over tasks.
    """
    role, text = blank("role"), blank("text")
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc()]
    ranged = written(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")).filter("shift > 0")
    within = Window.partitionBy("conv_id", "part").orderBy(*order)
    numbered = ranged.withColumn("at", F.row_number().over(within) - 1).join(shift, ["conv_id", "part"], "left")
    return numbered.select("conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).cast("long").alias("pos"), "key", "words")


def rebuilt(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """Conversations that start with another one's first turns.

    heads (conv_id, base, h): the first h turns of conversation base (all if there are fewer, none if it is absent), then the conversation's own
    turns after its first h. turns (conv_id, pos, key, words); the result has its columns.
    """
    most = heads.agg(F.max("h")).first()[0] or 0
    source = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    taken = written(heads.join(source, "base").filter("pos < h").select("conv_id", "pos", "key", "words"), "heads")
    begin = heads.select("conv_id", "h").join(taken.groupBy("conv_id").agg(F.count("*").alias("taken")), "conv_id", "left").select("conv_id", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    own = turns.join(begin, "conv_id").filter("pos >= h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "key", "words")
    return taken.unionByName(own)


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of conversations (conv_id, unique) with turns (conv_id, pos from 0, key, words).

    conv_id is the least member, parent_conv_id the parent's name; n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens
    (over the subtree, (n_convs - 1) * words of the node's turn), ends_sha256 (of the ids of conversations that end here, joined by commas).
    """
    turns = written(turns.repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "placed")  # a level reads only its rows
    ids = written(conversations.join(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).cast("long").alias("length")), "conversations")
    root = ids.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).first()
    live = ids.select("conv_id", "length", F.lit(root["node"]).cast("long").alias("node"))
    shared, chains, ends = [], [], []
    if root["n"]:
        shared.append(written(ids.agg(F.min("conv_id").alias("node"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words")), "level"))
    depth = 0
    while shared and len(shared) == depth + 1:
        depth += 1
        ends.append(live.filter(F.col("length") < depth).select(F.lit(depth - 1).cast("long").alias("depth"), "node", "conv_id"))
        going = written(live.filter(F.col("length") >= depth).join(turns.filter(F.col("pos") == depth - 1).select("conv_id", "key", "words"), "conv_id"), "going")
        groups = going.groupBy(F.col("node").alias("parent"), "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
        groups = written(groups, "groups")
        many = groups.filter("n_convs > 1")
        chains.append(groups.filter("n_convs = 1").select(F.col("node").alias("conv_id"), "parent", F.lit(depth).cast("long").alias("top")))
        if many.isEmpty():
            break
        shared.append(many.select("node", "parent", "n_convs", "words"))
        dealt = many.select("parent", "key", F.col("node").alias("child"), F.explode(F.array(*map(F.lit, range(PIECES)))).alias("piece"))
        mine = going.withColumn("piece", F.pmod(F.xxhash64("conv_id"), F.lit(PIECES)).cast("int")).withColumnRenamed("node", "parent")
        live = written(mine.join(dealt, ["parent", "key", "piece"]).select("conv_id", "length", F.col("child").alias("node")), "live")
    return _rolled_up(ids, shared, chains, ends)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _rolled_up(ids: DataFrame, shared: list[DataFrame], chains: list[DataFrame], ends: list[DataFrame]) -> DataFrame:
    """Sums of children, level by level from the deepest, and the chains below."""
    spark = ids.sparkSession
    if not shared:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in COLUMNS) + ", ends_sha256 string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    levels: list[DataFrame] = []
    for depth in reversed(range(len(shared))):
        # a chain is a child with one leaf that saves nothing
        below = chains[depth].select(F.col("parent").alias("node"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        if levels:
            below = below.unionByName(levels[-1].select(F.col("parent_conv_id").alias("node"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        sums = below.groupBy("node").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        level = shared[depth].join(sums, "node", "left").select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"), zero("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"))
        levels.append(written(level, "level"))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    ending = ends[0]
    for e in ends[1:]:
        ending = ending.unionByName(e)
    named = nodes.join(hashed_ids(ending), (F.col("conv_id") == F.col("node")) & (F.col("depth") == F.col("at")), "left").select(*COLUMNS, F.coalesce("hash", F.lit(EMPTY)).alias("ends_sha256"))
    alone = chains[0]
    for c in chains[1:]:
        alone = alone.unionByName(c)
    # a chain's depths are made in runs, so that none is one long array
    runs = alone.join(ids, "conv_id").withColumn("first", F.explode(F.sequence("top", F.greatest("length", "top"), F.lit(CHAIN).cast("long"))))
    steps = runs.withColumn("depth", F.explode(F.sequence("first", F.least("length", F.col("first") + CHAIN - 1))))
    last = F.col("depth") == F.col("length")
    chain = steps.select("conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"))
    return named.unionByName(chain)


def hashed_ids(ends: DataFrame) -> DataFrame:
    """(at, node, hash): SHA-256 of the conv_ids that end in a node (depth, node, conv_id), ascending, joined by commas.

    Ranges of ids become strings, in parallel for a node with many; the strings of a node then stream through one hash, so a task holds no more than one of them.
    """
    ship_package(ends.sparkSession)
    order = ["depth", "node", "conv_id"]

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            depth, node, conv = (b.column(k).to_pylist() for k in range(3))
            cut = [0, *(k for k in range(1, len(node)) if node[k] != node[k - 1] or depth[k] != depth[k - 1]), len(node)]
            spans = [(a, min(a + IDS, z)) for x, z in zip(cut, cut[1:], strict=False) for a in range(x, z, IDS)]
            yield pa.RecordBatch.from_pylist([{"depth": depth[a], "node": node[a], "first": conv[a], "ids": ",".join(map(str, conv[a:z]))} for a, z in spans], schema=joined)

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in it:
            out = []
            for depth, node, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (depth, node) != key:
                    if key:
                        out.append((*key, h.hexdigest()))
                    key, h = (depth, node), hashlib.sha256()
                    h.update(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("at", "node", "hash"), r, strict=True)) for r in out], schema=hashes)
        if key:
            yield pa.RecordBatch.from_pylist([{"at": key[0], "node": key[1], "hash": h.hexdigest()}], schema=hashes)

    joined = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    hashes = pa.schema([("at", pa.int64()), ("node", pa.int64()), ("hash", pa.string())])
    strings = written(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, node long, first long, ids string"), "ids")
    return strings.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "at long, node long, hash string")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that begin with up to three turns of the one whose id is the next lower multiple of 20."""
    source = table(spark, sf_dir, "conversations")
    turns = written(numbered_turns(source), "numbered")
    heads = source.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = written(heads.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h")), "heads")
    return prefix_trie(rebuilt(turns, heads), heads.select("conv_id"))
