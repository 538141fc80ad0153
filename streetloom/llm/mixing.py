"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut into blocks of equal bytes, in an order by hash.
Block j (from 0) of a source of weight w is released at slot floor(j / w) and due at
slot ceil((j + 1) / w); one block runs in each slot, the released one with
the earliest deadline. Weights sum to one as fractions, without rounding, so every deadline is
met, and after any number of slots each source is less than one block off its target.

Every block has ``block_bytes`` of its source's text, or more where the mix would take more than SLOTS slots: then it is cut into SLOTS.
So the schedule has a bounded size whatever the corpus and however many sources there are. The schedule covers the whole mix: as many slots as
it takes until each source has been through once at its weight. A source's blocks follow one another through its bytes and begin again at its
end (the next epoch), in the middle of a block if need be, so no document is left out and weights hold in bytes, to the end and for sources smaller than a block.
What the slowest source has left after its last block, less than one, goes with that block.

A source whose target is less than one block in the whole mix can't fill a block.
All such sources share the blocks of a pool that has the sum of their weights and spreads over the
whole mix; each comes once, or as often as its target holds its bytes, rounded up or down by a hash of its name, so it is less than one block off its target too,
and the pool as a whole near its own.

A null source counts as the source "". Empty and null texts have no
bytes and go with the block where they stand, those of a source without any bytes once; repeated rows each get a place. A document is
never cut: it stands in the block where it begins, so a text longer than a block brings its source ahead by what is beyond, and blocks that begin and end within one document have no rows.
Columns of docs may have any names but those with two leading underscores that mix() adds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from heapq import heappop, heappush
from math import ceil, isfinite, lcm, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table, written

#: Bytes of text in a block, at least, and slots of a schedule, at most.
BLOCK_BYTES = 64 << 10
SLOTS = 1 << 17
#: Default target weights: a source's share of all bytes to this power, made to sum to one.
TEMPERATURE = 0.9
#: Documents of a source that are ordered together, about.
CHUNK = 2_000
#: What pooled sources have in place of a number; repetitions of a row that are made at once.
POOL, RUN = -1, 1024


def schedule(weights: Sequence[Fraction], slots: int) -> list[list[int]]:
    """The slots of each weight's blocks, by earliest deadline among released blocks; weights sum to one. A first block is due at the end at the latest."""
    whole = lcm(*(w.denominator for w in weights)) if weights else 1
    parts = [int(w * whole) for w in weights]
    waiting = [(0, s, 0) for s in range(len(parts))]  # (release, source, block), a heap
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    out: list[list[int]] = [[] for _ in parts]
    for slot in range(slots if parts else 0):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heappop(waiting)
            due = -(-(j + 1) * whole // parts[s])
            heappush(ready, (min(due, slots) if j == 0 else due, s, j))
        _, s, j = heappop(ready)
        out[s].append(slot)
        heappush(waiting, ((j + 1) * whole // parts[s], s, j + 1))
    return out


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block_bytes: int = BLOCK_BYTES, source: str = "source", text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs with __source, __epoch, __slot and __offset (bytes of its source, or of the pool, before it); a row for each epoch of a document.

    weights names every source; by default TEMPERATURE sets them.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("__bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    totals = rows.groupBy("__source").agg(F.sum("__bytes").alias("bytes"), F.count("*").alias("n"))
    if weights is None:
        totals = totals.withColumn("w", F.pow(F.greatest("bytes", F.lit(1)).cast("double"), F.lit(TEMPERATURE)))
    else:
        if not all(w > 0 and isfinite(w) for w in weights.values()):
            raise ValueError("weights must be positive")
        named = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "__source string, w double")
        totals = totals.join(named, "__source", "left")
    totals = written(totals, "sources")
    if missing := totals.filter("w IS NULL").limit(3).collect():
        raise ValueError(f"no weight for {sorted(r['__source'] for r in missing)}")
    sums = totals.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.max(F.col("bytes") / F.col("w")).alias("stretch")).first()
    # bytes of the mix in which the slowest source gets through once
    reach = (sums["stretch"] or 0) * (sums["w"] or 0)
    block = max(block_bytes, ceil(reach / SLOTS))
    slots = max(1, ceil(reach / block))
    big = F.col("w") * slots >= sums["w"]
    large = totals.filter(big).orderBy("__source").collect() if sums["n"] else []  # at most as many as slots
    pool = totals.filter(~big).agg(F.sum("w").alias("w"), F.sum("bytes").alias("bytes")).first() if sums["n"] else {"w": None}
    lanes = [(k, r["__source"], Fraction(r["w"]), r["bytes"]) for k, r in enumerate(large)]
    if pool["w"] is not None:
        lanes.append((POOL, None, Fraction(pool["w"]), pool["bytes"]))
    whole = sum(w for _, _, w, _ in lanes)
    served = schedule([w / whole for _, _, w, _ in lanes], slots)
    # how often a pooled source comes: its target over its bytes, rounded by a hash so that sums keep the pool's target
    often = F.floor(F.col("w") / F.lit(float(whole or 1)) * F.lit(float(slots) * block) / F.col("bytes") + F.pmod(F.xxhash64("__source"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    pooled = totals.filter(~big).select("__source", F.when(F.col("bytes") > 0, F.greatest(often, F.lit(1))).otherwise(F.lit(1)).cast("long").alias("__times"), "bytes")
    pool_bytes = (pooled.agg(F.sum(F.col("bytes") * F.col("__times"))).first()[0] or 0) if pool["w"] is not None else 0
    plan, places = [], []
    for (lane, name, _, size), at in zip(lanes, served, strict=True):
        n = max(1, len(at))
        total = pool_bytes if lane == POOL else size
        plan.append((name, lane, n, max(1, -(-total // n)) if lane == POOL else block, total, 1 if lane == POOL or not total else max(1, -(-n * block // total))))
        places.append(np.stack([np.full(len(at), lane), np.arange(len(at)), np.array(at, np.int64)]))
    plan = spark.createDataFrame(plan, "__source string, __lane long, __blocks long, __size long, __total long, __epochs long")
    flat = np.concatenate(places, axis=1).astype(np.int64) if places else np.zeros((3, 0), np.int64)
    places = spark.createDataFrame(pa.table({"__lane": flat[0], "__j": flat[1], "__slot": flat[2]}))

    # a document's bytes before it in its source: within a chunk of the hash order, and before the chunk
    bits = max(1, ceil(log2(max(2, (sums["n"] or 0) / CHUNK))))
    known = F.broadcast(plan.filter("__source IS NOT NULL").select("__source", "__lane"))
    rows = rows.join(known, "__source", "left").withColumn("__lane", F.coalesce("__lane", F.lit(POOL)))
    ties = [f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    again = _counted(rows.filter(F.col("__lane") == POOL).join(pooled.select("__source", "__times"), "__source"), "__times", "__epoch").drop("__times")
    rows = rows.filter(F.col("__lane") != POOL).withColumn("__epoch", F.lit(0).cast("long")).unionByName(again)
    rows = rows.withColumn("__hash", F.when(F.col("__epoch") == 0, F.xxhash64(id, text)).otherwise(F.xxhash64(id, text, "__epoch"))).withColumn("__chunk", F.shiftright("__hash", 64 - bits))
    chunks = rows.groupBy("__lane", "__chunk").agg(F.sum("__bytes").alias("__sum"))
    before = Window.partitionBy("__lane").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("__lane", "__chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__lane", "__chunk").orderBy("__hash", id, F.xxhash64(*ties)).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__within", F.coalesce(F.sum("__bytes").over(within), F.lit(0))).join(chunks, ["__lane", "__chunk"])
    placed = placed.withColumn("__offset", F.col("__base") + F.col("__within")).join(F.broadcast(plan.drop("__source")), "__lane")
    large = F.col("__lane") != POOL
    placed = _counted(placed.withColumn("__from", F.col("__epoch")), "__epochs", "__epoch")
    turn = F.expr("(__epoch * __total + __offset) div __size")
    # in the first epoch what is left after the last block stays in it; later ones end there
    j = F.when(large & (F.col("__epoch") > 0), turn).otherwise(F.least(F.expr("__offset div __size"), F.col("__blocks") - 1))
    placed = placed.withColumn("__j", j).withColumn("__epoch", F.when(large, F.col("__epoch")).otherwise(F.col("__from")))
    return placed.join(F.broadcast(places), ["__lane", "__j"]).select(*docs.columns, "__source", "__epoch", "__slot", "__offset")


def _counted(rows: DataFrame, times: str, out: str) -> DataFrame:
    """Each row as often as times says, with out from 0 on; in runs, so that no array is long."""
    runs = rows.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(RUN).cast("long"))))
    return runs.withColumn(out, F.explode(F.sequence("__run", F.least(F.col(times) - 1, F.col("__run") + RUN - 1)))).drop("__run")


def op10_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """Every document's slots in the mix, of all epochs; see the module for nulls, ties and repeated rows."""
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("__source").alias("source"), F.col("__epoch").alias("epoch"), F.col("__slot").alias("slot"), F.col("__offset").alias("source_offset"))
