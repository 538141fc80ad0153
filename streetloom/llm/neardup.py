"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to eight dimensions or a multiple of it,
and each block of eight is decoded to the nearest point of the E8 lattice. A
vector is listed under its own cell in each table, and looks into the
neighbouring cells that lie nearest. Vectors that meet are verified by cosine
in double precision, and links become components. The number of blocks follows
the number of vectors, so that a cell's expected occupancy doesn't grow.

What travels to the cells isn't the vector but its direction in 16 bits a component, whose
error is bounded: a pair that it certifies is a link, one that it rules out is none, and the few pairs within the error
that no certain link joins yet are compared by the vectors themselves afterwards.

Cells are counted first. One that holds more than a bounded number of entries,
be it a dense region or the neighbour of one, is cut into pieces of owners and
pieces of entries that meet in tasks of their own, so no cell is one task's work.

Links never leave a component, so counts of links are then taken exactly
within components, in tiles of bounded size. What hashing can still miss is a
link between two components; recall is measured in the tests.

Tables are added with the blocks, so that recall doesn't fall as the input grows.
Equal vectors are one class throughout. Vectors that are null, zero, empty or hold null or
non-finite components link with nothing, and neither do rows without an id (their
component is null, and they are kept); vectors of different dimensions have no cosine. Rows that
share an id share a component and count each other as others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import U64, mix, prepare, table, written
from .topk import sound

#: Tables, for one block of eight dimensions, two, and so on: pairs at the threshold meet in one table with probability
#: 0.8, 0.37, 0.11 and 0.035, so these numbers keep recall above 0.95. Four blocks serve up to 1e14 vectors.
TABLES = (4, 8, 28, 96)
#: Cells that a vector looks into besides its own in each table, for each block.
PROBES = 12
#: Cell width: a pair at the threshold differs by about this much in each projected coordinate.
STEP = 0.25
#: Vectors that a cell of the densest region may hold before a further block of eight dimensions is hashed, and the
#: cells that one block tells apart.
OCCUPANCY, CELLS = 64, 700
#: Rows of a tile, rows of it that are compared at once, and rows of a bucket of cells.
TILE, STRIP, BUCKET = 4_096, 512, 10_000
#: Entries of one cell that are compared in one piece; the owners and the entries of a fuller cell are cut into pieces
#: of about this size, and every piece of owners meets every piece of entries.
CROWD = 4_096
#: Components of a direction are whole numbers of this part of one, in 16 bits.
GRAIN = 32_767


@lru_cache(1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, by rule: two coordinates of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        if signs.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if signs >> i & 1 else 0.5 for i in range(8)]))
    return np.array(out)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: the better of the nearest points of D8 and of D8 shifted by one half."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        rest = y - near
        odd = np.flatnonzero(near.sum(1) % 2 != 0)
        worst = np.argmax(np.abs(rest[odd]), axis=1)
        near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    better = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    whole[better] = half[better]
    return whole


def cells(unit: np.ndarray, number: int, blocks: int, probes: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(own cell, neighbouring cells) of unit vectors in table number, as hashes."""
    dim = unit.shape[1]
    rng = np.random.default_rng([number, blocks, dim])
    # differences of length sqrt(0.2), the threshold's, come to step in each coordinate
    x = unit @ (rng.standard_normal((dim, 8 * blocks)) * step / np.sqrt(0.2)) + rng.random(8 * blocks)
    points = [decode_e8(x[:, 8 * b : 8 * b + 8]) for b in range(blocks)]

    def name(p: np.ndarray, b: int) -> np.ndarray:
        h = np.full(len(p), mix(np.array([number * 64 + b + 1], U64))[0])
        for c in np.rint(2 * p).astype(np.int64).view(U64).T:
            h = mix(h ^ (c * U64(0x9E3779B97F4A7C15)))
        return h

    whole = [name(p, b) for b, p in enumerate(points)]
    own = whole[0].copy()
    for h in whole[1:]:
        own ^= h
    # a step to a neighbour v from residual r costs |v|^2 - 2 r.v; the cheapest steps over all blocks are probed
    shell = neighbours()
    cost = np.hstack([2 - 2 * (x[:, 8 * b : 8 * b + 8] - points[b]) @ shell.T for b in range(blocks)])
    pick = np.argpartition(cost, min(probes, cost.shape[1] - 1), axis=1)[:, :probes]
    near = np.empty(pick.shape, U64)
    for k in range(pick.shape[1]):
        for b in range(blocks):
            at = np.flatnonzero(pick[:, k] // 240 == b)
            near[at, k] = own[at] ^ whole[b][at] ^ name(points[b][at] + shell[pick[at, k] % 240], b)
    return own, near


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(col: pa.Array, rows: np.ndarray) -> np.ndarray:
    lengths, flat = col.value_lengths().to_numpy(), col.flatten().to_numpy()
    starts = (np.cumsum(lengths) - lengths)[rows]
    return flat[starts[:, None] + np.arange(lengths[rows[0]])].astype(np.float64)


def _entries(col: pa.Array, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cells, whether they are the vector's own, rows) of a column of vectors, one dimension at a time."""
    tables, probes = TABLES[blocks - 1], PROBES * blocks
    lengths = col.value_lengths().to_numpy()
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        unit = units(_matrix(col, rows))
        keys, own, who = [], [], []
        for t in range(tables):
            mine, near = cells(unit, t, blocks, probes, STEP)
            keys += [mine, near.ravel()]
            own += [np.ones(len(mine), bool), np.zeros(near.size, bool)]
            who += [rows, np.repeat(rows, near.shape[1])]
        yield np.concatenate(keys).view(np.int64), np.concatenate(own), np.concatenate(who)


def _sizes(blocks: int):
    """(key, owners, entries) of the cells of each batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for keys, own, _ in _entries(b.column(0), blocks):
                key, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at[own], minlength=len(key))), pa.array(np.bincount(at))], ["key", "owners", "entries"])

    return run


def coarse(unit: np.ndarray) -> pa.Array:
    """Unit vectors as 16 bits a component."""
    width = 2 * unit.shape[1]
    offsets = np.arange(len(unit) + 1) * width
    return pa.Array.from_buffers(pa.binary(), len(unit), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.rint(unit * GRAIN).astype("<i2").tobytes())])


def slack(dim: int) -> float:
    """How far a product of two coarse vectors may be off: each is off by half a grain a component at most, and single precision adds its own."""
    off = np.sqrt(dim) / 2 / GRAIN
    return 2 * off + off * off + dim * 2.0**-22


def _listed(blocks: int):
    """key, own, rep, h and v, the coarse vector, of every entry."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, hashes, col = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            for keys, own, who in _entries(col, blocks):
                rows = np.unique(who)
                small = coarse(units(_matrix(col, rows)))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own), pa.array(ids[who]), pa.array(hashes[who]), small.take(pa.array(np.searchsorted(rows, who)))], ["key", "own", "rep", "h", "v"])

    return run


def _dealt(listed: DataFrame, crowds: DataFrame) -> DataFrame:
    """key, own, asks, rep, h and v: entries of crowded cells under a key for each pair of a piece of owners and a piece of entries."""
    x = listed.join(crowds, "key", "left").filter("owners IS NULL OR owners > 0")  # without owners nothing is met
    i, j = F.pmod(F.xxhash64("h"), F.col("owners")), F.pmod(F.xxhash64("h", F.lit(1)), F.col("entries"))
    place = lambda i, j, own: F.struct(F.xxhash64("key", i, j).alias("key"), F.lit(own).alias("own"), F.lit(not own).alias("asks"))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asking = F.transform(up_to("owners"), lambda k: place(k, j, False))
    owning = F.when(F.col("own"), F.transform(up_to("entries"), lambda k: place(i, k, True))).otherwise(F.array().cast("array<struct<key:bigint,own:boolean,asks:boolean>>"))
    plain = F.array(F.struct("key", "own", F.lit(True).alias("asks")))
    return x.select(F.explode(F.when(F.col("owners").isNull(), plain).otherwise(F.concat(asking, owning))).alias("at"), "rep", "h", "v").select("at.key", "at.own", "at.asks", "rep", "h", "v")


def _met(least: float):
    """Links among the rows of a bucket of cells: for each vector the smallest one it is joined to, and as (ha, hb) the pairs of vectors that have to be compared exactly."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        col = t.column("v").combine_chunks()
        lengths = pc.binary_length(col).to_numpy()
        nothing = np.zeros(0, np.int64)
        sure_a, sure_b, open_a, open_b, open_ha, open_hb = ([nothing] for _ in range(6))
        for wide in np.unique(lengths):
            rows = np.flatnonzero(lengths == wide)
            key, own, asks, rep, h = (t.column(c).to_numpy()[rows] for c in ("key", "own", "asks", "rep", "h"))
            some = col.take(pa.array(rows)) if len(rows) < len(col) else col
            first = np.frombuffer(some.buffers()[1], np.int32)[some.offset]
            rough = np.frombuffer(some.buffers()[2], "<i2", len(rows) * wide // 2, int(first)).reshape(len(rows), wide // 2).astype(np.float32) / np.float32(GRAIN)
            off = slack(wide // 2)
            owners = np.flatnonzero(own)
            owners = owners[np.argsort(key[owners], kind="stable")]
            low, high = np.searchsorted(key[owners], key, "left"), np.searchsorted(key[owners], key, "right")
            n = np.where(asks, high - low, 0)
            todo = np.flatnonzero(n)
            cuts = np.flatnonzero(np.diff(np.cumsum(n[todo]) // 200_000, prepend=-1))
            for at in np.split(todo, cuts[1:]):
                if not len(at):
                    continue
                left = np.repeat(at, n[at])
                right = owners[np.arange(len(left)) - np.repeat(np.cumsum(n[at]) - n[at], n[at]) + np.repeat(low[at], n[at])]
                new = rep[left] != rep[right]
                left, right = left[new], right[new]
                near = np.einsum("ij,ij->i", rough[left], rough[right])
                sure, maybe = near >= least + off, (near >= least - off) & (near < least + off)
                sure_a.append(rep[left[sure]])
                sure_b.append(rep[right[sure]])
                for out, x in zip((open_a, open_b, open_ha, open_hb), (rep[left[maybe]], rep[right[maybe]], h[left[maybe]], h[right[maybe]]), strict=True):
                    out.append(x)
        a, b, ask_a, ask_b, ha, hb = (np.concatenate(x) for x in (sure_a, sure_b, open_a, open_b, open_ha, open_hb))
        names, flat = np.unique(np.concatenate([a, b, ask_a, ask_b]), return_inverse=True)
        label, (x, y, p, q) = np.arange(len(names)), np.split(flat, np.cumsum([len(a), len(b), len(ask_a)]))
        while True:
            before = label.copy()
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            label = label[label]
            if (label == before).all():
                break
        moved = np.flatnonzero(label != np.arange(len(names)))
        # pairs that certain links join already need no comparison
        apart = label[p] != label[q]
        pairs = np.unique(np.column_stack([np.minimum(ha[apart], hb[apart]), np.maximum(ha[apart], hb[apart])]), axis=0)
        none = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(moved), pa.int64())
        cols = [(names[label[moved]], none[0]), (names[moved], none[0]), (none[1], pairs[:, 0]), (none[1], pairs[:, 1])]
        return pa.table({c: pa.concat_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64())]) for c, (u, w) in zip(("a", "b", "ha", "hb"), cols, strict=True)})

    return run


def _verified(least: float):
    """Links (a, b) of pairs with their vectors (a, b, va, vb)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            va, vb = batch.column(2), batch.column(3)
            lengths = va.value_lengths().to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                keep[rows] = np.einsum("ij,ij->i", units(_matrix(va, rows)), units(_matrix(vb, rows))) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _counted(least: float):
    """Links of the rows in a bucket of tiles: for each vector, the copies of the others that it links with."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("component", "ascending"), ("i", "ascending"), ("j", "ascending")])
        comp, i, j, chunk, rep, copies = (t.column(c).to_numpy() for c in ("component", "i", "j", "chunk", "rep", "copies"))
        col = t.column("v").combine_chunks()
        lengths = col.value_lengths().to_numpy()
        new = np.ones(len(comp), bool)
        new[1:] = (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.append(np.flatnonzero(new), len(comp))
        reps, links = [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            for dim in np.unique(lengths[a:z]):
                rows = np.flatnonzero(lengths[a:z] == dim) + a
                unit = units(_matrix(col, rows))
                first = chunk[rows] == i[a]
                second = first if i[a] == j[a] else ~first
                x, y = rows[first], rows[second]
                if not len(x) or not len(y):
                    continue
                here, there = np.zeros(len(x)), np.zeros(len(y))
                left, right, more, most = unit[first], unit[second].T, copies[x].astype(np.float64), copies[y].astype(np.float64)
                for k in range(0, len(x), STRIP):
                    close = left[k : k + STRIP] @ right >= least
                    if i[a] == j[a]:
                        close[np.arange(len(close)), np.arange(k, k + len(close))] = False
                    close = close.astype(np.float64)  # counts are far below 2**53
                    here[k : k + STRIP] = close @ most
                    there += more[k : k + STRIP] @ close
                reps.append(rep[x])
                links.append(here)
                if i[a] != j[a]:
                    reps.append(rep[y])
                    links.append(there)
        return pa.table({"rep": np.concatenate(reps), "links": np.concatenate(links).astype(np.int64)})

    return run


def near_duplicates(df: DataFrame, least: float = 0.9, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept of each row; rows link at a cosine of least or more."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("v"))
    good = rows.filter(F.col("id").isNotNull() & sound("v") & F.exists("v", lambda x: x != 0))
    # ids of classes are their smallest; equal ids of different vectors meet again as links below
    classes = written(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("h", F.xxhash64("v")), "vectors")
    n = classes.count()
    blocks = min(len(TABLES), max(1, round(log(max(n / OCCUPANCY, 1)) / log(CELLS))))
    listed = classes.select("rep", "h", "v").mapInArrow(_listed(blocks), "key long, own boolean, rep long, h long, v binary")
    buckets = max(1, ceil(n * TABLES[blocks - 1] * (1 + PROBES * blocks) / BUCKET))
    sizes = classes.select("v").mapInArrow(_sizes(blocks), "key long, owners long, entries long").groupBy("key").agg(F.sum("owners").alias("owners"), F.sum("entries").alias("entries"))
    # written, so that Spark knows its size and broadcasts it only if it is small
    crowds = written(sizes.filter(F.col("entries") > CROWD).select("key", *(F.ceil(F.col(c) / CROWD).alias(c) for c in ("owners", "entries"))), "crowds")
    met = written(_dealt(listed, crowds).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(_met(least), "a long, b long, ha long, hb long"), "met")
    one, two = (classes.select(F.col("h").alias(f"h{c}"), F.col("rep").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    open_pairs = met.filter("ha IS NOT NULL").select("ha", "hb").distinct().join(one, "ha").join(two, "hb").select("a", "b", "va", "vb")
    links = met.filter("ha IS NULL").select("a", "b").unionByName(open_pairs.mapInArrow(_verified(least), "a long, b long"))
    shared_ids = good.join(classes.select("v", "rep"), "v").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    named = written(connected_components(links.unionByName(shared_ids)), "components")
    members = classes.join(named.withColumnRenamed("node", "rep"), "rep")
    chunks = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("chunks"))
    placed = members.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", F.xxhash64("v").alias("rep"), "copies", "v")
    spread = max(1, ceil(n / 20_000))
    counts = tiles.withColumn("bucket", F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("component"), F.lit(spread))).otherwise(F.xxhash64("component", "i", "j"))).groupBy("bucket").applyInArrow(_counted(least), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))
    known = written(classes.select("v", "rep", "copies", "h").join(counts.withColumnRenamed("rep", "h"), "h", "left").join(named.withColumnRenamed("node", "rep"), "rep", "left").select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c")), "known")
    return rows.join(known, ["v"], "left").select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_lattice_neardup(spark, sf_dir: str) -> DataFrame:
    """All vectors whose cosine is 0.9 or more, as counts of links and components; see the module for nulls, ties and repeated rows."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
