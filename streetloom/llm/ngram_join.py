"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, as components.

1. A sketch of hashed counts finds the n-grams that may stand in two documents. A set
   of which less than the threshold is such can link with nothing and is done.
2. Equal sets become one class; the smallest doc_id stands for it.
3. Once more for classes. What remains is ordered by the sketch's counts, n-grams
   of one class first, and then by hash. Sets that link share an n-gram among the first
   n - ceil(t n) + 1, their prefix (and n-grams of one class match nothing).
4. A tile is a prefix n-gram and a band of set sizes; sets visit the next larger
   band, as linked sizes differ by the threshold at most. Two sets that link do so
   in the tile of the first n-gram that both prefixes hold, where all that they
   share comes after it in both; a visit to a tile where the set has too little left
   for the tile's smallest set is left out.
5. In each round the members of a tile are compared with one of them, first the one
   with fewest n-grams of its class alone, which joins a group of copies in
   linear work. Bit counts of hashed bitmaps bound overlaps from above, and what passes
   is settled by intersecting sorted arrays.
6. Exact rest: tiles whose members share a component by now hold nothing new.
   The others give all their pairs of different components that sizes and places
   allow, each pair once, to the same bitmaps and intersections.

Tiles with many members are cut into chunks that meet pairwise. Sets are
compared by 64-bit hashes of their n-grams, equal sets found by 128 bits. Null and empty texts
have empty sets and link with nothing, and so do rows without a doc_id (their component is
null); rows that share a doc_id count as one document. Other columns are ignored. A
document is never cut: a worker holds about fifty times the bytes of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .exchange import Sketch, answers, blocked, pieces, repeated_keys, with_answers
from .shared import U64, dropped, mix, range_hashes, run_hashes, table, words, written

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD_BYTES = 5
#: One row with more room sends half of what two rows do; its false alarms (an eighth at most) only let a set through to the exact steps.
DEPTH, ROOM = 1, 8
#: Rounds of comparing with one member of each tile; the first round looks at so many of a set's first prefix n-grams.
ROUNDS, LEADERS = 2, 3
#: Members of a chunk of a tile, and bits of a bitmap for each n-gram.
TILE, BITS = 512, 4
#: Up to so many pairs are sent to all executors (16 MB); more are joined by shuffles.
FEW = 1_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's n-grams; of all its words, if they are fewer."""
    data = LOWER[data]
    start, end, doc = words(data, offsets)
    hashes = range_hashes(data, start, end)
    cuts = np.searchsorted(doc, np.arange(len(offsets)))
    every = run_hashes(hashes, size)
    out = []
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if z - a >= size:
            out.append(np.unique(every[a : z - size + 1]))
        elif z > a:
            out.append(mix(run_hashes(hashes[a:z], z - a), z - a))
        else:
            out.append(np.zeros(0, U64))
    return out


def least_overlap(n: int, num: int, den: int) -> int:
    """Fewest n-grams that a set of n must share to link: ceil(n * num / den)."""
    return -(-n * num // den)


def signature(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of at least BITS bits for each hash, a power of two; halves that are or-ed give the bitmap of half the size."""
    bits = max(64, 1 << ceil(log(max(BITS * len(hashes), 1), 2)))
    out = np.zeros(bits, bool)
    out[(mix(hashes, 5) & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(U64)


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bitmap.reshape(-1, size), axis=0)


def most_shared(a: np.ndarray, own_a: int, b: np.ndarray, own_b: int) -> int:
    """An upper bound of the overlap of two sets: each bit of one that the other lacks is an element that they don't share."""
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    return min(own_a - int(np.bitwise_count(a & ~b).sum()), own_b - int(np.bitwise_count(b & ~a).sum()))


def jaccard_components(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (4, 5), text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each document; two link at a Jaccard similarity of threshold (a fraction) or more."""
    num, den = threshold
    blocks, total = blocked(docs, text)
    sketch = Sketch(total // WORD_BYTES, DEPTH, ROOM)
    ratio = log(den / num)

    def keys_of(t: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, U64), *(s for data, offsets, _, _ in pieces(t) for s in shingle_sets(data, offsets, size))])

    def shared_sets(t: pa.Table, replies: pa.Table) -> pa.Table:
        flagged, block = answers(replies), t.column("block")[0].as_py()
        known = t.column("has_id").to_numpy(zero_copy_only=False)
        ids, n, sa, sb, sets, leads = t.column("doc_id").to_pylist(), [], [], [], [], {}
        for data, offsets, _, row in pieces(t):
            found = shingle_sets(data, offsets, size)
            every = np.concatenate(found)
            repeated = sketch.repeated(every, flagged)
            at = 0
            for k, s in enumerate(found):
                mine = repeated[at : at + len(s)]
                at += len(s)
                n.append(len(s))
                sets.append(None)
                if len(s) and known[row + k] and int(mine.sum()) >= least_overlap(len(s), num, den):
                    sa.append(int(mix(s, 7).sum(dtype=U64).view(np.int64)))
                    sb.append(int(mix(s, 8).sum(dtype=U64).view(np.int64)))
                    key = (len(s), sa[-1], sb[-1])
                    if key not in leads or ids[row + k] < ids[leads[key][0]]:
                        leads[key] = (row + k, s[mine])
                else:
                    sa.append(None)
                    sb.append(None)
        for row, s in leads.values():
            sets[row] = s.tobytes()
        return pa.table({"block": pa.array([block] * len(n), pa.int32()), "doc_id": t.column("doc_id"), "has_id": t.column("has_id"), "n": pa.array(n, pa.int64()), "sa": pa.array(sa, pa.int64()), "sb": pa.array(sb, pa.int64()), "set": pa.array(sets, pa.binary())})

    rows = written(with_answers(blocks, repeated_keys(blocks, keys_of, sketch), shared_sets, "block int, doc_id long, has_id boolean, n long, sa long, sb long, set binary"), "sets")
    classes = written(rows.filter("sa is not null").groupBy("n", "sa", "sb").agg(F.min("doc_id").alias("rep")), "classes")
    reps = rows.filter("set is not null").join(classes, ["n", "sa", "sb"]).filter("doc_id = rep").select("block", "rep", "n", "set")

    def set_keys(t: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for x in t.column("set").to_pylist())])

    def prefixes(t: pa.Table, replies: pa.Table) -> pa.Table:
        flagged = answers(replies)
        out = []
        for rep, n, blob in zip(t.column("rep").to_pylist(), t.column("n").to_pylist(), t.column("set").to_pylist(), strict=True):
            s = np.frombuffer(blob, U64)
            often = sketch.estimates(s, flagged)
            s, often = s[often > 1], often[often > 1]
            # n-grams of this class alone come first in the order, and match nothing
            keys = n - least_overlap(n, num, den) + 1 - (n - len(s))
            if keys > 0:
                out.append((rep, n, int(log(n) / ratio + 1e-9), len(s), signature(s).tobytes(), s.tobytes(), s[np.argsort(often, kind="stable")][:keys].view(np.int64).tolist()))
        cols = list(zip(*out, strict=True)) or [()] * 7
        return pa.table({n: pa.array(c, y) for n, c, y in zip(("rep", "n", "band", "own", "bits", "set", "keys"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)})

    reps = written(reps, "reps")
    dealt = reps.repartition("block")
    sets = written(with_answers(dealt, repeated_keys(dealt, set_keys, sketch), prefixes, "rep long, n long, band int, own long, bits binary, set binary, keys array<long>"), "prefixes")
    dropped(reps)
    entries = sets.select("rep", "n", "own", "band", F.posexplode("keys").alias("place", "key"))
    held: list[DataFrame] = [sets]

    def few(pairs: DataFrame) -> DataFrame:
        return F.broadcast(pairs) if pairs.count() <= FEW else pairs

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link: bitmaps bound the overlap from above, and what passes is settled by intersecting sorted arrays."""
        pairs = written(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        asked = written(sets.join(few(ids), "rep").select("rep", "n", "own", "bits", "set"), "asked")
        side = lambda k: asked.select(F.col("rep").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "own", "bits", "set")))
        both = pairs.join(side("a"), "a").join(side("b"), "b")

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in it:
                keep = []
                for na, oa, xa, sa, nb, ob, xb, sb in zip(*(t.column(f"{c}_{k}").to_pylist() for k in "ab" for c in ("n", "own", "bits", "set")), strict=True):
                    good = (num + den) * most_shared(np.frombuffer(xa, U64), oa, np.frombuffer(xb, U64), ob) >= num * (na + nb)
                    if good:
                        overlap = len(np.intersect1d(np.frombuffer(sa, U64), np.frombuffer(sb, U64), assume_unique=True))
                        good = den * overlap >= num * (na + nb - overlap)
                    keep.append(good)
                yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        out = written(both.mapInArrow(run, "a long, b long"), "linked")
        held.append(out)
        dropped(pairs)
        dropped(asked)
        return out

    def enough(own, place, n, other):
        """Whether a set may link with one of other n-grams if this n-gram is the first of both prefixes that they share: what comes after it must do."""
        return (num + den) * (F.col(own) - F.col(place)) >= num * (F.col(n) + F.col(other))

    def tiles(labels: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame]:
        """(visits of classes to tiles, the tiles whose members have different components): visits that can link with no set of their tile's sizes are left out."""
        placed = entries.withColumn("label", F.col("rep")) if labels is None else entries.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
        at = F.array(F.struct(F.col("band").alias("tile"), F.lit(False).alias("visitor")), F.struct((F.col("band") + 1).alias("tile"), F.lit(True).alias("visitor")))
        visits = placed.select("rep", "n", "own", "label", "key", "place", F.explode(at).alias("t")).select("rep", "n", "own", "label", "key", "place", "t.*")
        # the set with fewest n-grams of its own is likely to be the one that its copies were made from
        order = F.struct((F.col("n") - F.col("own")).alias("alone"), F.xxhash64("rep", F.lit(seed)).alias("o"), "rep", "n", "label", "own", "place")
        sums = [F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("visitor").alias("strangers"), F.min("n").alias("least")]
        mixed = "lo < hi AND NOT strangers"
        found = visits.groupBy("key", "tile").agg(*sums).filter(mixed).select("key", "tile", "least")
        visits = written(visits.join(found, ["key", "tile"]).filter(enough("own", "place", "n", "least")).drop("least"), "visits")
        return visits, visits.groupBy("key", "tile").agg(*sums, F.count("*").alias("members"), F.min(order).alias("lead")).filter(mixed)

    links = labels = None
    for seed in range(ROUNDS):
        visits, mixed = tiles(labels, seed)
        near = (F.col("label") != F.col("lead.label")) & (den * F.least("n", "lead.n") >= num * F.greatest("n", "lead.n")) & enough("own", "place", "n", "lead.n") & enough("lead.own", "lead.place", "lead.n", "n")
        there = visits.filter(F.col("place") < LEADERS) if labels is None else visits
        asked = there.join(mixed.select("key", "tile", "lead"), ["key", "tile"]).filter(near).select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()
        new = verified(asked)
        links = new if links is None else links.unionByName(new)
        labels = written(connected_components(links), "labels")
        dropped(visits)
        held.append(labels)

    visits, mixed = tiles(labels, ROUNDS)
    here = visits.join(mixed.select("key", "tile", F.ceil(F.col("members") / TILE).cast("int").alias("chunks")), ["key", "tile"])
    side = lambda k: (F.col(c).alias(f"{c}_{k}") for c in ("n", "own", "place", "label", "visitor"))
    left = here.select("key", "tile", F.col("rep").alias("a"), *side("a"), F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"))
    right = here.select("key", "tile", F.col("rep").alias("b"), *side("b"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    apart = (F.col("a") != F.col("b")) & (F.col("label_a") < F.col("label_b")) & ~(F.col("visitor_a") & F.col("visitor_b"))
    sizes = (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")) & enough("own_a", "place_a", "n_a", "n_b") & enough("own_b", "place_b", "n_b", "n_a")
    more = verified(left.join(right, ["key", "tile", "chunk"]).filter(apart & sizes).select("a", "b").distinct())
    dropped(visits)
    # rows that share a doc_id are one document: it links the classes of its texts
    owners = rows.filter("sa is not null").join(classes, ["n", "sa", "sb"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    every = more.unionByName(owners) if links is None else links.unionByName(more).unionByName(owners)
    final = written(connected_components(every), "components")
    named = written(classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "sa", "sb", F.coalesce("component", "rep").alias("component")), "named")
    for df in (*held, final, classes):
        dropped(df)
    got = rows.select("doc_id", "has_id", "n", "sa", "sb").join(named, ["n", "sa", "sb"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    one = got.filter("has_id").select("doc_id", F.col("n").alias("n_shingles"), F.min("component").over(Window.partitionBy("doc_id")).alias("component_id"))
    lost = got.filter("not has_id").select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return one.unionByName(lost)


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of distinct 5-word shingles overlap by 80 % or more; see the module for nulls, ties and repeated rows."""
    return jaccard_components(table(spark, sf_dir, "documents"))
