"""Lloyd's rounds over integer vectors with Drake's adaptive bounds.

A vector keeps its cluster, an upper bound of the distance to it, lower bounds of the distances to the next nearest few centroids, and one lower
bound of all that remain. When centroids move, bounds move by how far; a vector is looked at again only where the order can't be
certified by them: first its own distance is made exact, then as many of the bounded centroids as the bounds ask for, and all of them only if
even the remainder isn't certified. Bounds are rounded outwards and must be strictly apart, so assignments, ties included, are
those of a full scan. The number of bounds follows what the rounds needed.

A round is one pass over the table of vectors and bounds, without a shuffle of vectors: tasks give sums of components for each cluster, as
exact numbers, and the driver holds nothing but the centroids (k vectors).

Defined results: vectors of another length, null ones and those with null or non-finite components take no part and give no row; rows that repeat a
vec_id are vectors of their own; a null vec_id comes last where seeds are chosen; with fewer vectors than k, each is a seed; an empty table gives
no row; other columns are ignored. Components of any size are exact; a distance, or a sum of distances, beyond a long is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, table, written

#: Sums travel in limbs of so many bits.
LIMB = 48

#: Relative slack of a bound, far above the rounding of the few operations between two scans.
SLACK = 1e-13

#: Scaled components below this have exact squares and sums in a double.
SMALL = 1 << 21


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that hold whole numbers where all are small, else Python's integers."""
    x = values.astype(np.float64)
    if not x.size or np.abs(x).max() * scale < SMALL:
        return np.floor(x * scale)  # scale is a power of two, so the product is exact
    flat = [math.floor(Fraction(v) * scale) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def limbs(value: int) -> list[int]:
    """value as sum of limb * 2^(LIMB * place); only the last may be negative."""
    out = []
    while not -(1 << LIMB - 1) <= value < 1 << LIMB - 1:
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return [*out, value]


def squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid, doubles where they hold them, else Python's integers."""
    if vectors.dtype != object and (not centroids.size or max(map(abs, centroids.ravel().tolist())) < SMALL):
        c = centroids.astype(np.float64)
        return (vectors**2).sum(1)[:, None] + (c**2).sum(1) - 2 * (vectors @ c.T)
    v, c = whole(vectors), centroids
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(v), 0), object)


def whole(vectors: np.ndarray) -> np.ndarray:
    return vectors if vectors.dtype == object else vectors.astype(np.int64).astype(object)


def _root(d: int) -> float:
    """Infinite beyond a double, which certifies nothing that isn't so."""
    try:
        return math.sqrt(d)
    except OverflowError:
        r = math.isqrt(d)
        return float(r) if r.bit_length() < 1024 else math.inf


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d) if d.dtype != object else np.array([_root(x) for x in d.ravel().tolist()], float).reshape(d.shape)


class Bounds:
    """State of a batch: cluster, upper bound, order (n, b) of the bounded centroids, lower (n, b), rest (n)."""

    def __init__(self, cluster, upper, order, lower, rest):
        self.cluster, self.upper, self.order, self.lower, self.rest = cluster, upper, order, lower, rest

    @classmethod
    def scan(cls, d: np.ndarray, b: int) -> Bounds:
        """From all squared distances (n, k); of equal ones the smaller number is first."""
        n, k = d.shape
        order = np.argsort(d, 1, kind="stable")
        r = np.take_along_axis(roots(d), order, 1)
        rest = r[:, b + 1] * (1 - SLACK) if k > b + 1 else np.full(n, np.inf)
        return cls(order[:, 0].astype(np.int32), r[:, 0] * (1 + SLACK), order[:, 1 : b + 1].astype(np.int32), r[:, 1 : b + 1] * (1 - SLACK), rest)

    def moved(self, drift: np.ndarray) -> None:
        """Centroids have moved by drift, rounded up."""
        self.upper = (self.upper + drift[self.cluster]) * (1 + SLACK)
        self.lower = np.maximum(self.lower - drift[self.order], 0) * (1 - SLACK)
        self.rest = np.maximum(self.rest - drift.max(initial=0), 0) * (1 - SLACK)

    def needed(self) -> np.ndarray:
        """How many bounded centroids must be looked at until all others are certified to be farther; b + 1 for a full scan."""
        ends = np.concatenate([self.lower, self.rest[:, None]], 1)
        least = np.minimum.accumulate(ends[:, ::-1], 1)[:, ::-1]  # least[:, i]: of all from the i-th on
        safe = self.upper[:, None] < least
        return np.where(safe.any(1), safe.argmax(1), ends.shape[1])

    def keep(self, b: int) -> None:
        """Fewer bounds: the remainder takes in those that go."""
        if b < self.lower.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, b:].min(1))
            self.order, self.lower = self.order[:, :b], self.lower[:, :b]

    def revise(self, vectors: np.ndarray, centroids: np.ndarray) -> tuple[int, int]:
        """Assign every vector again; (most bounded centroids looked at, distances computed)."""
        b = self.lower.shape[1]
        open_ = np.flatnonzero(self.needed())
        used, computed = 0, len(open_)
        if len(open_):  # the own distance alone may certify
            for c in np.unique(self.cluster[open_]).tolist():
                at = open_[self.cluster[open_] == c]
                self.upper[at] = roots(squares(vectors[at], centroids[c : c + 1])[:, 0]) * (1 + SLACK)
        need = self.needed()
        for i in np.unique(need[need > 0]).tolist():
            at = np.flatnonzero(need == i)
            if i > b:
                fresh = Bounds.scan(squares(vectors[at], centroids), b)
                self.cluster[at], self.upper[at], self.rest[at] = fresh.cluster, fresh.upper, fresh.rest
                self.order[at], self.lower[at] = fresh.order, fresh.lower
                computed += len(at) * len(centroids)
                continue
            used = max(used, i)
            names = np.concatenate([self.cluster[at, None], self.order[at, :i]], 1)
            d = np.take_along_axis(squares(vectors[at], centroids), names, 1) if len(centroids) <= 2 * (i + 1) else _chosen(vectors[at], centroids, names)
            computed += d.size
            by_name = np.argsort(names, 1)  # then of equal distances the smaller number is first
            names, d = np.take_along_axis(names, by_name, 1), np.take_along_axis(d, by_name, 1)
            near = np.argsort(d, 1, kind="stable")
            names, r = np.take_along_axis(names, near, 1), roots(np.take_along_axis(d, near, 1))
            self.cluster[at], self.upper[at] = names[:, 0], r[:, 0] * (1 + SLACK)
            self.order[at, :i], self.lower[at, :i] = names[:, 1:], r[:, 1:] * (1 - SLACK)
        return used, computed


def _chosen(vectors: np.ndarray, centroids: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to the centroids that names lists for it."""
    plain = vectors.dtype != object and max(map(abs, centroids.ravel().tolist())) < SMALL
    v, c = (vectors, centroids.astype(np.float64)) if plain else (whole(vectors), centroids)
    return np.stack([((v - c[names[:, j]]) ** 2).sum(1) for j in range(names.shape[1])], 1)


def _vectors(column: pa.Array, width: int, scale: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width), scale)


def _whole_list(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, object) if rows else np.zeros((0, 0), object)


class DrakeClustering:
    """k centroids from seeds, rounds of assignment and update, a last assignment.

    After run(), centroids are the final ones, and computed holds the distances that each pass computed (a full scan takes k for each vector).
    """

    def __init__(self, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1"):
        self.k, self.rounds, self.width, self.scale, self.seed = k, rounds, width, scale, seed
        self.centroids = np.zeros((0, width), object)
        self.computed: list[int] = []

    def kept(self, vectors: DataFrame, id: str, column: str) -> DataFrame:
        x = F.col(column)
        sound = x.isNotNull() & (F.size(x) == self.width) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
        return vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(id).alias("id"), x.cast("array<double>").alias("v"))

    def run(self, vectors: DataFrame, id: str = "vec_id", column: str = "embedding") -> DataFrame:
        """(id, cluster, distance): the final cluster of each vector that takes part and its squared distance there."""
        source = self.kept(vectors, id, column)
        key = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.col("id").cast("string")), 256)
        first = source.orderBy(key.asc_nulls_last(), "v").limit(self.k).select("v").collect()  # k vectors
        self.centroids = _whole_list([[math.floor(Fraction(x) * self.scale) for x in r["v"]] for r in first])
        if not len(self.centroids):
            return source.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        b = max(1, self.k // 4)
        least = max(1, self.k // 8)
        state, drift = source, None
        for _ in range(self.rounds):
            after = written(state.mapInArrow(self._pass(drift, b), self._fields()), "bounds")
            moved, used, computed = self._update(after)
            self.computed.append(computed)
            if drift is not None:
                dropped(state)
                b = min(b, max(least, used))
            state, drift = after.select("id", "v", "cluster", "upper", "order", "lower", "rest"), moved
        last = written(state.mapInArrow(self._pass(drift, b, last=True), "id long, cluster int, distance decimal(38,0), computed long"), "assigned")
        dropped(state)
        self.computed.append(last.agg(F.sum("computed")).first()[0] or 0)
        fits = F.col("distance").between(F.lit(0), F.lit(2**63 - 1))
        return last.filter("cluster IS NOT NULL").select("id", "cluster", F.when(fits, F.col("distance")).cast("long").alias("distance"))

    @staticmethod
    def _fields() -> str:
        return "id long, v array<double>, cluster int, upper double, order array<int>, lower array<double>, rest double, sums array<struct<cluster:int,place:int,limb:int,value:decimal(38,0)>>, counts array<long>, used int, computed long"

    def _pass(self, drift: np.ndarray | None, b: int, last: bool = False):
        """One pass over batches: assigned anew with bounds, and the batch's sums in its first row."""
        centroids, width, scale = self.centroids, self.width, self.scale
        k = len(centroids)
        b = min(b, max(k - 1, 0))
        rows = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, max(a.shape[1], 1), np.int32) if a.shape[1] else np.zeros(len(a) + 1, np.int32), pa.array(a.ravel()))
        alone = lambda value, n, kind: pa.array([value] + [None] * (n - 1), kind)
        sum_type = pa.list_(pa.struct([("cluster", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("value", pa.decimal128(38, 0))]))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                n = batch.num_rows
                if not n:
                    continue
                get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
                x = _vectors(get("v"), width, scale)
                if drift is None:
                    s, used, computed = Bounds.scan(squares(x, centroids), b), b, n * k
                else:
                    held = len(get("order")[0])
                    lists = lambda c, t: get(c).flatten().to_numpy(zero_copy_only=False).astype(t).reshape(n, held)  # noqa: E731, B023
                    s = Bounds(get("cluster").to_numpy().copy(), get("upper").to_numpy().copy(), lists("order", np.int32), lists("lower", np.float64), get("rest").to_numpy().copy())
                    s.keep(b)
                    s.moved(drift)
                    used, computed = s.revise(x, centroids)
                if last:
                    own = _chosen(x, centroids, s.cluster[:, None])[:, 0]
                    far = [int(d) for d in own.tolist()]
                    far = pa.array([d if d < 10**38 else -1 for d in far], pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays([get("id").cast(pa.int64()), pa.array(s.cluster), far, alone(computed, n, pa.int64())], ["id", "cluster", "distance", "computed"])
                    continue
                sums = []
                counts = np.bincount(s.cluster, minlength=k)
                for c in np.flatnonzero(counts).tolist():
                    for place, value in enumerate(x[s.cluster == c].sum(0).tolist()):
                        sums += [{"cluster": c, "place": place, "limb": l, "value": part} for l, part in enumerate(limbs(int(value)))]
                yield pa.RecordBatch.from_arrays(
                    [get("id").cast(pa.int64()), get("v"), pa.array(s.cluster), pa.array(s.upper), rows(s.order), rows(s.lower), pa.array(s.rest), alone(sums, n, sum_type), alone(counts.tolist(), n, pa.list_(pa.int64())), alone(used, n, pa.int32()), alone(computed, n, pa.int64())],
                    ["id", "v", "cluster", "upper", "order", "lower", "rest", "sums", "counts", "used", "computed"],
                )

        return run

    def _update(self, state: DataFrame) -> tuple[np.ndarray, int, int]:
        """Move centroids to the floored means; (how far each moved, rounded up; most bounds used; distances computed)."""
        parts = state.filter("computed IS NOT NULL")
        k = len(self.centroids)
        sums = parts.select(F.explode("sums").alias("s")).groupBy("s.cluster", "s.place", "s.limb").agg(F.sum("s.value").alias("value")).collect()  # k * width rows
        counts = {r["c"]: r["n"] for r in parts.select(F.posexplode("counts").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()}
        total = np.zeros((k, self.width), object)
        for r in sums:
            total[r["cluster"], r["place"]] += int(r["value"]) << LIMB * r["limb"]
        before = self.centroids
        self.centroids = np.array([[t // counts[c] for t in total[c]] if counts.get(c) else list(before[c]) for c in range(k)], object)
        used, computed = parts.agg(F.max("used"), F.sum("computed")).first()
        return np.array([_root(d) * (1 + SLACK) for d in ((self.centroids - before) ** 2).sum(1)], float), used or 0, computed or 0

    def digests(self) -> list[str]:
        """SHA-256 of each centroid's components, as decimal integers joined by commas."""
        return [hashlib.sha256(",".join(str(x) for x in c).encode()).hexdigest() for c in self.centroids.tolist()]


def op12_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final clusters of all sound vectors of 64 components with their distances and inertias."""
    model = DrakeClustering()
    found = model.run(table(spark, sf_dir, "embeddings"))
    long = lambda c: F.when(c.between(F.lit(0), F.lit(2**63 - 1)), c).cast("long")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost"))
    each = each.select("cluster", F.when(F.col("lost") == 0, F.col("s")).alias("s"))  # at most k rows
    whole = each.agg(F.when(F.count_if(F.col("s").isNull()) == 0, F.sum("s")).alias("t"))
    names = spark.createDataFrame(list(enumerate(model.digests())), "cluster int, centroid_sha256 string")
    both = each.crossJoin(F.broadcast(whole)).join(names, "cluster").select("cluster", long(F.col("s")).alias("cluster_inertia"), long(F.col("t")).alias("inertia"), "centroid_sha256")  # one row
    return found.join(F.broadcast(both), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
