"""Exact top-k by inner product with dual cover trees over queries and data.

Both sides are indexed by cover trees: a node is one of its points and a
radius that covers all points below it; its children are centres more than half the radius
apart that cover all its points within half the radius, the node's own point first. Children
of very few points share leaves. For a query node (centre q, radius r) and a data node (x, s)
no inner product exceeds q.x + r|x| + s|q| + rs. The walk goes down both trees over pairs
of nodes; a pair is left out when its bound is less than the worst k-th score so far among the
node's queries, so ties are kept and results are exact.

Queries are dealt to blocks and data to slabs. A task holds a block's queries, their tree and their k
best so far, and streams a slab's data through, a tree at a time; scores carry over
from tree to tree. Each task sends k rows a query. Nothing is sent to the driver or to all executors.

Vectors that are null or empty or hold null or non-finite components, and rows without an id,
take no part; a query sees vectors of its own dimension only, and not the rows of its own id. Equal
scores go to the smaller id; repeated rows are candidates each, but one query; different vectors of one
query id share its k places. Scores are exact integers; one beyond 64 bits counts as the nearest number of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import joined, prepare, table

#: Queries that a task holds, and bytes of their vectors, at most about.
QUERY_BLOCK, QUERY_BYTES = 16_384, 32 << 20
#: Data rows under one tree, points in a leaf, and points of a cover that is a node of its own; smaller ones share leaves.
TREE_ROWS, LEAF, COVER = 2_048, 64, 4
LOW, HIGH = -(2**63), 2**63 - 1


def sound(vec: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    v = F.col(vec)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


class CoverTree:
    """Nodes as arrays: centre and radius; inner nodes have kids, leaves hold rows of ``points``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.kids: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        todo = [(self._node(0, np.arange(len(points))), np.arange(len(points)), 0)] if len(points) else []
        while todo:
            node, rows, center = todo.pop()
            if len(rows) <= LEAF or self.radius[node] == 0:
                self.rows[node] = rows
                continue
            loose = []
            for child, members in self._covers(rows, center, self.radius[node] / 2):
                if len(members) >= COVER:
                    kid = self._node(child, members)
                    self.kids[node].append(kid)
                    todo.append((kid, members, child))
                else:
                    loose.append(members)
            held = np.concatenate(loose) if loose else rows[:0]
            for a in range(0, len(held), LEAF):
                bundle = held[a : a + LEAF]
                kid = self._node(int(bundle[0]), bundle)
                self.rows[kid] = bundle
                self.kids[node].append(kid)
        self.c = np.array(self.center).reshape(len(self.center), points.shape[1])
        self.r = np.array(self.radius)
        self.norm = np.sqrt((self.c**2).sum(1))

    def _node(self, center: int, rows: np.ndarray) -> int:
        d = self.points[rows] - self.points[center]
        self.center.append(self.points[center])
        # a hair more than the rounded distance, so that the node surely covers its points
        self.radius.append(float(np.sqrt((d * d).sum(1).max())) * (1 + 1e-9))
        self.kids.append([])
        self.rows.append(None)
        return len(self.center) - 1

    def _covers(self, rows: np.ndarray, center: int, radius: float):
        """(centre, rows) of covers within radius: the farthest row is the next centre until all rows are near one."""
        points = self.points[rows]
        norms = (points * points).sum(1)
        near = np.full(len(rows), np.inf)
        owner, centers = np.zeros(len(rows), np.int64), [int(np.flatnonzero(rows == center)[0])]
        while True:
            at = centers[-1]
            d = norms + norms[at] - 2 * (points @ points[at])  # rounding moves a border, not a bound: radii are measured
            d[at] = -1.0
            closer = d < near
            owner[closer] = len(centers) - 1
            near[closer] = d[closer]
            far = int(np.argmax(near))
            if near[far] <= radius * radius:
                break
            centers.append(far)
        order = np.argsort(owner, kind="stable")
        for at, members in zip(centers, np.split(order, np.searchsorted(owner[order], np.arange(1, len(centers)))), strict=True):
            yield int(rows[at]), rows[members]


class Best:
    """The k best of each query so far: scores and ids, best first; places still empty have the id HIGH."""

    def __init__(self, ids: np.ndarray, k: int):
        self.queries, self.k = ids, k
        self.scores, self.ids = np.full((len(ids), k), LOW, np.int64), np.full((len(ids), k), HIGH, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates for queries rows: scores [row, id]; a query's own id is none."""
        own = self.queries[rows][:, None] == ids[None, :]
        at, col = np.nonzero((scores >= self.scores[rows, -1][:, None]) & ~own)
        if not len(at):
            return
        q = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        s = np.concatenate([self.scores[rows].ravel(), scores[at, col]])
        i = np.concatenate([self.ids[rows].ravel(), ids[col]])
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, without overflow
        first = np.searchsorted(q[order], np.arange(len(rows)))
        pick = order[first[:, None] + np.arange(self.k)]
        self.scores[rows], self.ids[rows] = s[pick], i[pick]

    def worst(self, rows: np.ndarray) -> float:
        """The least k-th score; below all bounds where a query has fewer than k candidates."""
        return float(self.scores[rows, -1].min()) if (self.ids[rows, -1] < HIGH).all() else -np.inf


def walk(queries: CoverTree, below: list[np.ndarray], data: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Dual traversal; below: the queries under each query node. Returns how many pairs of rows were scored."""
    scored = 0
    todo = [(0, np.array([0]))] if len(queries.points) and len(data.points) else []
    while todo:
        q, nodes = todo.pop()
        rows = below[q]
        bound = data.c[nodes] @ queries.c[q]
        room = queries.r[q] * data.norm[nodes] + data.r[nodes] * queries.norm[q] + queries.r[q] * data.r[nodes]
        bound += room + 1e-9 * (np.abs(bound) + room + queries.norm[q] * data.norm[nodes])
        keep = bound >= best.worst(rows)
        nodes, bound = nodes[keep], bound[keep]
        if not len(nodes):
            continue
        inner = np.array([data.rows[n] is None for n in nodes.tolist()])
        if queries.rows[q] is None and not (inner.any() and data.r[nodes].max() > queries.r[q]):
            todo += [(kid, nodes) for kid in queries.kids[q]]
            continue
        if queries.rows[q] is not None and not inner.any():
            for part in np.array_split(nodes[np.argsort(-bound)], -(-len(nodes) // 16)):  # the most promising first
                top = data.c[part] @ queries.c[q] + queries.r[q] * data.norm[part] + data.r[part] * queries.norm[q] + queries.r[q] * data.r[part]
                part = part[top * (1 + 1e-9 * np.sign(top)) + 1e-9 * queries.norm[q] * data.norm[part] >= best.worst(rows)]
                if len(part):
                    members = np.concatenate([data.rows[n] for n in part.tolist()])
                    scored += len(rows) * len(members)
                    best.add(rows, (queries.points[rows] @ data.points[members].T).astype(np.int64), ids[members])
            continue
        wide = inner & (data.r[nodes] >= data.r[nodes][inner].max() / 2)
        kids = [k for n in nodes[wide].tolist() for k in data.kids[n]]
        todo.append((q, np.concatenate([nodes[~wide], np.array(kids, np.int64)])))
    return scored


def _below(tree: CoverTree) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(tree.rows)
    for n in range(len(tree.rows) - 1, -1, -1):  # kids have larger numbers
        out[n] = tree.rows[n] if tree.rows[n] is not None else np.concatenate([out[k] for k in tree.kids[n]])
    return out


def whole_numbers(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * x) as floats, which rows are too large for exact float products)."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * float(scale))
    return out, ~(np.abs(out).max(1) < sqrt(2**53 / vectors.shape[1]) / 2)


def exact_products(a: np.ndarray, b: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of floor(scale * x) by whole numbers of any size, cut to 64 bits."""
    left, right = ([[floor(Fraction(x) * scale) for x in v] for v in m.tolist()] for m in (a, b))
    return np.array([[min(HIGH, max(LOW, sum(x * y for x, y in zip(v, w, strict=True)))) for w in right] for v in left], np.int64).reshape(len(a), len(b))


class Held:
    """A block's queries of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, scale: int):
        self.scale, self.raw, self.best = scale, vectors, Best(ids, k)
        points, self.large = whole_numbers(vectors, scale)
        self.small = np.flatnonzero(~self.large)
        self.large = np.flatnonzero(self.large)
        self.tree = CoverTree(points[self.small])
        self.below = _below(self.tree)
        self.small_best = Best(ids[self.small], k)
        self.scored = 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        points, large = whole_numbers(vectors, self.scale)
        small = np.flatnonzero(~large)
        if len(small) and len(self.small):
            self.scored += walk(self.tree, self.below, CoverTree(points[small]), ids[small], self.small_best)
        for rows, others in ((self.large, np.arange(len(ids))), (self.small, np.flatnonzero(large))):
            if len(rows) and len(others):
                self.best.add(rows, exact_products(self.raw[rows], vectors[others], self.scale), ids[others])

    def found(self):
        """(query id, id, score) arrays: both kinds' best."""
        for best in (self.best, self.small_best):
            at, rank = np.nonzero(best.ids < HIGH)
            yield best.queries[at], best.ids[at, rank], best.scores[at, rank]


def _by_dimension(b: pa.RecordBatch):
    """(dimension, ids, vectors) of a batch's rows."""
    ids, col = b.column(b.schema.get_field_index("id")).to_numpy(), b.column(b.schema.get_field_index("v"))
    lengths, flat = col.value_lengths().to_numpy(), col.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, ids[at], flat[starts[at][:, None] + np.arange(d)]


def _searcher(k: int, scale: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def groups(it: Iterator[pa.RecordBatch]):
        """(key, q, batch) of runs of rows of one key and side, in batches of about TREE_ROWS."""
        held, size, last = [], 0, None
        for b in it:
            name = b.column(0).to_numpy() * 2 + b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(name)) + 1).tolist(), len(name)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z == a:
                    continue
                if held and (name[a] != last or size >= TREE_ROWS):
                    yield last, joined(held)
                    held, size = [], 0
                held.append(b.slice(a, z - a))
                size, last = size + z - a, name[a]
        if held:
            yield last, joined(held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, held = None, {}, {}

        def found():
            for h in held.values():
                for cols in h.found():
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

        for name, b in groups(it):
            if name // 2 != key:
                yield from found()
                key, waiting, held = name // 2, {}, {}
            for d, ids, vectors in _by_dimension(b):
                if name % 2 == 0:  # queries come first
                    waiting.setdefault(d, []).append((ids, vectors))
                    continue
                if d in waiting:
                    held[d] = Held(*(np.concatenate(x) for x in zip(*waiting.pop(d), strict=True)), k, scale)
                if d in held:
                    held[d].meet(ids, vectors)
        yield from found()

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vec: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows by the inner product of floor(scale * x)."""
    spark = prepare(df.sparkSession)
    rows = df.filter(F.col(id).isNotNull() & sound(vec)).select(F.col(id).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, asked, wide = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    blocks = max(1, ceil((asked or 0) / min(QUERY_BLOCK, max(LEAF, QUERY_BYTES // (8 * (wide or 1))))))
    slabs = max(1, min(ceil(2 * spark.sparkContext.defaultParallelism / blocks), ceil(n / TREE_ROWS)))
    # each block of queries meets each slab of data once; a key is a pair of them
    spot = lambda parts, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(parts))
    queries = rows.filter("q").dropDuplicates(["id", "v"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))).select((spot(blocks, 1) * slabs + F.col("j")).alias("key"), F.lit(False).alias("side"), "id", "v")
    data = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select((F.col("i") * slabs + spot(slabs, 2)).alias("key"), F.lit(True).alias("side"), "id", "v")
    met = queries.unionByName(data).repartition(blocks * slabs, "key").sortWithinPartitions("key", "side")
    found = met.mapInArrow(_searcher(k, scale), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_cover_topk(spark, sf_dir: str) -> DataFrame:
    """Every 50th vector against all others: the 5 best by integer inner product; see the module for nulls, ties and repeated rows."""
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)
