"""Searches for cheap selections: Pareto fronts by brute force or greedily, and a budgeted beam search.

Distances come from distributed searches; the combinatorial steps work on the
metric closure of the candidates, whose size is checked before it is brought to the
driver, or on what matters of the reduced graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush, nsmallest
from itertools import chain, islice
from math import inf, isfinite

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, ship_package, written
from .contract import Contracted, sound
from .graph import FULL_WEIGHT, Graph
from .steiner import both_ways, tree_weight
from .traverse import closure, dealt, frontier_links, path_to_sources, released, shortest, top_by

#: Most candidates for brute force, most terminals whose closure the driver holds.
BRUTE_FORCE, CLOSURE = 20, 3_000
#: Links of a reduced graph that the driver holds, or of what matters of one; how many clusters states may add beyond their common ones before that is told anew.
HELD, ROOM = 5_000_000, 512
#: Fixed values of the budgeted search: states kept in a round, candidates tried from each.
BEAM, FANOUT = 24, 32


def mst_weight(dist: np.ndarray) -> float:
    """Of a dense distance matrix; 0 below two nodes, infinite if they aren't connected."""
    n = len(dist)
    if n < 2:
        return 0.0
    near, total, out = dist[0].copy(), 0.0, np.ones(n, bool)
    out[0] = False
    for _ in range(n - 1):
        k = int(np.argmin(np.where(out, near, inf))) if out.any() else 0
        if not out[k]:
            return inf
        total += float(near[k])
        out[k] = False
        near = np.minimum(near, dist[k])
    return total


def distance_matrix(edges: DataFrame, terminals: Sequence) -> np.ndarray:
    """Distances between terminals in their order, along edges (src, dst, w) both ways."""
    if len(terminals) > CLOSURE:
        raise ValueError(f"more than {CLOSURE} terminals")
    kind = dict(edges.dtypes)["src"]
    named = edges.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terminals)], f"node {kind}")
    place = {}
    for k, t in enumerate(terminals):
        place.setdefault(t, []).append(k)
    out = np.full((len(terminals), len(terminals)), inf)
    for ks in place.values():
        out[np.ix_(ks, ks)] = 0.0
    # places and distances come as columns, two numbers and a double a pair
    first = named.sparkSession.createDataFrame([(t, ks[0]) for t, ks in place.items()], f"node {kind}, k int")
    pairs = closure(edges, named).join(F.broadcast(first.withColumnsRenamed({"node": "a", "k": "i"})), "a").join(F.broadcast(first.withColumnsRenamed({"node": "b", "k": "j"})), "b")
    found = pairs.select("i", "j", F.col("dist").cast("double").alias("dist")).toArrow()
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["dist"].to_numpy()
    for ks in place.values():  # a terminal that is named twice
        for k in ks[1:]:
            out[k, :], out[:, k] = out[ks[0], :], out[:, ks[0]]
    return out


def _rows(spark: SparkSession, out: list[tuple], kind: str) -> DataFrame:
    return spark.createDataFrame(out, f"step long, selected array<{kind}>, size long, total_buildings long, tree_weight double")


def _subsets(dist: np.ndarray) -> Callable:
    def run(it):
        import pandas as pd

        for f in it:
            rows = []
            for mask in f["mask"]:
                pick = [i for i in range(len(dist)) if mask >> i & 1]
                rows.append((mask, len(pick), mst_weight(dist[np.ix_(pick, pick)])))
            yield pd.DataFrame(rows, columns=["mask", "size", "weight"])

    return run


def brute_force_pareto(edges: DataFrame, candidates: Sequence) -> DataFrame:
    """The undominated non-empty subsets of at most BRUTE_FORCE candidates, larger ones first.

    A subset is dominated by one of at least its size and at most its weight; of equal ones the first in binary order stays.
    """
    if len(candidates) > BRUTE_FORCE:
        raise ValueError(f"brute force takes {BRUTE_FORCE} candidates at most")
    spark = edges.sparkSession
    ship_package(spark)
    dist = distance_matrix(edges, candidates)
    subsets = spark.range(1, 1 << len(candidates)).withColumnRenamed("id", "mask").mapInPandas(_subsets(dist), "mask long, size long, weight double")
    # the best of each size, then those lighter than all larger sizes: at most BRUTE_FORCE rows are left for the driver
    best = subsets.groupBy("size").agg(F.min(F.struct("weight", "mask")).alias("m")).select("size", "m.weight", "m.mask").collect()
    front, least = [], inf
    for r in sorted(best, key=lambda r: -r["size"]):
        if r["weight"] < least or not front:
            front.append(r)
            least = r["weight"]
    kind = dict(edges.dtypes)["src"]
    return _rows(spark, [(k + 1, [c for i, c in enumerate(candidates) if r["mask"] >> i & 1], r["size"], None, r["weight"]) for k, r in enumerate(front)], kind)


class _Growing:
    """Spanning trees that grow by a node: only the old tree's edges and the new node's can stand in the new one."""

    def __init__(self, dist: np.ndarray):
        self.dist, self.nodes, self.tree = dist, [], []

    def weight(self, node: int) -> float:
        return self._with(node)[0]

    def _with(self, node: int):
        edges = sorted([*self.tree, *((float(self.dist[node, v]), node, v) for v in self.nodes if isfinite(self.dist[node, v]))])
        up = {v: v for v in [*self.nodes, node]}

        def find(v):
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        kept = []
        for w, a, b in edges:
            x, y = find(a), find(b)
            if x != y:
                up[x] = y
                kept.append((w, a, b))
        whole = len(kept) == len(self.nodes)
        return (sum((w for w, _, _ in kept), 0.0) if whole else inf), kept

    def add(self, node: int) -> None:
        self.tree = self._with(node)[1]
        self.nodes.append(node)


def _greedy(n: int, score: Callable[[list[int], int], float], stop: bool = False):
    """Picks one index at a time by least score; of equals the first in the list, where the last takes a picked one's place."""
    left, picked = list(range(n)), []
    while left:
        scores = [score(picked, i) for i in left]
        usable = [k for k, s in enumerate(scores) if isfinite(s)] if stop else range(len(left))
        if not usable:
            return
        if any(s != s for s in scores):
            raise ValueError("weights of disconnected candidates can't be compared")
        k = min(usable, key=lambda k: scores[k])
        picked.append(left[k])
        left[k] = left[-1]
        left.pop()
        yield list(picked)


def greedy_pareto(edges: DataFrame, candidates: Sequence) -> DataFrame:
    """A solution for each number of candidates: each adds the one that makes the lightest tree."""
    dist = distance_matrix(edges, candidates)
    out, grown = [], _Growing(dist)
    for picked in _greedy(len(candidates), lambda _, i: grown.weight(i)):
        weight = grown.weight(picked[-1])
        grown.add(picked[-1])
        out.append((len(picked), [candidates[i] for i in picked], len(picked), None, weight))
    return _rows(edges.sparkSession, out, dict(edges.dtypes)["src"])


def _greedy_ratio(edges: DataFrame, hubs: Sequence, names: Sequence, sizes: Sequence[int], kind: str, stop: bool) -> DataFrame:
    dist = distance_matrix(edges, hubs)
    out, grown, total, before = [], _Growing(dist), 0, 0.0

    def ratio(_, i):
        with np.errstate(all="ignore"):
            return float(np.float64(grown.weight(i) - before) / np.float64(sizes[i]))

    for picked in _greedy(len(hubs), ratio, stop):
        weight = grown.weight(picked[-1])
        grown.add(picked[-1])
        before, total = weight, total + sizes[picked[-1]]
        out.append((len(picked), [names[i] for i in picked], len(picked), total, weight))
    return _rows(edges.sparkSession, out, kind)


def greedy_cluster_pareto(graph: Graph, clusters: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Clusters in order of least added weight a building; a cluster's hub is its smallest building. Disconnected hubs raise ValueError. edges are graph's both ways, if they are there."""
    if edges is None:
        edges = written(graph.both_ways(FULL_WEIGHT), "edges")
    found = clusters.groupBy("cluster_id").agg(F.min("node").alias("hub"), F.count("*").alias("n")).orderBy("cluster_id").limit(CLOSURE + 1).collect()
    return _greedy_ratio(edges, [r["hub"] for r in found], [r["cluster_id"] for r in found], [r["n"] for r in found], "long", False)


def greedy_reduced_pareto(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The same on a reduced graph; it stops when nothing reachable is left."""
    found = nodes.orderBy("cluster_id").limit(CLOSURE + 1).collect()
    ids = [r["cluster_id"] for r in found]
    return _greedy_ratio(written(both_ways(links), "edges"), ids, ids, [r["size"] for r in found], "long", True)


@dataclass
class Ways:
    """Of all places, the ways from some of them: distance, links, the place before; and the others by distance a building."""

    dist: np.ndarray
    links: np.ndarray
    before: np.ndarray
    order: np.ndarray


@dataclass
class State:
    selected: list[int]
    buildings: int
    cost: float
    #: In a held graph: ways from clusters selected before, those that are better from later ones, and the clusters added since.
    base: Ways | None = None
    own: dict[int, tuple[float, int, int]] = field(default_factory=dict)
    added: list[int] = field(default_factory=list)

    @property
    def ratio(self) -> float:
        return self.cost / self.buildings if self.buildings else inf


def _common(beam: list[State]) -> set[int]:
    """Clusters that all states have, and so all that grow from them."""
    return set(beam[0].selected).intersection(*(s.selected for s in beam[1:]))


class Reduced:
    """A reduced graph, or what matters of one, on the driver; clusters go by their place in the order of ids.

    A way is (distance, links, the cluster before); of equal distances the fewest links, then the smallest cluster before. So ways
    depend on what is selected alone, not on the order in which it was. States share the ways of the one that they grew from and hold
    only what is better; where that is much, it becomes ways of its own.
    """

    def __init__(self, nodes: DataFrame, links: DataFrame):
        size = nodes.select("cluster_id", "size").distinct().orderBy("cluster_id").toArrow()
        self.ids, self.size = size["cluster_id"].to_pylist(), size["size"].to_pylist()
        self.place = {c: k for k, c in enumerate(self.ids)}
        rows, ids = links.select("a", "b", F.col("dist").cast("double").alias("dist")).toArrow(), np.array(self.ids, np.int64)
        a, b = (np.searchsorted(ids, rows[x].to_numpy()) for x in ("a", "b"))
        self.links = a, b, rows["dist"].to_numpy()
        # neighbours and distances of all places, one place's after another's
        src, order = np.concatenate([a, b]), np.argsort(np.concatenate([a, b]), kind="stable")
        self.ends = np.concatenate([b, a])[order], np.concatenate([self.links[2]] * 2)[order]
        self.at = [0, *np.cumsum(np.bincount(src, minlength=len(ids))).tolist()]
        self.sizes = np.array(self.size, np.float64)

    def places(self, clusters: Iterable[int]) -> list[int]:
        return [self.place[c] for c in clusters if c in self.place]

    def nothing(self) -> Ways:
        n = len(self.ids)
        return Ways(np.full(n, inf), np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(0, np.int32))

    def folded(self, base: Ways, own: dict[int, tuple[float, int, int]]) -> Ways:
        at, ways = np.fromiter(own, np.int64, len(own)), zip(*own.values(), strict=True)
        dist, links, before = base.dist.copy(), base.links.copy(), base.before.copy()
        dist[at], links[at], before[at] = ways
        met = np.flatnonzero((self.sizes > 0) & (dist < inf))
        return Ways(dist, links, before, met[np.argsort(dist[met] / self.sizes[met], kind="stable")].astype(np.int32))

    def reach(self, state: State) -> None:
        """Bring a state's ways up to what it added: only what that brings nearer is visited."""
        base, own = state.base or self.nothing(), dict(state.own)
        heap = [(0.0, 0, s) for s in sorted(self.places(state.added))]
        for _, _, s in heap:
            own[s] = (0.0, 0, -1)
        while heap:
            d, h, u = heappop(heap)
            if (d, h) > own[u][:2]:
                continue
            here = slice(self.at[u], self.at[u + 1])
            ends, far = self.ends[0][here], d + self.ends[1][here]
            near = far <= base.dist[ends]
            for v, e in zip(ends[near].tolist(), far[near].tolist(), strict=True):
                way, old = (e, h + 1, u), own.get(v)
                if old is None:
                    old = (base.dist[v], base.links[v], base.before[v])
                if way < old:
                    own[v] = way
                    if way[:2] < old[:2]:
                        heappush(heap, (e, h + 1, v))
        if state.base is None or len(own) > len(self.ids) / 64 + FANOUT:
            base, own = self.folded(base, own), {}
        state.base, state.own, state.added = base, own, []

    def nearest(self, state: State, inside: set[int]) -> list[int]:
        """The FANOUT places with least distance a building that the state hasn't selected."""
        own = [(way[0] / self.size[v], v) for v, way in state.own.items() if v not in inside and self.size[v] > 0]
        others = islice((v for v in map(int, state.base.order) if v not in state.own and v not in inside), FANOUT)
        return [v for _, v in nsmallest(FANOUT, chain(own, ((float(state.base.dist[v]) / self.size[v], v) for v in others)))]

    def tries(self, beam: list[State]) -> Iterator[tuple[State, list[int], list[int], float]]:
        """(state, clusters of the way, their sizes, its length) of each state's candidates, nearest first."""
        for state in beam:
            self.reach(state)
            inside = set(self.places(state.selected))
            for c in self.nearest(state, inside):
                path, at = [], c
                while at not in inside:
                    path.append(at)
                    at = state.own[at][2] if at in state.own else int(state.base.before[at])
                path.reverse()
                length = state.own[c][0] if c in state.own else float(state.base.dist[c])
                yield state, [self.ids[p] for p in path], [self.size[p] for p in path], length

    def tree_weight(self, clusters: Sequence[int]) -> float:
        """Of the spanning tree of clusters' distances: the least ways between their cells hold one."""
        terminals = self.places(clusters)
        label, dist, heap = {t: t for t in terminals}, dict.fromkeys(terminals, 0.0), [(0.0, t) for t in sorted(set(terminals))]
        while heap:
            d, u = heappop(heap)
            if d > dist[u]:
                continue
            here = slice(self.at[u], self.at[u + 1])
            for v, w in zip(self.ends[0][here].tolist(), self.ends[1][here].tolist(), strict=True):
                if d + w < dist.get(v, inf):
                    dist[v], label[v] = d + w, label[u]
                    heappush(heap, (d + w, v))
        cell, far = np.full(len(self.ids), -1), np.zeros(len(self.ids))
        met = np.fromiter(label, np.int64)
        cell[met], far[met] = np.fromiter(label.values(), np.int64), [dist[v] for v in met.tolist()]
        a, b, w = self.links
        crossing = (cell[a] >= 0) & (cell[b] >= 0) & (cell[a] != cell[b])
        a, b, w = a[crossing], b[crossing], w[crossing]
        length, lo, hi = far[a] + w + far[b], np.minimum(cell[a], cell[b]), np.maximum(cell[a], cell[b])
        order = np.lexsort((length, hi, lo))
        lo, hi, length = lo[order], hi[order], length[order]
        first = np.ones(len(order), bool)  # of each two cells' ways, the least
        first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        ways = sorted(zip(length[first].tolist(), lo[first].tolist(), hi[first].tolist(), strict=True))
        up, total, left = {t: t for t in terminals}, 0.0, len(set(terminals)) - 1

        def find(v):
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for w, a, b in ways:
            a, b = find(a), find(b)
            if a != b:
                up[a], total, left = b, total + w, left - 1
        return inf if left > 0 else total


class Spread:
    """A reduced graph that stays in Spark: its edges are dealt once for all searches."""

    def __init__(self, nodes: DataFrame, links: DataFrame):
        self.nodes, self.links = nodes.select(F.col("cluster_id").alias("node"), "size").distinct(), links
        self.edges = written(both_ways(links), "edges")
        self.over = Contracted(sound(self.edges).withColumn("h", F.lit(1).cast("bigint")), [])
        self.ways = dealt(self.over.core)

    def search(self, seeds: DataFrame, **options) -> DataFrame:
        return shortest(self.edges, seeds, over=self.over, ways=self.ways, **options)

    def named(self, clusters: Iterable[int]) -> DataFrame:
        return self.edges.sparkSession.createDataFrame([(c, c) for c in clusters], "node long, label long")

    def tries(self, beam: list[State]) -> Iterator[tuple[State, list[int], list[int], float]]:
        """As Reduced has them, by one search from each state."""
        rows = [(k, c, 0) for k, s in enumerate(beam) for c in s.selected]
        seeds = self.edges.sparkSession.createDataFrame(rows, "state int, node long, label int")
        tree = written(self.search(seeds, by=("state",)), "tree")
        dist = F.col("dist").cast("double")
        ranked = tree.filter("hops > 0").join(self.nodes.filter("size > 0"), "node").select("state", "node", dist.alias("dist"), (dist / F.col("size")).alias("ratio"))
        top = written(top_by(ranked, "state", FANOUT, "ratio", "node"), "top")
        at = lambda c: F.struct(F.col("state"), F.col(c).alias("node"))
        up = tree.select(at("node").alias("node"), F.when(F.col("parent").isNotNull(), at("parent")).alias("parent"))
        steps = path_to_sources(up, top.select(at("node").alias("node"))).select("target.*", "pos", F.col("node.node").alias("step"))
        steps = steps.join(self.nodes.withColumnRenamed("node", "step"), "step").groupBy("state", "node").agg(F.sort_array(F.collect_list(F.struct("pos", "step", "size")), False).alias("steps"))
        for r in sorted(top.join(steps, ["state", "node"]).collect(), key=lambda r: (r["state"], r["rank"])):
            path = r["steps"][1:]  # the first is selected already
            yield beam[r["state"]], [p["step"] for p in path], [p["size"] for p in path], r["dist"]
        dropped(tree)

    def part(self, common: set[int], room: int) -> Reduced | None:
        """What matters to states that have all of common and less than room - FANOUT other clusters; None if that is more than HELD links.

        At least FANOUT of the room clusters with the least distance from common a building aren't selected, so no candidate is worse than the last of
        these. A cluster whose least link is already longer for its size is never one. The others' ways come from within balls of the
        distance that such a candidate may have, or of the distance from common if that is less; one search takes all balls.
        """
        near = self.search(self.named(common).select("node"), parents=False, mutual=True)
        least = self.edges.groupBy(F.col("src").alias("node")).agg(F.min("w").alias("m"))
        sized = near.join(self.nodes.filter("size > 0"), "node").join(self.named(common).select("node"), "node", "left_anti").join(least, "node")
        sized = written(sized.withColumn("ratio", F.col("dist") / F.col("size")), "sized")
        r = sized.select("ratio").orderBy("ratio").limit(room).agg(F.count("*").alias("n"), F.max("ratio").alias("most")).first()
        most = F.lit(r["most"] if r["n"] == room else inf)
        far = F.least(F.col("dist").cast("double"), most * F.col("size")) * (1 + 1e-9)
        if dict(self.over.core.dtypes)["w"] == "bigint":
            far = F.ceil(far)
        balls = sized.filter(F.col("m") / F.col("size") <= most).select("node", (-far).alias("dist"))
        inner = written(self.search(balls, limit=0, parents=False).select("node"), "inner")
        links = written(self.links.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").join(inner.withColumnRenamed("node", "b"), "b", "left_semi"), "inner-links")
        if links.count() > HELD:
            return None
        ends = inner.unionByName(self.named(common).select("node")).distinct()
        return Reduced(self.nodes.join(ends, "node", "left_semi").withColumnRenamed("node", "cluster_id"), links)

    def tree_weight(self, clusters: Sequence[int]) -> float:
        terminals = self.named(clusters)
        cells = written(self.search(terminals, pinned=True, parents=False, mutual=True), "cells")
        return tree_weight(terminals, frontier_links(self.edges.filter("src < dst"), cells)).first()[0]

    def close(self) -> None:
        released(self.ways)


def budgeted_search(nodes: DataFrame, links: DataFrame, sources: Sequence[int], budget: float = 300.0, epsilon: float = 1.5, iterations: int = 100) -> DataFrame | None:
    """The selection with most buildings whose connection cost a building is within budget, grown from the source clusters.

    A round takes each state of the beam, tries its nearest FANOUT clusters by cost
    a building, and adds all clusters on the way; states beyond budget * epsilon
    are dropped, and the BEAM best go on. All sources are in every solution. None without sources.

    A graph of at most HELD links is searched on the driver. A larger one stays in Spark: the driver holds the part that can matter to the
    beam (Spread.part), and while even that is too large, a round is one search of all states over the whole graph.
    """
    sources = list(dict.fromkeys(sources))
    if not sources:
        return None
    if links.count() <= HELD:
        return _grown(nodes, Reduced(nodes, links), None, sources, budget, epsilon, iterations)
    spread = Spread(nodes, links)
    try:
        return _grown(nodes, None, spread, sources, budget, epsilon, iterations)
    finally:
        spread.close()


def _grown(nodes: DataFrame, graph: Reduced | None, spread: Spread | None, sources: list[int], budget: float, epsilon: float, iterations: int) -> DataFrame:
    buildings = nodes.filter(F.col("cluster_id").isin(sources)).agg(F.sum("size")).first()[0]
    first = State(sources, buildings, 0.0, added=sources)
    beam, best = [first], first if first.ratio <= budget else None
    common, room = None, inf
    for _ in range(iterations):
        if spread is not None:
            others = max(len(s.selected) for s in beam) - len(common or ())
            if graph is None and common != _common(beam) or graph is not None and others > room - FANOUT:
                common = _common(beam)
                room = FANOUT + ROOM + max(len(s.selected) for s in beam) - len(common)
                graph = spread.part(common, room)
                for s in beam:
                    s.base, s.own, s.added = None, {}, s.selected
        children = []
        for state, path, sizes, length in (graph or spread).tries(beam):
            child = State([*state.selected, *path], state.buildings + sum(sizes), state.cost + length, state.base, state.own, path)
            if child.buildings > state.buildings and isfinite(child.ratio) and child.ratio <= budget * epsilon:
                children.append(child)
        for child in children:
            if child.ratio <= budget and (best is None or child.buildings > best.buildings or child.buildings == best.buildings and child.cost < best.cost):
                best = child
        if not children:
            break
        beam = sorted(children, key=lambda s: (s.ratio, -s.buildings, s.cost))[:BEAM]
    if best is None:
        best = min(beam, key=lambda s: (s.ratio, -s.buildings))
    weight = (spread or graph).tree_weight(best.selected)
    return _rows(nodes.sparkSession, [(1, best.selected, len(best.selected), best.buildings, weight)], "long")
