"""Small graphs with known answers, and random ones against plain Python."""

import heapq
import math
import random
from math import inf, isinf

import pytest
from pyspark.sql import functions as F

from streetloom.operators import cluster, nearest, routing, search, steiner, traverse
from streetloom.operators.components import connected_components
from streetloom.operators.graph import FULL_WEIGHT, BuildGraphError, build_graph, building_node, connector_node

SEGMENTS = "id string, length_m double, connectors array<struct<connector_id string, at double>>"
POINTS = "id string, x double, y double"
LINKS = "building_id string, connector_id string, distance_m double"


def make(spark, roads, connectors, buildings=(), links=(), **options):
    frames = (spark.createDataFrame(list(r), s) for r, s in ((roads, SEGMENTS), (connectors, POINTS), (buildings, POINTS), (links, LINKS)))
    return build_graph(*frames, **options)


def line(spark):
    """c1 -10- c2 -10- c3."""
    return make(spark, [("r1", 10.0, [("c1", 0.0), ("c2", 1.0)]), ("r2", 10.0, [("c2", 0.0), ("c3", 1.0)])], [("c1", 0.0, 0.0), ("c2", 1.0, 0.0), ("c3", 2.0, 0.0)])


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def weights(g):
    return g.both_ways(FULL_WEIGHT)


def test_small_graph(spark):
    for directed, edges in ((False, 2), (True, 4)):
        g = make(spark, [("r1", 100.0, [("c1", 0.0), ("c2", 1.0)])], [("c1", 0.0, 0.0), ("c2", 1.0, 0.0)], [("b1", 0.2, 0.1)], [("b1", "c1", 12.5)], directed=directed)
        assert tuple(g.counts().first()) == (3, edges)
        assert {r["kind"]: r["count"] for r in g.nodes.groupBy("kind").count().collect()} == {"connector": 2, "building": 1}


def test_pieces_of_a_road(spark):
    g = make(spark, [("r", 100.0, [("b", 0.6), ("a", 0.2), ("a", 0.6), ("c", 0.6)])], [(c, 0.0, 0.0) for c in "abc"])
    got = sorted((r["src"], r["dst"], round(r["length_m"], 9)) for r in g.edges.collect())
    assert got == [("c:a", "c:b", 40.0), ("c:a", "c:c", 0.0), ("c:b", "c:a", 0.0)]  # refs at the same place keep their order


@pytest.mark.parametrize(
    "roads, connectors, buildings, links, text",
    [
        ([], [("c", 0.0, 0.0)] * 2, [("b", 0.0, 0.0)] * 2, [], "duplicate connector id: c"),
        ([("r", 1.0, [])], [], [("b", 0.0, 0.0)] * 2, [], "duplicate building id: b"),
        ([("r", 1.0, [("c", 0.0)])], [("c", 0.0, 0.0)], [], [("x", "c", 1.0)], "road segment r must reference at least two connectors"),
        ([("r", 1.0, [("c", 0.0), ("d", 1.0)])], [("c", 0.0, 0.0)], [], [], "missing connector id: d"),
        ([], [("c", 0.0, 0.0)], [], [("x", "c", 1.0)], "missing building id: x"),
        ([], [("c", 0.0, 0.0)], [("b", 0.0, 0.0)], [("b", "y", 1.0)], "missing connector id: y"),
    ],
)
def test_errors(spark, roads, connectors, buildings, links, text):
    with pytest.raises(BuildGraphError, match=f"^{text}$"):
        make(spark, roads, connectors, buildings, links)


def test_steiner_on_a_line(spark):
    g = line(spark)
    for names, want in ((["c:c1", "c:c3"], 20.0), (["c:c1"], 0.0), (["c:c1", "c:c2"], 10.0), ([], 0.0)):
        assert steiner.steiner_weight(g, nodes(spark, names)).first()[0] == want


def test_fronts_on_a_line(spark):
    e = weights(line(spark))
    front = lambda names: [(r["size"], r["tree_weight"]) for r in search.brute_force_pareto(e, names).collect()]
    assert front(["c:c1", "c:c2"]) == [(2, 10.0), (1, 0.0)]
    assert front(["c:c1", "c:c2", "c:c3"]) == [(3, 20.0), (2, 10.0), (1, 0.0)]
    greedy = search.greedy_pareto(e, ["c:c1", "c:c2", "c:c3"]).orderBy("step").collect()
    assert [r["size"] for r in greedy] == [1, 2, 3] and [r["tree_weight"] for r in greedy] == [0.0, 10.0, 20.0]
    assert [r["tree_weight"] for r in search.greedy_pareto(e, ["c:c1"]).collect()] == [0.0]
    with pytest.raises(ValueError):
        search.brute_force_pareto(e, [f"c:{k}" for k in range(21)])


def test_front_of_disconnected_candidates(spark):
    g = make(spark, [], [("c1", 0.0, 0.0), ("c2", 0.0, 0.0)])
    got = [(r["size"], r["tree_weight"]) for r in search.brute_force_pareto(weights(g), ["c:c1", "c:c2"]).collect()]
    assert got == [(2, inf), (1, 0.0)]


def chain(spark, gap=100.0):
    """Two buildings on connectors gap apart, a third far away, one without a link."""
    return make(
        spark,
        [("r", gap, [("c1", 0.0), ("c2", 1.0)]), ("q", 500.0, [("c2", 0.0), ("c3", 1.0)])],
        [(f"c{k}", float(k), 0.0) for k in (1, 2, 3)],
        [(f"b{k}", float(k), 0.0) for k in (1, 2, 3, 4)],
        [("b1", "c1", 500.0), ("b2", "c2", 5.0), ("b3", "c3", 1.0)],
    )


def groups(clusters):
    out = {}
    for r in clusters.collect():
        out.setdefault(r["cluster_id"], set()).add(r["building_id"])
    return [out[k] for k in sorted(out)]


def test_clusters(spark):
    assert groups(cluster.cluster_buildings(chain(spark))) == [{"b1", "b2"}, {"b3"}, {"b4"}]
    assert groups(cluster.cluster_buildings(chain(spark, 100.0001))) == [{"b1"}, {"b2"}, {"b3"}, {"b4"}]
    assert groups(cluster.cluster_buildings(chain(spark), -1.0)) == [{"b1"}, {"b2"}, {"b3"}, {"b4"}]
    bridge = make(spark, [], [("c1", 0.0, 0.0), ("c2", 9.0, 0.0)], [(b, 0.0, 0.0) for b in ("b1", "b2", "b3")], [("b1", "c1", 9.0), ("b2", "c1", 9.0), ("b2", "c2", 9.0), ("b3", "c2", 9.0)])
    assert groups(cluster.cluster_buildings(bridge)) == [{"b1", "b2", "b3"}]


def test_reduced_graph_counts_access(spark):
    g = chain(spark)
    c = cluster.cluster_buildings(g)
    n, e, near = cluster.reduced_graph(g, c)
    assert [(r["cluster_id"], r["size"], r["centroid_x"]) for r in n.orderBy("cluster_id").collect()] == [(0, 2, 1.5), (1, 1, 3.0), (2, 1, 4.0)]
    assert [tuple(r) for r in e.collect()] == [(0, 1, 506.0)]
    assert {r["node"]: r["cluster_id"] for r in near.collect()}["c:c2"] == 0


def test_members_come_in_bounded_lists(spark, monkeypatch):
    monkeypatch.setattr(cluster, "LISTED", 3)
    rows = [(f"b:{k:02}", f"{k:02}", k % 2 if k < 4 else 2) for k in range(24)]
    lists = cluster.cluster_members(spark.createDataFrame(rows, "node string, building_id string, cluster_id long")).orderBy("cluster_id", "part").collect()
    got = {}
    for r in lists:
        assert len(r["members"]) <= 3 and r["part"] == len(got.setdefault(r["cluster_id"], []))
        got[r["cluster_id"]].append(r["members"])
    assert {c: sum(m, []) for c, m in got.items()} == {c: [b for _, b, d in rows if d == c] for c in range(3)}


def dijkstra(adj, sources, limit=inf):
    dist, heap = dict.fromkeys(sources, 0), [(0, s) for s in sources]
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for v, w in adj.get(u, ()):
            if d + w < dist.get(v, inf) and d + w <= limit:
                dist[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return dist


def union(names, links):
    up = {n: n for n in names}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def mst(names, dist):
    total, inside, left = 0, [names[0]], set(names[1:])
    while left:
        w, v = min((dist[u].get(v, inf), v) for u in inside for v in left)
        total += w
        inside.append(v)
        left.remove(v)
    return total


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n, m = 30, 18
    connectors = [(f"{k:02}", 0.0, 0.0) for k in range(n)]
    roads = [(f"r{k}", float(rnd.randint(0, 9)), [(f"{rnd.randrange(n):02}", 0.0), (f"{rnd.randrange(n):02}", 1.0)]) for k in range(28)]
    buildings = [(f"{k:02}", 0.0, 0.0) for k in range(m)]
    links = [(f"{rnd.randrange(m):02}", f"{rnd.randrange(n):02}", float(rnd.randint(0, 9))) for _ in range(m + 6)]
    g = make(spark, roads, connectors, buildings, links)
    free, full = {}, {}
    for r in g.edges.collect():
        for a, b in ((r["src"], r["dst"]), (r["dst"], r["src"])):
            full.setdefault(a, []).append((b, r["length_m"]))
            free.setdefault(a, []).append((b, 0.0 if r["kind"] == "access" else r["length_m"]))
    names = [f"b:{k:02}" for k in range(m)]
    for limit in (0.0, 4.0):
        near = [(a, b) for a in names for b in dijkstra(free, [a], limit) if b in names]
        root = union(names, near)
        clusters = cluster.cluster_buildings(g, limit)
        got = {r["node"]: r["cluster_id"] for r in clusters.collect()}
        order = sorted(set(root.values()))
        assert got == {b: order.index(root[b]) for b in names}
    assert {r["node"]: r["dist"] for r in traverse.distances(weights(g), "c:00").collect()} == dijkstra(full, ["c:00"])
    assert {r["node"]: r["dist"] for r in traverse.distances(weights(g), "c:00", 6.0).collect()} == dijkstra(full, ["c:00"], 6.0)
    picked = rnd.sample(names, 5)
    dist = {a: dijkstra(full, [a]) for a in picked}
    want = mst(picked, dist)
    weight = steiner.steiner_weight(g, nodes(spark, picked)).first()[0]
    assert weight == want or isinf(weight) and isinf(want)
    matrix = search.distance_matrix(weights(g), picked)
    assert all(matrix[i, j] == dist[a].get(b, inf) for i, a in enumerate(picked) for j, b in enumerate(picked))
    c = cluster.cluster_buildings(g, 2.0)
    rn, re, _ = cluster.reduced_graph(g, c)
    assert rn.agg(F.sum("size")).first()[0] == m
    assert all(r["dist"] > 2.0 for r in re.collect())  # whatever joins two clusters is longer than the limit


def test_parents_make_paths(spark):
    g = chain(spark)
    tree = traverse.shortest(weights(g), nodes(spark, ["c:c1"]).withColumn("label", F.lit(0)))
    path = traverse.path_to_sources(tree, nodes(spark, ["b:b3", "b:b4"])).orderBy("target", "pos").collect()
    assert [r["node"] for r in path] == ["b:b3", "c:c3", "c:c2", "c:c1"]


def test_components(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "d"), ("x", "y")], "a string, b string")
    assert {r["node"]: r["component"] for r in connected_components(links, nodes(spark, "abcdexy")).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "x": "x", "y": "x"}


def reduced(spark, sizes, links):
    return spark.createDataFrame([(k, s, 0.0, 0.0) for k, s in enumerate(sizes)], "cluster_id long, size long, centroid_x double, centroid_y double"), spark.createDataFrame(links, "a long, b long, dist double")


def test_budgeted_search(spark):
    n, e = reduced(spark, [1, 5, 1, 50], [(0, 1, 100.0), (1, 2, 600.0), (2, 3, 900.0)])
    run = lambda **o: search.budgeted_search(n, e, [0], **o).first()
    r = run(budget=100 / 6)  # exactly the budget
    assert r["selected"] == [0, 1] and r["total_buildings"] == 6 and r["tree_weight"] == 100.0
    assert run(budget=10.0, epsilon=1.0)["selected"] == [0]
    assert run(budget=30.0, epsilon=4.0)["selected"] == [0, 1, 2, 3]  # through a state beyond the budget
    assert search.budgeted_search(n, e, []) is None


def test_search_keeps_disconnected_sources(spark):
    n = spark.createDataFrame([(0, 1), (1, 1)], "cluster_id long, size long")
    e = spark.createDataFrame([], "a long, b long, dist double")
    r = search.budgeted_search(n, e, [0, 1]).first()
    assert r["selected"] == [0, 1] and isinf(r["tree_weight"])


def test_greedy_reduced_stops_at_the_unreachable(spark):
    n, e = reduced(spark, [2, 1, 4], [(0, 1, 10.0)])
    got = search.greedy_reduced_pareto(n, e).orderBy("step").collect()
    assert [(r["selected"], r["total_buildings"], r["tree_weight"]) for r in got] == [([0], 2, 0.0), ([0, 1], 3, 10.0)]


def test_greedy_clusters(spark):
    g = chain(spark)
    c = cluster.cluster_buildings(g).filter("building_id <> 'b4'")
    got = search.greedy_cluster_pareto(g, c).orderBy("step").collect()
    assert [(r["selected"], r["total_buildings"], r["tree_weight"]) for r in got] == [([0], 2, 0.0), ([0, 1], 3, 1101.0)]


def test_sources_and_tree(spark):
    g = chain(spark)
    c = cluster.cluster_buildings(g)
    near = cluster.nearest_cluster(g, c)
    ids = spark.createDataFrame([("b3", 0), ("c1", 1), ("nobody", 2)], "id string, ord int")
    got = routing.resolved_sources(ids, g, c, near)
    assert {r["id"]: (r["node"], r["cluster_id"]) for r in got.collect()} == {"b3": ("b:b3", 1), "c1": ("c:c1", 0), "nobody": (None, None)}
    assert routing.source_clusters(got) == [1, 0]
    with pytest.raises(ValueError):
        routing.source_clusters(got.filter("node IS NULL"))
    assert sorted(r[0] for r in routing.road_tree(g, ["b:b1", "b:b4", "b:b3", "b:b2"]).collect()) == ["q", "r"]
    assert routing.road_tree(g, ["b:b1"]).count() == 0


def test_road_tree_against_plain_paths(spark):
    """Streets of many pieces, dead ends, and hubs within them; all lengths differ by powers of two, so there is one shortest way each."""
    rnd = random.Random(21)
    ways, names = town(rnd, streets=9, length=6, ends=8)
    ways = list({(min(a, b), max(a, b)): (a, b) for a, b, _ in ways if a != b and "far" not in a and a[0] != "r"}.values())
    length = {frozenset(w): 1.0 + 2.0 ** -(k + 1) for k, w in enumerate(rnd.sample(ways, len(ways)))} if len(ways) < 45 else {frozenset(w): rnd.uniform(1, 2) for w in ways}
    g = make(spark, [(f"r{k}", length[frozenset(w)], [(w[0], 0.0), (w[1], 1.0)]) for k, w in enumerate(ways)], [(n, 0.0, 0.0) for n in {x for w in ways for x in w}])
    near = {}
    for a, b in ways:
        near.setdefault(a, []).append((b, length[frozenset((a, b))]))
        near.setdefault(b, []).append((a, length[frozenset((a, b))]))
    reach = dijkstra(near, [ways[0][0]])
    hubs = rnd.sample(sorted(reach), 3)
    tree, want = {hubs[0]}, set()
    for h in hubs[1:]:
        dist = dijkstra(near, sorted(tree))
        at = h
        while at not in tree:
            up = min((dist[v] + w, v) for v, w in near[at] if v in dist)[1]
            want.add(frozenset((at, up)))
            tree.add(at)
            at = up
    got = {frozenset(ways[int(r["segment_id"][1:])]) for r in routing.road_tree(g, [f"c:{h}" for h in hubs]).collect()}
    assert got == want


def test_nearest(spark):
    rnd = random.Random(3)
    left = [(f"b{k}", rnd.uniform(0, 50) if k else 5000.0, rnd.uniform(0, 50)) for k in range(80)] + [("tie", 0.5, -3.0), ("null", None, 1.0), ("nan", math.nan, 1.0)]
    right = [(f"c{k:02}", rnd.uniform(0, 50), rnd.uniform(0, 50)) for k in range(30)] + [("t1", 0.0, -3.0), ("t0", 1.0, -3.0), ("t2", 0.0, -3.0), ("lost", None, 0.0)]
    for leaf in (1, 32):
        got = {r["building_id"]: (r["connector_id"], r["distance_m"]) for r in nearest.nearest_join(spark.createDataFrame(left, POINTS), spark.createDataFrame(right, POINTS), leaf).collect()}
        assert len(got) == len(left) and got.pop("null") == got.pop("nan") == (None, None) and got["tie"] == ("t0", 0.5)
        for i, x, y in left[:-2]:
            d, c = min((((x - a) ** 2 + (y - b) ** 2) ** 0.5, j) for j, a, b in right[:-1])
            assert got[i][0] == c and abs(got[i][1] - d) < 1e-9
    none = nearest.nearest_join(spark.createDataFrame(left[:3], POINTS), spark.createDataFrame(right[-1:], POINTS)).collect()
    assert len(none) == 3 and all(r["connector_id"] is None for r in none)


def test_nearest_in_a_dense_place(spark, monkeypatch):
    """Nine tenths of both sides lie in a millionth of the square: leaves stay bounded, and a block meets few of them."""
    rnd = random.Random(8)
    spot = lambda: (rnd.uniform(500, 500.001), rnd.uniform(500, 500.001)) if rnd.random() < 0.9 else (rnd.uniform(0, 1000), rnd.uniform(0, 1000))
    right = [(f"c{k}", *spot()) for k in range(3000)]
    left = [(f"b{k}", *spot()) for k in range(2000)]
    cells, points = nearest.quadtree(spark.createDataFrame(right, "id string, rx double, ry double").withColumn("code", nearest.morton(F.col("rx"), F.col("ry"), 0.0, 0.0, 1000.0)), 32)
    held = [r["count"] for r in points.groupBy("level", "cell").count().collect()]
    assert max(held) <= 32 and sum(held) == len(right) and len(cells) > 5
    met = []
    real = nearest.written
    monkeypatch.setattr(nearest, "written", lambda df, label: (met.append((label, real(df, label))), met[-1][1])[1])
    joined = nearest.nearest_join(spark.createDataFrame(left, POINTS), spark.createDataFrame(right, POINTS)).collect()
    own = [r["n"] for label, df in met if label == "pairs" for r in df.selectExpr("size(own) AS n").collect()]
    assert max(own) <= nearest.BLOCK and sum(own) < 8 * len(left)  # a point meets a few leaves, a leaf a block's points at once
    import numpy as np

    r = np.array([(x, y) for _, x, y in right])
    for row in joined:
        d = np.hypot(r[:, 0] - row["lx"], r[:, 1] - row["ly"])
        assert row["connector_id"] == right[int(d.argmin())][0] and abs(row["distance_m"] - d.min()) < 1e-9
    assert len(joined) == len(left)


def test_names_of_nodes(spark):
    df = spark.createDataFrame([(7,)], "id long")
    assert tuple(df.select(connector_node("id"), building_node("id")).first()) == ("c:7", "b:7")


def test_registered_search_grows_until_nothing_fits(spark, monkeypatch):
    """A star whose leaves cost more and more: the most buildings within budget are the longest prefix that fits, beyond 20 rounds."""
    from streetloom.plans import queries

    budget = float(queries.LIMIT)
    costs = [k * budget / 15.25 for k in range(1, 41)]
    best = max(k for k in range(41) if sum(costs[:k]) <= budget * (1 + k))
    assert 20 < best < 40
    monkeypatch.setattr(queries, "reduced", lambda *_: reduced(spark, [1] * 41, [(0, k + 1, c) for k, c in enumerate(costs)]))
    r = queries.QUERIES["budgeted_search"](spark, "").first()
    assert sorted(map(int, r["selected"].split())) == list(range(best + 1))
    assert r["total_buildings"] == best + 1 and r["tree_weight"] == pytest.approx(sum(costs[:best]))


def plain_states(ways, seeds, pinned=False, limit=None):
    """{node: (dist, label, hops, parent)} by trying every edge until nothing improves."""
    best = {}
    for node, label in seeds:
        best[node] = min(best.get(node, (0, label, 0, None)), (0, label, 0, None), key=lambda s: s[1])
    fixed = set(best) if pinned else set()
    while True:
        offers = {}
        for a, b, w in ways:
            if a != b and a in best and b not in fixed and (limit is None or best[a][0] + w <= limit):
                o = (best[a][0] + w, best[a][1], best[a][2] + 1, a)
                offers[b] = min(offers.get(b, o), o)
        better = {b: o for b, o in offers.items() if b not in best or o[:3] < best[b][:3] or o[:3] == best[b][:3] and best[b][3] is not None and o[3] < best[b][3]}
        if not better:
            return best
        best |= better


def town(rnd, streets=12, length=9, ends=15):
    """Junctions joined by chains, with dead ends and trees hanging on them, a ring of its own, parallel ways and a far pair."""
    ways = []
    for s in range(streets):
        a, b = rnd.randrange(6), rnd.randrange(6)
        inner = [f"s{s}_{k}" for k in range(rnd.randrange(length))]
        ways += list(zip([f"j{a}", *inner], [*inner, f"j{b}"], strict=True))
    names = sorted({n for w in ways for n in w})
    for e in range(ends):
        ways.append((rnd.choice(names), f"e{e}"))
        names.append(f"e{e}")
    ways += [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("far0", "far1")]
    return [(a, b, rnd.randint(0, 4)) for a, b in ways], names


@pytest.mark.parametrize("seed", range(2))
def test_contracted_searches_are_plain_ones(spark, monkeypatch, seed):
    from streetloom.operators import contract

    if seed == 1:
        monkeypatch.setattr(traverse, "HEAVY", 2)  # edges of most nodes lie in several pieces
    rnd = random.Random(seed)
    ways, names = town(rnd)
    ways += [(b, a, w) for a, b, w in ways] + ([(a, b, 1) for a, b in (rnd.sample(names, 2) for _ in range(5))] if seed else [])  # some lead one way only
    edges = spark.createDataFrame(ways, "src string, dst string, w long")
    picked = [(n, rnd.randint(0, 2)) for n in rnd.sample(names, 4)] + [("alone", 0)]
    picked.append((picked[0][0], 5))
    seeds = spark.createDataFrame(picked, "node string, label int")
    got = lambda **o: {r["node"]: (r["dist"], r["label"], r["hops"], r["parent"]) for r in traverse.shortest(edges, seeds, **o).collect()}
    assert got(pinned=True) == plain_states(ways, picked, pinned=True)
    if seed:
        return
    assert got(limit=5.5) == plain_states(ways, picked, limit=5)
    goal = rnd.choice(names)
    want = plain_states(ways, picked)
    near = got(until=goal)
    assert near.get(goal) == want.get(goal) and all(want[n] == s for n, s in near.items() if goal not in want or s[0] < want[goal][0])
    apart = spark.createDataFrame([(p, n, 0) for p, n in (("p", "j1"), ("p", names[3]), ("q", names[7]))], "start string, node string, label int")
    rows = traverse.shortest(edges, apart, by=("start",)).collect()
    for p, s in (("p", [("j1", 0), (names[3], 0)]), ("q", [(names[7], 0)])):
        assert {r["node"]: (r["dist"], r["label"], r["hops"], r["parent"]) for r in rows if r["start"] == p} == plain_states(ways, s)
    parts = contract.contract(contract.sound(edges), seeds)
    assert parts.links and parts.core.select("src").distinct().count() < len(names) / 2


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from streetloom.operators import contract

    rounds = []
    for m in (traverse, contract):
        real = m.written
        monkeypatch.setattr(m, "written", lambda df, label, real=real: (rounds.append(label), real(df, label))[1])
    n = 10_000
    edges = spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst", "1 + id % 3 AS w")
    edges = edges.unionByName(edges.selectExpr("dst AS src", "src AS dst", "w"))
    seeds = spark.createDataFrame([(0, 0)], "node long, label int")
    tree = traverse.shortest(edges, seeds).orderBy("node").collect()
    dist = 0
    for k, r in enumerate(tree):
        assert (r["node"], r["dist"], r["hops"], r["parent"]) == (k, dist, k, k - 1 if k else None)
        dist += 1 + k % 3
    assert len(tree) == n and len(rounds) < 40, rounds


def test_unsound_weights_and_doubles(spark):
    ways = [("a", "b", 0.1), ("b", "c", 0.2), ("c", "d", 0.3), ("a", "d", math.inf), ("a", "x", math.nan), ("a", "y", None), ("d", "d", 1.0)]
    edges = spark.createDataFrame(ways, "src string, dst string, w double")
    got = {r["node"]: (r["dist"], r["parent"]) for r in traverse.shortest(edges, spark.createDataFrame([("a", 0)], "node string, label int")).collect()}
    assert got == {"a": (0.0, None), "b": (0.1, "a"), "c": (0.3, "b"), "d": (0.6, "c")}


def test_paths_double(spark):
    rnd = random.Random(5)
    up = {0: None} | {k: rnd.randrange(max(0, k - 3), k) for k in range(1, 60)}
    tree = spark.createDataFrame(list(up.items()), "node long, parent long")
    got = {}
    for r in traverse.path_to_sources(tree, spark.createDataFrame([(59,), (30,), (0,), (99,), (30,)], "node long")).collect():
        got.setdefault(r["target"], {})[r["pos"]] = r["node"]
    for t in (59, 30, 0):
        chain = [t]
        while up[chain[-1]] is not None:
            chain.append(up[chain[-1]])
        assert got.pop(t) == dict(enumerate(chain))
    assert not got


@pytest.mark.parametrize("seed", range(2))
def test_spanning_trees(spark, seed):
    rnd = random.Random(seed)
    n = 40
    links = [(rnd.randrange(n), rnd.randrange(n), rnd.randint(0, 6)) for _ in range(70)]
    tree = [tuple(r) for r in steiner.spanning_tree(spark.createDataFrame(links, "a long, b long, dist long")).collect()]
    up = {k: k for k in range(n)}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    want = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in links if a != b):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.append((a, b, w))
    assert sorted(tree) == sorted(want)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([(a, b) for a, b, _ in links], "a long, b long")).collect()}
    root = union(range(n), [(a, b) for a, b, _ in links])
    assert all(root[k] == c for k, c in got.items())


def plain_search(sizes, links, sources, budget, epsilon, iterations=100):
    """The beam search with a fresh search of the whole graph from each state."""
    near = {}
    for a, b, w in links:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    ratio = lambda s: s[2] / s[1]
    first = (tuple(sources), sum(sizes[s] for s in sources), 0.0)
    beam, best = [first], first if ratio(first) <= budget else None
    for _ in range(iterations):
        children = []
        for chosen, count, cost in beam:
            dist, parent, heap = dict.fromkeys(chosen, 0.0), {}, [(0.0, s) for s in chosen]
            while heap:
                d, u = heapq.heappop(heap)
                for v, w in near.get(u, ()) if d <= dist[u] else ():
                    if d + w < dist.get(v, inf):
                        dist[v], parent[v] = d + w, u
                        heapq.heappush(heap, (d + w, v))
            for c in sorted((c for c in dist if c not in chosen), key=lambda c: (dist[c] / sizes[c], c))[:32]:
                path = [c]
                while parent[path[-1]] not in chosen:
                    path.append(parent[path[-1]])
                child = (chosen + tuple(reversed(path)), count + sum(sizes[p] for p in path), cost + dist[c])
                if ratio(child) <= budget * epsilon:
                    children.append(child)
        for c in children:
            if ratio(c) <= budget and (best is None or (c[1], -c[2]) > (best[1], -best[2])):
                best = c
        if not children:
            break
        beam = sorted(children, key=lambda s: (ratio(s), -s[1], s[2]))[:24]
    return best or min(beam, key=lambda s: (ratio(s), -s[1]))


def test_budgeted_search_against_a_plain_one(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        n = 60
        sizes = [rnd.randint(1, 9) for _ in range(n)]
        links = {(min(p), max(p)): rnd.uniform(1, 100) for p in (rnd.sample(range(n), 2) for _ in range(110))}  # no ties
        links = [(a, b, w) for (a, b), w in links.items()]
        sources, budget = rnd.sample(range(n), 2), rnd.uniform(2, 9)
        got = search.budgeted_search(*reduced(spark, sizes, links), sources, budget, 1.5).first()
        chosen, count, _ = plain_search(sizes, links, sources, budget, 1.5)
        assert got["selected"] == list(chosen) and got["total_buildings"] == count
        near = {}
        for a, b, w in links:
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
        weight = mst(list(chosen), {a: dijkstra(near, [a]) for a in chosen})
        assert got["tree_weight"] == pytest.approx(weight) or isinf(weight) and isinf(got["tree_weight"])


def plain_greedy(dist, sizes=None, stop=False):
    """(picked, weight) a step: every candidate's whole tree is weighed anew; the last in the list takes a picked one's place."""
    left, picked, before, out = list(range(len(dist))), [], 0.0, []
    while left:
        weight = [mst([*picked, c], dist) for c in left]
        score = weight if sizes is None else [(w - before) / sizes[c] for w, c in zip(weight, left, strict=True)]
        usable = [k for k in range(len(left)) if not stop or not isinf(score[k])]
        if not usable:
            break
        k = min(usable, key=lambda k: score[k])
        before = weight[k]
        picked = [*picked, left[k]]
        left[k] = left[-1]
        left.pop()
        out.append((picked, before))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_greedy_fronts_against_plain_ones(spark, seed):
    rnd = random.Random(seed)
    n = 24
    tree = [(rnd.randrange(k), k) for k in range(1, n)]
    more = [tuple(sorted(rnd.sample(range(n), 2))) for _ in range(20)]
    length = {p: float(rnd.randint(1, 500)) for p in [*tree, *more]}  # whole: a cluster on a way that is there adds nothing, exactly
    near = {}
    for (a, b), w in length.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    dist = {a: dijkstra(near, [a]) for a in range(n)}

    # candidates in an order of their own
    order = rnd.sample(range(n), 11)
    edges = spark.createDataFrame([(a, b, w) for a in near for b, w in near[a]], "src int, dst int, w double")
    got = [(r["selected"], r["tree_weight"]) for r in search.greedy_pareto(edges, order).orderBy("step").collect()]
    want = plain_greedy({i: {j: dist[a].get(b, inf) for j, b in enumerate(order)} for i, a in enumerate(order)})
    assert [s for s, _ in got] == [[order[i] for i in p] for p, _ in want]
    assert [w for _, w in got] == pytest.approx([w for _, w in want])

    # a reduced graph with two clusters that nothing reaches
    sizes = [rnd.randint(1, 9) for _ in range(n + 2)]
    links = [(a, b, w) for (a, b), w in length.items()] + [(n, n + 1, 5.0)]
    reach = {**dist, n: {n: 0, n + 1: 5.0}, n + 1: {n: 5.0, n + 1: 0}}
    got = [(r["selected"], r["total_buildings"], r["tree_weight"]) for r in search.greedy_reduced_pareto(*reduced(spark, sizes, links)).orderBy("step").collect()]
    want = plain_greedy(reach, sizes, stop=True)
    assert [(s, b) for s, b, _ in got] == [(p, sum(sizes[i] for i in p)) for p, _ in want] and len(got) == n
    assert [w for *_, w in got] == pytest.approx([w for _, w in want])

    # clusters, each with its buildings beside their hub
    connectors = [(f"{k:02}", 0.0, 0.0) for k in range(n)]
    roads = [(f"r{a}-{b}", w, [(f"{a:02}", 0.0), (f"{b:02}", 1.0)]) for (a, b), w in length.items()]
    houses = [(k, i) for k in rnd.sample(range(n), 9) for i in range(rnd.randint(1, 4))]
    far = {k: float(rnd.randint(1, 30)) for k, _ in houses}
    g = make(spark, roads, connectors, [(f"{k:02}-{i}", 0.0, 0.0) for k, i in houses], [(f"{k:02}-{i}", f"{k:02}", far[k]) for k, i in houses])
    clusters = spark.createDataFrame([(f"b:{k:02}-{i}", f"{k:02}-{i}", k) for k, i in houses], "node string, building_id string, cluster_id long")
    ids = sorted(far)
    apart = {i: {j: dist[a][b] + far[a] + far[b] for j, b in enumerate(ids) if a != b} for i, a in enumerate(ids)}
    want = plain_greedy(apart, [sum(k == c for k, _ in houses) for c in ids])
    got = [(r["selected"], r["tree_weight"]) for r in search.greedy_cluster_pareto(g, clusters).orderBy("step").collect()]
    assert [s for s, _ in got] == [[ids[i] for i in p] for p, _ in want]
    assert [w for _, w in got] == pytest.approx([w for _, w in want])
