"""What searches move must not grow with their rounds."""

import random

import pytest

from streetloom.operators import cluster, contract, search, steiner, traverse
from streetloom.operators.graph import Graph
from streetloom.plans import queries


def dense(spark, n=30, leaves=25, seed=3):
    """Edges (src, dst, w), both ways, of a dense graph on which dead ends hang."""
    rnd = random.Random(seed)
    ways = {(a, b): rnd.randint(0, 9) for a in range(n) for b in range(a) if rnd.random() < 0.7}
    ways |= {(n + k, rnd.randrange(n)): rnd.randint(0, 9) for k in range(leaves)}
    rows = [(f"n{a}", f"n{b}", w) for (a, b), w in ways.items()]
    return spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src string, dst string, w long"), rows


def test_dealt_edges_stay_in_place_and_dead_ends_alone_are_no_level(spark):
    edges, rows = dense(spark)
    parts = contract.contract(contract.sound(edges), spark.createDataFrame([("n0",)], "node string"))
    assert not parts.links
    ways = traverse.dealt(parts.core)
    seeds = spark.createDataFrame([("n0",)], "node string")
    got = {r["node"]: r["dist"] for r in traverse.shortest(edges, seeds, parents=False, over=parts, ways=ways).collect()}
    assert ways[0].storageLevel.useMemory
    traverse.released(ways)
    want, moved = {"n0": 0}, True
    while moved:
        moved = False
        for a, b, w in rows + [(b, a, w) for a, b, w in rows]:
            if a in want and want[a] + w < want.get(b, 10**9):
                want[b], moved = want[a] + w, True
    assert got == want


def test_closure_searches_half_ways(spark, monkeypatch):
    """Pairs are right, of several components too, with few states: no search from every end over the whole graph."""
    rnd = random.Random(4)
    rows = [(f"n{k}", f"n{k + 1}", rnd.choice([0.1, 0.7, 2.3])) for k in range(60)] + [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}", 9.5) for _ in range(20)] + [("x0", "x1", 0.3)]
    edges = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src string, dst string, w double")
    ends = ["n3", "n20", "n41", "n58", "x0", "x1", "nowhere"]
    limits, real = [], traverse.shortest
    monkeypatch.setattr(traverse, "shortest", lambda *a, **o: (limits.append((o.get("by"), o.get("limit"))), real(*a, **o))[1])
    got = {(r["a"], r["b"]): round(r["dist"], 9) for r in traverse.closure(edges, spark.createDataFrame([(e,) for e in ends], "node string")).collect()}
    dist = {(a, a): 0.0 for a in ends}
    for _ in range(70):
        for a, b, w in rows + [(b, a, w) for a, b, w in rows]:
            for e in ends:
                if (e, a) in dist:
                    dist[e, b] = min(dist.get((e, b), 1e9), dist[e, a] + w)
    assert got == {(a, b): round(dist[a, b], 9) for a in ends for b in ends if a != b and (a, b) in dist}
    assert any(by and limit is not None for by, limit in limits)


def test_clusters_move_no_edge_beyond_the_limit(spark, monkeypatch):
    """Edges longer than the limit are gone before the search, and the clusters are those of all pairs' distances."""
    rnd = random.Random(11)
    roads = [(f"c:{a}", f"c:{b}", rnd.choice([0, 1, 2, 5, 9])) for a in range(25) for b in range(a) if rnd.random() < 0.3]
    homes = [(f"b:{k}", f"c:{rnd.randrange(25)}") for k in range(12)]
    edges = [(a, b, "road", "s", w) for a, b, w in roads] + [(b, c, "access", None, 50) for b, c in homes]
    names = sorted({n for e in edges for n in e[:2]})
    nodes = spark.createDataFrame([(n, "building" if n[0] == "b" else "connector", n[2:], 0.0, 0.0) for n in names], "node string, kind string, id string, x double, y double")
    g = Graph(nodes, spark.createDataFrame(edges, "src string, dst string, kind string, segment_id string, length_m long"))
    searched, real = [], cluster.shortest
    monkeypatch.setattr(cluster, "shortest", lambda e, *a, **o: (searched.append(e.agg({"w": "max"}).first()[0]), real(e, *a, **o))[1])
    dist = {(a, b): 0 if a == b else 10**6 for a in names for b in names}
    for a, b, kind, _, w in edges:
        dist[a, b] = dist[b, a] = min(dist[a, b], 0 if kind == "access" else w)
    for k in names:
        for a in names:
            for b in names:
                dist[a, b] = min(dist[a, b], dist[a, k] + dist[k, b])
    for limit in (-1, 1):
        got = {}
        for r in cluster.cluster_buildings(g, limit).collect():
            got.setdefault(r["cluster_id"], set()).add(r["node"])
        want, left = [], sorted(b for b, _ in homes)
        while left:
            group, todo = set(), [left[0]]
            while todo:
                b = todo.pop()
                if b not in group:
                    group.add(b)
                    todo += [c for c in left if c != b and dist[b, c] <= limit]
            want.append(group)
            left = [b for b in left if b not in group]
        assert [got[k] for k in sorted(got)] == want
        assert searched.pop() in (None, *range(limit + 1))


def test_dense_links_leave_few_for_later_rounds(spark, monkeypatch):
    """The light links' forest goes first; of the others only those between its trees are left."""
    rnd = random.Random(5)
    links = [(a, b, rnd.randint(0, 40)) for a in range(40) for b in range(40) if a != b and (a < 30) == (b < 30)] + [(0, 35, 99), (1, 36, 99)]
    counts, real = [], steiner._forest
    monkeypatch.setattr(steiner, "_forest", lambda live, named: (counts.append(live.count()), real(live, named))[1])
    tree = sorted(tuple(r) for r in steiner.spanning_tree(spark.createDataFrame(links, "a long, b long, dist long")).collect())
    want = []
    find = lambda v: v if up[v] == v else find(up[v])
    up = list(range(40))
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in links):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.append((a, b, w))
    assert tree == sorted(want)
    assert len(counts) == 2 and counts[0] < len(links) / 2 and counts[1] < len(links) / 10


def test_unresolved_sources_take_no_clusters(spark, monkeypatch):
    monkeypatch.setattr(queries, "clusters_of", lambda *a: 1 / 0)
    got = sorted(r["id"] for r in queries.unresolved_sources(spark, "/root/testdata/sf0.001").collect())
    names = sorted(r["n_name"] for r in spark.read.parquet("/root/testdata/sf0.001/nation.parquet").collect())
    assert set(names) <= set(got)


def test_first_jobs_take_the_lightest_edges_alone(spark, monkeypatch):
    """Right distances and labels with lists cut in the first jobs, and fewer offers in all than edges a node and round."""
    rnd = random.Random(8)
    rows = [(f"n{a}", f"n{b}", rnd.randint(1, 500)) for a in range(60) for b in range(a) if rnd.random() < 0.6] + [("x0", "x1", 3)]
    rows += [(b, a, w) for a, b, w in rows]
    sliced, real = [], traverse.F.expr
    monkeypatch.setattr(traverse.F, "expr", lambda e: (sliced.append(e) if "slice(ways" in e else None, real(e))[1])
    seeds = ["n3", "n50", "x1"]
    got = {r["node"]: (r["dist"], r["label"]) for r in traverse.nearest_source(spark.createDataFrame(rows, "src string, dst string, w long"), spark.createDataFrame([(s, s) for s in seeds], "node string, label string"), mutual=True).collect()}
    want, moved = {s: (0, s) for s in seeds}, True
    while moved:
        moved = False
        for a, b, w in rows:
            if a in want and b not in seeds and (b not in want or (want[a][0] + w, want[a][1]) < want[b]):
                want[b], moved = (want[a][0] + w, want[a][1]), True
    assert got == want and sliced


@pytest.mark.parametrize("ring", [False, True])
def test_closure_of_far_terminals_takes_light_edges(spark, monkeypatch, ring):
    """Terminals at the end of long edges don't widen the balls, and only light edges are dealt; where these don't lead to all, all are. Distances are those along all edges."""
    rnd = random.Random(9)
    rows = [(f"n{a}", f"n{b}", rnd.randint(1, 500)) for a in range(60) for b in range(a) if rnd.random() < 0.7]
    rows += [(f"t{k}", f"n{7 * k}", 4000 + k) for k in range(5)] + [("n1", "n2", 1), ("t0", "n9", 4100)]
    if ring:  # behind a heavy edge that isn't a terminal's own, and in a part of its own
        rows += [("n5", "y", 9000), ("y", "t9", 2), ("z0", "z1", 700)]
    rows += [(b, a, w) for a, b, w in rows]
    ends = ["t0", "t1", "t2", "t3", "t4", "n30", *(["t9", "z0", "z1"] if ring else [])]
    counts, limits, deal, real = [], [], traverse.dealt, traverse.shortest
    monkeypatch.setattr(traverse, "dealt", lambda core: (counts.append(core.count()), deal(core))[1])
    monkeypatch.setattr(traverse, "shortest", lambda e, s, *a, **o: (limits.append(o["limit"]) if o.get("by") and o.get("limit") is not None else None, real(e, s, *a, **o))[1])
    got = {(r["a"], r["b"]): r["dist"] for r in traverse.closure(spark.createDataFrame(rows, "src string, dst string, w long"), spark.createDataFrame([(e,) for e in ends], "node string")).collect()}
    dist = {(e, e): 0 for e in ends}
    for _ in range(70):
        for a, b, w in rows:
            for e in ends:
                if (e, a) in dist:
                    dist[e, b] = min(dist.get((e, b), 1 << 60), dist[e, a] + w)
    assert got == {(a, b): dist[a, b] for a in ends for b in ends if a != b and (a, b) in dist}
    if not ring:
        assert max(limits) < 500 and max(counts) < len(rows) / 2


def test_reached_nodes_need_no_distances(spark):
    rows = [("a", "b", 7), ("b", "c", 9), ("x", "y", 1)]
    edges = spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src string, dst string, w long")
    assert sorted(r["node"] for r in traverse.reached(edges, "a").collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("held", [0, 100])
def test_beam_search_of_a_graph_that_the_driver_does_not_hold(spark, monkeypatch, held):
    """The same selection, in order, from searches in Spark, from the part that matters, and from a graph held whole; many ways tie."""
    rnd = random.Random(6)
    sizes = [rnd.randint(1, 9) for _ in range(80)]
    links = {(min(p), max(p)): rnd.randint(1, 20) for p in (rnd.sample(range(80), 2) for _ in range(160))}
    n = spark.createDataFrame(list(enumerate(sizes)), "cluster_id long, size long")
    e = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a long, b long, dist long")
    run = lambda: search.budgeted_search(n, e, [3, 40], 4.0, 1.5, 2).first()
    want = run()
    for name in ("LINKS", "HELD"):
        monkeypatch.setattr(search, name, held, raising=False)
    monkeypatch.setattr(search, "ROOM", 4, raising=False)
    assert run() == want and want["size"] > 3


def test_beam_states_share_ways(spark, monkeypatch):
    """Arrays of all clusters are made for few states: a round takes no time for clusters that it brings no nearer."""
    made, real = [], search.Ways
    monkeypatch.setattr(search, "Ways", lambda *a: (made.append(1), real(*a))[1])
    n = spark.range(4000).selectExpr("id AS cluster_id", "1L AS size")
    e = spark.range(1, 400).selectExpr("0L AS a", "id AS b", "double(id) AS dist")
    got = search.budgeted_search(n, e, [0], 30.0, 1.5, 25).first()
    assert got["selected"][0] == 0 and got["size"] > 20 and 0 < len(made) < 10


@pytest.mark.parametrize("spread", [9, 2])
def test_reached_nodes_deal_no_edges_at_first(spark, monkeypatch, spread):
    """Rounds over edges as they lie; ways of more rounds than SPREAD take a search from all that is found."""
    monkeypatch.setattr(traverse, "SPREAD", spread, raising=False)
    dealing, deal = [], traverse.dealt
    monkeypatch.setattr(traverse, "dealt", lambda core: (dealing.append(1), deal(core))[1])
    rows = [(f"n{k}", f"n{k + 1}", 3) for k in range(7)] + [("n2", "n2", 1), ("x", "n0", 1), ("n1", "bad", None)]
    got = [r["node"] for r in traverse.reached(spark.createDataFrame(rows, "src string, dst string, w long"), "n0").collect()]
    assert sorted(got) == [f"n{k}" for k in range(8)] and bool(dealing) == (spread == 2)


def test_paths_write_each_place_once(spark, monkeypatch):
    wrote, real = [], traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, label: (wrote.append((label, real(df, label))), wrote[-1][1])[1])
    tree = spark.createDataFrame([(k, k - 1 if k else None) for k in range(40)], "node long, parent long")
    got = sorted(tuple(r) for r in traverse.path_to_sources(tree, tree.select("node")).collect())
    assert got == sorted((t, p, t - p) for t in range(40) for p in range(t + 1))
    assert sum(df.count() for label, df in wrote if label == "path") == len(got)
