"""Shortest paths over a contracted graph, by relaxation in rounds.

Dead ends and chains are taken out first (contract.py). On the core a round joins the nodes that improved last with their edges and
keeps the best offer of each node; STEPS rounds make one job, and the state is written once a job. Core edges are
dealt by their source once, as one list a node by weight, and stay in place; edges of a node with more than HEAVY are dealt in pieces. Where nodes have many
edges, the first jobs relax along the FEW lightest of each alone, so most distances are near their last values before all edges are taken, once. Nodes that were taken out then get their
distances level by level, and parents come from one join of the original edges with the whole state.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, written
from .contract import STEPS, Contracted, bound, contract, sound

#: Edges of a node that lie in one piece; ranges of hashes by which nodes with more are found.
HEAVY, RANGES = 100_000, 1 << 16

#: Edges of a node in the first jobs, where nodes have DENSE on average; how many times the nodes that have a distance must grow in one for another of its kind.
FEW, DENSE, GROWN = 6, 24, 4

#: Rounds over edges as they lie, before they are dealt to tell what is reached.
SPREAD = 9

#: Edges a node among the light ones that bound a closure, about; the shares of all edges that they are taken from.
LIGHT, SHARES = 10, [k / 64 for k in range(1, 33)]


def shortest(edges: DataFrame, seeds: DataFrame, limit=None, pinned: bool = False, by: tuple[str, ...] = (), until=None, parents: bool = True, over: Contracted | None = None, ways: tuple[DataFrame, DataFrame | None] | None = None, mutual: bool = False) -> DataFrame:
    """(*by, node, dist, label, hops, parent) from seeds (*by, node, label) along edges (src, dst, w).

    Of equal distances the smallest label wins, then fewest hops, then the smallest
    parent. With pinned a seed keeps its own label even where another seed is at
    distance 0. limit bounds distances, inclusively. by separates independent searches. With until, a node, nodes farther than it
    may be missing; it may be a DataFrame (node) too, with over: all distances are bounds then, which no job would better by a tenth for the farthest of these nodes. Without parents hops and parents are left out, and seeds may be without labels, which are left out then, and have a dist to begin with. over is a contraction of sound(edges) made before, which must have kept the seeds and until, and ways its core as dealt() left it, for several searches over one. mutual says that edges lead both ways. Weights are summed exactly: whole numbers as such, others with 15 digits after the point.
    """
    kind = dict(edges.dtypes)["w"]
    whole = sound(edges)
    told = [c for c in ("label",) if c in seeds.columns] + (["hops"] if parents else [])
    seeds = seeds.groupBy(*by, "node").agg(F.min("label").alias("label")) if "label" in told else seeds.select(*by, "node", *(c for c in ("dist",) if c in seeds.columns)).distinct()
    keep = seeds.select("node")
    if over is None and until is not None:
        keep = keep.unionByName(edges.sparkSession.createDataFrame([(until,)], f"node {dict(seeds.dtypes)['node']}"))
    if over is None and (most := bound(limit, dict(whole.dtypes)["w"])):
        whole = whole.filter(F.col("w") <= F.expr(most))  # no way within the limit takes a longer edge
    parts = over or contract(whole, keep, limit)
    state = _searched(parts.core, seeds, dict(whole.dtypes)["w"], limit, pinned, by, until, told, ways, mutual)
    for links in reversed(parts.links):
        state = state.unionByName(written(_hung(state, links, dict(whole.dtypes)["w"], limit, by, told), "state"))
    here = [*by, "node", F.col("dist").cast(kind).alias("dist"), *told]
    if not parents:
        return state.select(*here)
    if until is not None and (most := _farthest(state.filter(F.col("node") == F.lit(until)), dict(whole.dtypes)["w"])):
        state, whole = state.filter(F.col("dist") <= F.expr(most)), whole.filter(F.col("w") <= F.expr(most))
    return _with_parents(whole, state, by).select(*here, "parent")


def _farthest(state: DataFrame, kind: str) -> str | None:
    """The greatest distance as SQL; none of no rows."""
    d = state.agg(F.max("dist").alias("d")).first()["d"]
    return None if d is None else f"CAST('{d}' AS {kind})"


def dealt(core: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(src, ways) of core edges, one list (w, dst, h) a node in this order, where a state's rows lie, and apart from them (src, piece, ways) of nodes with more than HEAVY; kept until released().

    A light node's list begins with the node itself, without a weight: the row by which a state keeps what it has.
    """
    parts = int(core.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    way = F.struct("w", "dst", "h").alias("way")
    # counts of ranges of hashes merge where they are made, counts of nodes hardly; only a range with more than HEAVY can hold such a node
    spread = F.pmod(F.xxhash64("src"), F.lit(RANGES)).alias("range")
    crowded = written(core.groupBy(spread).agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("range"), "crowded")
    some = core.limit(0) if crowded.isEmpty() else core.withColumn("range", spread).join(F.broadcast(crowded), "range", "left_semi")
    heavy = written(some.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("src", F.ceil(F.col("n") / HEAVY).cast("int").alias("pieces")), "heavy")
    rest = None
    if not heavy.isEmpty():
        rest = core.join(heavy, "src").withColumn("piece", F.pmod(F.xxhash64("dst"), F.col("pieces")).cast("int")).repartition(parts, "src", "piece").groupBy("src", "piece").agg(F.collect_list(way).alias("ways"))
        core = core.join(heavy, "src", "left_anti")
    nothing = {c: F.lit(None).cast(dict(core.dtypes)[c]).alias(c) for c in ("w", "h")}
    own = F.array(F.struct(nothing["w"], F.col("src").alias("dst"), nothing["h"]))
    light = core.repartition(parts, "src").groupBy("src").agg(F.collect_list(way).alias("ways")).select("src", F.sort_array(F.concat(own, "ways")).alias("ways")).sortWithinPartitions("src")
    kept = [df if df is None else df.persist(StorageLevel.MEMORY_AND_DISK) for df in (light, rest)]
    for df in kept:
        if df is not None:
            df.count()  # once they lie in place, where they lie is known, and no job deals them again
    return kept[0], kept[1]


def released(ways: tuple[DataFrame, DataFrame | None]) -> None:
    for df in ways:
        if df is not None:
            df.unpersist()


def _searched(core: DataFrame, seeds: DataFrame, kind: str, limit, pinned: bool, by: tuple[str, ...], until, told: list[str], ways=None, mutual: bool = False) -> DataFrame:
    """The state (*by, node, dist, *told) of the core's nodes and the seeds, told being label, hops, both or neither."""
    keys = [*by, "node"]
    edges, heavy = mine = ways or dealt(core)
    pieces = None if heavy is None else written(heavy.groupBy("src").agg(F.collect_set("piece").alias("pieces")), "pieces")
    start = {"label": F.col("label") if "label" in told else None, "hops": F.lit(0).cast("bigint").alias("hops")}
    state = written(seeds.select(*keys, (F.col("dist") if "dist" in seeds.columns else F.lit(0)).cast(kind).alias("dist"), *(start[c] for c in told), F.lit(True).alias("seed"), F.lit(True).alias("fresh")), "state")
    places = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {"dist": kind, "label": dict(seeds.dtypes).get("label"), "hops": "bigint"}
    fields = ["dist", *told]
    one = fields == ["dist"]  # a plain number is merged by hash, a struct by sorting
    best = kind if one else f"struct<{','.join(f'{c}:{kinds[c]}' for c in fields)}>"
    met = {"dist": "dist + e.w", "label": "label", "hops": "hops + e.h"}
    held, offered = ("dist", met["dist"]) if one else (f"struct({', '.join(fields)})", f"struct({', '.join(met[c] for c in fields)})")
    itself = f"array(CAST(struct(NULL, node, NULL) AS struct<w:{kind},dst:{dict(seeds.dtypes)['node']},h:bigint>))"
    better = "offer IS NOT NULL AND (old IS NULL OR offer < old" + (" AND NOT seed)" if pinned else ")")

    def relaxed(source: DataFrame, bounds: list, few: bool) -> DataFrame:
        """A state's row and its offers come out of one join, so that rounds of a job stand in line and no plan is doubled."""
        taken = f"slice(ways, 1, {FEW + 1})" if few else "ways"
        spread = source.join(edges, (F.col("node") == F.col("src")) & F.col("fresh"), "left").select(*by, "dist", *told, "seed", F.explode(F.expr(f"coalesce({taken}, {itself})")).alias("e"))
        if heavy is not None and not few:
            cut = source.filter("fresh").join(pieces.withColumnRenamed("src", "node"), "node").withColumn("p", F.explode("pieces"))
            spread = spread.unionByName(cut.join(heavy, (F.col("node") == F.col("src")) & (F.col("p") == F.col("piece"))).select(*by, "dist", *told, "seed", F.explode("ways").alias("e")))
        if bounds:
            spread = spread.filter("e.w IS NULL OR " + " AND ".join(f"dist + e.w <= {b}" for b in bounds))
        if by:  # dealt once for the merge and the next round's join
            spread = spread.repartition(places, F.col("e.dst"))
        offers = spread.select(*by, F.col("e.dst").alias("node"), F.expr(f"CASE WHEN e.w IS NULL THEN CAST({held} AS {best}) END").alias("old"), F.expr(f"CASE WHEN e.w IS NOT NULL THEN CAST({offered} AS {best}) END").alias("offer"), F.expr("e.w IS NULL AND seed").alias("seed"))
        merged = offers.groupBy(*keys).agg(F.min("old").alias("old"), F.min("offer").alias("offer"), F.max("seed").alias("seed"))
        after = merged.select(*keys, F.expr(f"CASE WHEN {better} THEN offer ELSE old END").alias("b"), "seed", F.expr(better).alias("fresh"))
        return after.select(*keys, *([F.col("b").alias("dist")] if one else [F.col(f"b.{c}").alias(c) for c in fields]), "seed", "fresh")

    size = edges.agg(F.count("*").alias("n"), F.avg(F.size("ways")).alias("mean")).first()
    few, had = not by and (size["mean"] or 0) > DENSE, state.count()
    ends, far = until.count() if isinstance(until, DataFrame) else 1, None
    whole = False
    while True:
        bounds = [b for b in [bound(limit, kind)] if b]
        if until is not None:
            met_ends = state.join(until, "node", "left_semi") if isinstance(until, DataFrame) else state.filter(F.col("node") == F.lit(until))
            r = met_ends.agg(F.count("*").alias("n"), F.max("dist").alias("d")).first()
            if r["n"] == ends:
                if isinstance(until, DataFrame) and far is not None and 10 * r["d"] >= 9 * far:
                    break
                far = r["d"]
                bounds.append(f"CAST('{far}' AS {kind})")
        if mutual and not few and not by and heavy is None:
            # once all nodes have a distance, no offer beyond the greatest one betters any
            whole = whole or had >= size["n"] and edges.select(F.col("src").alias("node")).join(state, "node", "left_anti").isEmpty()
            bounds += [b for b in [_farthest(state, kind) if whole else None] if b]
        after = state.repartition(places, "node")
        for _ in range(STEPS if heavy is None else 1):
            after = relaxed(after, bounds, few)
        after = written(after, "state")
        dropped(state)
        state = after
        done = state.filter("fresh").isEmpty()
        if few:
            before, had = had, state.count()
            if done or had < GROWN * before or 2 * had > size["n"]:
                few, state = False, state.withColumn("fresh", F.lit(True))
        elif done:
            break
        else:
            had = state.count()
    if ways is None:
        released(mine)
    return state.select(*keys, *fields)


def _hung(state: DataFrame, links: DataFrame, kind: str, limit, by: tuple[str, ...], told: list[str]) -> DataFrame:
    """States of nodes (node) by ways (node, via, w, h) from nodes that have one."""
    ways = links.select(F.col("node").alias("inner"), F.col("via").alias("node"), "w", "h")
    past = {"label": F.col("label") if "label" in told else None, "hops": (F.col("hops") + F.col("h")).alias("hops") if "hops" in told else None}
    best = F.struct((F.col("dist") + F.col("w")).cast(kind).alias("dist"), *(past[c] for c in told))
    found = state.join(ways, "node").select(*by, F.col("inner").alias("node"), best.alias("best"))
    if most := bound(limit, kind):
        found = found.filter(F.col("best.dist") <= F.expr(most))
    return found.groupBy(*by, "node").agg(F.min("best").alias("best")).select(*by, "node", "best.*")


def _with_parents(edges: DataFrame, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of the neighbours that are nearer by the order (dist, hops), the one through which a node has its state; the smallest of several."""
    far = state.select(*by, F.col("node").alias("src"), F.col("dist").alias("d1"), F.col("label").alias("l1"), F.col("hops").alias("h1"))
    own = state.filter("hops > 0").select(*by, F.col("node").alias("dst"), F.col("dist").alias("d2"), F.col("label").alias("l2"), F.col("hops").alias("h2"))
    met = edges.join(far, "src").join(own, [*by, "dst"]).filter("d1 + w = d2 AND l1 <=> l2 AND h1 + 1 = h2")
    up = met.groupBy(*by, F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    return state.join(up, [*by, "node"], "left")


def distances(edges: DataFrame, source, limit=None) -> DataFrame:
    """(node, dist) from one node, or from every node of a DataFrame (node)."""
    seeds = source if isinstance(source, DataFrame) else edges.sparkSession.createDataFrame([(source,)], f"node {dict(edges.dtypes)['src']}")
    return shortest(edges, seeds.select("node"), limit, parents=False)


def reached(edges: DataFrame, source) -> DataFrame:
    """(node) to which ways lead from one node, or from nodes (node). Rounds go over the edges as they lie, from new nodes alone; what SPREAD rounds leave open takes a search by edges that count nothing."""
    seeds = source if isinstance(source, DataFrame) else edges.sparkSession.createDataFrame([(source,)], f"node {dict(edges.dtypes)['src']}")
    fine = sound(edges)
    found, done = _spread(fine, seeds)
    if done:
        return found
    free = fine.withColumn("w", F.lit(0).cast("bigint"))
    return shortest(free, found, parents=False, over=contract(free, found)).select("node")


def _spread(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, bool]:
    """(node) that SPREAD rounds along edges reach from seeds (node), and whether there are no others."""
    new = written(seeds.select("node").distinct(), "reached")
    found = [new]
    for _ in range(SPREAD):
        step = edges.join(new.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = written(step.join(reduce(DataFrame.unionByName, found), "node", "left_anti"), "reached")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found), True
        found.append(new)
    return reduce(DataFrame.unionByName, found), False


def nearest_source(edges: DataFrame, sources: DataFrame, mutual: bool = False) -> DataFrame:
    """(node, dist, label) by the nearest of sources (node, label), each of which keeps its own; mutual says that edges lead both ways."""
    return shortest(edges, sources, pinned=True, parents=False, mutual=mutual).select("node", "dist", "label")


def path_to_sources(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, pos, node): the chain of parents from each target to a source; targets that weren't reached have none.

    Paths double: with all places before 2^k and every node's 2^k-th ancestor, one join gives all places before 2^(k + 1).
    """
    up = written(tree.select("node", F.col("parent").alias("over")), "tree")
    places = [written(targets.select(F.col("node").alias("target")).distinct().join(up.select(F.col("node").alias("target")), "target").select("target", F.lit(0).cast("long").alias("pos"), F.col("target").alias("node")), "path")]
    up = up.filter("over IS NOT NULL")
    while True:
        step = 1 << len(places) - 1
        found = reduce(DataFrame.unionByName, places)
        more = written(found.join(up, "node").select("target", (F.col("pos") + step).alias("pos"), F.col("over").alias("node")), "path")  # places before aren't written again
        if more.isEmpty():
            return found
        places.append(more)
        next_up = written(up.join(up.select(F.col("node").alias("over"), F.col("over").alias("over2")), "over").select("node", F.col("over2").alias("over")), "tree")
        dropped(up)
        up = next_up


def closure(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """(a, b, dist): the distance from each terminal (node) to each other one that it reaches, along edges (src, dst, w) that lead both ways.

    Distances count from where a terminal's least edge ends: a way between two that is 2r or less beyond their least edges has an edge by which it leaves the ball
    of radius r around its one end and enters the one around its other end, so balls of half the distances do, however long the ways to the terminals are. A search
    from one terminal bounds them, along the light edges alone where they lead to all: r begins at three quarters of its farthest one and grows until all pairs that
    the bounds leave open are 2r apart at most. Where the light edges lead to all and r is no longer than they, none but they and the terminals' own are dealt. Terminals that this search doesn't reach are searched from without a bound.
    """
    named = written(terminals.select("node").distinct(), "ends")
    kind, whole = dict(edges.dtypes)["w"], sound(edges)
    sums = dict(whole.dtypes)["w"]
    own = whole.join(named.withColumnRenamed("node", "src"), "src").groupBy(F.col("src").alias("node")).agg(F.min("w").alias("m"))
    ends = written(named.join(own, "node", "left").select("node", F.coalesce("m", F.lit(0)).cast(sums).alias("m")), "ends")
    names = ends.select("node")
    pairs = lambda df: df.join(names, "node").filter("start <> node").select(F.col("start").alias("a"), F.col("node").alias("b"), "dist")
    first = names.agg(F.min("node").alias("node")).filter("node IS NOT NULL")
    told = lambda df: written(df.join(ends, "node").select("node", "dist", "m"), "near")
    within, light = _light(whole, names)
    near = None
    if light is not None:
        parts = contract(light, names)
        ways = dealt(parts.core)
        near = told(shortest(light, first, parents=False, over=parts, ways=ways, until=names))
        if near.count() < ends.count():
            released(ways)
            near = None
    if near is None:
        within, light = None, whole
        parts = contract(whole, names)
        ways = dealt(parts.core)
        near = told(shortest(whole, first, parents=False, over=parts, ways=ways))
    apart = written(names.join(near.select("node"), "node", "left_anti"), "apart")
    left, right = near.select(F.col("node").alias("a"), F.col("dist").alias("da"), F.col("m").alias("ma")), near.select(F.col("node").alias("b"), F.col("dist").alias("db"), F.col("m").alias("mb"))
    # by the first terminal; of each pair, as the result has, and what of it lies beyond the least edges
    around = left.join(right, F.col("a") != F.col("b")).select("a", "b", (F.col("da") + F.col("db")).cast(sums).alias("dist"), (F.col("ma") + F.col("mb")).cast(sums).alias("m"))
    start = near.join(first.select(F.col("node").alias("one")), F.col("node") == F.col("one"), "left")
    far = start.agg(F.max(F.when(F.col("one").isNull(), F.col("dist") - F.col("m"))) - F.max(F.when(F.col("one").isNotNull(), F.col("m"))), F.max("m"))
    far, longest = (x or 0 for x in far.first())
    half = (lambda d: (d + 1) // 2) if sums == "bigint" else (lambda d: Decimal(d) / 2 * Decimal("1.000001"))
    far = max(far, 0)
    r = half(far + far // 2) if sums == "bigint" else half(Decimal(far) * 3 / 2)  # pairs may be farther apart than the first one is from any
    seeds = near.select(F.col("node").alias("start"), "node", (-F.col("m")).alias("dist"))
    while True:
        if within is not None and r > within:  # the light edges don't do
            released(ways)
            within, light = r, written(_short(whole, names, r, sums), "short")
            parts = contract(light, names, r + longest)
            ways = dealt(parts.core)
        balls = written(shortest(light, seeds, limit=r, by=("start",), parents=False, over=parts, ways=ways).withColumn("dist", F.col("dist").cast(sums)), "balls")
        out = balls.select(F.col("start").alias("a"), F.col("node").alias("src"), F.col("dist").alias("da"))
        back = balls.select(F.col("start").alias("b"), F.col("node").alias("dst"), F.col("dist").alias("db"))
        leaving = _short(whole, names, 2 * r, sums).join(out, "src").filter(F.col("da") + F.col("w") > F.expr(bound(r, sums))).select("a", "dst", (F.col("da") + F.col("w")).cast(sums).alias("da"))
        # of the edges by which a ball's ways enter a node, the least
        crossing = leaving.groupBy("a", "dst").agg(F.min("da").alias("da")).join(back, "dst").filter("a <> b").select("a", "b", (F.col("da") + F.col("db")).cast(sums).alias("dist"))
        inside = pairs(balls).join(ends.select(F.col("node").alias("b"), "m"), "b").select("a", "b", (F.col("dist") - F.col("m")).cast(sums).alias("dist"))
        both = crossing.unionByName(inside).groupBy("a", "b").agg(F.min("dist").alias("beyond"))
        total = around.join(both, ["a", "b"], "left").select("a", "b", F.least("dist", F.col("beyond") + F.col("m")).cast(sums).alias("dist"), "m")
        found = written(total.withColumn("beyond", F.col("dist") - F.col("m")), "pairs")
        dropped(balls)
        most = found.agg(F.max("beyond")).first()[0]
        if most is None or most <= 2 * r:
            break
        dropped(found)
        r = min(half(most), 2 * r or half(most))
    found = found.select("a", "b", "dist")
    if not apart.isEmpty():  # the search was along all edges
        found = found.unionByName(written(pairs(shortest(whole, apart.select(F.col("node").alias("start"), "node"), parents=False, over=parts, ways=ways, by=("start",))), "pairs"))
    released(ways)
    return found.select("a", "b", F.col("dist").cast(kind).alias("dist"))


def _short(edges: DataFrame, ends: DataFrame, most, kind: str) -> DataFrame:
    """Edges (src, dst, w) of a length or less, and all of ends (node); those may stand twice."""
    short = edges.filter(F.col("w") <= F.expr(bound(most, kind)))
    long = edges.filter(F.col("w") > F.expr(bound(most, kind)))
    return short.unionByName(long.join(ends.withColumnRenamed("node", "src"), "src", "left_semi")).unionByName(long.join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi"))


def _light(edges: DataFrame, ends: DataFrame) -> tuple:
    """(length, edges (src, dst, w) of it or less and all of ends (node)): about LIGHT a node; nones where nodes don't have twice as many. Distances along them are bounds of those along all."""
    r = edges.agg(F.count("*").alias("n"), F.approx_count_distinct("src").alias("nodes"), F.percentile_approx("w", SHARES).alias("most")).first()
    share = next((k for k, s in enumerate(SHARES) if s * r["n"] >= LIGHT * r["nodes"]), None)
    if share is None or r["most"] is None:
        return None, None
    return r["most"][share], written(_short(edges, ends, r["most"][share], dict(edges.dtypes)["w"]), "light")


def frontier_links(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b, dist), a < b: the least way through an edge whose ends lie in cells (node, dist, label) of different labels."""
    left = cells.select(F.col("node").alias("src"), F.col("dist").alias("du"), F.col("label").alias("lu"))
    right = cells.select(F.col("node").alias("dst"), F.col("dist").alias("dv"), F.col("label").alias("lv"))
    crossing = edges.join(left, "src").join(right, "dst").filter("lu <> lv")
    return crossing.groupBy(F.least("lu", "lv").alias("a"), F.greatest("lu", "lv").alias("b")).agg(F.min(F.col("du") + F.col("w") + F.col("dv")).alias("dist"))


def top_by(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    """The first n rows of each group in an order, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)
