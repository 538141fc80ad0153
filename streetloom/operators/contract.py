"""Road networks without their thin parts: dead ends and chains of nodes with two neighbours, which are most of a road network.

A level takes out all dead ends and chains at once. Arcs along a chain jump over each other, so a chain of n nodes takes log2(n)
jumps; what is left between two junctions is one arc of the chain's length. Each node taken out remembers the junctions that it hangs
on, with the ways from them, so a search over the core alone gives every node's distance afterwards. Levels follow
one another while they take out a share worth a pass; trees are gone after a logarithm of their size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written

#: Relaxations in one job; the share of nodes that a level must take out.
STEPS, WORTH = 6, 0.1

#: Nodes among which one is counted to tell whether a level is worth it, and how many counted ones tell; fewer, and all are.
PART, TOLD = 64, 1_000


@dataclass
class Contracted:
    """core (src, dst, w, h): the least ways between nodes that are left, h is how many edges each stands for. links[k] (node, via, w, h): the way to a node taken out at level k from one left after it."""

    core: DataFrame
    links: list[DataFrame]


def exact(kind: str) -> str:
    """A type in which sums of weights don't depend on their order; with one digit more, a sum of two would lose its last place."""
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "decimal(37,15)"


def bound(limit, kind: str) -> str | None:
    """A limit of distances as SQL of an exact type; none for none and infinity."""
    if limit is None or limit == math.inf:
        return None
    return f"CAST('{math.floor(limit) if kind == 'bigint' else limit}' AS {kind})"


def sound(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, w) with exact weights; loops, and weights that no path can have (null, infinite, NaN), are left out."""
    kind = dict(edges.dtypes)["w"]
    w = F.col("w")
    fine = w.isNotNull() & ~F.isnan(w.cast("double")) & (F.abs(w.cast("double")) < float("inf"))
    return edges.filter((F.col("src") != F.col("dst")) & fine).select("src", "dst", w.cast(exact(kind)).alias("w"))


def contract(edges: DataFrame, keep: DataFrame, limit=None) -> Contracted:
    """Edges (src, dst, w) from sound(), which needn't be the same both ways; nodes in keep (node) stay. Ways beyond limit may be left out."""
    if not _worth(edges):
        return Contracted(edges.withColumn("h", F.lit(1).cast("bigint")), [])
    kind = dict(edges.dtypes)["w"]
    way = f"struct<w:{kind},h:bigint>"
    none = F.lit(None).cast(way)
    one = F.struct(F.col("w"), F.lit(1).cast("bigint").alias("h")).cast(way)
    # an arc stands once from each of its ends: f leads from src to dst, r back
    there = edges.select("src", "dst", one.alias("f"), none.alias("r"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), none.alias("f"), one.alias("r"))
    arcs = written(_least(there.unionByName(back), "dst"), "arcs")
    keep = keep.select("node").distinct()
    links: list[DataFrame] = []
    left = arcs.select("src").distinct().count()
    while left:
        degree = arcs.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi")).filter("n <= 2")
        thin = written(degree.withColumnRenamed("src", "node").join(keep, "node", "left_anti"), "thin")
        gone = thin.count()
        if gone < WORTH * left:
            dropped(thin)
            break
        walks = _walked(arcs, thin, kind, limit)
        ended = walks.filter("next IS NULL AND NOT dead")  # the others lead to dead ends, or round a ring that nothing leads to
        links.append(written(ended.filter("inner AND r IS NOT NULL").select(F.col("src").alias("node"), F.col("to").alias("via"), "r.w", "r.h"), "links"))
        chains = ended.filter(~F.col("inner") & (F.col("src") != F.col("to"))).select("src", "to", "f", "r")
        after = written(_least(chains, "to").filter("f IS NOT NULL OR r IS NOT NULL"), "arcs")
        for spent in (walks, thin, arcs):
            dropped(spent)
        arcs = after
        left -= gone
    return Contracted(arcs.filter("f IS NOT NULL").select("src", "dst", "f.w", "f.h"), links)


def _worth(edges: DataFrame) -> bool:
    """Whether a first level takes out WORTH of the nodes from within chains, or WORTH of the edges at all: dead ends alone make no way shorter, and a level moves all edges.

    It is told from counts that merge by hash. Parallel edges count apart, so at worst a level isn't taken. Of large graphs one node in PART is counted with all
    its edges, as this moves every edge twice and settles nothing but whether a level comes first: results are the same with and without it.
    """
    r = _counted(edges, PART)
    if r["nodes"] < TOLD:
        r = _counted(edges, 1)
    return r["nodes"] > 0 and (r["within"] >= WORTH * r["nodes"] or (r["freed"] or 0) >= WORTH * r["ends"])


def _counted(edges: DataFrame, part: int):
    there, back = (edges.select(F.col(a).alias("node"), F.xxhash64(b).alias("h")) for a, b in (("src", "dst"), ("dst", "src")))
    ends = there.unionByName(back).filter(F.pmod(F.xxhash64("node"), F.lit(part)) == 0).groupBy("node").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    thin = (F.col("n") <= 4) | (F.col("lo") == F.col("hi"))
    return ends.agg(F.count("*").alias("nodes"), F.sum("n").alias("ends"), F.count_if(thin & (F.col("lo") != F.col("hi"))).alias("within"), F.sum(F.when(thin, F.col("n"))).alias("freed")).first()


def _least(arcs: DataFrame, end: str) -> DataFrame:
    """Of parallel ways the shortest, then the one of fewest edges."""
    return arcs.groupBy("src", F.col(end).alias("dst")).agg(F.min("f").alias("f"), F.min("r").alias("r"))


def _walked(arcs: DataFrame, thin: DataFrame, kind: str, limit) -> DataFrame:
    """(src, to, next, dead, inner, f, r): arcs followed through chains to where they end; inner ones begin at a node that goes, dead ones end at a dead end."""
    way = f"struct<w:{kind},h:bigint>"
    most = bound(limit, kind)

    def short(c: Column) -> Column:
        return c if most is None else F.when(c["w"] <= F.expr(most), c)

    def both(a: Column, b: Column) -> Column:
        total = F.struct((a["w"] + b["w"]).cast(kind).alias("w"), (a["h"] + b["h"]).alias("h")).cast(way)
        return short(F.when(a.isNotNull() & b.isNotNull(), total))

    ends = thin.select(F.col("node").alias("dst"), F.col("n").alias("n2"), "lo", "hi")
    tagged = arcs.join(ends, "dst", "left").join(thin.select(F.col("node").alias("src"), F.lit(True).alias("inner")), "src", "left")
    onward = F.when(F.col("n2") == 2, F.when(F.col("lo") == F.col("src"), F.col("hi")).otherwise(F.col("lo")))
    first = tagged.select("src", "dst", F.col("dst").alias("to"), onward.alias("next"), (F.coalesce("n2", F.lit(0)) == 1).alias("dead"), F.coalesce("inner", F.lit(False)).alias("inner"), short(F.col("f")).alias("f"), short(F.col("r")).alias("r"))
    walks = written(first, "walks")
    longest, reach = 2 * thin.count() + 2, 1
    while reach < longest and not walks.filter("next IS NOT NULL").isEmpty():
        reach *= 2
        over = walks.filter("inner").select(F.col("src").alias("to"), F.col("dst").alias("next"), F.col("to").alias("to2"), F.col("next").alias("next2"), F.col("dead").alias("dead2"), F.col("f").alias("f2"), F.col("r").alias("r2"))
        jumped = walks.filter("next IS NOT NULL").join(over, ["to", "next"]).select("src", "dst", F.col("to2").alias("to"), F.col("next2").alias("next"), F.col("dead2").alias("dead"), "inner", both(F.col("f"), F.col("f2")).alias("f"), both(F.col("r2"), F.col("r")).alias("r"))
        after = written(walks.filter("next IS NULL").unionByName(jumped), "walks")
        dropped(walks)
        walks = after
    return walks
