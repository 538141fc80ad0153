"""The road and building graph as two DataFrames.

nodes(node, kind, id, x, y): node is "c:" or "b:" and the id, since connectors
and buildings have id spaces of their own. edges(src, dst, kind, segment_id,
length_m): an undirected edge stands once, a directed graph has both ways.
Parallel edges, loops and edges of length zero are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONNECTOR, BUILDING, ROAD, ACCESS = "connector", "building", "road", "access"


class BuildGraphError(ValueError):
    """kind is duplicate_connector, duplicate_building, missing_connector, missing_building or short_road; id names the culprit."""

    #: Fixed texts.
    TEXTS = {
        "duplicate_connector": "duplicate connector id: {}",
        "duplicate_building": "duplicate building id: {}",
        "missing_connector": "missing connector id: {}",
        "missing_building": "missing building id: {}",
        "short_road": "road segment {} must reference at least two connectors",
    }

    def __init__(self, kind: str, id: str):
        super().__init__(self.TEXTS[kind].format(id))
        self.kind, self.id = kind, id


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    def counts(self) -> DataFrame:
        n = self.nodes.agg(F.count("*").alias("node_count"))
        return n.crossJoin(F.broadcast(self.edges.agg(F.count("*").alias("edge_count"))))  # one row each

    def both_ways(self, weight: str, limit=None) -> DataFrame:
        """(src, dst, w): the cheapest edge between neighbours, both ways, without loops; with a limit, none that is longer."""
        e = self.edges.select("src", "dst", F.expr(weight).alias("w")).filter("src <> dst")
        if limit is not None:
            e = e.filter(F.col("w") <= F.lit(limit))
        if self.directed:
            return e.groupBy("src", "dst").agg(F.min("w").alias("w"))
        pairs = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("w").alias("w"))
        ways = F.inline(F.array(*(F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), "w") for x, y in (("a", "b"), ("b", "a")))))
        return pairs.select(ways)


#: Access edges cost nothing in clustering, and their length everywhere else.
FREE_ACCESS = f"CASE WHEN kind = '{ACCESS}' THEN 0 ELSE length_m END"
FULL_WEIGHT = "length_m"


def connector_node(id) -> Column:
    return F.concat(F.lit("c:"), F.col(id).cast("string") if isinstance(id, str) else id)


def building_node(id) -> Column:
    return F.concat(F.lit("b:"), F.col(id).cast("string") if isinstance(id, str) else id)


def exploded_refs(segments: DataFrame) -> DataFrame:
    """(segment_id, length_m, pos, connector_id, at); segments without refs give no row."""
    refs = segments.select(F.col("id").alias("segment_id"), "length_m", F.posexplode("connectors").alias("pos", "ref"))
    return refs.select("segment_id", "length_m", "pos", F.col("ref.connector_id").alias("connector_id"), F.col("ref.at").alias("at"))


def piece_edges(refs: DataFrame) -> DataFrame:
    """An edge between each two consecutive refs of a segment, in order of at and then of place: its share of the length."""
    order = Window.partitionBy("segment_id").orderBy("at", "pos")
    pairs = refs.withColumn("next_id", F.lead("connector_id").over(order)).withColumn("next_at", F.lead("at").over(order))
    return pairs.filter(F.col("next_id").isNotNull()).select(connector_node("connector_id").alias("src"), connector_node("next_id").alias("dst"), F.lit(ROAD).alias("kind"), "segment_id", (F.col("length_m") * F.abs(F.col("next_at") - F.col("at"))).alias("length_m"))


def access_edges(links: DataFrame) -> DataFrame:
    return links.select(building_node("building_id").alias("src"), connector_node("connector_id").alias("dst"), F.lit(ACCESS).alias("kind"), F.lit(None).cast("string").alias("segment_id"), F.col("distance_m").alias("length_m"))


def faults(segments: DataFrame, connectors: DataFrame, buildings: DataFrame, links: DataFrame) -> DataFrame:
    """(stage, kind, id): everything that building would reject; the first by stage and id is what it raises."""
    again = lambda df, stage, kind: df.groupBy("id").count().filter("count > 1").select(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
    missing = lambda used, there, stage, kind: used.distinct().join(there.select(F.col("id").alias("used")), "used", "left_anti").select(F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), F.col("used").cast("string").alias("id"))
    short = segments.filter(F.coalesce(F.size("connectors"), F.lit(0)) < 2).select(F.lit(3).alias("stage"), F.lit("short_road").alias("kind"), F.col("id").cast("string").alias("id"))
    return (
        again(connectors, 1, "duplicate_connector")
        .unionByName(again(buildings, 2, "duplicate_building"))
        .unionByName(short)
        .unionByName(missing(exploded_refs(segments).select(F.col("connector_id").alias("used")), connectors, 3, "missing_connector"))
        .unionByName(missing(links.select(F.col("building_id").alias("used")), buildings, 4, "missing_building"))
        .unionByName(missing(links.select(F.col("connector_id").alias("used")), connectors, 4, "missing_connector"))
    )


def build_graph(segments: DataFrame, connectors: DataFrame, buildings: DataFrame, links: DataFrame, directed: bool = False, check: bool = True) -> Graph:
    """segments(id, length_m, connectors), connectors and buildings (id, x, y), links(building_id, connector_id, distance_m)."""
    if check:
        first = faults(segments, connectors, buildings, links).orderBy("stage", "id", "kind").limit(1).collect()
        if first:
            raise BuildGraphError(first[0]["kind"], first[0]["id"])
    named = lambda df, node, kind: df.select(node("id").alias("node"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "x", "y")
    nodes = named(connectors, connector_node, CONNECTOR).unionByName(named(buildings, building_node, BUILDING))
    edges = piece_edges(exploded_refs(segments)).withColumn("segment_id", F.col("segment_id").cast("string")).unionByName(access_edges(links))
    if directed:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "segment_id", "length_m"))
    return Graph(nodes, edges, directed)
