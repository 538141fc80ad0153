"""One query for each capability, over the derived road graph, and the SQL that says the same."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cluster, nearest, routing, search, steiner, traverse
from ..operators.components import connected_components
from ..operators.graph import FULL_WEIGHT, Graph, exploded_refs, faults
from ..sources.files import inside_box, read_connectors, read_id_list, read_roads, read_sniffed_csv, road_segments, stringify_complex, write_csv
from ..sources.geopackage import read_geopackage, write_geopackage
from ..sources.geoparquet import SRID, read_geoparquet, srid_of, write_geoparquet
from ..storage import shared_dir, written
from . import derived as d
from .derived import LIMIT, SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function by its name, and the SQL that says the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def on_graph(sql: str) -> str:
    return f"WITH RECURSIVE {SQL} {sql}"


def weighted(g: Graph) -> DataFrame:
    return written(g.both_ways(FULL_WEIGHT), "edges")


def node_frame(spark: SparkSession, nodes: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node string")


# Scans, projections, filters


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors as features: a point of 1 by 2 units around it as bbox."""
    c = d.connectors(spark, sf_dir)
    return c.select("id", F.struct((F.col("x") - 1).alias("xmin"), (F.col("x") + 1).alias("xmax"), (F.col("y") - 2).alias("ymin"), (F.col("y") + 2).alias("ymax")).alias("bbox"), F.struct("x", "y").alias("at"))


@query("SELECT p_partkey AS id FROM part WHERE (p_partkey * 37) % 1009 - 1 > 99 AND (p_partkey * 37) % 1009 + 1 < 601 AND (p_partkey * 91) % 997 - 2 > 98 AND (p_partkey * 91) % 997 + 2 < 702")
def bbox_filter(spark, sf_dir):
    return features(spark, sf_dir).filter(inside_box((99, 98, 601, 702))).select("id")


@query("SELECT p_partkey AS id, CAST((p_partkey * 37) % 1009 AS DOUBLE) AS px, CAST((p_partkey * 91) % 997 - 2 AS DOUBLE) AS south FROM part")
def nested_field_project(spark, sf_dir):
    return features(spark, sf_dir).select("id", F.col("at.x").alias("px"), F.col("bbox.ymin").alias("south"))


@query("""SELECT o_orderkey AS id, CAST(len AS VARCHAR) AS amount, '[' || string_agg('{"part":' || l_partkey || ',"line":' || l_linenumber || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS items
FROM (SELECT DISTINCT o_orderkey, CAST(round(o_totalprice) AS DECIMAL(12, 0)) AS len, l_partkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY ALL""")
def stringify_complex_columns(spark, sf_dir):
    items = d.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")).alias("i")).distinct()
    lists = items.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("i")), lambda i: F.struct(i["part"].alias("part"), i["line"].alias("line"))).alias("items"))
    orders = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("decimal(12,0)").alias("amount"))
    return stringify_complex(orders.join(lists, "id"))


@query(f"WITH {SQL} SELECT road_id AS segment_id, k AS pos, connector_id, k AS \"at\" FROM refs")
def explode_refs(spark, sf_dir):
    return exploded_refs(d.segments(spark, sf_dir)).select("segment_id", F.col("pos").cast("long").alias("pos"), "connector_id", "at")


def _id_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a list file has them: names of nations, padded, with comments and blanks between."""
    return d.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(F.concat(F.lit("  "), "n_name", F.lit(" ")), F.concat(F.lit("# "), "n_name"), F.lit(" "))).alias("value"))


def _shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streetloom-{name}-{uuid.uuid4().hex}"


@query("SELECT DISTINCT id FROM (SELECT n_name AS id FROM nation UNION ALL SELECT r_name FROM region)")
def id_list_union_distinct(spark, sf_dir):
    inline = [r[0] for r in d.table(spark, sf_dir, "region").select("r_name").collect()]
    path = _shared_path(spark, "ids")
    _id_file(spark, sf_dir).select("value").write.text(path)
    return read_id_list(spark, path, inline).select("id")


@query("""WITH lines AS (SELECT n_name AS id, 1 AS part, n_nationkey AS n FROM nation UNION ALL SELECT n_name, 2, -n_nationkey FROM nation UNION ALL SELECT r_name, 0, r_regionkey FROM region)
SELECT id, row_number() OVER (ORDER BY part, n) AS place FROM (SELECT id, min((part, n)) AS f, f[1] AS part, f[2] AS n FROM lines GROUP BY id)""")
def id_list_order(spark, sf_dir):
    """Places of ids at their first appearance in several files of different lengths: regions inline, nations by key, then all again backwards."""
    inline = [r[0] for r in d.table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").collect()]
    path = _shared_path(spark, "ids")
    names = _id_file(spark, sf_dir)
    backwards = names.select(F.lit(2).alias("part"), (-F.col("n_nationkey")).alias("n"), "value").unionByName(names.select(F.lit(3).alias("part"), F.lit(0).alias("n"), F.lit("# the end").alias("value")))
    lines = names.select(F.lit(1).alias("part"), F.col("n_nationkey").alias("n"), "value").unionByName(backwards)
    lines.repartitionByRange(5, "part", "n").sortWithinPartitions("part", "n").select("value").write.text(path)
    return read_id_list(spark, path, inline).select("id", F.row_number().over(Window.orderBy("ord")).cast("long").alias("place"))  # names of nations and regions


@query(f"WITH {SQL} SELECT CAST(road_id AS VARCHAR) AS id, CAST(max(len) AS DOUBLE) AS length_m, string_agg(CAST(connector_id AS VARCHAR), ',' ORDER BY k // 2, k) AS connectors FROM refs GROUP BY road_id")
def csv_roads_over_files(spark, sf_dir):
    """Refs of every road lie in several CSV files, two at each place, and keep the order of the files."""
    path = _shared_path(spark, "refs")
    refs = d.refs(spark, sf_dir).select("road_id", "connector_id", F.expr("cast(ord div 2 as double)").alias("at"), F.col("road_length_m").cast("double").alias("road_length_m"), "ord")
    write_csv(refs.repartitionByRange(6, "ord", "road_id").sortWithinPartitions("ord", "road_id").drop("ord"), path)
    s = read_roads(spark, path)
    return s.select("id", "length_m", F.array_join(F.transform("connectors", lambda c: c["connector_id"]), ",").alias("connectors"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CAST((p_partkey * 37) % 1009 AS DOUBLE) AS x, CAST((p_partkey * 91) % 997 AS DOUBLE) AS y FROM part")
def csv_connectors(spark, sf_dir):
    path = _shared_path(spark, "connectors")
    write_csv(d.connectors(spark, sf_dir), path)
    return read_connectors(spark, path)


@query("SELECT p_partkey AS id, 3857 AS srid, CAST((p_partkey * 37) % 1009 AS DOUBLE) AS px, CAST((p_partkey * 91) % 997 AS DOUBLE) AS py FROM part")
def geoparquet_round_trip(spark, sf_dir):
    """Points in web Mercator, whose system is read from the files."""
    path = _shared_path(spark, "geo").removeprefix("file://")
    write_geoparquet(d.connectors(spark, sf_dir).select("id", geo.point_wkb(F.col("x"), F.col("y")).alias("geometry")).withMetadata("geometry", {SRID: 3857}), path)
    got = read_geoparquet(spark, path)
    return got.select("id", F.lit(srid_of(got)).alias("srid"), geo.centroid_xy(F.col("geometry")).alias("p")).select("id", "srid", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("SELECT p_partkey AS id, p_name AS name, p_size > 25 AS big, CAST((p_partkey * 37) % 1009 AS DOUBLE) AS px, CAST((p_partkey * 91) % 997 AS DOUBLE) AS py FROM part")
def geopackage_round_trip(spark, sf_dir):
    """Points with columns of several types, written by several tasks and read again."""
    path = _shared_path(spark, "layer").removeprefix("file://") + ".gpkg"
    names = d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") > 25).alias("big"))
    rows = d.connectors(spark, sf_dir).join(names, "id").repartition(4, "id").select("id", "name", "big", geo.point_wkb(F.col("x"), F.col("y")).alias("geometry"))
    write_geopackage(rows.withMetadata("geometry", {SRID: 3857}), path, "places")
    got = read_geopackage(spark, path)
    return got.select("id", "name", "big", geo.centroid_xy(F.col("geometry")).alias("p")).select("id", "name", "big", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query(f"WITH {SQL} SELECT road_id AS id, max(len) AS length_m, count(*) AS n_refs, string_agg(CAST(connector_id AS VARCHAR), ',' ORDER BY k) AS connectors FROM refs GROUP BY road_id")
def read_roads_grouped(spark, sf_dir):
    s = road_segments(d.refs(spark, sf_dir))
    return s.select("id", "length_m", F.size("connectors").cast("long").alias("n_refs"), F.array_join(F.transform("connectors", lambda c: c["connector_id"].cast("string")), ",").alias("connectors"))


@query("""WITH l AS (SELECT l_orderkey AS id, list(CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber, l_partkey, l_quantity) AS v FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) GROUP BY 1)
SELECT id, v[len(v)] AS length_m FROM l""")
def road_length_fold(spark, sf_dir):
    items = d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("q")).distinct()
    rows = items.select(F.col("l_orderkey").alias("road_id"), F.col("l_partkey").alias("connector_id"), F.lit(0.0).alias("at"), F.col("q").alias("road_length_m"), F.struct("l_linenumber", "l_partkey", "q").alias("ord"))
    return road_segments(rows).select("id", "length_m")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 2")
def tree_segments_join(spark, sf_dir):
    """Segments by listed ids, once for each time that an id is listed."""
    from .pipeline import tree_segments

    segments = d.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"))
    ids = d.table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").cast("string").alias("segment_id"))
    return tree_segments(segments, ids)


@query("SELECT CAST(s_suppkey AS BIGINT) AS key, s_name AS name, s_acctbal AS balance FROM supplier")
def sniffed_csv(spark, sf_dir):
    """Semicolons and single quotes, told from the file."""
    path = _shared_path(spark, "sniffed")
    rows = d.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    rows.write.csv(path, header=True, sep=";", quote="'", quoteAll=True)
    got = read_sniffed_csv(spark, path)
    return got.select(F.col("key").cast("long").alias("key"), "name", F.col("balance").cast("double").alias("balance"))


# Graph construction


@query(f"WITH {SQL} SELECT src, dst, kind, segment_id, length_m FROM edges")
def build_edges(spark, sf_dir):
    return d.graph(spark, sf_dir).edges


@query(f"WITH {SQL} SELECT src, dst, kind, segment_id, length_m FROM edges UNION ALL SELECT dst, src, kind, segment_id, length_m FROM edges")
def build_edges_directed(spark, sf_dir):
    return d.graph(spark, sf_dir, directed=True).edges


@query(f"WITH {SQL} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def graph_counts(spark, sf_dir):
    return d.graph(spark, sf_dir).counts()


@query("""SELECT 1 AS stage, 'duplicate_connector' AS kind, CAST(l_partkey AS VARCHAR) AS id FROM lineitem GROUP BY l_partkey HAVING count(*) > 1
UNION ALL SELECT 2, 'duplicate_building', CAST(c_nationkey AS VARCHAR) FROM customer GROUP BY c_nationkey HAVING count(*) > 1
UNION ALL SELECT 3, 'short_road', CAST(l_orderkey AS VARCHAR) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_orderkey HAVING count(*) < 2
UNION ALL SELECT 4, 'missing_building', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT c_nationkey FROM customer)
UNION ALL SELECT 3, 'missing_connector', CAST(p AS VARCHAR) FROM (SELECT DISTINCT l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE p NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 4, 'missing_connector', CAST(p AS VARCHAR) FROM (SELECT DISTINCT (c_custkey * 7) % (SELECT count(*) FROM part) AS p FROM customer) WHERE p NOT IN (SELECT l_partkey FROM lineitem)""")
def validation_faults(spark, sf_dir):
    c = d.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    b = d.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("id"))
    return faults(d.segments(spark, sf_dir), c, b, d.links(spark, sf_dir))


# Geometry


@query("""SELECT p_partkey AS id, round(6378137 * radians(lon), 3) AS x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y
FROM (SELECT p_partkey, (p_partkey * 37) % 1009 / 1009.0::DOUBLE * 300 - 150 AS lon, (p_partkey * 91) % 997 / 997.0::DOUBLE * 160 - 80 AS lat FROM part)""")
def web_mercator(spark, sf_dir):
    c = d.connectors(spark, sf_dir)
    x, y = geo.to_web_mercator(F.col("x") / 1009 * 300 - 150, F.col("y") / 997 * 160 - 80)
    return c.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""SELECT p_partkey AS id, (p_partkey * 37) % 1009 / 1009.0::DOUBLE AS px, (p_partkey * 91) % 997 / 997.0::DOUBLE AS py FROM part""")
def point_wkb_round_trip(spark, sf_dir):
    c = d.connectors(spark, sf_dir).select("id", geo.point_wkb(F.col("x") / 1009, F.col("y") / 997).alias("g"))
    return c.select("id", geo.centroid_xy(F.col("g")).alias("p")).select("id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey * 37) % 1009 * 1.0::DOUBLE AS x, (p_partkey * 91) % 997 * 1.0::DOUBLE AS y, 1 + p_size AS s FROM part)
SELECT id, round(x + s / 2.0::DOUBLE, 6) AS cx, round(y + s / 2.0::DOUBLE, 6) AS cy FROM p""")
def line_centroid(spark, sf_dir):
    c = d.connectors(spark, sf_dir).join(d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1).alias("s")), "id")
    g = c.select("id", geo.line_wkb(F.col("x"), F.col("y"), F.col("x") + F.col("s"), F.col("y") + F.col("s")).alias("g"))
    return g.select("id", geo.centroid_xy(F.col("g")).alias("p")).select("id", F.round("p.x", 6).alias("cx"), F.round("p.y", 6).alias("cy"))


@query("""SELECT c_custkey AS id, round(6378137 * radians(1 + (c_custkey * 53) % 1013 / 1013.0::DOUBLE), 3) AS metres FROM customer""")
def geodesic_length(spark, sf_dir):
    """Along the equator the ellipsoid is a circle."""
    b = d.buildings(spark, sf_dir)
    g = b.select("id", geo.line_wkb(F.lit(0.0), F.lit(0.0), 1 + F.col("x") / 1013, F.lit(0.0)).alias("g"))
    return g.select("id", F.round(geo.length_spheroid(F.col("g")), 3).alias("metres"))


#: Squares of side s with a square hole of side h, and a second square beside; and the centroid that areas give.
SQUARES = """WITH p AS (SELECT p_partkey AS id, (p_partkey * 37) % 1009 * 1.0::DOUBLE AS x, (p_partkey * 91) % 997 * 1.0::DOUBLE AS y, 4.0::DOUBLE + p_size AS s, 1.0::DOUBLE + p_partkey % 3 AS h FROM part)
"""


def squares(spark, sf_dir) -> DataFrame:
    p = d.connectors(spark, sf_dir).join(d.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 4.0).alias("s"), (F.col("p_partkey") % 3 + 1.0).alias("h")), "id")

    def ring(x, y, side):
        return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]

    x, y, s, h = (F.col(c) for c in ("x", "y", "s", "h"))
    holed = geo.polygon_wkb(ring(x, y, s), ring(x + 0.5, y + 0.5, h))
    return p.select("id", holed.alias("one"), geo.multi_wkb(6, holed, geo.polygon_wkb(ring(x + 100, y, h))).alias("two"))


@query(SQUARES + """SELECT id, round((s * s * (x + s / 2) - h * h * (x + 0.5 + h / 2)) / (s * s - h * h), 6) AS cx, round((s * s * (y + s / 2) - h * h * (y + 0.5 + h / 2)) / (s * s - h * h), 6) AS cy FROM p""")
def polygon_centroid(spark, sf_dir):
    """A shell and a hole."""
    g = squares(spark, sf_dir).select("id", geo.centroid_xy(F.col("one")).alias("p"))
    return g.select("id", F.round("p.x", 6).alias("cx"), F.round("p.y", 6).alias("cy"))


@query(SQUARES + """SELECT id, round((s * s * (x + s / 2) - h * h * (x + 0.5 + h / 2) + h * h * (x + 100 + h / 2)) / (s * s), 6) AS cx, round((s * s * (y + s / 2) - h * h * (y + 0.5 + h / 2) + h * h * (y + h / 2)) / (s * s), 6) AS cy FROM p""")
def multi_polygon_centroid(spark, sf_dir):
    g = squares(spark, sf_dir).select("id", geo.centroid_xy(F.col("two")).alias("p"))
    return g.select("id", F.round("p.x", 6).alias("cx"), F.round("p.y", 6).alias("cy"))


#: Vincenty's inverse formula, ten steps for every line; lines go in any direction and are far from antipodal.
VINCENTY = """WITH RECURSIVE p AS (
    SELECT c_custkey AS id, c_custkey * 53 % 1013 / 1013.0::DOUBLE * 100 - 50 AS lon1, c_custkey * 29 % 991 / 991.0::DOUBLE * 100 - 50 AS lat1, 1 + c_nationkey AS dx, 10 - c_custkey % 21 AS dy FROM customer
), u AS (SELECT id, radians(dx) AS l, atan((1 - f) * tan(radians(lat1))) AS u1, atan((1 - f) * tan(radians(lat1 + dy))) AS u2, f FROM p, (SELECT 1 / 298.257223563::DOUBLE AS f)),
v(id, k, l, u1, u2, f, lam) AS (
    SELECT id, 0, l, u1, u2, f, l FROM u
    UNION ALL
    SELECT id, k + 1, l, u1, u2, f, l + (1 - c) * f * sa * (sg + c * ss * (m + c * cs * (2 * m * m - 1)))
    FROM (SELECT *, f / 16 * q * (4 + f * (4 - 3 * q)) AS c FROM (SELECT *, CASE WHEN q = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / q END AS m FROM (SELECT *, 1 - sa * sa AS q FROM (
        SELECT *, atan2(ss, cs) AS sg, cos(u1) * cos(u2) * sin(lam) / ss AS sa FROM (
            SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v WHERE k < 10)))))
), w AS (
    SELECT *, q * (1 / pow(1 - f, 2) - 1) AS uu, CASE WHEN q = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / q END AS m FROM (SELECT *, atan2(ss, cs) AS sg, 1 - pow(cos(u1) * cos(u2) * sin(lam) / ss, 2) AS q FROM (
        SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v WHERE k = 10))
), x AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS a, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS b FROM w)
SELECT id, round(6378137 * (1 - f) * a * (sg - b * ss * (m + b / 4 * (cs * (2 * m * m - 1) - b / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))), 3) AS metres FROM x
"""


@query(VINCENTY)
def oblique_length(spark, sf_dir):
    """Lines in all directions, each in a multi line."""
    b = d.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 53 % 1013 / 1013 * 100 - 50).alias("lon"), (F.col("c_custkey") * 29 % 991 / 991 * 100 - 50).alias("lat"), (F.col("c_nationkey") + 1).alias("dx"), (10 - F.col("c_custkey") % 21).alias("dy"))
    g = b.select("id", geo.multi_wkb(5, geo.line_wkb(F.col("lon"), F.col("lat"), F.col("lon") + F.col("dx"), F.col("lat") + F.col("dy"))).alias("g"))
    return g.select("id", F.round(geo.length_spheroid(F.col("g")), 3).alias("metres"))


# Nearest joins


NEAREST = """WITH c AS (SELECT p_partkey AS connector_id, (p_partkey * 37) % 1009 AS rx, (p_partkey * 91) % 997 AS ry FROM part),
b AS (SELECT c_custkey AS building_id, (c_custkey * 53) % 1013 AS lx, (c_custkey * 29) % 991 AS ly FROM customer),
n AS (SELECT building_id, connector_id, sqrt(CAST((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry) AS DOUBLE)) AS distance, lx, ly, rx, ry FROM b, c
    QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY distance, connector_id) = 1)
"""


@query(NEAREST + "SELECT building_id, connector_id, round(distance, 6) AS distance_m FROM n")
def nearest_connector(spark, sf_dir):
    found = nearest.first_link(nearest.nearest_join(d.buildings(spark, sf_dir), d.connectors(spark, sf_dir)))
    return found.select("building_id", "connector_id", F.round("distance_m", 6).alias("distance_m"))


@query(NEAREST + "SELECT building_id, connector_id, round((lx + rx) / 2.0::DOUBLE, 6) AS mx, round((ly + ry) / 2.0::DOUBLE, 6) AS my FROM n WHERE distance > 0")
def nearest_lines(spark, sf_dir):
    lines = nearest.link_lines(nearest.first_link(nearest.nearest_join(d.buildings(spark, sf_dir), d.connectors(spark, sf_dir))))
    p = lines.filter("distance_m > 0").select("building_id", "connector_id", geo.centroid_xy(F.col("geometry")).alias("p"))
    return p.select("building_id", "connector_id", F.round("p.x", 6).alias("mx"), F.round("p.y", 6).alias("my"))


# Traversal

#: Distances by a keyed recursion from seeds along edges, within a bound.
SSSP = """, s(node, dist) USING KEY (node) AS (
    SELECT node, CAST(0 AS BIGINT) FROM ({seeds})
    UNION
    SELECT u.dst, min(s.dist + u.w) FROM s JOIN {edges} u ON u.src = s.node LEFT JOIN recurring.s r ON r.node = u.dst
    WHERE s.dist + u.w < coalesce(r.dist, 9223372036854775807) AND s.dist + u.w <= {bound} GROUP BY u.dst)
"""
START = "SELECT 'c:0' AS node"
FAR = 10**15


def sssp_sql(seeds: str, edges: str = "und", bound: int = FAR) -> str:
    return on_graph(SSSP.format(seeds=seeds, edges=edges, bound=bound))


@query(sssp_sql(START) + "SELECT node, dist FROM s")
def sssp(spark, sf_dir):
    return traverse.distances(weighted(d.graph(spark, sf_dir)), "c:0")


@query(sssp_sql(START, bound=3000) + "SELECT node, dist FROM s")
def bounded_sssp(spark, sf_dir):
    return traverse.distances(weighted(d.graph(spark, sf_dir)), "c:0", limit=3000)


#: Terminals of the searches: the connectors that the regions' and the nations' keys name.
REGIONS = "SELECT 'c:' || (r_regionkey * 31) AS node FROM region"
NATIONS = "SELECT 'c:' || (n_nationkey * 7) AS node FROM nation"


def regions(spark, sf_dir) -> DataFrame:
    return d.table(spark, sf_dir, "region").select(F.concat(F.lit("c:"), (F.col("r_regionkey") * 31).cast("string")).alias("node"))


def nations(spark, sf_dir) -> DataFrame:
    return d.table(spark, sf_dir, "nation").select(F.concat(F.lit("c:"), (F.col("n_nationkey") * 7).cast("string")).alias("node"))


def listed(df: DataFrame) -> list[str]:
    """Nodes of a small table in order of its keys."""
    return [r["node"] for r in df.orderBy(F.length("node"), "node").collect()]


#: Distances from each start apart.
PAIRS = """, starts AS ({starts}), p(start, node, dist) USING KEY (start, node) AS (
    SELECT node, node, CAST(0 AS BIGINT) FROM starts
    UNION
    SELECT p.start, u.dst, min(p.dist + u.w) FROM p JOIN {edges} u ON u.src = p.node LEFT JOIN recurring.p r ON r.start = p.start AND r.node = u.dst
    WHERE p.dist + u.w < coalesce(r.dist, 9223372036854775807) AND p.dist + u.w <= {bound} GROUP BY p.start, u.dst)
"""


def pairs_sql(starts: str, edges: str = "und", bound: int = FAR) -> str:
    return on_graph(PAIRS.format(starts=starts, edges=edges, bound=bound))


@query(pairs_sql(NATIONS) + "SELECT node, min(dist) AS dist, CASE WHEN node IN (SELECT node FROM starts) THEN node ELSE arg_min(start, (dist, start)) END AS label FROM p GROUP BY node")
def multi_source_labels(spark, sf_dir):
    n = nations(spark, sf_dir)
    return traverse.nearest_source(weighted(d.graph(spark, sf_dir)), n.select("node", F.col("node").alias("label")), mutual=True)


@query(pairs_sql(REGIONS) + "SELECT start AS a, p.node AS b, dist FROM p JOIN starts s ON s.node = p.node WHERE start <> p.node")
def metric_closure(spark, sf_dir):
    return traverse.closure(weighted(d.graph(spark, sf_dir)), regions(spark, sf_dir))


@query(sssp_sql(START) + "SELECT node AS target, dist AS length FROM s")
def path_to_source(spark, sf_dir):
    """The lengths of all paths, edge by edge along the parents."""
    edges = weighted(d.graph(spark, sf_dir))
    tree = written(traverse.shortest(edges, node_frame(spark, ["c:0"]).withColumn("label", F.lit(0))), "tree")
    path = traverse.path_to_sources(tree, tree.select("node"))
    # a node's edge from its parent is looked up once, not for each path that takes it
    up = written(tree.select(F.col("node").alias("dst"), F.col("parent").alias("src")).join(edges, ["src", "dst"]).select(F.col("dst").alias("node"), "w"), "up")
    return path.join(up, "node", "left").groupBy("target").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("length"))


# Components and clusters

#: Each node's component, the smallest node.
COMPONENTS = on_graph(""", c(node, component) USING KEY (node) AS (
    SELECT node, node FROM nodes UNION SELECT u.dst, min(c.component) FROM c JOIN und u ON u.src = c.node JOIN recurring.c r ON r.node = u.dst WHERE c.component < r.component GROUP BY u.dst)
""")


@query(COMPONENTS + "SELECT node, component FROM c")
def connected(spark, sf_dir):
    g = d.graph(spark, sf_dir)
    return connected_components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), g.nodes)


#: The definition: buildings within the limit of one another are linked; numbered by the smallest node.
CLUSTERS = pairs_sql("SELECT node FROM nodes WHERE kind = 'building'", "und0", LIMIT) + """, near AS (SELECT start, p.node FROM p JOIN starts s ON s.node = p.node),
c(node, component) USING KEY (node) AS (
    SELECT node, node FROM starts UNION SELECT n.node, min(c.component) FROM c JOIN near n ON n.start = c.node JOIN recurring.c r ON r.node = n.node WHERE c.component < r.component GROUP BY n.node),
clusters AS (SELECT node, CAST(substr(node, 3) AS VARCHAR) AS building_id, CAST(dense_rank() OVER (ORDER BY component) - 1 AS BIGINT) AS cluster_id FROM c)
"""


def clusters_of(spark, sf_dir, g: Graph | None = None) -> DataFrame:
    return written(cluster.cluster_buildings(g or d.graph(spark, sf_dir), LIMIT), "clusters")


@query(CLUSTERS + "SELECT building_id, cluster_id FROM clusters")
def cluster_buildings(spark, sf_dir):
    return cluster.cluster_buildings(d.graph(spark, sf_dir), LIMIT).select("building_id", "cluster_id")


@query(CLUSTERS + "SELECT cluster_id, count(*) AS building_count FROM clusters GROUP BY cluster_id")
def cluster_sizes(spark, sf_dir):
    return cluster.cluster_sizes(clusters_of(spark, sf_dir)).orderBy(F.desc("building_count"), "cluster_id")


@query(CLUSTERS + "SELECT max(n) AS largest, count(*) AS clusters FROM (SELECT count(*) AS n FROM clusters GROUP BY cluster_id)")
def cluster_max(spark, sf_dir):
    return cluster.cluster_sizes(clusters_of(spark, sf_dir)).agg(F.max("building_count").alias("largest"), F.count("*").alias("clusters"))


@query(CLUSTERS + "SELECT max(cluster_id) + 1 AS cluster_count FROM clusters")
def cluster_count(spark, sf_dir):
    return cluster.cluster_count(clusters_of(spark, sf_dir))


@query(CLUSTERS + "SELECT c_custkey, c_name, CAST(c_custkey AS VARCHAR) AS building_id, cluster_id FROM customer LEFT JOIN clusters ON building_id = CAST(c_custkey AS VARCHAR)")
def cluster_left_join(spark, sf_dir):
    b = d.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("id"))
    from .pipeline import with_clusters

    return with_clusters(b, clusters_of(spark, sf_dir)).drop("id")


@query(CLUSTERS + "SELECT cluster_id, count(*) AS building_count, string_agg(building_id, ' ' ORDER BY node) AS members FROM clusters GROUP BY cluster_id")
def cluster_members(spark, sf_dir):
    m = cluster.cluster_members(clusters_of(spark, sf_dir)).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("part", "members"))).alias("parts"))
    whole = F.flatten("parts.members")
    return m.select("cluster_id", F.size(whole).cast("long").alias("building_count"), F.array_join(whole, " ").alias("members"))


BIG = ", big AS (SELECT cluster_id FROM clusters GROUP BY cluster_id HAVING count(*) >= 3) "


def big_clusters(clusters: DataFrame) -> DataFrame:
    return cluster.cluster_sizes(clusters).filter("building_count >= 3").select("cluster_id")


@query(CLUSTERS + BIG + "SELECT building_id, cluster_id FROM clusters WHERE cluster_id IN (SELECT cluster_id FROM big)")
def selected_semi(spark, sf_dir):
    c = clusters_of(spark, sf_dir)
    return routing.selected_buildings(c, big_clusters(c))


@query(CLUSTERS + BIG + "SELECT c_custkey, c_name, building_id, cluster_id FROM customer JOIN clusters ON building_id = CAST(c_custkey AS VARCHAR) WHERE cluster_id IN (SELECT cluster_id FROM big)")
def selected_inner_join(spark, sf_dir):
    from .pipeline import with_selection

    c = clusters_of(spark, sf_dir)
    b = d.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("id"))
    return with_selection(b, routing.selected_buildings(c, big_clusters(c))).drop("id")


# The reduced graph

#: Nearest clusters by one label a node, the least (distance, cluster); buildings keep their own.
LABELS = CLUSTERS + """, v(node, dist, label) USING KEY (node) AS (
    SELECT node, CAST(0 AS BIGINT), cluster_id FROM clusters
    UNION
    SELECT o.dst, o.best.d, o.best.l FROM (SELECT u.dst, min({'d': v.dist + u.w, 'l': v.label}) AS best FROM v JOIN und u ON u.src = v.node GROUP BY u.dst) o LEFT JOIN recurring.v r ON r.node = o.dst
    WHERE o.dst NOT LIKE 'b:%' AND (r.dist IS NULL OR o.best.d < r.dist OR (o.best.d = r.dist AND o.best.l < r.label)))
"""


@query(CLUSTERS + "SELECT cluster_id, count(*) AS size, round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y FROM clusters JOIN nodes USING (node) GROUP BY cluster_id")
def reduced_nodes(spark, sf_dir):
    g = d.graph(spark, sf_dir)
    n = cluster.reduced_nodes(g, clusters_of(spark, sf_dir, g))
    return n.select("cluster_id", "size", F.round("centroid_x", 6).alias("centroid_x"), F.round("centroid_y", 6).alias("centroid_y"))


@query(LABELS + "SELECT node, dist, label AS cluster_id FROM v")
def nearest_cluster(spark, sf_dir):
    g = d.graph(spark, sf_dir)
    return cluster.nearest_cluster(g, clusters_of(spark, sf_dir, g))


LINKS = LABELS + ", links AS (SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, min(a.dist + e.length_m + b.dist) AS dist FROM edges e JOIN v a ON a.node = e.src JOIN v b ON b.node = e.dst WHERE a.label <> b.label GROUP BY 1, 2) "


@query(LINKS + "SELECT a, b, dist FROM links")
def reduced_edges(spark, sf_dir):
    return reduced(spark, sf_dir)[1]


def reduced(spark, sf_dir):
    g = d.graph(spark, sf_dir)
    nodes, edges, _ = cluster.reduced_graph(g, clusters_of(spark, sf_dir, g))
    return written(nodes, "reduced-nodes"), written(edges, "reduced-edges")


# Steiner trees and fronts

#: The weight of a minimum spanning tree of pairs d(a, b, dist): for each length, the components that it joins.
PRIM = """, prim(k, done, reached, total) AS (
    SELECT 1, [(SELECT min(node) FROM starts)], CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
    UNION ALL
    SELECT k + 1, list_append(done, best.n), best.w, total + best.w
    FROM (SELECT k, done, total, (SELECT min({'w': CAST(p.dist AS DOUBLE), 'n': p.node}) FROM p WHERE list_contains(done, p.start) AND NOT list_contains(done, p.node) AND p.node IN (SELECT node FROM starts)) AS best FROM prim)
    WHERE best IS NOT NULL)
SELECT CASE WHEN (SELECT count(*) FROM starts) < 2 THEN 0.0 WHEN max(k) < (SELECT count(DISTINCT node) FROM starts) THEN CAST('inf' AS DOUBLE) ELSE max(total) END AS tree_weight FROM prim
"""


@query(pairs_sql(NATIONS) + PRIM)
def steiner_weight(spark, sf_dir):
    return steiner.steiner_weight(d.graph(spark, sf_dir), nations(spark, sf_dir))


@query(COMPONENTS + "SELECT CAST(count(*) - count(DISTINCT component) AS BIGINT) AS joined FROM c")
def spanning_tree_size(spark, sf_dir):
    """A forest has an edge for each node but one a component."""
    links = d.graph(spark, sf_dir).edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col(FULL_WEIGHT).alias("dist"))
    return steiner.spanning_tree(links).agg(F.count("*").alias("joined"))


#: Every cluster is a terminal, so the tree of their distances weighs what the links' own tree does; grown a cluster at a time from the least.
REDUCED_PRIM = """, ways AS (SELECT a, b, dist FROM links UNION ALL SELECT b, a, dist FROM links), ids AS (SELECT DISTINCT cluster_id FROM clusters),
prim(k, done, total) AS (
    SELECT 1, [(SELECT min(cluster_id) FROM ids)], CAST(0 AS DOUBLE)
    UNION ALL
    SELECT k + 1, list_append(done, best.n), total + best.w
    FROM (SELECT k, done, total, (SELECT min({'w': CAST(dist AS DOUBLE), 'n': b}) FROM ways WHERE list_contains(done, a) AND NOT list_contains(done, b)) AS best FROM prim)
    WHERE best IS NOT NULL)
SELECT CASE WHEN (SELECT count(*) FROM ids) < 2 THEN 0.0 WHEN max(k) < (SELECT count(*) FROM ids) THEN CAST('inf' AS DOUBLE) ELSE max(total) END AS tree_weight FROM prim
"""


@query(LINKS + REDUCED_PRIM)
def reduced_steiner(spark, sf_dir):
    nodes, links = reduced(spark, sf_dir)
    return steiner.reduced_steiner_weight(links, nodes.select(F.col("cluster_id").alias("node")))


FRONT = """, subsets AS (SELECT m.mask, list(s.node ORDER BY s.i) AS nodes FROM range(1, CAST(1 << (SELECT count(*) FROM starts) AS BIGINT)) m(mask), (SELECT node, row_number() OVER (ORDER BY length(node), node) - 1 AS i FROM starts) s WHERE (m.mask >> s.i) & 1 = 1 GROUP BY m.mask),
d AS (SELECT start AS a, node AS b, CAST(dist AS DOUBLE) AS w FROM p WHERE node IN (SELECT node FROM starts)),
grow(mask, nodes, done, total) AS (
    SELECT mask, nodes, [nodes[1]], CAST(0 AS DOUBLE) FROM subsets
    UNION ALL
    SELECT g.mask, g.nodes, list_append(g.done, g.best.n), g.total + g.best.w
    FROM (SELECT grow.*, (SELECT min({'w': d.w, 'n': d.b}) FROM d WHERE list_contains(done, d.a) AND list_contains(nodes, d.b) AND NOT list_contains(done, d.b)) AS best FROM grow) g
    WHERE g.best IS NOT NULL),
weights AS (SELECT mask, any_value(len(nodes)) AS size, CASE WHEN max(len(done)) = any_value(len(nodes)) THEN max(total) ELSE CAST('inf' AS DOUBLE) END AS w, any_value(nodes) AS nodes FROM grow GROUP BY mask)
SELECT CAST(size AS BIGINT) AS size, w AS tree_weight, array_to_string(nodes, ' ') AS selected FROM weights x
WHERE NOT EXISTS (SELECT 1 FROM weights y WHERE y.size >= x.size AND y.w <= x.w AND (y.size > x.size OR y.w < x.w OR y.mask < x.mask))
"""


@query(pairs_sql(REGIONS) + FRONT)
def brute_force_pareto(spark, sf_dir):
    front = search.brute_force_pareto(weighted(d.graph(spark, sf_dir)), listed(regions(spark, sf_dir)))
    return front.select("size", "tree_weight", F.array_join("selected", " ").alias("selected"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("step", "size", "total_buildings", "tree_weight", F.array_join(F.transform("selected", lambda x: x.cast("string")), " ").alias("selected"))


@query()
def greedy_pareto(spark, sf_dir):
    return _flat(search.greedy_pareto(weighted(d.graph(spark, sf_dir)), listed(nations(spark, sf_dir))))


@query()
def greedy_cluster_pareto(spark, sf_dir):
    """Clusters of buildings by nation, whose hubs are connected."""
    g = d.graph(spark, sf_dir)
    by_nation = d.table(spark, sf_dir, "customer").select(F.concat(F.lit("b:"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_custkey").cast("string").alias("building_id"), F.col("c_nationkey").cast("long").alias("cluster_id"))
    edges = weighted(g)
    return _flat(search.greedy_cluster_pareto(g, by_nation.join(traverse.reached(edges, "c:0"), "node", "left_semi"), edges))


def nation_graph(spark, sf_dir):
    """A reduced graph of the nations' customers."""
    g = d.graph(spark, sf_dir)
    by_nation = d.table(spark, sf_dir, "customer").select(F.concat(F.lit("b:"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_custkey").cast("string").alias("building_id"), F.col("c_nationkey").cast("long").alias("cluster_id"))
    nodes, links, _ = cluster.reduced_graph(g, by_nation)
    return written(nodes, "nodes"), written(links, "links")


@query()
def greedy_reduced_pareto(spark, sf_dir):
    return _flat(search.greedy_reduced_pareto(*nation_graph(spark, sf_dir)))


@query()
def budgeted_search(spark, sf_dir):
    nodes, links = reduced(spark, sf_dir)
    return _flat(search.budgeted_search(nodes, links, [0], budget=float(LIMIT)))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / (1 + o_orderkey), o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 32")
def beam_fanout(spark, sf_dir):
    """The FANOUT best candidates of each state by ratio."""
    o = d.table(spark, sf_dir, "orders")
    return traverse.top_by(o, "o_custkey", search.FANOUT, F.col("o_totalprice") / (1 + F.col("o_orderkey")), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal / (1 + c_nationkey), c_nationkey DESC, c_acctbal, c_custkey LIMIT 24")
def beam_limit(spark, sf_dir):
    """The BEAM best states by ratio, then more buildings, then less cost."""
    c = d.table(spark, sf_dir, "customer")
    return c.orderBy(F.col("c_acctbal") / (1 + F.col("c_nationkey")), F.desc("c_nationkey"), "c_acctbal", "c_custkey").limit(search.BEAM).select("c_custkey", "c_acctbal")


# Sources and routing

IDS = ", ids AS (SELECT CAST(o_custkey AS VARCHAR) AS id FROM orders UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem UNION SELECT n_name FROM nation) "


def source_ids(spark, sf_dir) -> DataFrame:
    ids = d.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    ids = ids.union(d.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string"))).union(d.table(spark, sf_dir, "nation").select("n_name")).distinct()
    return ids.select("id", F.col("id").alias("ord"))


RESOLVED = LABELS + IDS + ", resolved AS (SELECT id, coalesce(b.node, c.node) AS node FROM ids LEFT JOIN nodes b ON b.node = 'b:' || id LEFT JOIN nodes c ON c.node = 'c:' || id) "


def resolved(spark, sf_dir) -> DataFrame:
    g = d.graph(spark, sf_dir)
    clusters = clusters_of(spark, sf_dir, g)
    return routing.resolved_sources(source_ids(spark, sf_dir), g, clusters, written(cluster.nearest_cluster(g, clusters), "near"))


@query(RESOLVED + "SELECT id, r.node, v.label AS cluster_id FROM resolved r LEFT JOIN v ON v.node = r.node")
def resolve_sources(spark, sf_dir):
    return resolved(spark, sf_dir).select("id", "node", "cluster_id")


@query(RESOLVED + "SELECT id FROM resolved WHERE node IS NULL")
def unresolved_sources(spark, sf_dir):
    """Which ids name a node doesn't hang on clusters."""
    return routing.named_sources(source_ids(spark, sf_dir), d.graph(spark, sf_dir)).filter("node IS NULL").select("id")


@query(CLUSTERS + "SELECT cluster_id, min(node) AS hub FROM clusters GROUP BY cluster_id")
def cluster_hubs(spark, sf_dir):
    return routing.hubs(clusters_of(spark, sf_dir))


#: One hub after another: distances from the tree so far, then the way back by nearer neighbours, the smallest of several.
JOINED = """, v{k}(node, dist, hops) USING KEY (node) AS (
    SELECT node, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM tree{before}
    UNION
    SELECT o.dst, o.best.d, o.best.h FROM (SELECT u.dst, min({{'d': v.dist + u.w, 'h': v.hops + 1}}) AS best FROM v{k} v JOIN und u ON u.src = v.node GROUP BY u.dst) o LEFT JOIN recurring.v{k} r ON r.node = o.dst
    WHERE r.dist IS NULL OR o.best.d < r.dist OR (o.best.d = r.dist AND o.best.h < r.hops)),
way{k}(src, dst) AS (
    SELECT CAST(NULL AS VARCHAR), h.node FROM hubs h JOIN v{k} USING (node) WHERE h.n = {k}
    UNION ALL
    SELECT w.dst, (SELECT min(u.src) FROM und u JOIN v{k} a ON a.node = u.src JOIN v{k} b ON b.node = u.dst WHERE u.dst = w.dst AND a.dist + u.w = b.dist AND a.hops + 1 = b.hops) AS up FROM way{k} w WHERE up IS NOT NULL),
tree{k} AS (SELECT node FROM tree{before} UNION SELECT dst FROM way{k})"""


def road_tree_sql(starts: str, hubs: int) -> str:
    """The roads of the ways that join so many hubs, by their cheapest edge of each step: a road before an access, then the smallest segment."""
    ways = "".join(JOINED.format(k=k, before=k - 1) for k in range(1, hubs))
    steps = " UNION ".join(f"SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM way{k} WHERE src IS NOT NULL" for k in range(1, hubs))
    return on_graph(f""", hubs AS (SELECT node, row_number() OVER (ORDER BY length(node), node) - 1 AS n FROM ({starts})), tree0 AS (SELECT node FROM hubs WHERE n = 0){ways},
    steps AS ({steps}), best AS (
        SELECT a, b, min({{'w': length_m, 'k': CASE kind WHEN 'road' THEN 0 ELSE 1 END, 's': segment_id}}) AS e FROM steps JOIN edges ON a = least(src, dst) AND b = greatest(src, dst) GROUP BY a, b)
    SELECT DISTINCT e.s AS segment_id FROM best WHERE e.k = 0""")


@query(road_tree_sql(REGIONS, 5))
def routing_tree(spark, sf_dir):
    """The road tree that joins the regions' connectors."""
    return routing.road_tree(d.graph(spark, sf_dir), listed(regions(spark, sf_dir)))


@functools.cache
def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
