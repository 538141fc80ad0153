"""A road graph derived from order tables: parts are connectors, customers buildings, orders roads, line items their refs.

Lengths are whole numbers, so sums of paths are exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph, build_graph
from ..storage import ship_package

#: Clusters are chained by this length in the derived graph.
LIMIT = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k * 37 % 1009).cast("double").alias("x"), (k * 91 % 997).cast("double").alias("y"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 53 % 1013).cast("double").alias("x"), (k * 29 % 991).cast("double").alias("y"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(road_id, connector_id, at, road_length_m, ord): a road's distinct line items in order of number and part."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("road_id").orderBy("l_linenumber", "connector_id")
    own = items.select(F.col("l_orderkey").alias("road_id"), F.col("l_partkey").alias("connector_id"), "l_linenumber").repartition("road_id").distinct()  # dealt once for all that follows
    length = orders.select(F.col("o_orderkey").alias("road_id"), F.expr("1 + cast(round(o_totalprice * 100) as bigint) div 6000").alias("road_length_m"))
    placed = own.withColumn("at", (F.row_number().over(order) - 1).cast("long")).join(length, "road_id")
    return placed.select("road_id", "connector_id", "at", "road_length_m", F.col("at").alias("ord"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads with two refs or more, and their refs as a list."""
    r = refs(spark, sf_dir).groupBy(F.col("road_id").alias("id"), F.col("road_length_m").alias("length_m")).agg(F.array_sort(F.collect_list(F.struct("at", "connector_id"))).alias("r"))
    return r.select("id", "length_m", F.transform("r", lambda c: F.struct(c["connector_id"].alias("connector_id"), c["at"].alias("at"))).alias("connectors"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n))  # one row
    return c.select(F.col("c_custkey").alias("building_id"), (F.col("c_custkey") * 7 % F.col("n")).alias("connector_id"), F.round(F.abs("c_acctbal")).cast("long").alias("distance_m"))


def graph(spark: SparkSession, sf_dir: str, directed: bool = False) -> Graph:
    long = segments(spark, sf_dir).filter(F.size("connectors") >= 2)
    return build_graph(long, connectors(spark, sf_dir), buildings(spark, sf_dir), links(spark, sf_dir), directed, check=False)


#: The same in SQL.
SQL = """
refs AS (
    SELECT l_orderkey AS road_id, l_partkey AS connector_id, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS BIGINT) AS k,
        1 + CAST(round(o_totalprice * 100) AS BIGINT) // 6000 AS len
    FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey
), roads AS (
    SELECT 'c:' || connector_id AS src, 'c:' || lead(connector_id) OVER o AS dst, 'road' AS kind, CAST(road_id AS VARCHAR) AS segment_id, CAST(len * abs(lead(k) OVER o - k) AS BIGINT) AS length_m
    FROM refs WINDOW o AS (PARTITION BY road_id ORDER BY k)
    QUALIFY dst IS NOT NULL
), access AS (
    SELECT 'b:' || c_custkey AS src, 'c:' || ((c_custkey * 7) % (SELECT count(*) FROM part)) AS dst, 'access' AS kind, CAST(NULL AS VARCHAR) AS segment_id, CAST(round(abs(c_acctbal)) AS BIGINT) AS length_m
    FROM customer
), edges AS (SELECT * FROM roads UNION ALL SELECT * FROM access),
nodes AS (
    SELECT 'c:' || p_partkey AS node, 'connector' AS kind, CAST((p_partkey * 37) % 1009 AS DOUBLE) AS x, CAST((p_partkey * 91) % 997 AS DOUBLE) AS y FROM part
    UNION ALL SELECT 'b:' || c_custkey, 'building', CAST((c_custkey * 53) % 1013 AS DOUBLE), CAST((c_custkey * 29) % 991 AS DOUBLE) FROM customer
), und AS (
    SELECT src, dst, min(length_m) AS w FROM (SELECT src, dst, length_m FROM edges UNION ALL SELECT dst, src, length_m FROM edges) WHERE src <> dst GROUP BY src, dst
), und0 AS (
    SELECT src, dst, min(w) AS w FROM (SELECT src, dst, CASE kind WHEN 'access' THEN 0 ELSE length_m END AS w FROM edges UNION ALL SELECT dst, src, CASE kind WHEN 'access' THEN 0 ELSE length_m END FROM edges) WHERE src <> dst GROUP BY src, dst
)
"""
