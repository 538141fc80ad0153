"""Commands: python -m streetloom.plans.cli COMMAND ... Paths are whatever Spark can read; GeoPackages are local files."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import cluster_count
from ..operators.graph import build_graph
from ..sources import extract, read_building_links, read_buildings, read_connectors, read_geopackage, read_geoparquet, read_id_list, read_roads, read_sniffed_csv, write_csv, write_geopackage, write_geoparquet, write_parquet
from ..sources.files import BOX
from ..sources.geoparquet import srid_of
from . import pipeline as p

log = logging.getLogger("streetloom")
DATA = "data"
#: The names under which tables are exchanged with earlier runs and other programs.
CONNECTORS, BUILDINGS, ROAD_REFS, BUILDING_LINKS = "rust_connectors.csv", "rust_buildings.csv", "rust_road_connector_refs.csv", "rust_building_links.csv"
CLUSTERS, REDUCED_NODES, SELECTED, TREE = "rust_clusters.csv", "reduced_nodes.csv", "selected_buildings.csv", "optimized_tree_segments.csv"


def _session(args) -> SparkSession:
    builder = SparkSession.builder.appName("streetloom")
    if args.s3_region:
        builder = builder.config("spark.hadoop.fs.s3a.endpoint.region", args.s3_region)
    return builder.getOrCreate()


def _counted(name: str, df: DataFrame, write) -> None:
    """Write df and report its rows, counted as they are written."""
    seen = Observation(name)
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    log.info("%s: %d rows", name, seen.get["rows"])


def _any(spark: SparkSession, path: str) -> DataFrame:
    return read_geopackage(spark, path) if path.endswith(".gpkg") else read_geoparquet(spark, path)


def _features(name: str):
    def run(spark: SparkSession, args) -> None:
        path = f"{args.data}/{name}.parquet"
        _counted(name, extract(spark, args.source, tuple(args.box)), lambda df: write_parquet(df, path))
        if args.gpkg:  # from what was written, so the source is read once
            write_geopackage(spark.read.parquet(path), f"{args.data}/{name}.gpkg", name)

    return run


def extract_centroids(spark: SparkSession, args) -> None:
    path = f"{args.data}/building_centroids.parquet"
    _counted("centroids", p.centroids(extract(spark, args.source, tuple(args.box))), lambda df: write_parquet(df, path))
    if args.gpkg:
        write_geopackage(spark.read.parquet(path), f"{args.data}/building_centroids.gpkg", "building_centroids")


def link_buildings(spark: SparkSession, args) -> None:
    buildings, connectors = (p.points(read_geoparquet(spark, f"{args.data}/{n}.parquet")) for n in ("building_centroids", "connectors"))
    df = p.building_links(buildings, connectors)
    write_geoparquet(df, f"{args.data}/building_to_connector_lines.parquet")
    if args.gpkg:
        write_geopackage(df, f"{args.data}/building_to_connector_lines.gpkg", "building_to_connector_lines")


def prepare_graph(spark: SparkSession, args) -> None:
    read = lambda n: read_geoparquet(spark, f"{args.data}/{n}.parquet")
    save = lambda df, name: write_csv(df, f"{args.data}/{name}", args.one_file)
    save(p.points(read("connectors")), CONNECTORS)
    save(p.points(read("building_centroids")), BUILDINGS)
    save(p.road_refs(read("routes")).orderBy("road_id", "ord").drop("ord").select("road_id", "connector_id", "at", "road_length_m"), ROAD_REFS)
    save(read("building_to_connector_lines").select("building_id", "connector_id", "distance_m"), BUILDING_LINKS)


def run_graph(spark: SparkSession, args) -> None:
    if not args.sources_file and not args.source_id:
        raise SystemExit("at least one source is needed: --sources-file or --source-id")
    d = args.data
    graph = build_graph(read_roads(spark, f"{d}/{ROAD_REFS}"), read_connectors(spark, f"{d}/{CONNECTORS}"), read_buildings(spark, f"{d}/{BUILDINGS}"), read_building_links(spark, f"{d}/{BUILDING_LINKS}"))
    log.info("graph: %s", graph.counts().first())
    out = p.optimise(graph, read_id_list(spark, args.sources_file, args.source_id))
    log.info("clusters: %s; solution: %s", cluster_count(out.clusters).first(), out.solution.first())
    for df, name in ((out.clusters.select("building_id", "cluster_id"), CLUSTERS), (out.reduced_nodes, REDUCED_NODES), (out.buildings, SELECTED), (out.segments, TREE)):
        write_csv(df, f"{d}/{name}", args.one_file)


def cluster_output(spark: SparkSession, args) -> None:
    clusters = read_sniffed_csv(spark, args.clusters, infer=False).select("building_id", F.col("cluster_id").cast("long").alias("cluster_id"))
    write_geopackage(p.with_clusters(_any(spark, args.buildings), clusters), args.output, "clusters")


def reduced_output(spark: SparkSession, args) -> None:
    nodes = read_sniffed_csv(spark, args.nodes)
    write_geopackage(p.reduced_points(nodes), args.output, "reduced_nodes")


def optimised_outputs(spark: SparkSession, args) -> None:
    buildings = _any(spark, args.buildings_gpkg)
    selected = spark.read.csv(args.selected_csv, header=True, schema="building_id string, cluster_id long")
    write_geopackage(p.with_selection(buildings, selected), args.out_buildings, "buildings")
    ids = spark.read.csv(args.segments_csv, header=True, schema="segment_id string")
    segments = p.tree_segments(read_geoparquet(spark, args.segments_parquet), ids)
    if srid_of(segments) != srid_of(buildings):
        segments = segments.withColumn("geometry", p.reproject_lines(F.col("geometry"), srid_of(segments), srid_of(buildings))).withMetadata("geometry", {"srid": srid_of(buildings)})
    write_geopackage(segments, args.out_tree, "tree")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="streetloom")
    top.add_argument("--s3-region", help="region of s3a:// sources")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments) -> None:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--data", default=DATA, help="folder of the run's tables")
        for names, options in arguments:
            c.add_argument(*names, **options)

    one = lambda *names, **options: (names, options)
    box = one("--box", type=float, nargs=4, default=BOX, metavar=("WEST", "SOUTH", "EAST", "NORTH"))
    source, gpkg = one("--source", required=True, help="parquet glob"), one("--gpkg", action="store_true", help="write a GeoPackage too")
    for name in ("routes", "connectors", "buildings"):
        command(f"extract-{name}", _features(name), source, box, gpkg)
    command("extract-building-centroids", extract_centroids, source, box, gpkg)
    command("building-to-connector", link_buildings, gpkg)
    one_file = one("--one-file", action="store_true", help="CSV tables as one file each, not folders of parts")
    command("prepare-graph", prepare_graph, one_file)
    command("build-graph", run_graph, one_file, one("--sources-file"), one("--source-id", action="append", default=[]))
    command("cluster-buildings", cluster_output, one("--clusters", required=True), one("--buildings", required=True), one("--output", required=True))
    command("create-reduced-gpkg", reduced_output, one("--nodes", required=True), one("--output", required=True))
    names = ("--buildings-gpkg", "--selected-csv", "--segments-csv", "--segments-parquet", "--out-buildings", "--out-tree")
    command("create-optimized-outputs", optimised_outputs, *(one(n, required=True) for n in names))
    return top


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    args = parser().parse_args(argv)
    args.run(_session(args), args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
