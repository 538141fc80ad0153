"""Geometry functions, file formats, and a whole run from files to GeoPackages."""

import csv
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom import sources
from streetloom.functions import geo
from streetloom.plans import cli, pipeline


def ring(*p):
    return struct.pack("<I", len(p)) + b"".join(struct.pack("<dd", *q) for q in p)


def polygon(*rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(rings)


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
HOLE = ring((2, 1), (3, 1), (3, 3), (2, 3), (2, 1))


def test_centroids():
    assert geo.centroid(polygon(SQUARE)) == (2.0, 2.0)
    assert geo.centroid(polygon(SQUARE, HOLE)) == pytest.approx(((32 - 5) / 14, 2.0))
    two = struct.pack("<BII", 1, 6, 2) + polygon(SQUARE) + polygon(ring((10, 0), (12, 0), (12, 2), (10, 2), (10, 0)))
    assert geo.centroid(two) == pytest.approx(((2 * 16 + 11 * 4) / 20, (2 * 16 + 1 * 4) / 20))
    big_endian = struct.pack(">BIdd", 0, 1, 3.0, 4.0)
    assert geo.centroid(big_endian) == (3.0, 4.0)
    with_z = struct.pack("<BIddd", 1, 1001, 3.0, 4.0, 9.0)
    assert geo.centroid(with_z) == (3.0, 4.0)
    assert geo.centroid(struct.pack("<BII", 1, 3, 0)) is None and geo.centroid(None) is None
    assert geo.centroid(polygon(ring((1, 1), (3, 1), (1, 1)))) == pytest.approx((2.0, 1.0))  # no area: its line counts


def some_geometry(rnd, depth=2, kind=None):
    """Any kind, byte order and number of dimensions, with empty parts."""
    o, dims = rnd.choice("<>"), rnd.choice([2, 2, 3, 4])
    kind = kind or rnd.randint(1, 7 if depth else 3)
    head = struct.pack(o + "BI", o == "<", kind + {2: 0, 3: 1000, 4: 3000}[dims])

    def points(n, closed=False):
        p = [[rnd.uniform(-5, 5) for _ in range(dims)] for _ in range(n)]
        p += p[:1] if closed else []
        return struct.pack(o + "I", len(p)) + b"".join(struct.pack(o + "d" * dims, *q) for q in p)

    if kind == 1:
        return head + struct.pack(o + "d" * dims, *([float("nan")] * dims if rnd.random() < 0.1 else [rnd.uniform(-5, 5) for _ in range(dims)]))
    if kind == 2:
        return head + points(rnd.randint(0, 5))
    n = rnd.randint(0, 3)
    parts = [points(rnd.choice([0, 1, 2, 3, 6]), True) for _ in range(n)] if kind == 3 else [some_geometry(rnd, depth - 1, {4: 1, 5: 2, 6: 3}.get(kind)) for _ in range(n)]
    return head + struct.pack(o + "I", n) + b"".join(parts)


def test_columns_of_geometries_are_rows_of_them():
    import random

    import pyarrow as pa

    from streetloom.functions import wkb

    rnd = random.Random(4)
    rows = [None if rnd.random() < 0.05 else some_geometry(rnd) for _ in range(1500)]
    for column, want in ((pa.array(rows, pa.binary()), rows), (pa.array(rows, pa.large_binary()).slice(7), rows[7:]), (pa.array([None, b""], pa.binary()), [None, None]), (pa.array([], pa.binary()), [])):
        got = wkb.centroids(column).to_pylist()
        assert len(got) == len(want)
        for g, raw in zip(got, want, strict=True):
            w = geo.centroid(raw)
            assert (w is None) == (g is None) and (w is None or (g["x"], g["y"]) == pytest.approx(w, rel=1e-6, abs=1e-6))
    lines = [geo.lines_wkb([np.array([[rnd.uniform(-9, 9), rnd.uniform(-9, 9)] for _ in range(rnd.randint(0, 4))]) .reshape(-1, 2) for _ in range(rnd.randint(0, 3))]) for _ in range(200)]
    for order in ("xy", "yx"):
        assert wkb.lengths(pa.array(lines, pa.binary()), geo.geodesic, order == "yx").to_pylist() == pytest.approx([geo.line_length(x, order) for x in lines])
    with pytest.raises(ValueError):
        wkb.runs(pa.array([struct.pack("<BI", 1, 99)], pa.binary()))


def test_geodesic_known_distances():
    assert float(geo.geodesic(0.0, 0.0, 1.0, 0.0)) == pytest.approx(111319.4908, abs=1e-3)
    assert float(geo.geodesic(0.0, 0.0, 0.0, 1.0)) == pytest.approx(110574.3886, abs=1e-3)
    assert float(geo.geodesic(5.0, 5.0, 5.0, 5.0)) == 0.0
    line = geo.lines_wkb([np.array([[0.0, 51.0], [1.0, 51.0]])])
    assert geo.line_length(line) == pytest.approx(70197.0, abs=20) and geo.line_length(line, "yx") != geo.line_length(line)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-1.25, 51.75), (179.0, -80.0)], "lon double, lat double")
    x, y = geo.to_web_mercator(F.col("lon"), F.col("lat"))
    lon, lat = geo.from_web_mercator(x, y)
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r["a"], r["b"]) == pytest.approx((r["lon"], r["lat"]))
    with pytest.raises(ValueError):
        geo.reprojected(F.col("lon"), F.col("lat"), 4326, 27700)


def test_csv_tables(spark, tmp_path):
    (tmp_path / "c.csv").write_text("any,name,here\nc1,0.5,1\n")
    assert [tuple(r) for r in sources.read_connectors(spark, str(tmp_path / "c.csv")).collect()] == [("c1", 0.5, 1.0)]
    for bad in ("c1,x,1\n", "c1,,1\n"):
        (tmp_path / "bad.csv").write_text("id,x,y\n" + bad)
        with pytest.raises(Exception):  # noqa: B017
            sources.read_connectors(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "r.csv").write_text("road_id,connector_id,at,road_length_m\nr,b,1,10\nr,a,0,10.0000000001\nr,c,0.5,12\nq,a,0,1\n")
    got = {r["id"]: (r["length_m"], [c["connector_id"] for c in r["connectors"]]) for r in sources.read_roads(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {"r": (12.0, ["a", "c", "b"]), "q": (1.0, ["a"])}
    (tmp_path / "ids").write_text(" b1 \n\n# no\nb2\nb1\n")
    assert [r["id"] for r in sources.read_id_list(spark, str(tmp_path / "ids"), ["x", "b2"]).orderBy("ord").collect()] == ["x", "b2", "b1"]


def test_rows_keep_the_order_of_files(spark, tmp_path):
    """Spark reads the longest file first; order is by name all the same."""
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "part-0").write_text("a1\nb1\n")
    (tmp_path / "l" / "part-1").write_text("".join(f"b{k}\n" for k in range(300)))
    got = [r["id"] for r in sources.read_id_list(spark, str(tmp_path / "l"), ["b7"]).orderBy("ord").collect()]
    assert got == ["b7", "a1", "b1"] + [f"b{k}" for k in range(300) if k not in (1, 7)]
    (tmp_path / "r").mkdir()
    head = "road_id,connector_id,at,road_length_m\n"
    (tmp_path / "r" / "part-0.csv").write_text(head + "r,c0,0,5\n")
    (tmp_path / "r" / "part-1.csv").write_text(head + "r,c1,0,7\n" + "".join(f"q{k},c,0,1\n" for k in range(300)))
    (r,) = sources.read_roads(spark, str(tmp_path / "r")).filter("id = 'r'").collect()
    assert [c["connector_id"] for c in r["connectors"]] == ["c0", "c1"] and r["length_m"] == 7.0


def test_sniffed_csv(spark, tmp_path):
    def got(text, **o):
        (tmp_path / "x.csv").write_text(text)
        df = sources.read_sniffed_csv(spark, str(tmp_path / "x.csv"), **o)
        return df.columns, [tuple(r) for r in df.collect()]

    assert got("building_id;cluster_id\n007;1\n'a;b';2\n", infer=False) == (["building_id", "cluster_id"], [("007", "1"), ("a;b", "2")])
    assert got("x\ty\n1\t2.5\n") == (["x", "y"], [(1, 2.5)])
    assert got("1,2\n3,4\n") == (["column0", "column1"], [(1, 2), (3, 4)])
    assert got("segment_id\ns1\ns2\n") == (["segment_id"], [("s1",), ("s2",)])
    assert got("a|b\n") == (["a", "b"], [])


def test_unknown_reference_systems(spark, tmp_path):
    entry = lambda **c: '{"columns": {"geometry": %s}}' % __import__("json").dumps(c)
    assert sources.geo_srid(None) == sources.geo_srid(entry(encoding="WKB")) == 4326
    assert sources.geo_srid(entry(crs={"id": {"authority": "OGC", "code": "CRS84"}})) == 4326
    assert sources.geo_srid(entry(crs={"id": {"authority": "EPSG", "code": 27700}})) == 27700
    assert sources.geo_srid(entry(crs={"name": "British National Grid"})) == sources.geo_srid(entry(crs=None)) == -1
    df = spark.createDataFrame([(1, bytearray(polygon(SQUARE)))], "id long, geometry binary").withMetadata("geometry", {"srid": -1})
    sources.write_geoparquet(df, str(tmp_path / "u"))
    got = sources.read_geoparquet(spark, str(tmp_path / "u"))
    assert got.schema["geometry"].metadata["srid"] == -1 and got.count() == 1
    with pytest.raises(ValueError):
        pipeline.reproject_points(got, 4326)


def test_geopackage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a'é", 2.5, True, bytearray(polygon(SQUARE)), {"k": [1]}), (2, None, None, None, None, None)], "id long, name string, v double, ok boolean, geometry binary, m map<string, array<int>>")
    path = str(tmp_path / "x.gpkg")
    sources.write_geopackage(df.withMetadata("geometry", {"srid": 3857}), path, "things")
    got = sources.read_geopackage(spark, path)
    assert got.schema["geometry"].metadata == {"srid": 3857}
    a, b = got.orderBy("id").collect()
    assert (a["name"], a["v"], a["ok"], bytes(a["geometry"]), a["m"]) == ("a'é", 2.5, True, polygon(SQUARE), '{"k":[1]}')
    assert (b["name"], b["v"], b["ok"], b["geometry"], b["m"]) == (None,) * 5
    import sqlite3

    with sqlite3.connect(path) as db:
        assert db.execute("SELECT min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents").fetchone() == (0.0, 0.0, 4.0, 4.0, 3857)
        assert db.execute("SELECT minx, maxx, miny, maxy FROM rtree_things_geometry").fetchall() == [(0.0, 4.0, 0.0, 4.0)]
        (blob,) = db.execute("SELECT geometry FROM things WHERE id = 1").fetchone()
        assert struct.unpack("<2s2BI4d", blob[:40]) == (b"GP", 0, 3, 3857, 0.0, 4.0, 0.0, 4.0) and blob[40:] == polygon(SQUARE)
    empty = struct.pack("<BII", 1, 3, 0)
    many = spark.range(25).selectExpr("id", "CAST(NULL AS binary) AS geometry").unionByName(spark.createDataFrame([(99, bytearray(empty))], "id long, geometry binary")).repartition(5)
    sources.write_geopackage(many, path)
    assert sorted((r["id"], r["geometry"] and bytes(r["geometry"])) for r in sources.read_geopackage(spark, path).collect()) == [*((k, None) for k in range(25)), (99, empty)]
    sources.write_geopackage(df.limit(0), path)
    assert sources.read_geopackage(spark, path).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        sources.read_geopackage(spark, str(tmp_path / "none.gpkg"))


def test_geoparquet_carries_its_reference_system(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(polygon(SQUARE)))], "id long, geometry binary")
    for srid in (4326, 3857):
        path = str(tmp_path / f"{srid}")
        sources.write_geoparquet(df.withMetadata("geometry", {"srid": srid}), path)
        got = sources.read_geoparquet(spark, path)
        assert got.schema["geometry"].metadata["srid"] == srid and got.count() == 1


def town(spark, folder):
    """Four connectors on a street near Oxford, five buildings, and a building outside the box."""
    at = [(-1.25 + 0.001 * k, 51.75) for k in range(4)]
    box = "struct<xmin double, xmax double, ymin double, ymax double>"
    flat = lambda p: (p[0], p[0], p[1], p[1])
    point = lambda p: bytearray(struct.pack("<BIdd", 1, 1, *p))
    spark.createDataFrame([(f"c{k}", point(p), flat(p)) for k, p in enumerate(at)], f"id string, geometry binary, bbox {box}").write.parquet(f"{folder}/src_connectors")
    street = bytearray(geo.lines_wkb([np.array(at)]))
    refs = [(f"c{k}", k / 3) for k in range(4)]
    spark.createDataFrame([("street", street, (at[0][0], at[3][0], 51.75, 51.75), refs)], f"id string, geometry binary, bbox {box}, connectors array<struct<connector_id string, at double>>").write.parquet(f"{folder}/src_routes")
    homes = [(f"h{k}", (at[k % 4][0], 51.7501 + 0.0001 * k)) for k in range(5)] + [("far", (10.0, 10.0))]
    square = lambda p: bytearray(polygon(ring(*((p[0] + a * 1e-5, p[1] + b * 1e-5) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))))
    spark.createDataFrame([(n, square(p), flat(p), {"use": "home"}) for n, p in homes], f"id string, geometry binary, bbox {box}, tags map<string, string>").write.parquet(f"{folder}/src_buildings")


def test_whole_run(spark, tmp_path):
    d = str(tmp_path)
    town(spark, d)
    run = lambda *a: cli.main([*a, "--data", d]) if a[0] not in ("cluster-buildings", "create-reduced-gpkg", "create-optimized-outputs") else cli.main(list(a))
    for name in ("routes", "connectors", "buildings"):
        run(f"extract-{name}", "--source", f"{d}/src_{name}", "--gpkg")
    run("extract-building-centroids", "--source", f"{d}/src_buildings")
    run("building-to-connector", "--gpkg")
    run("prepare-graph")
    folders = {n: sorted(map(tuple, spark.read.csv(f"{d}/{n}", header=True).collect())) for n in (cli.CONNECTORS, cli.BUILDINGS, cli.ROAD_REFS, cli.BUILDING_LINKS)}
    run("prepare-graph", "--one-file")  # a file takes the folder's place
    for n, rows in folders.items():
        with open(f"{d}/{n}", newline="") as f:
            names, *got = csv.reader(f)
        assert names == spark.read.csv(f"{d}/{n}", header=True).columns and sorted(map(tuple, got)) == rows
    with pytest.raises(SystemExit):
        run("build-graph")
    run("build-graph", "--source-id", "h0", "--one-file")
    assert all((tmp_path / n).is_file() for n in (cli.CLUSTERS, cli.REDUCED_NODES, cli.SELECTED, cli.TREE)) and not list(tmp_path.glob("*.parts"))
    links = sources.read_building_links(spark, f"{d}/rust_building_links.csv")
    assert {r["building_id"]: r["connector_id"] for r in links.collect()} == {"h0": "c0", "h1": "c1", "h2": "c2", "h3": "c3", "h4": "c0"}
    clusters = spark.read.csv(f"{d}/rust_clusters.csv", header=True)
    assert clusters.count() == 5 and clusters.select("cluster_id").distinct().count() == 1  # 69 m apart
    assert spark.read.csv(f"{d}/selected_buildings.csv", header=True).count() == 5
    run("cluster-buildings", "--clusters", f"{d}/rust_clusters.csv", "--buildings", f"{d}/buildings.gpkg", "--output", f"{d}/clusters.gpkg")
    got = sources.read_geopackage(spark, f"{d}/clusters.gpkg")
    assert got.filter("cluster_id = 0").count() == 5
    run("create-reduced-gpkg", "--nodes", f"{d}/reduced_nodes.csv", "--output", f"{d}/reduced.gpkg")
    assert sources.read_geopackage(spark, f"{d}/reduced.gpkg").count() == 1
    run("create-optimized-outputs", "--buildings-gpkg", f"{d}/buildings.gpkg", "--selected-csv", f"{d}/selected_buildings.csv", "--segments-csv", f"{d}/optimized_tree_segments.csv", "--segments-parquet", f"{d}/routes.parquet", "--out-buildings", f"{d}/b.gpkg", "--out-tree", f"{d}/t.gpkg")
    assert sources.read_geopackage(spark, f"{d}/b.gpkg").count() == 5
    # the run without files in between gives the same clusters
    read = lambda n: sources.read_geoparquet(spark, f"{d}/{n}.parquet")
    g = pipeline.graph_of(read("routes"), read("connectors"), read("buildings"))
    out = pipeline.optimise(g, sources.read_id_list(spark, None, ["h0", "c3"]), limit=10.0)
    assert out.reduced_nodes.count() == 4 and {r["segment_id"] for r in out.segments.collect()} <= {"street"}
    assert out.solution.first()["total_buildings"] == 5


def test_one_csv_file_keeps_the_order_of_parts(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    for n in (0, 25, 1):  # an empty table is a header; a file takes a file's place
        df = spark.range(n).select("id", F.concat(F.lit('a, "'), "id").alias("name")).repartitionByRange(7, "id").sortWithinPartitions("id")
        sources.write_csv(df, path, one_file=True)
        assert [tuple(r) for r in spark.read.csv(path, header=True, schema="id long, name string").collect()] == [(k, f'a, "{k}') for k in range(n)]
        with open(path) as f:
            assert f.readline() == "id,name\n"


def test_arguments():
    with pytest.raises(SystemExit) as e:
        cli.parser().parse_args(["--help"])
    assert e.value.code == 0
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["build-graph", "--candidate-limit", "3"])
