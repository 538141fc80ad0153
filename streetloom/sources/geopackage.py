"""GeoPackage files (SQLite) as a Python data source: spark.read.format("geopackage") and df.write.format("geopackage").

Rows go in and out as Arrow batches. Tasks make SQLite parts with finished rows, geometry headers and boxes; the commit attaches one part after
another and copies its rows inside SQLite, then adds the R-tree and the layer's extent. One file is the format, so its size is what one disk holds;
tables beyond that belong in GeoParquet.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import wkb
from ..storage import ship_package
from .files import stringify_complex
from .geoparquet import SRID, srid_of

#: Rows that one reading task takes, and rows of a batch.
SLICE, BATCH = 100_000, 10_000


def from_gpkg(blob: bytes | None) -> bytes | None:
    """Well-known binary without the GeoPackage header."""
    if blob is None or blob[:2] != b"GP":
        return blob
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return blob[8 + envelope :]


def to_gpkg(column: pa.Array, srid: int) -> tuple[list[bytes | None], np.ndarray]:
    """(GeoPackage blobs with envelopes, boxes (west, east, south, north)); an empty geometry has no envelope."""
    boxes = wkb.boxes(column)
    lead, bare = b"GP\x00\x03" + struct.pack("<i", srid), b"GP\x00\x11" + struct.pack("<i", srid)
    empty = np.isnan(boxes).any(1)
    values = column.to_pylist()
    return [None if v is None else bare + v if e else lead + box.tobytes() + v for v, e, box in zip(values, empty, boxes.astype("<f8"), strict=True)], boxes


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _layer(db: sqlite3.Connection, name: str | None) -> tuple[str, str, int]:
    """(table, geometry column, srid) of a feature layer, by default the first."""
    row = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns WHERE ?1 IS NULL OR table_name = ?1", (name,)).fetchone()
    if row is None:
        raise ValueError(f"no feature layer {name or ''}")
    return row


#: SQLite's declared types, by prefix, as Spark types.
DECLARED = {"INT": T.LongType(), "MEDIUMINT": T.LongType(), "SMALLINT": T.LongType(), "TINYINT": T.LongType(), "BOOL": T.BooleanType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(), "FLOAT": T.DoubleType(), "BLOB": T.BinaryType()}


def _connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Slice(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class GeoPackageSource(DataSource):
    """Options: path, layer, geometry (column name when written), srid (when written)."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> T.StructType:
        with _connect(self.options["path"]) as db:
            table, geometry, srid = _layer(db, self.options.get("layer"))
            fields = []
            for _, name, kind, _, _, key in db.execute(f"PRAGMA table_info({_quoted(table)})"):
                if name == geometry:
                    fields.append(T.StructField(name, T.BinaryType(), True, {SRID: srid}))
                elif not (key and name == "fid"):
                    fields.append(T.StructField(name, next((t for k, t in DECLARED.items() if kind.upper().startswith(k)), T.StringType())))
            return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, schema, overwrite)


class Reader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.layer, self.fields = options["path"], options.get("layer"), [(f.name, f.dataType.typeName()) for f in schema.fields]
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[Slice]:
        with _connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(_layer(db, self.layer)[0])}").fetchone()
        return [Slice(a, min(a + SLICE, high + 1)) for a in range(low, high + 1, SLICE)] if low is not None else [Slice(0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        with _connect(self.path) as db:
            table, geometry, _ = _layer(db, self.layer)
            names = ", ".join(_quoted(n) for n, _ in self.fields)
            found = db.execute(f"SELECT {names} FROM {_quoted(table)} WHERE rowid >= ? AND rowid < ?", (part.first, part.last))
            while rows := found.fetchmany(BATCH):
                columns = []
                for (name, kind), values, field in zip(self.fields, zip(*rows, strict=True), self.schema, strict=True):
                    if name == geometry:
                        values = map(from_gpkg, values)
                    elif kind in ("boolean", "string"):
                        values = (None if v is None else bool(v) if kind == "boolean" else str(v) for v in values)
                    columns.append(pa.array(list(values), field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class Staged(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class Writer(DataSourceArrowWriter):
    """Tasks stage SQLite parts beside the target; the driver's commit copies those of the tasks that count into one file."""

    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.path, self.layer = options["path"], options.get("layer", "features")
        self.geometry, self.srid = options.get("geometry", "geometry"), int(options.get("srid", "4326"))
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.fields = [(f.name, f.dataType.typeName()) for f in schema.fields]
        self.staging = f"{self.path}.{uuid.uuid4().hex}"
        os.makedirs(self.staging)

    @property
    def _columns(self) -> str:
        kinds = {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "DOUBLE", "binary": "BLOB", "date": "DATE"}
        return ", ".join(f"{_quoted(n)} {'GEOMETRY' if n == self.geometry else kinds.get(k, 'TEXT')}" for n, k in self.fields)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        at = f"{self.staging}/{uuid.uuid4().hex}"
        db = sqlite3.connect(at)
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        db.execute(f"CREATE TABLE part (fid INTEGER PRIMARY KEY, west DOUBLE, east DOUBLE, south DOUBLE, north DOUBLE, {self._columns})")
        insert = f"INSERT INTO part VALUES (NULL, {', '.join('?' * (4 + len(self.fields)))})"
        for b in batches:
            columns, boxes = [], np.full((b.num_rows, 4), np.nan)
            for (name, kind), c in zip(self.fields, b.columns, strict=True):
                if name == self.geometry:
                    blobs, boxes = to_gpkg(c, self.srid)
                    columns.append(blobs)
                elif kind in ("long", "integer", "short", "byte", "boolean", "double", "float", "binary", "string"):
                    columns.append(c.to_pylist())
                else:
                    columns.append([None if v is None else str(v) for v in c.to_pylist()])
            db.executemany(insert, zip(*(boxes[:, k].tolist() for k in range(4)), *columns, strict=True))
        db.commit()
        db.close()
        return Staged(at)

    def commit(self, messages: list[Staged | None]) -> None:
        target = f"{self.staging}/out.gpkg"
        db = sqlite3.connect(target, isolation_level=None)
        db.execute("PRAGMA application_id = 0x47504B47")
        db.execute("PRAGMA user_version = 10300")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
        db.execute("CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL, UNIQUE (table_name, column_name, extension_name))")
        systems = {-1: "undefined cartesian", 0: "undefined geographic", 4326: "WGS 84"}
        systems.setdefault(self.srid, f"EPSG:{self.srid}")
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, NULL)", [(name, i, "NONE" if i <= 0 else "EPSG", i, "undefined" if i <= 0 else name) for i, name in systems.items()])
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 0, 0)", (self.layer, self.geometry, self.srid))
        db.execute(f"CREATE TABLE {_quoted(self.layer)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, {self._columns})")
        tree = _quoted(f"rtree_{self.layer}_{self.geometry}")
        db.execute(f"CREATE VIRTUAL TABLE {tree} USING rtree(id, minx, maxx, miny, maxy)")
        db.execute("INSERT INTO gpkg_extensions VALUES (?, ?, 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (self.layer, self.geometry))
        names = ", ".join(_quoted(n) for n, _ in self.fields)
        before, extent = 0, [None] * 4
        for m in messages:
            if m is None:
                continue
            db.execute("ATTACH ? AS part", (m.path,))
            db.execute("BEGIN")
            db.execute(f"INSERT INTO {_quoted(self.layer)} (fid, {names}) SELECT fid + ?, {names} FROM part.part ORDER BY fid", (before,))
            db.execute(f"INSERT INTO {tree} SELECT fid + ?, west, east, south, north FROM part.part WHERE west IS NOT NULL", (before,))
            count, *box = db.execute("SELECT count(*), min(west), min(south), max(east), max(north) FROM part.part").fetchone()
            db.execute("COMMIT")
            db.execute("DETACH part")
            before += count
            extent = [b if a is None else a if b is None else f(a, b) for f, a, b in zip((min, min, max, max), extent, box, strict=True)]
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (self.layer, self.layer, *extent, self.srid))
        db.close()
        os.replace(target, self.path)
        shutil.rmtree(self.staging)

    def abort(self, messages) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(GeoPackageSource)


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("geopackage").option("path", path)
    df = (reader.option("layer", layer) if layer else reader).load()
    with _connect(path) as db:
        _, geometry, srid = _layer(db, layer)
    return df.withMetadata(geometry, {SRID: srid})


def write_geopackage(df: DataFrame, path: str, layer: str = "features", geometry: str = "geometry") -> None:
    """One file; the folder must be shared by driver and executors. Nested columns become JSON."""
    register(df.sparkSession)
    plain = stringify_complex(df, geometry)
    plain.write.format("geopackage").mode("overwrite").option("path", path).option("layer", layer).option("geometry", geometry).option("srid", str(srid_of(df, geometry))).save()
