"""Parquet with a well-known-binary geometry and its reference system in the file's metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SRID = "srid"

#: The number of a reference system that is there but isn't known by an EPSG code; nothing is projected from it.
UNKNOWN = -1


def geo_srid(geo: str | bytes | None, column: str = "geometry") -> int:
    """The EPSG code in a file's geo metadata; without a system there, longitude and latitude (4326), as the format says; UNKNOWN for one without a code, or null."""
    found = json.loads(geo or "{}").get("columns", {}).get(column) or {}
    crs = found.get("crs")
    if isinstance(crs, dict):
        id = crs.get("id") or {}
        authority, code = str(id.get("authority", "")).upper(), str(id.get("code", ""))
        if authority == "EPSG" and code.isdigit():
            return int(code)
        return 4326 if (authority, code) == ("OGC", "CRS84") else UNKNOWN
    return UNKNOWN if "crs" in found else 4326


def read_geoparquet(spark: SparkSession, path: str, column: str = "geometry", srid: int | None = None) -> DataFrame:
    """A parquet table whose geometry column carries its srid as column metadata.

    The footer's geo entry is looked up where this process can open the path; otherwise pass srid.
    """
    if srid is None:
        srid = geo_srid(_geo_entry(path), column)
    df = spark.read.parquet(path)
    return df.withMetadata(column, {SRID: srid})


def _geo_entry(path: str) -> bytes | None:
    import pyarrow.parquet as pq
    from pyarrow import fs

    try:
        where, at = _opened(path)
        info = where.get_file_info(at)
        if info.type == fs.FileType.Directory:
            files = [f.path for f in where.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet") and not f.base_name.startswith("_")]
            at = min(files, default=None)
        return (pq.read_metadata(at, filesystem=where).metadata or {}).get(b"geo") if at else None
    except (OSError, ValueError):
        return None


def srid_of(df: DataFrame, column: str = "geometry") -> int:
    return df.schema[column].metadata.get(SRID, 4326)


def write_geoparquet(df: DataFrame, path: str, column: str = "geometry") -> None:
    """Parquet whose footers hold the geo entry: a task writes its rows with it, one file a partition.

    Files are opened through Arrow's file systems, so path may be a local or mounted folder that every executor reaches, or a URI of a store that Arrow knows (hdfs, s3, gs).
    """
    import uuid

    from pyarrow import fs

    srid = srid_of(df, column)
    known = {} if srid == 4326 else {"crs": None if srid == UNKNOWN else {"id": {"authority": "EPSG", "code": srid}}}
    entry = {"version": "1.0.0", "primary_column": column, "columns": {column: {"encoding": "WKB", "geometry_types": []} | known}}
    where, base = _opened(path)
    where.create_dir(base, recursive=True)

    def run(it):
        import pyarrow as pa
        import pyarrow.parquet as pq

        files, base = _opened(path)
        writer, name, rows = None, f"part-{uuid.uuid4().hex}.parquet", 0
        for b in it:
            t = pa.Table.from_batches([b]).replace_schema_metadata({b"geo": json.dumps(entry).encode()})
            if writer is None:
                # an underscore hides a file from readers until it is put in place
                writer = pq.ParquetWriter(f"{base}/_{name}", t.schema, compression="snappy", filesystem=files)
            writer.write_table(t)
            rows += b.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "rows": [rows]})

    # a task that is run twice leaves a file that isn't named here, so only the named ones are put in place, and the others go
    for r in df.mapInArrow(run, "file string, rows long").collect():
        where.move(f"{base}/_{r['file']}", f"{base}/{r['file']}")
    for f in where.get_file_info(fs.FileSelector(base)):
        if f.base_name.startswith("_part-"):
            where.delete_file(f.path)


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
