"""CSV, text and parquet tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The default extent: Oxford and its surroundings, degrees (west, south, east, north).
BOX = (-1.4973, 51.5835, -0.9893, 51.8528)


def _csv(spark: SparkSession, path: str, schema: str, ordered: bool = False) -> DataFrame:
    """A CSV file with a header, columns by position; an empty or malformed cell is an error. ordered adds ord."""
    df = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=True)
    return df.select(*([file_order().alias("ord")] if ordered else []), *(F.when(F.col(c).isNull(), F.raise_error(F.lit(f"empty cell in column {c}"))).otherwise(F.col(c)).alias(c) for c in df.columns))


def read_connectors(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "id string, x double, y double")


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "id string, x double, y double")


def read_building_links(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "building_id string, connector_id string, distance_m double")


def file_order() -> Column:
    """Where a row stands in the files that were read: by file name, place of the split in it, and row. Spark deals files out by length, so their rows come in any order."""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """Segments (id, length_m, connectors) from rows (road_id, connector_id, at, road_length_m) in file order; several files count in order of their names."""
    return road_segments(_csv(spark, path, "road_id string, connector_id string, at double, road_length_m double", ordered=True))


def road_segments(refs: DataFrame) -> DataFrame:
    """Refs (road_id, connector_id, at, road_length_m, ord) grouped into segments.

    Refs are sorted by at, ties by ord. A road's length is its first; a later one
    replaces it if it differs by more than 1e-6 from what is current.
    """
    # a road's refs are few; the group's list is bounded by the road
    rows = F.array_sort(F.collect_list(F.struct("ord", "road_length_m")))
    fold = F.aggregate(F.slice("rows", 2, F.size("rows")), F.element_at("rows", 1)["road_length_m"], lambda a, r: F.when(F.abs(a - r["road_length_m"]) > 1e-6, r["road_length_m"]).otherwise(a))
    refs = refs.groupBy(F.col("road_id").alias("id")).agg(rows.alias("rows"), F.array_sort(F.collect_list(F.struct("at", "ord", "connector_id"))).alias("refs"))
    return refs.select("id", fold.alias("length_m"), F.transform("refs", lambda r: F.struct(r["connector_id"].alias("connector_id"), r["at"].alias("at"))).alias("connectors"))


def read_id_list(spark: SparkSession, path: str | None, inline: Iterable[str] = ()) -> DataFrame:
    """(id, ord): the inline ids, then the file's lines (of several files in order of their names); trimmed, without blanks and # comments, each id at its first place."""
    place = "struct<path:string,start:bigint,row:bigint>"
    ids = spark.createDataFrame([(i, ("", 0, n)) for n, i in enumerate(inline)], f"value string, place {place}")
    if path:
        lines = spark.read.text(path).select(F.trim("value").alias("value"), file_order().cast(place).alias("place"))
        ids = ids.unionByName(lines.filter((F.col("value") != "") & ~F.col("value").startswith("#")))
    return ids.groupBy(F.col("value").alias("id")).agg(F.min("place").alias("ord"))


#: Lines from which a CSV file's dialect is told.
SNIFFED = 50


def read_sniffed_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A CSV file whose delimiter, quote and header are told from its first lines, types from all (strings if not infer); without a header columns are column0, column1 and so on."""
    lines = [r[0] for r in spark.read.text(path).limit(SNIFFED).collect()]
    sample = "\n".join(lines)
    try:
        dialect = csv.Sniffer().sniff(sample, ",;\t|")
        sep, quote = dialect.delimiter, dialect.quotechar or '"'
    except csv.Error:  # a single column
        sep, quote = ",", '"'
    rows = list(csv.reader(lines, delimiter=sep, quotechar=quote))
    # a header has no empty or numeric name, and no name twice
    header = bool(rows) and len(set(rows[0])) == len(rows[0]) and not any(c.strip() == "" or _number(c) for c in rows[0])
    df = spark.read.csv(path, sep=sep, quote=quote, header=header, inferSchema=infer)
    return df if header else df.toDF(*(f"column{k}" for k in range(len(df.columns))))


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def inside_box(box: tuple[float, float, float, float] = BOX, bbox: str = "bbox") -> Column:
    """Whether a feature's bounding box lies strictly inside; pushed down to parquet."""
    west, south, east, north = box
    b = F.col(bbox)
    return (b["ymin"] > south) & (b["ymax"] < north) & (b["xmin"] > west) & (b["xmax"] < east)


def extract(spark: SparkSession, path: str, box: tuple[float, float, float, float] = BOX) -> DataFrame:
    """All columns of the features of a parquet glob (local, s3a and so on) inside a box."""
    return spark.read.parquet(path).filter(inside_box(box))


SIMPLE = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def stringify_complex(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Columns that file formats of plain types can't hold as strings: nested ones as JSON, others by cast. The geometry stays."""
    out = []
    for f in df.schema.fields:
        wide = isinstance(f.dataType, T.DecimalType) and (f.dataType.precision, f.dataType.scale) == (38, 0)
        if f.name == geometry or isinstance(f.dataType, SIMPLE) or wide:
            out.append(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`").cast("string").alias(f.name))
    return df.select(*out)


gpkg_safe = stringify_complex


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; a folder of part files, or one file for programs that can't read a folder.

    For one file the tasks write parts as well; the file system's streams then append them in order, a buffer at a time.
    """
    if not one_file:
        df.write.mode("overwrite").csv(path, header=True)
        return
    spark, parts = df.sparkSession, f"{path}.parts"
    df.write.mode("overwrite").csv(parts, header=False)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    target, folder = hadoop.fs.Path(path), hadoop.fs.Path(parts)
    fs = target.getFileSystem(conf)
    fs.delete(target, True)
    out = fs.create(target, True)
    try:
        out.write(bytearray(_header(df.columns).encode()))
        for part in sorted(s.getPath().toString() for s in fs.globStatus(hadoop.fs.Path(folder, "part-*"))):
            rows = fs.open(hadoop.fs.Path(part))
            try:
                hadoop.io.IOUtils.copyBytes(rows, out, conf, False)
            finally:
                rows.close()
    finally:
        out.close()
    fs.delete(folder, True)


def _header(names: list[str]) -> str:
    line = io.StringIO()
    csv.writer(line, lineterminator="\n", escapechar="\\", doublequote=False).writerow(names)
    return line.getvalue()
