"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "streetloom-shared")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back; a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/streetloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that written() made."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/streetloom-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """On a local master, let Python workers find this package wherever the driver was started."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
        if root not in path.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, path) if x)
