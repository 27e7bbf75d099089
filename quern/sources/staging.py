"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode.  On a
    cluster there is no folder to fall back to, since machines do not share theirs."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _LOCAL[app]


def _path(spark: SparkSession, address: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(address)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet, in a folder for each value of ``by``, and read back."""
    spark = df.sparkSession
    address = f"{shared_folder(spark)}/quern-core/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, address)
    fs.mkdirs(p.getParent())
    fs.deleteOnExit(p.getParent())
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(address)
    out = spark.read.schema(df.schema).parquet(address)
    out._staged_at = address
    return out


def drop(*tables: DataFrame) -> None:
    for df in tables:
        if address := getattr(df, "_staged_at", None):
            p, fs = _path(df.sparkSession, address)
            fs.delete(p, True)
