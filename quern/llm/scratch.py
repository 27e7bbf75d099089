"""Tables that a job writes once and reads again, in the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SEEN: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset: a temporary folder in local
    mode (one machine); on a cluster an error, since nothing else is sure to be shared."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in a folder of this application, which goes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_root(spark)}/quern/{app}"
    if folder not in _SEEN:
        _SEEN.add(folder)
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts the lineage, and a lost executor
    costs a file read instead of a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete staged tables whose readers have all finished."""
    for df in tables:
        if path := getattr(df, "_quern_path", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
