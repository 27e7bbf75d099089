"""Scans and sinks: driver tables, IDX files, folders of labelled files, CSV, models, metrics."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.stats import global_whiten

IMAGES, LABELS = 2051, 2049


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def idx_images(spark: SparkSession, path: str, side: int = 28) -> DataFrame:
    """row, data: pixels as b / 255 - 0.5, from IDX3 files, gzipped or not."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                raw = _unpacked(content)
                magic, n, rows, cols = struct.unpack(">iiii", raw[:16])
                if magic != IMAGES or (rows, cols) != (side, side) or len(raw) != 16 + n * rows * cols:
                    raise ValueError("not an image file of this size")
                pixels = np.frombuffer(raw, np.uint8, offset=16).reshape(n, rows * cols)
                for k in range(0, n, 1000):
                    yield pd.DataFrame({"row": np.arange(k, min(n, k + 1000)), "data": list(pixels[k : k + 1000] / 255.0 - 0.5)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, data array<double>")


def idx_labels(spark: SparkSession, path: str, classes: int = 10) -> DataFrame:
    """row, label: one-hot vectors, from IDX1 files."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                raw = _unpacked(content)
                magic, n = struct.unpack(">ii", raw[:8])
                if magic != LABELS or len(raw) != 8 + n:
                    raise ValueError("not a label file")
                yield pd.DataFrame({"row": np.arange(n), "label": list(np.eye(classes)[np.frombuffer(raw, np.uint8, offset=8)])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "row long, label array<double>")


def zip_columns(*tables: DataFrame) -> DataFrame:
    """Datasets side by side, by row number."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "row")
    return out


def digits(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """row, data, label of the "train" or "test" images of a folder of IDX files, gzipped or not."""
    stem = {"train": "train", "test": "t10k"}[part]
    return zip_columns(idx_images(spark, f"{folder}/{stem}-images-idx3-ubyte*"), idx_labels(spark, f"{folder}/{stem}-labels-idx1-ubyte*"))


def whitened_digits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both parts, whitened by the statistics of them together."""
    both = digits(spark, folder, "train").withColumn("part", F.lit("train")).unionByName(digits(spark, folder, "test").withColumn("part", F.lit("test")))
    white = global_whiten(both, "data")
    return white.where("part = 'train'").drop("part"), white.where("part = 'test'").drop("part")


def labelled_folder(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, content, class of the files below ``path``; the class is the parent folder's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.element_at(F.split("path", "/"), -2).alias("class"))


def decode_rows(files: DataFrame, decode, schema: str) -> DataFrame:
    """Rows that ``decode`` (bytes -> tuple or None) makes of the contents; unreadable ones go."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for cls, content in zip(part["class"], part["content"]):
                try:
                    got = decode(bytes(content))
                except (ValueError, OSError):
                    got = None
                if got is not None:
                    rows.append((cls, *got))
            yield pd.DataFrame(rows, columns=["class", *columns])

    return files.select("class", "content").mapInPandas(run, f"class string, {schema}")


def csv_vectors(spark: SparkSession, path: str, data: list[str], label: str, positive: str = "Yes") -> DataFrame:
    """data (numbers of the named columns) and label (1.0 for ``positive``) of a CSV file."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.array(*(F.col(c).cast("double") for c in data)).alias("data"), F.array(F.when(F.col(label) == positive, 1.0).otherwise(0.0)).alias("label"))


# -- models and metrics ---------------------------------------------------------------------


def save_network(net, spark: SparkSession, path: str, **facts) -> None:
    """Description and facts as JSON lines, parameters as a (name, shape, values) table."""
    rows = [("parameter", k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in net.parameters.items()]
    rows += [("state", k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in net.state.items()]
    schema = "kind string, name string, shape array<int>, values array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")
    spark.createDataFrame([(net.to_json(), json.dumps(facts))], "network string, facts string").coalesce(1).write.mode("overwrite").json(f"{path}/network")


def load_network(spark: SparkSession, path: str):
    from quern.plans.network import Layer, Network

    head = spark.read.schema("network string, facts string").json(f"{path}/network").first()
    if head is None:
        raise FileNotFoundError(path)
    spec = json.loads(head["network"])
    net = Network.build([Layer(**x) for x in spec["layers"]])
    net.losses, net.frozen = spec["losses"], set(spec["frozen"])
    for r in spark.read.parquet(f"{path}/parameters").toLocalIterator():
        (net.parameters if r["kind"] == "parameter" else net.state)[r["name"]] = np.array(r["values"]).reshape(r["shape"])
    return net, json.loads(head["facts"])


def free_name(spark: SparkSession, stem: str) -> str:
    """The stem, or the first stem-N that does not exist."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    k, name = 0, stem
    while True:
        p = jvm.org.apache.hadoop.fs.Path(name)
        if not p.getFileSystem(conf).exists(p):
            return name
        k += 1
        name = f"{stem}-{k}"


def list_networks(spark: SparkSession, pattern: str) -> DataFrame:
    """path and facts of saved networks, best cv_loss first."""
    heads = spark.read.schema("network string, facts string").json(f"{pattern}/network")
    return heads.select(F.input_file_name().alias("path"), F.get_json_object("facts", "$.cv_loss").cast("double").alias("cv_loss"), "facts").orderBy("cv_loss")


def upgrade_network(record: dict) -> dict:
    """A saved description of the former form, with packed parameters (values and shape) and
    gradients, in the present one: nested lists, without gradients."""
    out = {k: v for k, v in record.items() if k != "gradients"}
    out["parameters"] = {k: np.asarray(v["values"], float).reshape(v["shape"]).tolist() if isinstance(v, dict) else v for k, v in record.get("parameters", {}).items() if not k.endswith(".gradient")}
    return out


def load_arrays(net, arrays: dict[str, np.ndarray], channels_last: bool = True) -> None:
    """Weights of another library's export (name -> array) put into a network's parameters:
    dense kernels are (in, out), convolution kernels (height, width, in, out)."""
    for name, values in arrays.items():
        have, x = net.parameters[name], np.asarray(values, float)
        if name.endswith(".weights") and channels_last:
            x = x.transpose(3, 2, 0, 1) if x.ndim == 4 else x.T if x.ndim == 2 else x
        if x.size != have.size:
            raise ValueError(f"{name} has {have.size} entries, not {x.size}")
        net.parameters[name] = x.reshape(have.shape).copy()


def log_metrics(spark: SparkSession, path: str, epoch: int, values: dict) -> None:
    """Appends (epoch, name, value, entries) rows: numbers, or arrays (a layer's weights), whose
    value is their mean."""
    rows = [(epoch, k, float(np.mean(v)), np.ravel(v).astype(float).tolist() if np.ndim(v) else None) for k, v in values.items()]
    spark.createDataFrame(rows, "epoch int, name string, value double, entries array<double>").coalesce(1).write.mode("append").parquet(path)
