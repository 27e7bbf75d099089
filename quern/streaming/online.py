"""Online training: each micro-batch of a stream gives one optimiser step.

This has no counterpart to be equal to; it is the training loop driven by Structured
Streaming instead of an epoch loop."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.plans.network import Network


def train_stream(stream: DataFrame, net: Network, inputs: dict[str, str], labels: dict[str, str], optimizer, checkpoint: str, key: str | None = None, lanes: int = 8, available_now: bool = True) -> StreamingQuery:
    """Starts a query that trains ``net`` in place.  A micro-batch is split in ``lanes`` by the
    hash of ``key`` (or of inputs and labels), whose gradients are computed in parallel and summed.  After every
    micro-batch the model and the optimiser are saved under its number beside the stream's
    checkpoint; a restart loads the last one that the stream had committed."""
    spark = stream.sparkSession
    saved = f"{checkpoint}/model"

    def restore(epoch: int) -> None:
        got = _saved(spark, saved).where(F.col("epoch") < epoch).orderBy(F.col("epoch").desc()).limit(1).collect()
        if got:
            net.__dict__.update(pickle.loads(bytes(got[0]["net"])).__dict__)
            optimizer.__dict__.update(pickle.loads(bytes(got[0]["optimizer"])).__dict__)

    started = []

    def step(rows: DataFrame, epoch: int) -> None:
        if not started:  # also where a batch is run again that had not been committed
            restore(epoch)
            started.append(epoch)
        dealt = rows.withColumn("batch_id", F.pmod(F.xxhash64(*([key] if key else [*inputs.values(), *labels.values()])), F.lit(lanes)))
        g, _, n = net.step_gradient(dealt, inputs, labels, "batch_id", epoch)
        if n:
            net.assign(optimizer.step(net.flat(), net.rates() * g / n))
            net.constrain()
        state = [(epoch, bytearray(pickle.dumps(net)), bytearray(pickle.dumps(optimizer)))]
        spark.createDataFrame(state, _STATE).coalesce(1).write.mode("overwrite").parquet(f"{saved}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


_STATE = "number long, net binary, optimizer binary"


def _saved(spark, folder: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "epoch long, net binary, optimizer binary")
    return spark.read.option("basePath", folder).parquet(folder).select(F.col("epoch").cast("long").alias("epoch"), "net", "optimizer")
