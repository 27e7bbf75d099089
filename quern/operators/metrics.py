"""Classification metrics over (y, y_hat) columns of 0 and 1.

``fpr`` divides by the predicted negatives and ``tpr`` by the predicted positives, as the
golden values this library answers to have it; ``textbook=True`` gives the usual ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def wrong(y: Column, y_hat: Column) -> Column:
    return (y != y_hat).cast("int")


def false_positive(y: Column, y_hat: Column) -> Column:
    return (y_hat - y == 1).cast("int")


def false_negative(y: Column, y_hat: Column) -> Column:
    return (y - y_hat == 1).cast("int")


def true_positive(y: Column, y_hat: Column) -> Column:
    return (y * y_hat).cast("int")


def true_negative(y: Column, y_hat: Column) -> Column:
    return (y + y_hat == 0).cast("int")


def threshold(estimate: Column, t: Column | float) -> Column:
    return (estimate >= t).cast("int")


def rates(y: Column, y_hat: Column, textbook: bool = False) -> dict[str, Column]:
    """Aggregates by name."""
    tp, fp = F.sum(true_positive(y, y_hat)).cast("double"), F.sum(false_positive(y, y_hat)).cast("double")
    tpr = F.try_divide(tp, F.sum(y if textbook else y_hat))
    return {
        "accuracy": 1.0 - F.avg(wrong(y, y_hat)),
        "error_rate": F.avg(wrong(y, y_hat)),
        "recall": F.try_divide(tp, F.sum(y)),
        "precision": F.try_divide(tp, tp + fp),
        "fpr": F.try_divide(fp, F.sum(((y if textbook else y_hat) != 1).cast("int"))),
        "tpr": tpr,
        "fnr": 1.0 - tpr,
    }


def binary_metrics(df: DataFrame, y: str, y_hat: str, by: list[str] | None = None, textbook: bool = False) -> DataFrame:
    aggs = [c.alias(k) for k, c in rates(F.col(y), F.col(y_hat), textbook).items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _curve(df: DataFrame, y: str, estimate: str, bins: int) -> DataFrame:
    """t, predicted, tp, n of each threshold: one histogram of the rows by the number of
    thresholds they pass, then running sums over at most bins + 2 cells."""
    edges = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    passed = F.size(F.filter(edges, lambda t: F.col(estimate) >= t))
    cells = df.groupBy(passed.alias("k")).agg(F.count("*").alias("rows"), F.sum(y).alias("pos"))
    cells = df.sparkSession.range(bins + 2).select(F.col("id").cast("int").alias("k")).join(cells, "k", "left").fillna(0)
    up = W.orderBy(F.col("k").desc())
    return cells.select((F.col("k") - 1).alias("i"), F.sum("rows").over(up).alias("predicted"), F.sum("pos").over(up).alias("tp"), F.sum("rows").over(W.partitionBy()).alias("n")).where("i >= 0")


def roc_curve(df: DataFrame, y: str, estimate: str, bins: int = 100) -> DataFrame:
    """threshold, fpr, tpr where some but not all rows are predicted; consecutive points with
    the same rates keep their first."""
    c = _curve(df, y, estimate, bins).where("predicted > 0 AND predicted < n")
    c = c.select((F.col("i") / F.lit(float(bins))).alias("threshold"), ((F.col("predicted") - F.col("tp")) / (F.col("n") - F.col("predicted"))).alias("fpr"), (F.col("tp") / F.col("predicted")).alias("tpr"))
    w = W.orderBy("threshold")
    same = F.lag("fpr").over(w).eqNullSafe(F.col("fpr")) & F.lag("tpr").over(w).eqNullSafe(F.col("tpr"))
    return c.withColumn("_same", same).where(~F.col("_same")).drop("_same")


def equal_error_point(df: DataFrame, y: str, estimate: str, bins: int = 100) -> DataFrame:
    """threshold with the smallest |fpr - (1 - tpr)|, the last one among equals."""
    gap = F.abs(F.col("fpr") - (1.0 - F.col("tpr")))
    return roc_curve(df, y, estimate, bins).withColumn("gap", gap).orderBy("gap", F.col("threshold").desc()).limit(1).select("threshold", "gap")


def eer_accuracy(df: DataFrame, y: str, estimate: str, bins: int = 100) -> DataFrame:
    """accuracy at the equal error point, and its threshold."""
    point = equal_error_point(df, y, estimate, bins).first()
    if point is None:
        return df.sparkSession.createDataFrame([], "accuracy double, threshold double")
    hat = threshold(F.col(estimate), point["threshold"])
    return df.agg((1.0 - F.avg(wrong(F.col(y), hat))).alias("accuracy")).withColumn("threshold", F.lit(point["threshold"]))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, n for every pair of class names, zero where there is none."""
    names = df.select(F.explode(F.array(actual, predicted)).alias("c")).agg(F.collect_set("c").alias("c"))  # the classes
    grid = names.select("c", F.explode("c").alias("actual")).select("actual", F.explode("c").alias("predicted"))
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def sample_view(train: DataFrame, test: DataFrame, key: str, n: int = 50, seed: int = 0) -> DataFrame:
    """What a look at a dataset shows: the first n training rows and n test rows in a seeded
    order, with their part and place."""
    first = train.orderBy(key).limit(n).withColumn("part", F.lit("training"))
    mixed = test.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n).withColumn("part", F.lit("test"))
    return first.unionByName(mixed)


def top_per_cell(df: DataFrame, cell: list[str], score: str, id_col: str, k: int = 100) -> DataFrame:
    """The k best rows of each cell.  Every task keeps its own best first, so a hot cell
    sends k rows a task at most to the final ranking."""
    order = [F.col(score).desc(), F.col(id_col)]
    local = F.row_number().over(W.partitionBy(*cell, "_task").orderBy(*order))
    near = df.withColumn("_task", F.pmod(F.xxhash64(id_col), F.lit(64))).withColumn("_r", local).where(F.col("_r") <= k).drop("_task", "_r")
    return near.withColumn("rank", F.row_number().over(W.partitionBy(*cell).orderBy(*order))).where(F.col("rank") <= k)
