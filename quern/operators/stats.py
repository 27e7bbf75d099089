"""Column statistics and normalisation, each from partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_divisor(s: Column) -> Column:
    return F.when(F.abs(s) < 1e-6, 1.0).otherwise(s)


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: n, total, mean, squares (sum of squared deviations, undivided) and
    stddev (n - 1)."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"t{i}"), F.avg(x).alias(f"m{i}"), (F.var_pop(x) * F.count(x)).alias(f"q{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"s{i}")]
    rows = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("total"), F.col(f"m{i}").alias("mean"), F.col(f"q{i}").alias("squares"), F.col(f"s{i}").alias("stddev")) for i, c in enumerate(columns)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def normalize_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / stddev of each column; one aggregate, whose single row every task gets."""
    stats = {r["name"]: r for r in column_stats(df, columns).collect()}
    out = {}
    for c in columns:
        s = stats[c]["stddev"] or 0.0
        out[c] = (F.col(c) - F.lit(stats[c]["mean"])) / F.lit(s if abs(s) >= 1e-6 else 1.0)
    return df.withColumns(out)


def global_whiten(df: DataFrame, column: str) -> DataFrame:
    """Every entry of an array column divided by the global mean, then by the root mean
    square of the results."""
    x = df.select(F.explode(column).alias("x"))
    r = x.agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q")).first()
    mean = r["m"] if r["m"] else 1.0
    rms = (r["q"] ** 0.5) / abs(mean) if r["q"] else 1.0
    return df.withColumn(column, F.transform(column, lambda v: v / mean / (rms or 1.0)))


def mean_variance(df: DataFrame, column: str) -> DataFrame:
    """mean and population variance; 0 and 0 for no rows."""
    return df.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(column), F.lit(0.0)).alias("variance"))


def ensure_gaussian(df: DataFrame, column: str, mean: float, variance: float) -> DataFrame:
    """The column shifted and scaled to exactly this mean and variance."""
    r = mean_variance(df, column).first()
    scale = (variance / r["variance"]) ** 0.5 if r["variance"] > 0 else 1.0
    return df.withColumn(column, (F.col(column) - r["mean"]) * scale + mean)


def random_columns(df: DataFrame, seed: int, mean: float = 0.0, variance: float = 1.0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Adds gaussian and flat random numbers."""
    return df.withColumn("gaussian", F.randn(seed) * (variance**0.5) + mean).withColumn("flat", F.rand(seed + 1) * (high - low) + low)


def converges(df: DataFrame, order: str, value: str, target: float, tolerance: float = 1e-6, hits: int = 3, max_tests: int = 1000) -> float | None:
    """The first value that begins ``hits`` consecutive ones within tolerance of the target,
    among the first max_tests rows."""
    run: list[float] = []
    for r in df.orderBy(order).limit(max_tests).select(value).toLocalIterator():
        run = [*run, r[0]] if abs(r[0] - target) <= tolerance else []
        if len(run) == hits:
            return run[0]
    return None


def gini(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """1 - the sum of squared label shares, by group."""
    counts = df.groupBy(*group, label).agg(F.count("*").alias("c"))
    return counts.groupBy(*group).agg((1.0 - F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c").cast("double"), F.lit(2.0))).alias("gini"), F.sum("c").alias("n"))
