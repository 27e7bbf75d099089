"""Row numbers, batches, samples and splits, without a global window.

A row number over a whole table, or over a class that holds most of it, comes from two
passes: a histogram over key ranges gives each range its first number, and a window inside
each (class and) range numbers its rows.  Ranges come from approximate quantiles, so they are
about equal whatever the key's distribution, and their number follows the table's; rows that
share one key are told apart by the tie columns within their range.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of a numbering, and the rows that one aims at; a window holds a range at a time.
MIN_RANGES, MAX_RANGES, ROWS_A_RANGE = 64, 16_384, 1_000_000


def key_range(df: DataFrame, key: str, rows: int, least: int = MIN_RANGES) -> Column:
    """The number of the key's range: how many of the quantiles lie below it."""
    ranges = min(MAX_RANGES, max(least, -(-rows // ROWS_A_RANGE)))
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"]
    bounds = sorted(set(cuts or []))
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    at = F.array(*map(F.lit, bounds))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.get(at, n + step - 1) < F.col(key), n + step).otherwise(n))


def number_rows(df: DataFrame, key: str, *ties: str, name: str = "row", by: str | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of key, then ties; within each ``by`` if given."""
    marked = df.withColumn("_q_range", key_range(df, key, df.count()))
    marked = marked.withColumn("_q_by", F.col(by) if by else F.lit(0))
    counts = marked.groupBy("_q_by", "_q_range").agg(F.count("*").alias("_q_c"))
    # a row a class and range
    before = F.sum("_q_c").over(W.partitionBy("_q_by").orderBy("_q_range").rowsBetween(W.unboundedPreceding, -1))
    start = counts.select(F.col("_q_by").alias("_q_b"), F.col("_q_range").alias("_q_r"), F.coalesce(before, F.lit(0)).alias("_q_first"))
    within = F.row_number().over(W.partitionBy("_q_by", "_q_range").orderBy(key, *ties))
    rows = marked.join(start, F.col("_q_by").eqNullSafe(F.col("_q_b")) & (F.col("_q_range") == F.col("_q_r")))
    return rows.withColumn(name, (F.col("_q_first") + within - 1).cast("long")).drop("_q_range", "_q_by", "_q_b", "_q_r", "_q_first")


def batches(df: DataFrame, size: int, key: str, *ties: str) -> DataFrame:
    """Adds batch_id and row_in_batch; the incomplete last batch is dropped."""
    n = df.count()
    rows = number_rows(df, key, *ties).where(F.col("row") < n // size * size)
    return rows.withColumn("batch_id", F.floor(F.col("row") / size)).withColumn("row_in_batch", F.col("row") % size).drop("row")


def pad_to_batch(df: DataFrame, size: int, key: str, *ties: str) -> DataFrame:
    """Adds row and fills the last batch by cycling through the last ``size`` rows."""
    n = df.count()
    rows = number_rows(df, key, *ties)
    missing = -n % size
    if not missing or not n:
        return rows
    tail = min(size, n)
    extra = rows.where(F.col("row") >= n - tail)
    copies = F.expr(f"sequence(0, {-(-missing // tail) - 1})")
    extra = extra.withColumn("_c", F.explode(copies)).withColumn("row", F.col("row") + tail * (F.col("_c") + 1)).where(F.col("row") < n + missing).drop("_c")
    return rows.unionByName(extra)


def full_batches(df: DataFrame, size: int, key: str, *ties: str) -> DataFrame:
    """``batches``, of which there must be one at least."""
    if df.limit(size).count() < size:
        raise ValueError(f"no full batch: the table has fewer than {size} rows")
    return batches(df, size, key, *ties)


def to_columns(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """A row a batch, with an array of each column's values in order."""
    row = F.array_sort(F.collect_list(F.struct(order, *(F.col(c).alias(f"_{c}") for c in columns))))
    return df.groupBy(batch).agg(row.alias("_rows")).select(batch, *(F.col("_rows").getField(f"_{c}").alias(c) for c in columns))


def to_rows(df: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """Its inverse: a row for each entry, with its place."""
    zipped = F.arrays_zip(*columns)
    return df.select(batch, F.posexplode(zipped).alias("place", "_row")).select(batch, "place", *(F.col("_row")[c].alias(c) for c in columns))


def augmented(df: DataFrame, streams: dict[str, Column], whole: bool = True, batch: str = "batch_id") -> DataFrame:
    """Adds columns that are made from others: of a row alone, or with aggregates over the whole
    table (as losses need) or over each batch."""
    out = {}
    for name, column in streams.items():
        out[name] = column(W.partitionBy() if whole else W.partitionBy(batch)) if callable(column) and not isinstance(column, Column) else column
    return df.withColumns(out)


def inverse_label_counts(df: DataFrame, batch: str, label: str) -> DataFrame:
    """Adds inverse_count: 1 / rows of the batch with the same label."""
    counts = df.groupBy(batch, label).agg((1.0 / F.count("*")).alias("inverse_count"))
    return df.join(counts, [batch, label])


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """A seeded order that depends on ids alone."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)


def take(df: DataFrame, n: int, id_col: str, seed: int) -> DataFrame:
    """n rows without replacement."""
    return shuffled(df, id_col, seed).limit(n)


def take_with_replacement(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows with replacement: n random row numbers, joined."""
    total = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total)))).alias("row"))
    return draws.join(number_rows(df, key), "row").drop("row")


def holdout(df: DataFrame, id_col: str, percent: int = 90, salt: int = 7919, modulus: int = 1_000_003) -> DataFrame:
    """Adds is_train by arithmetic on an integer id, so any engine splits alike."""
    return df.withColumn("is_train", (F.col(id_col) * salt % modulus) % 100 < percent)


def class_split(df: DataFrame, label: str, id_col: str, test: float = 0.3) -> DataFrame:
    """Adds is_test: the first floor(test * n) rows of each class by id."""
    n = df.groupBy(label).agg(F.floor(F.count("*") * test).alias("_n")).withColumnRenamed(label, "_l")
    numbered = number_rows(df, id_col, name="_r", by=label)
    return numbered.join(n, F.col(label).eqNullSafe(F.col("_l"))).withColumn("is_test", F.col("_r") < F.col("_n")).drop("_r", "_n", "_l")


def class_rounds(df: DataFrame, label: str, key: str, *ties: str) -> DataFrame:
    """Adds turn: a row's place in its class.  Ordered by (turn, class), the rows are the
    classes' round-robin."""
    return number_rows(df, key, *ties, name="turn", by=label)


def balanced(df: DataFrame, label: str, key: str, *ties: str) -> DataFrame:
    """Round-robin in which small classes start again until the largest is exhausted."""
    turns = class_rounds(df, label, key, *ties)
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    top = sizes.agg(F.max("_n")).first()[0] or 0
    repeats = F.expr(f"sequence(0, cast((({top} - 1 - turn) div _n) AS int))")
    return turns.join(sizes, label).withColumn("_k", F.explode(repeats)).withColumn("turn", F.col("turn") + F.col("_k") * F.col("_n")).drop("_n", "_k")


def epochs(df: DataFrame, id_col: str, size: int = 1024, seed: int = 0, limit: int | None = None) -> Iterator[DataFrame]:
    """Endless reshuffles of the rows in chunks of ``size``: DataFrames of one epoch each."""
    n = df.count()
    epoch, done = 0, 0
    while limit is None or done < limit:
        order = number_rows(df.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed + epoch))), "_h", id_col).drop("_h")
        for k in range(max(1, n // size)):
            if limit is not None and done >= limit:
                return
            yield order.where((F.col("row") >= k * size) & (F.col("row") < (k + 1) * size)).drop("row")
            done += 1
        epoch += 1
