"""One-hot columns and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Distinct values of a feature that become columns; more are an error.
MAX_CLASSES = 1000


def classes_of(df: DataFrame, feature: str, most: int = MAX_CLASSES) -> list:
    """The distinct values of a column, in order; an error above ``most``."""
    got = [r[0] for r in df.select(feature).where(F.col(feature).isNotNull()).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{feature} has more than {most} distinct values")
    return sorted(got)


def one_hot_columns(df: DataFrame, features: list[str], classes: dict[str, list[str]] | None = None) -> DataFrame:
    """Replaces each feature by feature_value columns of 0 and 1, for its distinct values."""
    for f in features:
        values = classes[f] if classes and f in classes else classes_of(df, f)
        df = df.select(*(c for c in df.columns if c != f), *(F.when(F.col(f) == v, 1).otherwise(0).alias(f"{f}_{v}") for v in values))
    return df


def reverse_one_hot(df: DataFrame, features: list[str]) -> DataFrame:
    """The value of the first feature_* column that is 1, in the order of the columns."""
    for f in features:
        coded = [c for c in df.columns if c.startswith(f"{f}_")]
        value = F.coalesce(*(F.when(F.col(c) == 1, F.lit(c[len(f) + 1 :])) for c in coded)) if coded else F.lit(None).cast("string")
        df = df.select(*(c for c in df.columns if c not in coded), value.alias(f))
    return df
