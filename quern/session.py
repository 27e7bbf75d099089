"""The session that the library works in, with what it counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins and splits skewed ones; times are in UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(name: str = "quern", checkpoint_dir: str | None = None, **settings: str) -> SparkSession:
    """The running session, or a new one; the shared folder for staged tables is
    ``checkpoint_dir``."""
    builder = SparkSession.builder.appName(name)
    given = {k.replace("__", "."): v for k, v in settings.items()}
    if checkpoint_dir:
        given["spark.checkpoint.dir"] = checkpoint_dir
    for k, v in {**SETTINGS, **given}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
