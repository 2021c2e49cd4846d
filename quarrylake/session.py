"""Session settings: read what is there, never start a second session."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: What a session of our own starts with; a given session keeps its own settings.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session() -> SparkSession:
    """The active session, or a new one with DEFAULTS."""
    found = SparkSession.getActiveSession()
    return found or SparkSession.builder.config(map=DEFAULTS).getOrCreate()


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Runtime settings (dots as double underscores) that end with the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let_workers_import(spark: SparkSession) -> None:
    """Puts this package's folder on the Python workers' path, for sessions that were
    started elsewhere. A cluster without a shared file system needs --py-files too."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
