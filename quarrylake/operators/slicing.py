"""Slices in file order, with column selection, and samples for a first look."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LakeError
from ..sources import files, readers
from .audit import Thresholds, flag_static, split


def _checked(df: DataFrame, columns: Sequence[str]) -> list[str]:
    for c in columns:
        if c not in df.columns:
            raise LakeError(f"Column '{c}' not found in schema")
    return list(columns) or df.columns


def _between(spark: SparkSession, path: str, df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit of Parquet, by the rows' own numbers. The files of
    a folder follow each other by path; their sizes come from their footers."""
    file, number = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if not files.info(spark, path).is_dir:
        return df.where((number >= offset) & (number < offset + limit))
    held, at = [], 0
    for name, n in sorted(tuple(r) for r in df.groupBy(file.alias("file")).count().collect()):
        if at < offset + limit and at + n > offset:
            held.append((name, at))
        at += n
    if not held or not limit:
        return df.limit(0)
    (first, start), (last, end) = held[0], held[-1]
    after = (file > first) | ((file == first) & (number >= offset - start))
    before = (file < last) | ((file == last) & (number < offset + limit - end))
    return df.where(after & before).orderBy(file, number)


def slice_rows(spark: SparkSession, path: str, offset: int, limit: int, columns: Sequence[str] = ()) -> DataFrame:
    """Rows offset .. offset + limit of a file. Parquet is filtered by the rows' own
    numbers, in parallel and with pruned columns; other formats are cut in order."""
    if offset < 0 or limit < 0:
        raise OverflowError("offset and limit must not be negative")
    df = readers.read_file(spark, path)
    names = _checked(df, columns)
    if readers.format_of(path).kind == "parquet":
        return _between(spark, path, df, offset, limit).select(*names)
    return df.select(*names).offset(offset).limit(limit)


def _first(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """The first rows. A bare limit may take those of any part of the file."""
    df, kind = readers.read_file(spark, path), readers.format_of(path, spark).kind
    if kind == "parquet":
        return _between(spark, path, df, 0, rows)
    if kind not in readers.NATIVE or not df.columns:
        return df.limit(rows)
    order = {f"{name}_{uuid.uuid4().hex}": c for name, c in (("file", F.col("_metadata.file_path")), ("block", F.col("_metadata.file_block_start")), ("row", F.monotonically_increasing_id()))}
    return df.select("*", *(c.alias(name) for name, c in order.items())).orderBy(*order).limit(rows).drop(*order)


def preview(spark: SparkSession, path: str, rows: int, thresholds: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Clean and trash of the first rows."""
    first = _first(spark, path, rows)
    if first.isEmpty():
        raise LakeError(f"{path} has no rows")
    return split(flag_static(first, thresholds))
