"""The guard against formulas in CSV cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A cell that is a number as a whole (fixed value).
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan|INF|INFINITY|NAN|NaN|Inf|Infinity)\z"


def guarded(cell: Column) -> Column:
    """A quote before cells that start with = + @, or with - and are no number."""
    first = F.substring(cell, 1, 1)
    risky = first.isin("=", "+", "@") | ((first == "-") & ~cell.rlike(NUMBER))
    return F.when(risky, F.concat(F.lit("'"), cell)).otherwise(cell)


def guard(df: DataFrame) -> DataFrame:
    """All string columns guarded."""
    return df.select(*[guarded(df[f.name]).alias(f.name) if isinstance(f.dataType, T.StringType) else df[f.name] for f in df.schema.fields])
