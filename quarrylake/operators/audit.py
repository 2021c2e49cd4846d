"""Audits: rows flagged with what they violate, split into clean and trash.

Everything is one lazy DataFrame with a boolean and a code; clean and trash are two
filters over it, counts one aggregate. No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import Rule, parse_rules, violation

CLEAN, CODE, VIOLATED = "__clean", "audit_error_code", "audit_violated_rules"
#: Rules whose violations fit the code; more add the list of violated rules.
CODE_BITS = 64


@dataclass(frozen=True)
class Thresholds:
    """Limits of the static audit and the columns it looks at."""

    min_passenger: int = 1
    max_passenger: int = 9
    min_fare: float = 0.01
    max_speed_mph: float = 100.0
    passenger: str = "passenger_count"
    fare: str = "fare_amount"
    distance: str = "trip_distance"


def _bit(i: int) -> int:
    """Bit i as a signed 64-bit integer."""
    return -(1 << 63) if i == 63 else 1 << i


def flag_static(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Bits 1 passenger, 2 fare, 4 distance without fare. A check only runs on the
    exact type (long, double, double) and is skipped otherwise."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    no = F.lit(False)
    people = fare = far = no
    if isinstance(kinds.get(t.passenger), T.LongType):
        people = F.coalesce(~F.col(t.passenger).between(t.min_passenger, t.max_passenger), F.lit(True))
    if isinstance(kinds.get(t.fare), T.DoubleType):
        fare = F.coalesce(F.col(t.fare) < t.min_fare, F.lit(True))
    if isinstance(kinds.get(t.distance), T.DoubleType):
        far = fare & F.coalesce(F.col(t.distance) > 0, no)
    code = reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, F.lit(v)).otherwise(F.lit(0)) for c, v in ((people, 1), (fare, 2), (far, 4))))
    return df.withColumn(CODE, code.cast("long")).withColumn(CLEAN, F.col(CODE) == 0)


def flag_rules(df: DataFrame, rules: Sequence[str | Rule], strict: bool = False) -> DataFrame:
    """Bit i of the code for rule i of the first 64; over 64 rules also the list of
    all violated ones. Clean is decided by the violations, not by the code."""
    found = [(i, v) for i, r in enumerate(parse_rules(rules)) if (v := violation(r, df.schema, strict)) is not None]
    bits = [F.when(v, F.lit(_bit(i))).otherwise(F.lit(0)).cast("long") for i, v in found if i < CODE_BITS]
    code = reduce(Column.bitwiseOR, bits) if bits else F.lit(0).cast("long")
    out = df.withColumn(CODE, code)
    if len(rules) > CODE_BITS:
        ids = F.array(*(F.when(v, F.lit(i)) for i, v in found)) if found else F.array().cast("array<int>")
        out = out.withColumn(VIOLATED, F.filter(ids, lambda x: x.isNotNull()))
        # Not read off the list: counts and splits then never build it.
        broken = reduce(Column.__or__, (v for _, v in found)) if found else F.lit(False)
        return out.withColumn(CLEAN, ~F.coalesce(broken, F.lit(False)))
    return out.withColumn(CLEAN, F.col(CODE) == 0)


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows as they were, and trash rows with what they violate."""
    added = [c for c in (CODE, VIOLATED) if c in flagged.columns]
    return flagged.where(CLEAN).drop(CLEAN, *added), flagged.where(~F.col(CLEAN)).drop(CLEAN)


def summary(flagged: DataFrame) -> DataFrame:
    """One row: total_rows, clean_rows, trash_rows."""
    clean = F.count(F.when(F.col(CLEAN), 1))
    return flagged.agg(F.count("*").alias("total_rows"), clean.alias("clean_rows"), (F.count("*") - clean).alias("trash_rows"))


def counts(flagged: DataFrame) -> tuple[int, int, int]:
    r = summary(flagged).first()
    return r["total_rows"], r["clean_rows"], r["trash_rows"]
