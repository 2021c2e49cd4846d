"""Audits on streams: the expressions are stateless, so they run as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit
from ..operators.rules import Rule


def audit_stream(source: DataFrame, rules: Sequence[str | Rule]) -> DataFrame:
    """A streaming (or bounded) DataFrame with what each row violates."""
    return audit.flag_rules(source, rules)


def windowed_quality(source: DataFrame, rules: Sequence[str | Rule], time: str, window: str, delay: str) -> DataFrame:
    """Rows and violations by event-time window; rows later than ``delay`` are left out
    of windows that are closed."""
    flagged = audit.flag_rules(source.withWatermark(time, delay), rules)
    return flagged.groupBy(F.window(time, window)).agg(F.count("*").alias("total_rows"), F.count(F.when(~F.col(audit.CLEAN), 1)).alias("trash_rows"))


def split_sink(source: DataFrame, rules: Sequence[str | Rule], clean: str, trash: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes clean and trash rows of each micro-batch as Parquet; the batch's number
    names its folder, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        flagged = audit.flag_rules(batch, rules).persist()
        try:
            for df, folder in zip(audit.split(flagged), (clean, trash), strict=True):
                df.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            flagged.unpersist()

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
