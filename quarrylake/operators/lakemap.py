"""The lake map: a catalogue of files with row counts and column bounds, and its doctor."""

from __future__ import annotations

import io
import json
import warnings
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LakeError
from ..sources import files, readers
from . import discovery

MAP_NAME = ".quarry_map.ipc"
SCHEMA = pa.schema([("rel_path", pa.string()), ("size_bytes", pa.uint64()), ("mtime_ms", pa.int64()), ("total_rows", pa.uint64()), ("stats_json", pa.string())])
#: Types whose bounds the map holds.
BOUNDED = (T.LongType, T.DoubleType, T.StringType)


def column_bounds(df: DataFrame) -> DataFrame:
    """One row: total_rows and, of each bounded column, least and greatest value."""
    own = [f for f in df.schema.fields if isinstance(f.dataType, BOUNDED)]
    bounds = [g(F.col(f"`{f.name}`")).alias(f"{n}:{f.name}") for f in own for n, g in (("min", F.min), ("max", F.max))]
    return df.agg(F.count("*").alias("total_rows"), *bounds)


def _entries(spark: SparkSession, base: str, paths: Sequence[str]) -> tuple[list[dict], list[str]]:
    """Map entries, in one job for all files that share format and schema, and the
    files that cannot be read."""
    groups: dict[tuple, list[str]] = {}
    bad: list[str] = []
    for p in paths:
        try:
            f, schema = readers.signature(spark, p, typed=True)
            groups.setdefault((f, schema), []).append(p)
        except Exception:  # noqa: BLE001  reported to the caller by name
            bad.append(p)
    out = []
    for (f, _), own in groups.items():
        together = f.kind in ("parquet", "orc", "delimited") and len(own) > 1
        for batch in [own] if together else [[p] for p in own]:
            df = readers.read_group(spark, batch, f, typed=True)
            fields = [x for x in df.schema.fields if isinstance(x.dataType, BOUNDED)]
            bounds = [g(F.col(f"`{x.name}`")).alias(f"{n}:{x.name}") for x in fields for n, g in (("min", F.min), ("max", F.max))]
            if together:
                rows = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), *bounds).collect()
                by = {files.plain(r["path"]): r for r in rows}
            else:
                by = {batch[0]: df.agg(F.count("*").alias("rows"), *bounds).first()}
            for p in batch:
                r, i = by.get(files.plain(p)), files.info(spark, p)
                columns = {}
                for x in fields:
                    lo, hi = (r[f"{n}:{x.name}"] if r else None for n in ("min", "max"))
                    words = isinstance(x.dataType, T.StringType)
                    columns[x.name] = {"min": None if words else lo, "max": None if words else hi, "min_str": lo if words else None, "max_str": hi if words else None}
                n = r["rows"] if r else 0
                out.append({"rel_path": discovery_relative(p, base), "size_bytes": i.size, "mtime_ms": i.mtime_ms, "total_rows": n, "stats_json": json.dumps({"total_rows": n, "columns": columns})})
    return out, bad


def discovery_relative(path: str, base: str) -> str:
    base = files.plain(base).rstrip("/")
    return files.plain(path)[len(base) + 1 :]


def _save(spark: SparkSession, folder: str, entries: list[dict]) -> str:
    table = pa.Table.from_pylist(sorted(entries, key=lambda e: e["rel_path"]), schema=SCHEMA)
    sink = io.BytesIO()
    with pa.ipc.new_file(sink, SCHEMA) as w:
        w.write_table(table)
    path = f"{folder.rstrip('/')}/{MAP_NAME}"
    files.write_bytes(spark, path, sink.getvalue())
    return path


def _base(spark: SparkSession, folder: str) -> str:
    found = files.info(spark, folder)
    if found is None or not found.is_dir:
        raise LakeError(f"No such folder: {folder}")
    return found.path


def create_map(spark: SparkSession, folder: str) -> str:
    """Inspects every data file and writes the map; its path."""
    base = _base(spark, folder)
    entries, bad = _entries(spark, base, discovery.data_files(spark, folder))
    if bad:
        warnings.warn(f"not in the map, as they cannot be read: {', '.join(bad)}", stacklevel=2)
    return _save(spark, base, entries)


def load_map(spark: SparkSession, folder: str) -> list[dict]:
    path = f"{folder.rstrip('/')}/{MAP_NAME}"
    found = files.info(spark, path)
    if found is None:
        raise LakeError(f"no map in {folder}")
    return pa.ipc.open_file(pa.BufferReader(files.head(spark, path, found.size))).read_all().to_pylist()


def map_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The map as a DataFrame."""
    rows = [(e["rel_path"], e["size_bytes"], e["mtime_ms"], e["total_rows"], e["stats_json"]) for e in load_map(spark, folder)]
    return spark.createDataFrame(rows, "rel_path string, size_bytes long, mtime_ms long, total_rows long, stats_json string")


def totals(entries: DataFrame) -> DataFrame:
    """One row: total_files, total_rows, total_bytes."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return entries.agg(F.count("*").alias("total_files"), zero("total_rows").alias("total_rows"), zero("size_bytes").alias("total_bytes"))


def classify(disk: DataFrame, mapped: DataFrame) -> DataFrame:
    """rel_path and status (healthy, modified, missing, unindexed) of two listings
    (rel_path, size_bytes, mtime_ms); for lakes of any size."""
    d, m = disk.alias("d"), mapped.alias("m")
    same = (F.col("d.size_bytes") == F.col("m.size_bytes")) & (F.col("d.mtime_ms") == F.col("m.mtime_ms"))
    status = F.when(F.col("m.rel_path").isNull(), "unindexed").when(F.col("d.rel_path").isNull(), "missing").when(same, "healthy").otherwise("modified")
    return d.join(m, F.col("d.rel_path") == F.col("m.rel_path"), "full").select(F.coalesce("d.rel_path", "m.rel_path").alias("rel_path"), status.alias("status"))


def doctor(spark: SparkSession, folder: str, heal: bool = False) -> dict:
    """Compares map and folder; ``heal`` inspects what changed and writes the map anew."""
    base = _base(spark, folder)
    try:
        entries = {e["rel_path"]: e for e in load_map(spark, base)}
        had_map = True
    except LakeError:
        entries, had_map = {}, False
    disk = {discovery_relative(p, base): files.info(spark, p) for p in discovery.data_files(spark, folder)}
    listing = lambda rows: spark.createDataFrame(rows, "rel_path string, size_bytes long, mtime_ms long")
    found = classify(listing([(p, i.size, i.mtime_ms) for p, i in disk.items()]), listing([(p, e["size_bytes"], e["mtime_ms"]) for p, e in entries.items()])).collect()
    by: dict[str, list[str]] = {s: sorted(r["rel_path"] for r in found if r["status"] == s) for s in ("healthy", "modified", "missing", "unindexed")}
    drift = not had_map or any(by[s] for s in ("modified", "missing", "unindexed"))
    report = {"status": "DRIFT_DETECTED" if drift else "HEALTHY", "healthy_files": len(by["healthy"]), "modified_files": by["modified"], "missing_files": by["missing"], "unindexed_files": by["unindexed"], "unreadable_files": []}
    if drift and heal:
        fresh, bad = _entries(spark, base, [f"{base}/{p}" for p in by["modified"] + by["unindexed"]])
        _save(spark, base, [entries[p] for p in by["healthy"]] + fresh)
        report |= {"status": "HEALED", "unreadable_files": [discovery_relative(p, base) for p in bad]}
    return report


#: Bytes of a value by type name, for row widths (fixed values).
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "string": 32, "binary": 64}


def row_width(schema: T.StructType) -> int:
    """An estimate of a row's bytes."""
    def width(t: T.DataType) -> int:
        if isinstance(t, T.StructType):
            return sum(width(f.dataType) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return 4 * width(t.elementType)
        if isinstance(t, T.MapType):
            return 4 * (width(t.keyType) + width(t.valueType))
        return 16 if isinstance(t, T.DecimalType) else WIDTHS.get(t.simpleString(), 16)

    return max(1, sum(width(f.dataType) for f in schema.fields))


def recommend_batch_size(budget_bytes: int, threads: int, width: int) -> int:
    """Rows of a batch within a memory budget: between 64 and 2^20."""
    return max(64, min(1 << 20, int(budget_bytes / (max(1, threads) * 3.5) / max(1, width))))
