"""Writers that keep a lake's layout: clean and trash, gold, split parts, ingest.

Each file of the result is staged as Spark writes it and then moved to its place.
Files are handled by a bounded pool of driver threads, each starting a lazy Spark
job, so that many small files share the cluster and a large one still runs in
parallel: with ``parts`` over 1 a file becomes a folder of parts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LakeError, UnsupportedFormat
from ..sources import files, readers, registry
from . import audit, csvguard, discovery
from .rules import Rule, parse_rules

#: Files handled at once.
THREADS = 8
#: Row formats that ingest turns into Parquet (fixed values).
ROW_FORMATS = frozenset("csv tsv psv txt json jsonl ndjson msgpack xlsx".split())
MANIFEST = "_gold_metadata.json"


def _each(work: Callable, items: Sequence) -> list:
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(work, items))


def relative(path: str, base: str) -> str:
    base = files.plain(base).rstrip("/")
    return path[len(base) + 1 :] if path.startswith(base + "/") else path.rpartition("/")[2]


def write_file(spark: SparkSession, df: DataFrame, target: str, kind: str = "parquet", parts: int = 1) -> None:
    """Writes ``df`` as one file (or, with ``parts`` > 1, a folder of parts)."""
    stage = f"{target.rpartition('/')[0] or '.'}/.stage-{uuid.uuid4().hex}"
    out = (csvguard.guard(df) if kind == "csv" else df).coalesce(parts).write
    try:
        out.option("header", True).csv(stage) if kind == "csv" else out.option("compression", "zstd").parquet(stage)
        made = [c.path for c in files.children(spark, stage) if c.path.rpartition("/")[2].startswith("part-")]
        if parts == 1:
            files.move(spark, made[0], target)
        else:
            files.delete(spark, target)
            files.move(spark, stage, target)
    finally:
        files.delete(spark, stage)


def _inside(spark: SparkSession, folder: str) -> str:
    found = files.info(spark, folder)
    if found is None or not found.is_dir:
        raise LakeError(f"No such folder: {folder}")
    return found.path


def write_clean_and_trash(spark: SparkSession, source: str, clean: str, trash: str, part: str | None = None, thresholds: audit.Thresholds = audit.Thresholds(), skip_unreadable: bool = False) -> tuple[int, int, int, int]:  # noqa: B008
    """Audits every Parquet file and mirrors its clean and trash rows at the same
    relative paths; a side without rows has no file. (files, total, clean, trash)."""
    base = _inside(spark, source)
    paths = discovery.data_files(spark, source, part)

    def one(path: str) -> tuple[int, int, int]:
        if registry.known(path).kind != "parquet":
            return 0, 0, 0
        try:
            flagged = audit.flag_static(readers.read_file(spark, path), thresholds)
            total, good, bad = audit.counts(flagged)
            for n, df, folder in zip((good, bad), audit.split(flagged), (clean, trash), strict=True):
                if n:
                    write_file(spark, df, f"{folder}/{relative(path, base)}")
        except Exception:
            if skip_unreadable:
                return 0, 0, 0
            raise
        return total, good, bad

    sums = [sum(x) for x in zip(*_each(one, paths), strict=True)] or [0, 0, 0]
    return len(paths), *sums


def write_gold(spark: SparkSession, source: str, gold: str, version: str, part: str | None = None, thresholds: audit.Thresholds = audit.Thresholds()) -> tuple[int, int, str]:  # noqa: B008
    """Clean rows of every Parquet file, mirrored, and a manifest beside them."""
    base = _inside(spark, source)
    paths = [p for p in discovery.data_files(spark, source, part) if registry.known(p).kind == "parquet"]

    def one(path: str) -> int:
        flagged = audit.flag_static(readers.read_file(spark, path), thresholds)
        n = audit.counts(flagged)[1]
        if n:
            write_file(spark, audit.split(flagged)[0], f"{gold}/{relative(path, base)}")
        return n

    rows = sum(_each(one, paths))
    manifest = {"table_name": "clean_gold_table", "version": version, "created_at_epoch": int(time.time()), "total_files": len(paths), "total_gold_rows": rows, "engine": "quarrylake"}
    path = f"{gold.rstrip('/')}/{MANIFEST}"
    files.write_bytes(spark, path, json.dumps(manifest, indent=2).encode())
    return len(paths), rows, path


def part_numbers(df: DataFrame, rows: int, order: str = "__row") -> DataFrame:
    """``part`` = row number div ``rows``; for Parquet from the file's own numbering."""
    return df.withColumn("part", F.expr(f"{order} div {rows}"))


def split_file(spark: SparkSession, path: str, rows: int, folder: str, kind: str = "parquet") -> int:
    """Parts of ``rows`` rows in file order, numbered from 001, the last one with the rest."""
    if rows < 1:
        raise ValueError("max_rows_per_file must be 1 or more")
    if kind not in ("parquet", "pq", "csv"):
        raise UnsupportedFormat(f"Unsupported output format: {kind}")
    if registry.known(path) is None:
        raise UnsupportedFormat(f"Unsupported format: {path}")
    df = readers.read_file(spark, path)
    row, part = (f"{name}_{uuid.uuid4().hex}" for name in ("row", "part"))  # no column of the file can clash
    if registry.known(path).kind == "parquet":
        numbered = df.select("*", F.col("_metadata.row_index").alias(row))
    else:
        numbered = df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(df.schema.add(row, "long"))
    numbered = numbered.withColumn(part, F.expr(f"{row} div {rows}"))
    stem = path.rpartition("/")[2].rpartition(".")[0]
    parts = [r[0] for r in numbered.select(part).distinct().orderBy(part).collect()]
    stage = f"{folder}/.stage-{uuid.uuid4().hex}"
    # One shuffle deals the parts out; each is sorted by its rows' numbers and written whole.
    dealt = numbered.repartition(max(1, len(parts)), part).sortWithinPartitions(part, row).drop(row)
    out = csvguard.guard(dealt) if kind == "csv" else dealt  # numbers are left as they are
    written = out.write.option("maxRecordsPerFile", 0).partitionBy(part)
    try:
        written.option("header", True).csv(stage) if kind == "csv" else written.option("compression", "zstd").parquet(stage)
        for p in parts:
            found = [c.path for c in files.children(spark, f"{stage}/{part}={p}") if c.path.rpartition("/")[2].startswith("part-")]
            files.move(spark, found[0], f"{folder}/{stem}_part_{p + 1:03d}.{kind}")
    finally:
        files.delete(spark, stage)
    return len(parts)


def _alike(spark: SparkSession, paths: Sequence[str], base: str) -> dict[str, DataFrame]:
    """The files' rows. Files of one table (folder without its ``key=value`` levels,
    format, column names) whose inferred types differ, as those of a part without rows
    do, are all read with the types that their rows have together."""
    frames = dict(zip(paths, _each(lambda p: readers.read_file(spark, p), paths), strict=True))
    tables: dict[tuple, list[str]] = {}
    for p, df in frames.items():
        f = readers.format_of(p, spark)
        if f.kind in ("delimited", "json") and df.columns:
            folder = tuple(takewhile(lambda level: "=" not in level, relative(p, base).split("/")[:-1]))
            tables.setdefault((folder, f, tuple(df.columns)), []).append(p)
    for (_, f, _), own in tables.items():
        if len({frames[p].schema.json() for p in own}) > 1:
            schema = readers.read_group(spark, own, f).schema
            frames |= {p: readers.read_group(spark, [p], f, schema=schema) for p in own}
    return frames


def ingest(spark: SparkSession, source: str, target: str, normalize: bool = False) -> tuple[int, int]:
    """Copies a lake; with ``normalize`` row formats become Parquet, files of one table
    with the same types. (files, rows); copied files count no rows."""
    base = _inside(spark, source)
    paths = discovery.data_files(spark, source)
    names: dict[str, str] = {}
    taken = {relative(p, base) for p in paths if not (normalize and registry.extension(p) in ROW_FORMATS)}
    for p in paths:
        name = relative(p, base)
        if normalize and registry.extension(p) in ROW_FORMATS:
            stem = name.rpartition(".")[0] + ".parquet"
            name = stem if stem not in taken else name + ".parquet"
            taken.add(name)
        names[p] = name
    frames = _alike(spark, [p for p in paths if normalize and registry.extension(p) in ROW_FORMATS], base)

    def one(path: str) -> int:
        goal = f"{target}/{names[path]}"
        if path not in frames:
            files.copy(spark, path, goal)
            return 0
        df = frames[path]
        if not df.columns:
            return 0
        write_file(spark, df, goal)
        return spark.read.parquet(goal).count()

    return len(paths), sum(_each(one, paths))


def filter_files(spark: SparkSession, path: str, rules: Sequence[str | Rule] = (), part: str | None = None) -> dict[str, int]:
    """Audits all files of a path, each under its own schema: files that share format
    and schema are one scan. Counts only."""
    own = parse_rules(rules)
    found = discovery.targets(spark, path, own, part)
    if not found.files and not found.pruned:
        raise LakeError(f"no data files in {path}")
    groups: dict[tuple, list[str]] = {}
    for p in found.files:
        f, schema = readers.signature(spark, p)
        groups.setdefault((f, schema), []).append(p)
    sums = [audit.counts(audit.flag_rules(readers.read_group(spark, p, f), own)) for (f, _), p in groups.items()]
    total, clean, trash = (sum(x) for x in zip(*sums, strict=True)) if sums else (0, 0, 0)
    return {"total_files": len(found.files), "pruned_dirs": found.pruned, "total_rows": total, "clean_rows": clean, "trash_rows": trash}
