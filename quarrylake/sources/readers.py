"""Lazy DataFrames from files of any registered format."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..errors import LakeError
from . import decoders, files, registry
from .registry import Format

#: Kinds that Spark's own readers split over tasks.
NATIVE = ("parquet", "orc", "delimited", "json")
#: Decoder functions by kind.
DECODERS = {"avro": (decoders.avro_schema, decoders.avro_rows), "msgpack": (decoders.msgpack_schema, decoders.msgpack_rows), "xlsx": (decoders.xlsx_schema, decoders.xlsx_rows), "arrow": (decoders.arrow_schema, None)}
#: Rows of a record batch that a decoder yields.
BATCH = 8_192
_hinted: set[str] = set()


def format_of(path: str, spark: SparkSession | None = None) -> Format:
    """The path's format; unknown extensions are recognised by content."""
    return registry.resolve(path, lambda: files.head(spark or SparkSession.active(), path))


def widened(df: DataFrame) -> DataFrame:
    """Inferred integers as 64-bit ones, so that all files agree."""
    return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _delimited(spark: SparkSession, paths: list[str], f: Format, typed: bool, known: T.StructType | None = None) -> DataFrame:
    read = spark.read.option("sep", f.delimiter).option("header", f.header).option("quote", '"').option("escape", '"')
    if known:
        return read.schema(known).csv(paths)
    if f.text and not typed:
        probe = read.csv(paths[0])  # names only; no pass over the data
        names = [c if f.header else f"column_{i + 1}" for i, c in enumerate(probe.columns)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return spark.read.option("sep", f.delimiter).option("header", f.header).option("nullValue", "\\N").schema(schema).csv(paths) if names else probe
    df = widened(read.option("inferSchema", True).csv(paths))
    return df if f.header else df.toDF(*[f"column_{i + 1}" for i in range(len(df.columns))])


def _lines_hold_json(first: bytes) -> bool:
    """Whether a file holds one JSON value a line: its first line is one."""
    line = first.lstrip().split(b"\n", 1)[0].strip()
    try:
        json.loads(line)
        return True
    except ValueError:
        return not line or (not first.lstrip().startswith(b"[") and b"\n" not in first)


def _json(spark: SparkSession, paths: list[str], known: T.StructType | None = None) -> DataFrame:
    by = {True: [], False: []}
    for p in paths:
        by[_lines_hold_json(files.head(spark, p, 1 << 16))].append(p)
    parts = [spark.read.option("multiLine", not lines).json(own, schema=known) for lines, own in by.items() if own]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _decoded(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    schema_of, rows_of = DECODERS[kind]
    size = files.info(spark, paths[0]).size
    want = schema_of(files.head(spark, paths[0], size if kind in ("xlsx", "arrow") else min(size, 1 << 22)))
    schema = from_arrow_schema(want)
    if not len(want):
        return spark.createDataFrame([], schema)

    def text(v):
        return v if isinstance(v, str) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                if rows_of is None:
                    yield from decoders.arrow_batches(content.as_py())
                    continue
                held: list[dict] = []
                for row in rows_of(content.as_py()):
                    held.append({f.name: text(row.get(f.name)) if f.type == pa.string() else row.get(f.name) for f in want})
                    if len(held) == BATCH:
                        yield _batch(held, want)
                        held = []
                if held:
                    yield _batch(held, want)

    content = spark.read.format("binaryFile").load(paths).select("content")
    return content.repartition(len(paths)).mapInArrow(run, schema) if len(paths) > 1 else content.mapInArrow(run, schema)


def _batch(rows: list[dict], want: pa.Schema) -> pa.RecordBatch:
    def column(f: pa.Field) -> pa.Array:
        values = [r[f.name] for r in rows]
        try:
            return pa.array(values, f.type)
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError):  # a later row of another type
            good = {pa.int64(): int, pa.int32(): int, pa.float64(): float, pa.float32(): float, pa.bool_(): bool}[f.type]
            return pa.array([v if type(v) is good else None for v in values], f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in want], schema=want)


def read_group(spark: SparkSession, paths: Sequence[str], f: Format, typed: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Files of one format and schema as one DataFrame. ``typed``: also formats whose
    columns are strings by contract get inferred types, as SQL over paths has them.
    ``schema``: known types of delimited files and JSON, in place of inferred ones."""
    paths = list(paths)
    if f.kind == "own":
        return f.reader(spark, paths)
    if f.kind == "parquet":
        return spark.read.option("recursiveFileLookup", True).parquet(*paths)
    if f.kind == "orc":
        return spark.read.option("recursiveFileLookup", True).orc(paths)
    if f.kind not in _hinted:
        _hinted.add(f.kind)
        warnings.warn(f"{f.kind} files are read slower than Parquet; consider lake.ingest(auto_normalize=True)", stacklevel=2)
    if f.kind == "delimited":
        return _delimited(spark, paths, f, typed, schema)
    if f.kind == "json":
        return _json(spark, paths, schema)
    return _decoded(spark, paths, f.kind)


def read_file(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """One file, by extension or content."""
    if files.info(spark, path) is None:
        raise LakeError(f"No such file: {path}")
    return read_group(spark, [path], format_of(path, spark), typed)


def signature(spark: SparkSession, path: str, typed: bool = False) -> tuple[Format, str]:
    """What files must share to be read together: format and schema."""
    f = format_of(path, spark)
    return f, read_group(spark, [path], f, typed).schema.json()


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """By name, in first-seen order; what a part lacks is null. Numbers of different
    width meet in the wider type."""
    order = list(dict.fromkeys(c for p in parts for c in p.columns))
    kinds: dict[str, set] = {c: {p.schema[c].dataType for p in parts if c in p.columns} for c in order}
    for c, k in kinds.items():
        if len(k) > 1 and not all(isinstance(t, T.NumericType) for t in k):
            raise LakeError(f"column {c!r} has types that do not meet: {', '.join(sorted(t.simpleString() for t in k))}")
    wide = lambda k: T.DoubleType() if any(isinstance(t, T.FractionalType) for t in k) else T.LongType()
    cast = [p.select(*[F.col(f"`{c}`").cast(wide(kinds[c])).alias(c) if len(kinds[c]) > 1 else F.col(f"`{c}`") for c in p.columns]) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast).select(*[f"`{c}`" for c in order])


def read_files(spark: SparkSession, paths: Sequence[str], typed: bool = False) -> DataFrame:
    """Any files together: each group of one format is one scan, then by name."""
    if not paths:
        raise LakeError("no data files")
    groups: dict[Format, list[str]] = {}
    for p in paths:
        groups.setdefault(format_of(p, spark), []).append(p)
    parts = []
    for f, own in groups.items():
        if f.kind in NATIVE and f.kind != "parquet" or len(own) == 1:
            parts.append(read_group(spark, own, f, typed))
            continue
        by: dict[str, list[str]] = {}
        for p in own:
            by.setdefault(signature(spark, p, typed)[1], []).append(p)
        parts += [read_group(spark, x, f, typed) for x in by.values()]
    return union(parts)
