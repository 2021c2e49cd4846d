"""SQL whose FROM and JOIN name files and folders in quotes.

The text is read token by token; each quoted token that stands where a table stands
and names something that exists becomes a temporary view over a lazy scan. Other
literals stay as they are. Spark's own parser, optimiser and scans do the rest.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..errors import LakeError, QueryError
from ..functions import install
from ..functions.dialect import RENAMED
from ..operators import discovery
from ..session import settings
from ..sources import files, readers
from .rewrite import rewritten

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|[A-Za-z_][\w$]*)|(?P<other>.)""",
    re.S,
)
#: Words after which a table is named, and words that end a list of tables.
TABLES, OVER = ("from", "join"), frozenset("where group having order limit on using union intersect except select set window qualify lateral offset fetch".split())
#: Environment switch and folder of the copies of row formats.
CACHE, CACHE_FOLDER = "QUARRY_SQL_CACHE", ".quarry_cache"
QUERY = re.compile(r"\s*(?:\(|select\b|with\b|values\b|explain\b|describe\b|show\b|from\b|table\b)", re.I)


def tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m[0]) for m in TOKEN.finditer(text)]


def path_places(parts: list[tuple[str, str]]) -> list[int]:
    """Places of the string tokens that stand for tables."""
    out, depth, lists, before = [], 0, {}, ""
    for i, (kind, text) in enumerate(parts):
        if kind == "space":
            continue
        word = text.lower()
        if text == "(":
            depth += 1
        elif text == ")":
            lists.pop(depth, None)
            depth -= 1
        elif kind == "name" and word in TABLES:
            lists[depth] = True
        elif kind == "name" and word in OVER:
            lists[depth] = False
        elif kind == "string" and (before in TABLES or (before == "," and lists.get(depth))):
            out.append(i)
        before = word
    return out


def cached(spark: SparkSession, path: str) -> DataFrame:
    """A single file; with the switch CACHE on, a row format is first written as Parquet
    beside it, and again when the file is newer than its copy."""
    kind = readers.format_of(path, spark).kind
    if os.environ.get(CACHE, "").lower() not in ("1", "true") or kind in ("parquet", "orc"):
        return readers.read_file(spark, path, typed=True)
    folder, _, name = path.rpartition("/")
    copy = f"{folder or '.'}/{CACHE_FOLDER}/{name}.parquet"
    own, old = files.info(spark, path), files.info(spark, copy)
    if old is None or old.mtime_ms < own.mtime_ms:
        stage = f"{copy}.{uuid.uuid4().hex}"
        readers.read_file(spark, path, typed=True).write.option("compression", "zstd").parquet(stage)
        files.move(spark, stage, copy)
    return spark.read.parquet(copy)


def bind(spark: SparkSession, query: str) -> tuple[str, list[str]]:
    """The text with views for paths, and the views' names."""
    parts = tokens(query)
    views: dict[str, str] = {}
    for i in path_places(parts):
        path = parts[i][1][1:-1].replace("''", "'")
        if path not in views:
            found = files.info(spark, path)
            if found is None:
                raise QueryError(f"No such file or folder: {path}")
            df = readers.read_files(spark, discovery.data_files(spark, path), typed=True) if found.is_dir else cached(spark, path)
            views[path] = f"quarry_{uuid.uuid4().hex[:12]}"
            df.createOrReplaceTempView(views[path])
        parts[i] = ("name", views[path])
    out = []
    for i, (kind, text) in enumerate(parts):
        rest = next((t for k, t in parts[i + 1 :] if k != "space"), "")
        out.append(RENAMED.get(text.lower(), text) if kind == "name" and rest == "(" else text)
    return "".join(out), list(views.values())


def query(spark: SparkSession, text: str) -> DataFrame:
    """The lazy result of a query; other statements are refused."""
    if not QUERY.match(re.sub(r"\A(?:\s|--[^\n]*\n|/\*.*?\*/)+", "", text, flags=re.S)):
        raise QueryError("only queries run here; views, copies and changes of tables do not")
    try:
        install(spark)
        bound, views = bind(spark, text)
        try:
            with settings(spark, spark__sql__ansi__doubleQuotedIdentifiers="true"):
                return spark.sql(rewritten(bound.rstrip().rstrip(";"), tokens))
        finally:  # the plan holds what the views named
            for view in views:
                spark.catalog.dropTempView(view)
    except (PySparkException, LakeError, ValueError) as e:
        raise QueryError(str(e)) from e


def collect(df: DataFrame) -> pa.Table:
    try:
        return df.toArrow()
    except PySparkException as e:
        raise QueryError(str(e)) from e


def execute(spark: SparkSession, text: str, error_on_empty: bool = True) -> pa.Table:
    """The whole result; without rows an error, unless asked otherwise."""
    out = collect(query(spark, text))
    if error_on_empty and not out.num_rows:
        raise QueryError("Query returned 0 rows")
    return out


class BatchIterator:
    """Record batches of a lazy result, one after another, each partition when it is
    its turn; ``to_pyarrow`` takes what is left."""

    def __init__(self, df: DataFrame, rows: int = 1 << 16):
        self.df, self.size, self.batches, self.rows = df, rows, 0, 0
        self._rows: Iterator | None = None

    def __iter__(self) -> BatchIterator:
        return self

    def _schema(self) -> pa.Schema:
        return self.df.limit(0).toArrow().schema

    def __next__(self) -> pa.RecordBatch:
        if self._rows is None:
            self._schema_, self._rows = self._schema(), self.df.toLocalIterator(prefetchPartitions=True)
        held = []
        for r in self._rows:
            held.append(r.asDict(recursive=True))
            if len(held) == self.size:
                break
        if not held:
            raise StopIteration
        self.batches += 1
        self.rows += len(held)
        return pa.RecordBatch.from_pylist(held, schema=self._schema_)

    def to_pyarrow(self) -> pa.Table:
        found = list(self)
        return pa.Table.from_batches(found, schema=self._schema_)

    def __repr__(self) -> str:
        return f"BatchIterator(batches={self.batches}, rows={self.rows})"


def stream(spark: SparkSession, text: str) -> BatchIterator:
    return BatchIterator(query(spark, text))


def union_aligned(parts: list[DataFrame]) -> DataFrame:
    """By name, what is missing null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
