"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words everywhere in this subpackage (ASCII only).
BLANKS = r"\x20\x09-\x0D"

#: Bytes up to which a written side may be broadcast.
BROADCAST_BYTES = 24 << 20
#: Written bytes of a table that is that small however it unfolds.
SURELY_SMALL = 1 << 20
#: Bytes of an Arrow batch that a Python worker gets, where the session says nothing.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is
    unset a temporary folder will do on one machine only; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def trim() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; afterwards the memory that they needed goes back to the system, so
    that a Python worker that Spark reuses holds no more than a new one."""
    try:
        yield from batches
    finally:
        trim()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    Cuts the lineage so that a lost executor costs a re-read, not a recomputation
    of everything before, and gives later joins exact sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # Read once or twice and mostly hashes: speed over size, no dictionaries.
    df.write.option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _files(t: DataFrame):
    """A *materialized* table's file system and folder."""
    jvm = t.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(t._written_to)
    return path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()), path


def discard(*tables: DataFrame | None) -> None:
    """Deletes *materialized* tables that nothing will read again."""
    for t in tables:
        if t is not None and hasattr(t, "_written_to"):
            fs, path = _files(t)
            fs.delete(path, True)


def row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row in memory, from what its columns hold."""

    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.StructType):
            return sum((width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
                return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + width(x, kind.elementType)), F.lit(16))
            each = 16 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
            return F.greatest(F.size(c), F.lit(0)) * each + 16
        return F.lit(8)

    return sum((width(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(16)).cast("long")


def small(df: DataFrame, max_bytes: int) -> bool:
    """Whether the counted bytes of the rows of a *materialized* table, or of a few of
    them, are within ``max_bytes``."""
    if hasattr(df, "_written_to") and _files(df)[0].getContentSummary(_files(df)[1]).getLength() <= min(SURELY_SMALL, max_bytes // 16):
        return True
    return (df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0) <= max_bytes


def small_enough(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a *materialized* side for broadcast only when its rows' counted bytes are
    within ``max_bytes``; beyond that the planner is left to shuffle."""
    return F.broadcast(df) if small(df, max_bytes) else df


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, for whole texts; a session that sets a bound of
    its own keeps it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, f"{64 << 20}b"):  # unset, or this Spark's default
        spark.conf.set(name, BATCH_BYTES)


def seeded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows of a *materialized* table, spread over all of it: those of
    the least seeded hashes of ``key``. A first cut by the hash leaves little more
    than that many rows to be sorted, whatever the table's size."""
    total = max(df.count(), 1)
    place = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    cut = int(min(1.0, (1.1 * rows + 100) / total) * (1 << 40))
    return df.where(place <= cut).orderBy(place, key).limit(rows)


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def has_text(column: str, schema: T.StructType) -> Column:
    """The text column as a string, null-safe when the table has none."""
    return F.col(column).cast("string") if column in schema.names else F.lit(None).cast("string")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only, as the word contracts ask."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 4 << 20, max_rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of a few MB of text, whatever its rows hold; a longer text is
    a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at] - sizes[at]) + max_bytes, side="right"))
        to = min(max(to, at + 1), at + max_rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words per text, each word's place in the list of distinct words, and that list.

    Works on whole Arrow buffers; splits at the blanks above and nowhere else, whatever
    the process's locale, and lower-cases A-Z only.
    """
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    if lower and texts.buffers()[2]:
        raw = np.frombuffer(texts.buffers()[2], np.uint8).copy()
        raw[(raw >= 65) & (raw <= 90)] += 32
        texts = pa.Array.from_buffers(texts.type, len(texts), [texts.buffers()[0], texts.buffers()[1], pa.py_buffer(raw)], offset=texts.offset)
    for blank in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, blank, " ")
    lists = pc.split_pattern(texts, " ")
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:  # beside a leading, trailing or second blank
        real = index != words.index("")
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[real], minlength=len(lengths)).astype(np.int64)
        index = index[real]
    return lengths, index, words
