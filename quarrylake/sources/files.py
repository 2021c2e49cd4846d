"""Files through Hadoop's file systems, so that local and remote lakes look alike."""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileInfo:
    path: str
    size: int
    mtime_ms: int
    is_dir: bool


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def plain(path: str) -> str:
    """A local path without its scheme; other paths as they are."""
    url = urlparse(path)
    return unquote(url.path) if url.scheme == "file" else path


def is_link(path: str) -> bool:
    return os.path.islink(plain(path))


def hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out too."""
    return name.startswith((".", "_"))


def info(spark: SparkSession, path: str) -> FileInfo | None:
    p, fs = _open(spark, path)
    if not fs.exists(p):
        return None
    s = fs.getFileStatus(p)
    return FileInfo(plain(s.getPath().toString()), s.getLen(), s.getModificationTime(), s.isDirectory())


def children(spark: SparkSession, path: str) -> list[FileInfo]:
    """What a folder holds, sorted by path, without links."""
    p, fs = _open(spark, path)
    found = (FileInfo(plain(s.getPath().toString()), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in fs.listStatus(p))
    return sorted((f for f in found if not is_link(f.path)), key=lambda f: f.path)


def head(spark: SparkSession, path: str, size: int = 512) -> bytes:
    p, fs = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def make_dirs(spark: SparkSession, path: str) -> None:
    p, fs = _open(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _open(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames, in place of a file that may be there."""
    s, fs = _open(spark, source)
    t = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(t.getParent())
    if fs.exists(t):
        fs.delete(t, True)
    if not fs.rename(s, t):
        raise OSError(f"cannot move {source} to {target}")


def copy(spark: SparkSession, source: str, target: str) -> None:
    s, fs = _open(spark, source)
    t, other = _open(spark, target)
    other.mkdirs(t.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, s, other, t, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    p, fs = _open(spark, path)
    fs.mkdirs(p.getParent())
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
