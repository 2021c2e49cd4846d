"""Formats by file extension, own delimited formats, and recognition by content."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnsupportedFormat

Reader = Callable[[SparkSession, list[str]], DataFrame]


@dataclass(frozen=True)
class Format:
    """How a kind of file is read. ``text``: every column is a string."""

    kind: str
    delimiter: str = ","
    header: bool = True
    text: bool = False
    reader: Reader | None = None


#: The built-in formats (fixed values).
BUILT_IN: dict[str, Format] = {
    "parquet": Format("parquet"),
    "pq": Format("parquet"),
    "feather": Format("arrow"),
    "arrow": Format("arrow"),
    "ipc": Format("arrow"),
    "csv": Format("delimited"),
    "tsv": Format("delimited", "\t", text=True),
    "psv": Format("delimited", "|"),
    "txt": Format("delimited", ";"),
    "json": Format("json"),
    "jsonl": Format("json"),
    "ndjson": Format("json"),
    "xlsx": Format("xlsx"),
    "avro": Format("avro"),
    "orc": Format("orc"),
    "msgpack": Format("msgpack"),
}
#: Leading bytes by format, in the order in which they are tried (fixed values).
MAGIC = ((b"PAR1", "parquet"), (b"ARROW1", "arrow"), (b"PK\x03\x04", "xlsx"), (b"Obj\x01", "avro"), (b"ORC", "orc"))
#: Delimiters by format, in the order in which they are looked for in the first line.
DELIMITERS = ((b"\t", "tsv"), (b"|", "psv"), (b";", "txt"), (b",", "csv"))

_own: dict[str, Format] = {}
_lock = threading.Lock()


def register_delimited(extension: str, delimiter: str = ",", has_header: bool = True) -> None:
    """Own delimited files; the delimiter's first character counts."""
    with _lock:
        _own[extension.lower().lstrip(".")] = Format("delimited", delimiter[:1] or ",", has_header)


def register_reader(extension: str, reader: Reader) -> None:
    """Own files: ``reader`` gets the session and paths and returns a DataFrame."""
    with _lock:
        _own[extension.lower().lstrip(".")] = Format("own", reader=reader)


def unregister_format(extension: str) -> bool:
    with _lock:
        return _own.pop(extension.lower().lstrip("."), None) is not None


def list_formats() -> list[str]:
    with _lock:
        return sorted({*BUILT_IN, *_own})


def extension(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def known(path: str) -> Format | None:
    """The format by extension; own formats come first."""
    with _lock:
        return _own.get(extension(path)) or BUILT_IN.get(extension(path))


def sniff(first: bytes) -> str | None:
    """The format's extension by a file's first bytes."""
    for magic, name in MAGIC:
        if first.startswith(magic):
            return name
    if first and (0x80 <= first[0] <= 0x8F or first[0] in (0xDE, 0xDF)):
        return "msgpack"
    text = first.lstrip()
    if text.startswith(b"["):
        return "json"
    if text.startswith(b"{"):
        return "ndjson"
    line = text.split(b"\n", 1)[0]
    return next((name for mark, name in DELIMITERS if mark in line), None)


def resolve(path: str, first: Callable[[], bytes]) -> Format:
    """By extension, else by content."""
    found = known(path)
    if found is None and (name := sniff(first())):
        found = BUILT_IN[name]
    if found is None:
        raise UnsupportedFormat(f"Unsupported format: {path}")
    return found
