"""Decoders of the formats that Spark does not ship: Avro, MessagePack, XLSX, Arrow.

Each gives a schema from a file's bytes, and rows (or record batches) from them. They
run on executors, a file a task, over the content that Spark's binary reader brings.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa

from ..errors import LakeError

# --- Avro object containers -------------------------------------------------

#: Avro types by Arrow type; every other one is read as a string (fixed values).
AVRO_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string()}


class AvroFile:
    """An object container: null, deflate or zstandard blocks of records."""

    def __init__(self, data: bytes):
        self.b, self.at = data, 4
        if data[:4] != b"Obj\x01":
            raise LakeError("not an Avro file")
        meta: dict[str, bytes] = {}
        while n := self._long():
            if n < 0:
                n, _ = -n, self._long()
            for _ in range(n):
                key = self._bytes().decode()
                meta[key] = self._bytes()
        self.schema = json.loads(meta["avro.schema"])
        self.codec = meta.get("avro.codec", b"null").decode()
        self.mark = self._take(16)
        self.names: dict[str, object] = {}

    def _take(self, n: int) -> bytes:
        out = self.b[self.at : self.at + n]
        if len(out) < n:
            raise LakeError("the Avro file ends early")
        self.at += n
        return out

    def _long(self) -> int:
        shift = value = 0
        while True:
            c = self.b[self.at]
            self.at += 1
            value |= (c & 127) << shift
            if c < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def _bytes(self) -> bytes:
        return self._take(self._long())

    def arrow_schema(self) -> pa.Schema:
        return pa.schema([(f["name"], self._arrow(f["type"])) for f in self.schema["fields"]])

    @staticmethod
    def _arrow(kind) -> pa.DataType:
        if isinstance(kind, dict) and isinstance(kind["type"], str) and kind["type"] in AVRO_TYPES:
            kind = kind["type"]
        if isinstance(kind, list):  # a nullable type is the type itself
            rest = [k for k in kind if k != "null"]
            kind = rest[0] if len(rest) == 1 else "string"
        return AVRO_TYPES.get(kind, pa.string()) if isinstance(kind, str) else pa.string()

    def _value(self, kind):
        if isinstance(kind, list):
            return self._value(kind[self._long()])
        if isinstance(kind, dict):
            name = kind.get("name")
            if name:
                self.names[name] = kind
            t = kind["type"]
            if t == "record":
                return {f["name"]: self._value(f["type"]) for f in kind["fields"]}
            if t == "enum":
                return kind["symbols"][self._long()]
            if t == "fixed":
                return self._take(kind["size"])
            if t in ("array", "map"):
                out: list = []
                while n := self._long():
                    if n < 0:
                        n, _ = -n, self._long()
                    for _ in range(n):
                        key = self._bytes().decode() if t == "map" else None
                        item = self._value(kind["items" if t == "array" else "values"])
                        out.append((key, item) if t == "map" else item)
                return dict(out) if t == "map" else out
            return self._value(t)
        if kind in ("long", "int"):
            return self._long()
        if kind == "string":
            return self._bytes().decode("utf-8", "replace")
        if kind == "bytes":
            return self._bytes()
        if kind == "null":
            return None
        if kind == "boolean":
            return self._take(1) == b"\x01"
        if kind in ("double", "float"):
            return struct.unpack("<d" if kind == "double" else "<f", self._take(8 if kind == "double" else 4))[0]
        return self._value(self.names[kind])

    def rows(self) -> Iterator[dict]:
        whole = self.b
        while self.at < len(whole):
            n, body = self._long(), self._bytes()
            mark, resume = self._take(16), self.at
            if mark != self.mark:
                raise LakeError("a block of the Avro file is damaged")
            if self.codec == "deflate":
                body = zlib.decompress(body, -15)
            elif self.codec == "zstandard":
                import zstandard

                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif self.codec != "null":
                raise LakeError(f"Avro codec {self.codec} is not supported")
            self.b, self.at = body, 0
            for _ in range(n):
                yield self._value(self.schema)
            self.b, self.at = whole, resume


def avro_schema(data: bytes) -> pa.Schema:
    return AvroFile(data).arrow_schema()


def avro_rows(data: bytes) -> Iterator[dict]:
    return AvroFile(data).rows()


# --- MessagePack --------------------------------------------------------------


class _End(Exception):
    pass


def _unpack(b: bytes, at: int):
    """A value and where it ends."""

    def number(code: str, size: int):
        if at + 1 + size > len(b):
            raise _End
        return struct.unpack_from(">" + code, b, at + 1)[0], at + 1 + size

    def raw(start: int, n: int) -> tuple[bytes, int]:
        if start + n > len(b):
            raise _End
        return b[start : start + n], start + n

    def items(start: int, n: int) -> tuple[list, int]:
        out = []
        for _ in range(n):
            v, start = _unpack(b, start)
            out.append(v)
        return out, start

    def pairs(start: int, n: int) -> tuple[dict, int]:
        flat, end = items(start, 2 * n)
        return {k if isinstance(k, str) else str(k): v for k, v in zip(flat[::2], flat[1::2], strict=True)}, end

    if at >= len(b):
        raise _End
    c = b[at]
    if c < 0x80:
        return c, at + 1
    if c >= 0xE0:
        return c - 256, at + 1
    if c < 0x90:
        return pairs(at + 1, c & 15)
    if c < 0xA0:
        return items(at + 1, c & 15)
    if c < 0xC0:
        data, end = raw(at + 1, c & 31)
        return data.decode("utf-8", "replace"), end
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], at + 1
    if 0xC4 <= c <= 0xC6 or 0xD9 <= c <= 0xDB:
        n, start = number("BHI"[(c - 0xC4) if c < 0xD0 else c - 0xD9], 1 << ((c - 0xC4) if c < 0xD0 else c - 0xD9))
        data, end = raw(start, n)
        return (data if c < 0xD0 else data.decode("utf-8", "replace")), end
    if 0xC7 <= c <= 0xC9:
        n, start = number("BHI"[c - 0xC7], 1 << (c - 0xC7))
        return raw(start, n + 1)
    if 0xD4 <= c <= 0xD8:
        return raw(at + 1, 1 + (1 << (c - 0xD4)))
    if c in (0xCA, 0xCB):
        return number("f" if c == 0xCA else "d", 4 if c == 0xCA else 8)
    if 0xCC <= c <= 0xD3:
        return number("BHIQbhiq"[c - 0xCC], 1 << (c - 0xCC) % 4)
    if c in (0xDC, 0xDD):
        n, start = number("H" if c == 0xDC else "I", 2 if c == 0xDC else 4)
        return items(start, n)
    if c in (0xDE, 0xDF):
        n, start = number("H" if c == 0xDE else "I", 2 if c == 0xDE else 4)
        return pairs(start, n)
    raise _End


def msgpack_values(data: bytes) -> Iterator[object]:
    """Concatenated values from the first map on; what cannot be read ends the file."""
    at, met = 0, False
    while True:
        try:
            value, at = _unpack(data, at)
        except (_End, RecursionError):
            return
        met |= isinstance(value, dict)
        if met:
            yield value


def msgpack_schema(data: bytes) -> pa.Schema:
    first = next(msgpack_values(data), {})
    kind = lambda v: pa.bool_() if isinstance(v, bool) else pa.int64() if isinstance(v, int) else pa.float64() if isinstance(v, float) else pa.string()
    return pa.schema([(k, kind(v)) for k, v in first.items()])


def msgpack_rows(data: bytes) -> Iterator[dict]:
    return (v if isinstance(v, dict) else {} for v in msgpack_values(data))


# --- XLSX ---------------------------------------------------------------------

#: Namespaces of workbook parts (fixed values).
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xlsx_cells(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet, as strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{SHEET}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        first = book.find(f"{SHEET}sheets/{SHEET}sheet")
        if first is None:
            return
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[first.get(f"{LINK}id")]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{SHEET}row":
                    continue
                out: list[str | None] = []
                for cell in row.findall(f"{SHEET}c"):
                    letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                    place = len(out)
                    if letters:
                        place = 0
                        for c in letters:
                            place = place * 26 + ord(c) - 64
                        place -= 1
                    out += [None] * (place - len(out))
                    out.append(_xlsx_text(cell, shared))
                yield out
                row.clear()


def _xlsx_text(cell, shared: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t")) or None
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)] or None
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind in ("str", "e"):
        return value.text
    number = float(value.text)
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)


def xlsx_schema(data: bytes) -> pa.Schema:
    names = next(_xlsx_cells(data), [])
    return pa.schema([(n if n is not None else f"column_{i + 1}", pa.string()) for i, n in enumerate(names)])


def xlsx_rows(data: bytes) -> Iterator[dict]:
    cells = _xlsx_cells(data)
    names = [n if n is not None else f"column_{i + 1}" for i, n in enumerate(next(cells, []))]
    for row in cells:
        if any(c is not None for c in row):
            yield dict(zip(names, row, strict=False))


# --- Arrow ----------------------------------------------------------------------

#: Unsigned integers by the Spark type that holds them (fixed values).
UNSIGNED = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}


def _spark_type(kind: pa.DataType) -> pa.DataType:
    if pa.types.is_dictionary(kind):
        return _spark_type(kind.value_type)
    if pa.types.is_large_string(kind) or pa.types.is_string_view(kind):
        return pa.string()
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", kind.tz)
    if pa.types.is_date64(kind):
        return pa.date32()
    return UNSIGNED.get(kind, kind)


def _arrow_reader(data: bytes):
    return pa.ipc.open_file(pa.BufferReader(data)) if data[:6] == b"ARROW1" else pa.ipc.open_stream(pa.BufferReader(data))


def arrow_schema(data: bytes) -> pa.Schema:
    found = _arrow_reader(data).schema
    return pa.schema([(f.name, _spark_type(f.type)) for f in found])


def arrow_batches(data: bytes) -> Iterator[pa.RecordBatch]:
    reader = _arrow_reader(data)
    each = (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else iter(reader)
    want = arrow_schema(data)
    for batch in each:
        yield from pa.Table.from_batches([batch]).cast(want).to_batches()
