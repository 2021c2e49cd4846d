"""Media columns: signature sniffing, validation, correction and carving.

An Aho-Corasick automaton finds every format's magic bytes in a blob in one pass.
At each hit the format's validator walks the structure: lengths, chunk sums, end
marks. A hit that holds together is a media object with a known extent. The object
at offset 0 that fills the blob corrects the declared type; the others are carved.
After an object the search goes on behind its end, so nothing is counted twice.

Everything is per row: no shuffle, memory for one Arrow batch. A null blob holds no
media; a declared type that is null is corrected like a wrong one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payload bytes are filled up to a multiple of this (the contract's value).
BLOCK = 192
#: Sample rate that the stored form declares.
RATE = 16_000


@dataclass(frozen=True)
class Media:
    """A validated object within a blob."""

    kind: str
    start: int
    end: int


def _png(b: memoryview, at: int) -> int:
    """End of the PNG file at ``at``: chunk lengths and sums up to IEND; else -1."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + n
        if end > len(b) or (first and name != b"IHDR") or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return -1
        if name == b"IEND":
            return end
        pos, first = end, False
    return -1


def _riff(form: bytes, must: bytes) -> Callable[[memoryview, int], int]:
    def check(b: memoryview, at: int) -> int:
        if at + 12 > len(b) or bytes(b[at + 8 : at + 12]) != form:
            return -1
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        pos, seen = at + 12, False
        if end > len(b):
            return -1
        while pos + 8 <= end:
            name, n = struct.unpack_from("<4sI", b, pos)
            seen |= name == must
            pos += 8 + n + n % 2
        return end if seen and pos in (end, end + 1) else -1

    return check


def _gif(b: memoryview, at: int) -> int:
    if at + 13 > len(b) or bytes(b[at : at + 6]) not in (b"GIF87a", b"GIF89a"):
        return -1
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    images = 0
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return pos + 1 if images else -1
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 < len(b):
            images += 1
            local = b[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 128 else 0)
        else:
            return -1
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return -1


def _jpeg(b: memoryview, at: int) -> int:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF and b[pos + 1] not in (0xD9, 0xDA):
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
    if pos + 4 > len(b) or b[pos] != 0xFF or b[pos + 1] != 0xDA:
        return -1
    found = bytes(b[pos:]).find(b"\xff\xd9")
    return pos + found + 2 if found >= 0 else -1


def _bmp(b: memoryview, at: int) -> int:
    if at + 30 > len(b):
        return -1
    size, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    good = header in (12, 40, 52, 56, 64, 108, 124) and not zero and 14 + header <= start <= size
    return at + size if good and at + size <= len(b) else -1


def _pdf(b: memoryview, at: int) -> int:
    raw = bytes(b[at:])
    further = raw.find(b"%PDF-", 5)
    end = raw.rfind(b"%%EOF", 0, further) if further >= 0 else raw.rfind(b"%%EOF")
    if end < 0:  # the further header may lie in an attachment
        end = raw.find(b"%%EOF")
    if end < 0 or b"startxref" not in raw[:end]:
        return -1
    end += 5
    while end < len(raw) and raw[end] in b" \t\r\n":
        end += 1
    return at + end


#: Magic bytes, media type and validator of each format (fixed values).
FORMATS: tuple[tuple[bytes, str, Callable[[memoryview, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"RIFF", "audio/wav", _riff(b"WAVE", b"data")),
    (b"RIFF", "image/webp", _riff(b"WEBP", b"VP8 ")),
    (b"RIFF", "image/webp", _riff(b"WEBP", b"VP8L")),
    (b"RIFF", "image/webp", _riff(b"WEBP", b"VP8X")),
    (b"RIFF", "video/avi", _riff(b"AVI ", b"movi")),
    (b"GIF8", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
)


def automaton():
    import ahocorasick

    own = ahocorasick.Automaton()
    for magic in dict.fromkeys(m for m, *_ in FORMATS):
        own.add_word(magic.decode("latin-1"), magic)
    own.make_automaton()
    return own


def find_media(blob: bytes | None, own) -> list[Media]:
    """All validated objects of a blob, in order; what lies inside one is its own."""
    out: list[Media] = []
    if not blob:
        return out
    view, free = memoryview(blob), 0
    for last, magic in own.iter(blob.decode("latin-1")):
        start = last - len(magic) + 1
        if start < free:
            continue
        for m, kind, check in FORMATS:
            if m == magic and (end := check(view, start)) > 0:
                out.append(Media(kind, start, end))
                free = end
                break
        if free >= len(blob):
            break
    return out


def sniff(df: DataFrame, key: str, blob: str, declared: str | None = None) -> DataFrame:
    """The operator: one row per media object with offset, length, the declared and
    the true type, whether it was corrected or carved, and its bytes. A blob without
    media gives one row of nulls beside its declared type."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, t) for n, t in (("offset", T.LongType()), ("length", T.LongType()), ("declared", T.StringType()), ("media_type", T.StringType()), ("corrected", T.BooleanType()), ("carved", T.BooleanType()), ("media", T.BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, rows = b.slice(at, 64), []
                for k, data, said in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    found = find_media(data, own)
                    for m in found:
                        whole = m.start == 0 and m.end == len(data)
                        rows.append((k, m.start, m.end - m.start, said, m.kind, whole and m.kind != said, not whole, data[m.start : m.end]))
                    if not found:
                        rows.append((k, None, None, said, None, False, False, None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 8
                types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    said = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    return df.select(F.col(key), F.col(blob), said).mapInArrow(run, schema)


def pad(raw: bytes) -> bytes:
    """Fills up with spaces to a positive multiple of BLOCK."""
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def to_wav(payload: bytes) -> bytes:
    """The payload as unsigned 8-bit mono samples of a WAV file."""
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    odd = b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(payload) + len(odd), b"WAVE") + head + payload + odd


def from_wav(media: bytes) -> tuple[bytes, int, int]:
    """The samples of a WAV file, its rate and its bits a sample."""
    pos, rate, bits = 12, 0, 0
    while pos + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, pos)
        if name == b"fmt ":
            rate, bits = struct.unpack_from("<I", media, pos + 12)[0], struct.unpack_from("<H", media, pos + 22)[0]
        if name == b"data":
            return media[pos + 8 : pos + 8 + n], rate, bits
        pos += 8 + n + n % 2
    raise ValueError("no samples")


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts as media: key, n_bytes, ``blob`` (WAV) and a declared type that says
    nothing, as of a bucket of untyped objects."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("blob", T.BinaryType()), T.StructField("declared", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = [x or b"" for x in pc.cast(part.column(1), pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([to_wav(pad(x)) for x in raw], pa.binary()), pa.array(["application/octet-stream"] * len(raw))], names=schema.names)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def describe(media: bytes) -> tuple[int, str, int, str]:
    """Payload length, SHA-256, CRC-32 of the last 16 bytes, and the feature."""
    samples, rate, bits = from_wav(media)
    values = np.frombuffer(samples, np.uint8)
    feature = f"wav:{bits}bit:{rate}Hz:mean={values.mean():.4f}:peak={values.max()}:crossings={int(np.count_nonzero(np.diff(values >= 128)))}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), feature


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as media, finds the media in the stored bytes again with
    the sniffer, reads the payload back from what it carved and describes it.

    Both steps run in one Arrow map so that blobs stay in the worker."""
    fields = (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton()
        for b in batches:
            rows = []
            for raw in (x.as_py() or b"" for x in pc.cast(b.column(1), pa.binary())):
                blob = to_wav(pad(raw))
                whole = next(m for m in find_media(blob, own) if m.kind == "audio/wav")
                media = blob[whole.start : whole.end]
                n, sha, crc, feature = describe(media)
                rows.append((len(raw), n, sha, crc, len(media), hashlib.sha256(media).hexdigest(), f"{whole.kind}:{feature}"))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
