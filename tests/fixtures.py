"""Inputs that tests build, and small writers of the formats that Spark lacks."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

TAXI = [(1, 15.5, 2.5), (2, -5.0, 0.0), (0, 20.0, 3.1), (5, 100.0, 10.0), (12, 50.0, 1.2), (1, 0.0, 5.0)]
NAMES = ("passenger_count", "fare_amount", "trip_distance")
DICTS = [dict(zip(NAMES, r, strict=True)) for r in TAXI]


def delimited(path, sep: str, rows=TAXI, names=NAMES) -> str:
    path.write_text("\n".join([sep.join(names), *(sep.join(map(str, r)) for r in rows)]) + "\n")
    return str(path)


def zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def avro(path, rows=DICTS, codec: str = "null", nullable: bool = False) -> str:
    kinds = {"passenger_count": "long", "fare_amount": "double", "trip_distance": "double"}
    schema = {"type": "record", "name": "r", "fields": [{"name": n, "type": ["null", k] if nullable else k} for n, k in kinds.items()]}
    body = b""
    for r in rows:
        for n, k in kinds.items():
            v = r[n]
            if nullable:
                body += zigzag(0 if v is None else 1)
            if v is not None:
                body += zigzag(v) if k == "long" else struct.pack("<d", v)
    if codec == "deflate":
        c = zlib.compressobj(wbits=-15)
        body = c.compress(body) + c.flush()
    text = lambda s: zigzag(len(s)) + s
    head = b"Obj\x01" + zigzag(2) + text(b"avro.schema") + text(json.dumps(schema).encode()) + text(b"avro.codec") + text(codec.encode()) + zigzag(0)
    mark = bytes(range(16))
    path.write_bytes(head + mark + zigzag(len(rows)) + zigzag(len(body)) + body + mark)
    return str(path)


def msgpack(path, rows=DICTS, lead: bytes = b"") -> str:
    out = lead
    for r in rows:
        out += bytes([0x80 | len(r)])
        for k, v in r.items():
            out += bytes([0xA0 | len(k)]) + k.encode()
            out += struct.pack(">Bq", 0xD3, v) if isinstance(v, int) else struct.pack(">Bd", 0xCB, v)
    path.write_bytes(out)
    return str(path)


def xlsx(path, rows=TAXI, names=NAMES) -> str:
    def cell(v) -> str:
        return f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>" if v is not None else "<c/>"

    sheet = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [names, *rows])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="a" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    path.write_bytes(out.getvalue())
    return str(path)


def arrow(path, feather: bool = False) -> str:
    import pyarrow as pa

    table = pa.Table.from_pylist(DICTS)
    with pa.OSFile(str(path), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    return str(path)
