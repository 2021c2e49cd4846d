"""Schema documentation: Markdown dictionaries and Mermaid entity diagrams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..errors import LakeError
from ..sources import files, readers, registry
from . import discovery


def dictionary_rows(schema: T.StructType) -> list[tuple[int, str, str, str]]:
    """Number, name, type and whether null is allowed, of each column."""
    return [(i, f.name, f.dataType.simpleString(), "Yes" if f.nullable else "No") for i, f in enumerate(schema.fields, 1)]


def dictionary_markdown(title: str, schema: T.StructType) -> str:
    rows = "".join(f"| {i} | `{name}` | {kind} | {nullable} |  |\n" for i, name, kind, nullable in dictionary_rows(schema))
    return f"# Data Dictionary: {title}\n\n| STT | Column Name | Data Type | Nullable | Description |\n| --- | --- | --- | --- | --- |\n{rows}"


def write_dictionary(spark: SparkSession, target: str, output: str) -> str:
    """The dictionary of a file, or of a folder's first data file."""
    found = files.info(spark, target)
    if found is None:
        raise LakeError(f"No such file or folder: {target}")
    path = target
    if found.is_dir:
        path = next(iter(discovery.data_files(spark, target)), None)
        if path is None:
            raise LakeError(f"no data files in {target}")
    files.write_bytes(spark, output, dictionary_markdown(path.rpartition("/")[2], readers.read_file(spark, path).schema).encode())
    return output


def key_of(table: str, column: str) -> str:
    """PK, FK or nothing, by the column's name."""
    return "PK" if column in ("id", f"{table}_id") else "FK" if column.endswith("_id") else ""


def edges(tables: dict[str, Sequence[str]]) -> list[tuple[str, str, str]]:
    """(from, to, label): a column of one table that names another table's id."""
    out = []
    for a, columns in tables.items():
        for b in tables:
            names = {f"{b.rstrip('s').lower()}_id", f"{b.lower()}_id"}
            if a != b and names & {c.lower() for c in columns}:
                out.append((a, b, f"{b.lower()}_id"))
    return out


def mermaid(schemas: dict[str, T.StructType]) -> str:
    lines = ["```mermaid", "erDiagram"]
    schemas = dict(sorted(schemas.items()))
    for name, schema in schemas.items():
        lines.append(f"    {name} {{")
        lines += [f"        {f.dataType.simpleString().replace('<', '_').replace('>', '').replace(',', '_').replace(':', '_')} {f.name}" + (f" {key}" if (key := key_of(name, f.name)) else "") for f in schema.fields]
        lines.append("    }")
    lines += [f'    {a} }}|--|| {b} : "{label}"' for a, b, label in edges({n: s.names for n, s in schemas.items()})]
    return "\n".join([*lines, "```"]) + "\n"


def write_graph(spark: SparkSession, path: str, output: str) -> str:
    """The diagram of a file, or of the data files directly in a folder."""
    found = files.info(spark, path)
    if found is None:
        raise LakeError(f"No such file or folder: {path}")
    own = [c.path for c in files.children(spark, path) if not c.is_dir and registry.known(c.path) and not files.hidden(c.path.rpartition("/")[2])] if found.is_dir else [path]
    text = mermaid({p.rpartition("/")[2].rpartition(".")[0]: readers.read_file(spark, p).schema for p in own})
    files.write_bytes(spark, output, text.encode())
    return text
