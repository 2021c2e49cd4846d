"""The notebook cell magic ``%%quarry_sql name [--path PATH]``."""

from __future__ import annotations


def run_cell(line: str, cell: str, names: dict):
    """Fills ``{name}`` places of the cell, runs it, and gives (variable, table)."""
    from . import api

    words, variable, values = iter(line.split()), None, dict(names)
    for w in words:
        if w == "--path":
            values["path"] = next(words)
        else:
            variable = w
    return variable, api.sql.execute_sql_stream(cell.format(**values)).to_pyarrow()


def load_ipython_extension(ipython) -> None:
    """Registers the magic with a notebook."""

    def quarry_sql(line: str, cell: str):
        variable, table = run_cell(line, cell, ipython.user_ns)
        if variable:
            ipython.user_ns[variable] = table
        return table

    ipython.register_magic_function(quarry_sql, magic_kind="cell")
