"""A lake engine for PySpark: reading, auditing, querying and keeping tables.

``quarrylake.api`` has the engine class and the namespaces read, filter, sql, lake,
dictionary, graph and formats.
"""

import importlib


def __getattr__(name: str):
    """The public names, loaded when first used."""
    if name in ("read", "filter", "sql", "dictionary", "graph", "formats", "AuditEngine"):
        return getattr(importlib.import_module(".api", __name__), name)
    if name == "lake":
        return importlib.import_module(".api", __name__).lake_ops
    raise AttributeError(name)
