"""Errors of the public surface: bad requests are ValueErrors, failed queries
RuntimeErrors, everything about files OSErrors."""


class UnsupportedFormat(ValueError):
    """No reader is registered for a file."""


class RuleError(ValueError):
    """A rule text that has no operator, no column or no literal."""


class QueryError(RuntimeError):
    """A SQL text that Spark rejects, or an eager query without rows."""


class LakeError(OSError):
    """A file or folder that cannot be read or written."""
