"""SQL functions under the names that users of other engines know."""

from .dialect import install

__all__ = ["install"]
