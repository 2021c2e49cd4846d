"""Finding data files: folders, globs and Hive-style paths, pruned before reading."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import LakeError
from ..sources import files, registry
from .rules import Rule

COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def partitions(path: str) -> dict[str, str]:
    """Keys and values of all ``key=value`` parts of a path; the last of a key wins."""
    return {k.strip().lower(): v for k, sep, v in (part.partition("=") for part in path.replace("\\", "/").split("/")) if sep}


def _number(text: str, kind):
    try:
        return kind(text) if "_" not in text else None
    except ValueError:
        return None


def rule_fits(rule: Rule, values: dict[str, str]) -> bool:
    """Whether path values satisfy a rule, as integers, else floats, else text; keys
    that the path lacks say nothing against it."""
    own = values.get(rule.column.lower())
    if own is None:
        return True
    for kind in (int, float):
        a, b = _number(own, kind), _number(rule.literal, kind)
        if a is not None and b is not None:
            return COMPARE[rule.operator](a, b)
    return COMPARE[rule.operator](own, rule.literal)


@dataclass
class Found:
    """Data files, and how many whole branches were left out."""

    files: list[str] = field(default_factory=list)
    pruned: int = 0


def data_files(spark: SparkSession, folder: str, part: str | None = None) -> list[str]:
    """All known data files below a folder, sorted; ``part`` must occur in the path."""
    found = files.info(spark, folder)
    if found is None or not found.is_dir:
        return []
    out, stack = [], [found]
    while stack:
        for c in files.children(spark, stack.pop().path):
            if files.hidden(c.path.rpartition("/")[2]):
                continue
            if c.is_dir:
                stack.append(c)
            elif registry.known(c.path) and (not part or part in c.path):
                out.append(c.path)
    return sorted(out)


def prune(spark: SparkSession, folder: str, rules: Sequence[Rule] = (), part: str | None = None) -> Found:
    """Walks a folder and leaves out branches as high up as possible: one whose
    ``key=value`` breaks a rule, or that holds no file whose path has ``part``."""

    def branch(path: str) -> Found | None:
        """What a branch holds; None if it is dead as a whole."""
        if not all(rule_fits(r, partitions(path)) for r in rules):
            return None
        out, alive = Found(), not part or part in path
        for c in files.children(spark, path):
            if files.hidden(c.path.rpartition("/")[2]):
                continue
            if c.is_dir:
                below = branch(c.path)
                out.pruned += below.pruned if below else 1
                if below:
                    out.files += below.files
                    alive = True
            elif registry.known(c.path) and (not part or part in c.path) and all(rule_fits(r, partitions(c.path)) for r in rules):
                out.files.append(c.path)
                alive = True
        return out if alive else None

    return branch(folder) or Found([], 1)


def targets(spark: SparkSession, path: str, rules: Sequence[Rule] = (), part: str | None = None) -> Found:
    """The files that a path, a folder or a glob names. A glob neither prunes nor
    looks at extensions."""
    if re.search(r"[*?\[]", path):
        base = re.split(r"[*?\[]", path, maxsplit=1)[0].rpartition("/")[0] or "."
        pattern = re.compile(_glob(path))
        return Found(sorted(f for f in _all_files(spark, base) if pattern.match(f)))
    found = files.info(spark, path)
    if found is None:
        raise LakeError(f"No such file or folder: {path}")
    if not found.is_dir:
        return Found([path])
    return prune(spark, found.path, rules, part)


def _all_files(spark: SparkSession, folder: str) -> list[str]:
    out: list[str] = []
    found = files.info(spark, folder)
    for c in files.children(spark, folder) if found and found.is_dir else ():
        out += _all_files(spark, c.path) if c.is_dir else [c.path]
    return out


def _glob(pattern: str) -> str:
    """A glob as an expression: ``*`` within a name, ``**`` over folders."""
    out = ""
    for piece in re.split(r"(\*\*/?|\*|\?|\[[^\]]*\])", pattern):
        if piece.startswith("**"):
            out += "(?:.*/)?" if piece.endswith("/") else ".*"
        elif piece == "*":
            out += "[^/]*"
        elif piece == "?":
            out += "[^/]"
        elif piece.startswith("["):
            out += fnmatch.translate(piece)[4:].split(")")[0]
        else:
            out += re.escape(piece)
    return out + r"\Z"
