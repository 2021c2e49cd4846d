"""Rules ``column OP literal`` as Catalyst expressions.

A rule's literal becomes the column's own type before it is compared. A literal that
does not parse, a column that is missing and a type that rules do not know make the
rule ineffective (or raise under ``strict``). Null always violates; NaN violates
everything but ``!=``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RuleError

#: Operators; of two that start at one place the longer is meant (fixed values).
OPERATORS = (">=", "<=", "==", "!=", ">", "<")
#: Bounds of the integer types that rules know (fixed values).
INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
#: Unsigned 64-bit integers read as this.
UNSIGNED = T.DecimalType(20, 0)
FLOAT_TEXT = re.compile(r"[+-]?(?:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\Z", re.I)
INTEGER_TEXT = re.compile(r"[+-]?\d+\Z")


@dataclass(frozen=True)
class Rule:
    """A parsed rule; the literal stays text until the column's type is known."""

    column: str
    operator: str
    literal: str

    def __str__(self) -> str:
        return f"{self.column} {self.operator} {self.literal}"


def parse_rule(text: str) -> Rule:
    """Splits at the leftmost operator outside quotes."""
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif found := next((o for o in OPERATORS if text.startswith(o, i)), None):
            column, literal = text[:i].strip(), text[i + len(found) :].strip()
            for q in "'\"":
                if len(literal) > 1 and literal[0] == literal[-1] == q:
                    literal = literal[1:-1]
            if not column:
                break
            return Rule(column, found, literal)
    raise RuleError(f"no rule of the form 'column OP literal': {text!r}")


def parse_rules(texts: Sequence[str | Rule]) -> list[Rule]:
    return [t if isinstance(t, Rule) else parse_rule(t) for t in texts]


def _literal(kind: T.DataType, text: str) -> Column | None:
    """The literal in the column's type, or None where it is none."""
    if type(kind) in INTEGERS:
        bits = INTEGERS[type(kind)]
        if INTEGER_TEXT.match(text) and -(1 << bits - 1) <= int(text) < 1 << bits - 1:
            return F.lit(int(text)).cast(kind)
        return None
    if kind == UNSIGNED:
        return F.lit(text.lstrip("+")).cast(kind) if INTEGER_TEXT.match(text) and 0 <= int(text) < 1 << 64 else None
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.lit(float(text)).cast(kind) if FLOAT_TEXT.match(text) else None
    if isinstance(kind, T.StringType):
        return F.lit(text)
    return None


def violation(rule: Rule, schema: T.StructType, strict: bool = False) -> Column | None:
    """True where the rule is violated, never null; None if it has no effect."""
    kind = schema[rule.column].dataType if rule.column in schema.names else None
    value = None if kind is None else _literal(kind, rule.literal)
    if value is None:
        if strict:
            raise RuleError(f"rule {rule} does not apply to {'a missing column' if kind is None else kind.simpleString()}")
        return None
    column = F.col("`" + rule.column.replace("`", "``") + "`")
    holds = {">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value, "==": column == value, "!=": column != value}[rule.operator]
    if isinstance(kind, T.FloatType | T.DoubleType):
        if rule.literal.lower().lstrip("+-") == "nan":
            holds = column.isNotNull() if rule.operator == "!=" else F.lit(False)
        elif rule.operator != "!=":
            holds = holds & ~F.isnan(column)
    return ~F.coalesce(holds, F.lit(False))
