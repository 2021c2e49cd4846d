"""Rules: parsing, the compiler against a plain model, codes and lists."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from quarrylake.errors import RuleError
from quarrylake.operators import audit
from quarrylake.operators.rules import Rule, parse_rule


@pytest.mark.parametrize(
    "text,want",
    [
        ("a >= 5", Rule("a", ">=", "5")),
        ("a>5", Rule("a", ">", "5")),
        ("name == 'x y'", Rule("name", "==", "x y")),
        ('name != "q"', Rule("name", "!=", "q")),
        ("s == 'a >= b'", Rule("s", "==", "a >= b")),
        ("f < -1e3", Rule("f", "<", "-1e3")),
    ],
)
def test_parse(text, want):
    assert parse_rule(text) == want


@pytest.mark.parametrize("text", ["a = 5", "", "just words", "> 5"])
def test_parse_rejects(text):
    with pytest.raises(RuleError):
        parse_rule(text)


@given(st.text(max_size=30))
def test_parse_never_breaks(text):
    try:
        assert parse_rule(text).column
    except RuleError:
        pass


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("i", T.LongType()), ("b", T.ByteType()), ("f", T.DoubleType()), ("s", T.StringType()), ("d", T.DateType()))])
ROWS = [(5, 1, 2.5, "b", None), (None, None, None, None, None), (-3, -128, math.nan, "", None), (0, 0, math.inf, "é", None), (7, 127, -0.0, "B", None)]


def model(value, op, literal):
    """Whether a value satisfies a rule."""
    if value is None:
        return False
    if isinstance(value, float) and math.isnan(value):
        return op == "!="
    return {">": value > literal, ">=": value >= literal, "<": value < literal, "<=": value <= literal, "==": value == literal, "!=": value != literal}[op]


@pytest.mark.parametrize("column,literals", [("i", ["0", "5", "-3"]), ("b", ["0", "127"]), ("f", ["0", "2.5", "inf", "-1e2"]), ("s", ["b", "", "é"])])
def test_compiler_against_model(spark, column, literals):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kind = {"i": int, "b": int, "f": float, "s": str}[column]
    rules = [Rule(column, op, lit) for op in (">", ">=", "<", "<=", "==", "!=") for lit in literals]
    codes = [r["audit_error_code"] for r in audit.flag_rules(df, rules).collect()]
    for row, code in zip(ROWS, codes, strict=True):
        value = row[SCHEMA.names.index(column)]
        assert code == sum(1 << i for i, r in enumerate(rules) if not model(value, r.operator, kind(r.literal)))


@pytest.mark.parametrize("rule", ["i >= 2.5", "b > 128", "b > -129", "missing > 1", "d == 2020-01-01", "f > 1_0", "i > x", "I > 3"])
def test_ineffective_rules(spark, rule):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert audit.counts(audit.flag_rules(df, [rule])) == (5, 5, 0)
    with pytest.raises(RuleError):
        audit.flag_rules(df, [rule], strict=True)


def test_nan_literal(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert audit.counts(audit.flag_rules(df, ["f != nan"])) == (5, 4, 1)
    assert audit.counts(audit.flag_rules(df, ["f <= nan"])) == (5, 0, 5)


def test_hundred_rules_do_not_collide(spark):
    df = spark.createDataFrame([(1, 1), (200, 5), (50, 200), (200, 200)], "id long, val long")
    rules = ["id < 100"] + ["id >= 0"] * 63 + ["val < 100"] + ["id >= 0"] * 35
    rows = audit.flag_rules(df, rules).collect()
    assert [r[audit.VIOLATED] for r in rows] == [[], [0], [64], [0, 64]]
    assert [r[audit.CODE] for r in rows] == [0, 1, 0, 1]
    assert [r[audit.CLEAN] for r in rows] == [True, False, False, False]


def test_five_hundred_rules(spark):
    df = spark.createDataFrame([(500.0,), (-1.0,)], "f_num double")
    rules = [f"f_num > {-1000 - i}" if i not in (250, 499) else "f_num > 0" for i in range(500)]
    assert [r[audit.VIOLATED] for r in audit.flag_rules(df, rules).collect()] == [[], [250, 499]]


def test_bit_63(spark):
    df = spark.createDataFrame([(1,)], "a long")
    assert audit.flag_rules(df, ["a > 0"] * 63 + ["a > 5"]).first()[audit.CODE] == -(1 << 63)


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([], "a long")
    assert audit.counts(audit.flag_rules(df, [])) == (0, 0, 0)
    clean, trash = audit.split(audit.flag_rules(df, ["a > 1"]))
    assert clean.columns == ["a"] and trash.columns == ["a", "audit_error_code"]
