from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import FlowConfigError
from millrace.functions import coerce
from millrace.functions.paths import overlaps, parse_path, safe_id, safe_id_column
from millrace.functions.templates import Macro, Template, parse_template

NUMBER = T.DecimalType(38, 18)


@pytest.mark.parametrize(
    "text, path",
    [("a", ("a",)), ("a.b", ("a", "b")), ("a/b.c", ("a", "b", "c")), ("a..b", ("a", "", "b")), ("a.", ("a",)), ("", ("",))],
)
def test_path(text, path):
    assert parse_path(text) == path


def test_path_without_keys():
    with pytest.raises(FlowConfigError):
        parse_path(".")


def test_overlap():
    assert overlaps(("a",), ("a", "b")) and overlaps(("a", "b"), ("a",)) and not overlaps(("a", "b"), ("a", "c"))


def test_safe_id(spark):
    for text in ("a b-c", "a--b", "x/__y", "plain"):
        assert spark.createDataFrame([(text,)], "t string").select(safe_id_column(F.col("t"))).first()[0] == safe_id(text)
    assert safe_id("a--b") == "a_b"


def test_template_parts():
    assert parse_template("a${b}c").parts == ("a", Macro(Template(("b",))), "c")
    assert parse_template("${a${b}}").parts[0].name.parts == ("a", Macro(Template(("b",))))
    assert parse_template("${").text == "${" and parse_template("${}").text == "${}" and parse_template("a}").text == "a}"
    assert parse_template("${a").text == "${a"
    assert parse_template("${x}").single_name == "x" and parse_template("${x}y").single_name is None
    assert parse_template("${a.b}${c}").names == {"a.b", "c"} and parse_template("${a${b}}").names is None


@given(st.text(alphabet="ab", max_size=5), st.lists(st.sampled_from(["k", "x.y"]), max_size=3))
@settings(max_examples=50, deadline=None)
def test_template_names(text, names):
    template = parse_template(text + "".join("${" + n + "}" + text for n in names))
    assert template.names == set(names)


def _one(spark, dtype, value, fn):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", dtype)]))
    return df.select(fn(F.col("v")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, number",
    [
        ("", 0),
        ("abc", 0),
        (" 1 ", 0),
        ("1e5", 100000),
        ("-.5", Decimal("-0.5")),
        ("7.", 7),
        ("+3", 3),
        ("9" * 30, None),
        (None, 0),
        ("1\n", 0),
    ],
)
def test_text_to_number(spark, text, number):
    assert _one(spark, T.StringType(), text, lambda c: coerce.text_to_number(c, NUMBER)) == number


@pytest.mark.parametrize(
    "dtype, value, number",
    [
        (T.BooleanType(), True, 1),
        (T.BooleanType(), None, 0),
        (T.LongType(), 5, 5),
        (T.DoubleType(), 2.5, Decimal("2.5")),
        (T.ArrayType(T.StringType()), ["1"], 0),
        (T.StringType(), "x", 0),
        (T.LongType(), None, 0),
    ],
)
def test_to_number(spark, dtype, value, number):
    assert _one(spark, dtype, value, lambda c: coerce.to_number(c, dtype)) == number


@pytest.mark.parametrize("json, number", [("5", 5), ('"7"', 7), ("true", 1), ("[1]", 0), ("{}", 0), ("null", 0), ('"x"', 0)])
def test_variant_to_number(spark, json, number):
    got = _one(spark, T.StringType(), json, lambda c: coerce.to_number(F.parse_json(c), T.VariantType()))
    assert got == number


@pytest.mark.parametrize(
    "dtype, value, flag",
    [
        (T.StringType(), "TRUE", True),
        (T.StringType(), "false", False),
        (T.StringType(), None, False),
        (T.LongType(), 1, True),
        (T.LongType(), 2, False),
        (T.DoubleType(), 1.9, True),
        (T.ArrayType(T.StringType()), [], False),
        (T.ArrayType(T.StringType()), ["x"], True),
        (T.BooleanType(), None, False),
    ],
)
def test_to_boolean(spark, dtype, value, flag):
    assert _one(spark, dtype, value, lambda c: coerce.to_boolean(c, dtype)) is flag


@pytest.mark.parametrize("json, flag", [("1", True), ("1.5", True), ("2", False), ("[]", False), ("[0]", True), ("{}", False), ('{"a":1}', True), ('"true"', True), ("null", False)])
def test_variant_to_boolean(spark, json, flag):
    got = _one(spark, T.StringType(), json, lambda c: coerce.to_boolean(F.parse_json(c), T.VariantType()))
    assert got is flag


@pytest.mark.parametrize("text", ["yes", "1", ""])
def test_bad_boolean(spark, text):
    with pytest.raises(Exception, match="Not a boolean"):
        _one(spark, T.StringType(), text, lambda c: coerce.text_to_boolean(c))
    assert _one(spark, T.StringType(), text, lambda c: coerce.text_to_boolean(c, "null")) is None


@pytest.mark.parametrize(
    "dtype, value, text",
    [
        (NUMBER, Decimal("5"), "5"),
        (NUMBER, Decimal("100"), "100"),
        (NUMBER, Decimal("0"), "0"),
        (NUMBER, Decimal("-12.50"), "-12.5"),
        (T.DecimalType(10, 0), Decimal("30"), "30"),
        (T.ArrayType(T.StringType()), ["a", "b"], '"a","b"'),
        (T.ArrayType(T.LongType()), [1, 2], "1,2"),
        (T.ArrayType(T.LongType()), [], ""),
        (T.ArrayType(NUMBER), [Decimal("5"), Decimal("0"), Decimal("2.50")], "5,0,2.5"),
        (T.BooleanType(), True, "true"),
        (T.StringType(), None, None),
    ],
)
def test_to_text(spark, dtype, value, text):
    assert _one(spark, dtype, value, lambda c: coerce.to_text(c, dtype)) == text


@pytest.mark.parametrize("json, text", [('"a"', "a"), ("5.50", "5.5"), ('[1,"x"]', '1,"x"'), ('{"a":1}', '{"a":1}'), ("true", "true")])
def test_variant_to_text(spark, json, text):
    assert _one(spark, T.StringType(), json, lambda c: coerce.to_text(F.parse_json(c), T.VariantType())) == text


def test_decimal_text_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        for number, text in ((0, "0"), (Decimal("5"), "5"), (Decimal("0.1"), "0.1")):
            assert _one(spark, NUMBER, Decimal(number), lambda c: coerce.to_text(c, NUMBER)) == text
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
