import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import millrace as m
from catalog.steps import all_of, any_of, drop, enrich, field, tag
from millrace.operators.conditions import as_column, compile_condition
from millrace.operators.patterns import literal_texts
from millrace.plans.frame import Frame


def holds(spark, condition, rows, schema):
    frame = Frame.of(spark.createDataFrame(rows, schema).coalesce(1))
    test = as_column(compile_condition(condition, frame.scope, spark))
    return [r.t for r in frame.df.select(test.alias("t")).collect()]


def test_field_missing_is_empty_text(spark):
    rows = [("x",), (None,)]
    assert holds(spark, field("absent", is_="^$"), rows, "a string") == [True, True]
    assert holds(spark, field("absent", isnot="."), rows, "a string") == [True, True]
    assert holds(spark, field("a", is_="^$"), rows, "a string") == [False, True]
    assert holds(spark, field("a"), rows, "a string") == [True, True]
    assert holds(spark, field("a", is_="x", isnot="x"), rows, "a string") == [False, False]


def test_field_looks_into_context_and_paths(spark):
    rows = [(({"k": 5},), {"who": "me"})]
    schema = "event struct<a:struct<k:int>>, ctx map<string,string>"
    assert holds(spark, field("a.k", is_="^5$"), rows, schema) == [True]
    assert holds(spark, field("a/k", is_="^5$"), rows, schema) == [True]
    assert holds(spark, field("who", is_="^me$"), rows, schema) == [True]
    assert holds(spark, field("a.k.x", is_="."), rows, schema) == [False]


def test_search_is_not_anchored_and_java_end_of_line(spark):
    rows = [("error",), ("error\n",), ("error\r\n",), ("errors",), ("an error",), (None,)]
    for pattern in ("^error$", "error", "^error", "error$", "^(error|x)$", "err.r", "^(err|an)"):
        expected = holds(spark, field("${n}", is_=pattern), [(r[0], "v") for r in rows], "v string, n string")
        assert holds(spark, field("v", is_=pattern), rows, "v string") == expected
    assert holds(spark, field("v", is_="^error$"), rows, "v string") == [True, True, True, False, False, False]


def test_integer_equality(spark):
    assert holds(spark, field("v", is_="^(5|-6)$"), [(5,), (-6,), (55,), (None,)], "v long") == [True, True, False, False]
    assert holds(spark, field("v", is_="^05$"), [(5,)], "v long") == [False]


def test_tag(spark):
    rows = [(["a"],), (["b", None],), (None,)]
    schema = "tags array<string>"
    assert holds(spark, tag("a"), rows, schema) == [True, True, True]
    assert holds(spark, tag("b", is_="."), rows, schema) == [False, True, False]
    assert holds(spark, tag("b", isnot="."), rows, schema) == [True, False, True]
    assert holds(spark, tag("a", is_="^x"), rows, schema) == [False, False, False]
    assert holds(spark, tag("", is_="^$"), rows, schema) == [False, True, False]
    assert holds(spark, tag("a", is_="a"), [("a",)], "tags string") == [False]
    assert holds(spark, tag("", is_="^$"), [([1],)], "tags array<int>") == [True]


def test_tag_in_variant(spark):
    df = spark.sql("""SELECT parse_json(j) AS tags FROM VALUES ('["a",1]'), ('"a"'), ('[2]'), (null) AS t(j)""")
    frame = Frame.of(df)
    test = as_column(compile_condition(tag("a", is_="a"), frame.scope, spark))
    assert [r.t for r in frame.df.select(test.alias("t")).collect()] == [True, False, False, False]


def test_empty_lists(spark):
    assert holds(spark, any_of(), [("x",)], "a string") == [False]
    assert holds(spark, all_of(), [("x",)], "a string") == [True]


@given(st.lists(st.sampled_from("abc"), max_size=3), st.lists(st.sampled_from("abc"), max_size=3), st.booleans())
@settings(max_examples=15, deadline=None)
def test_any_all_like_python(spark, some, every, outer):
    test = (any_of if outer else all_of)(
        any_of(*[field("v", is_=f"^{c}$") for c in some]), all_of(*[field("v", isnot=f"^{c}$") for c in every])
    )
    combine = any if outer else all
    expected = [combine([any(v == c for c in some), all(v != c for c in every)]) for v in "abcd"]
    assert holds(spark, test, [(v,) for v in "abcd"], "v string") == expected


@pytest.mark.parametrize(
    "bad",
    [
        {"class": "other"},
        {},
        {"class": "field"},
        {"class": "field", "props": {}},
        {"class": "tag", "props": {"is": "x"}},
        {"class": "any"},
        {"class": "all", "list": [{"class": "nope"}]},
        {"class": "field", "props": {"name": "a", "is": "("}},
    ],
)
def test_bad_config(spark, bad):
    with pytest.raises(m.FlowConfigError):
        holds(spark, bad, [("x",)], "a string")


def test_class_is_case_insensitive(spark):
    assert holds(spark, {"class": "FIELD", "props": {"name": "a", "is": "x"}}, [("x",)], "a string") == [True]


def test_failed_condition_lets_records_through(apply):
    assert apply([("x",)], "a string", [enrich(("b", "1"), when=any_of()), drop(any_of())]) == [{"a": "x"}]
    assert apply([("x",)], "a string", [drop()]) == []


def test_condition_with_null_keeps_record(apply):
    assert len(apply([(None,), ("v",)], "a string", [drop(field("a", is_="v"))])) == 1


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "x")], "k string, n long, other string").write.parquet(path)
    df = m.apply_flow(spark.read.parquet(path), [drop(field("k", isnot="^a$")), drop(field("n", isnot="^1$"))]).select("k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(k" in plan and "EqualTo(n,1)" in plan and "ReadSchema: struct<k:string,n:bigint>" in plan


def test_literal_texts():
    assert literal_texts("^a$") == (True, True, ["a"])
    assert literal_texts("^(a|b[.])$") is None
    assert literal_texts(r"^(a|b\.c)$") == (True, True, ["a", "b.c"])
    assert literal_texts("^(?:a|b)") == (True, False, ["a", "b"])
    assert literal_texts(r"\d") is None and literal_texts("a|b") is None
    for pattern, text in itertools.product(["a", "^a", "^a$", "^(a|bc)$"], ["a", "ba", "abc", "bc"]):
        start, end, texts = literal_texts(pattern)
        ours = any((text == t) if start and end else text.startswith(t) if start else t in text for t in texts)
        assert ours == (re.search(pattern, text) is not None)
