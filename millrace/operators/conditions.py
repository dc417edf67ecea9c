"""Conditions: any, all, tag and field, each compiled to one boolean expression.

Every expression is NULL-free, so that negating it in ``drop`` cannot lose a record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FlowConfigError
from millrace.functions.coerce import is_variant
from millrace.functions.templates import parse_template
from millrace.operators.patterns import check_pattern, field_matches
from millrace.plans.scope import Scope

Test = Column | bool


def optional_text(config: dict, key: str) -> str | None:
    value = config.get(key)
    return value if isinstance(value, str) else None


def required_text(config: dict, key: str, owner: str) -> str:
    value = optional_text(config, key)
    if value is None:
        raise FlowConfigError(f"{owner}: expected text under {key!r}, got {config}")
    return value


def compile_condition(config: dict | None, scope: Scope, spark: SparkSession) -> Test:
    """Boolean expression of a condition config; a bool where it does not depend on the
    record. Without a config the answer is True."""
    if config is None:
        return True
    if not isinstance(config, dict):
        raise FlowConfigError(f"condition: expected an object, got {config!r}")
    kind = required_text(config, "class", "condition").lower()
    if kind in ("any", "all"):
        return _combined(kind, config, scope, spark)
    if kind not in ("field", "tag"):
        raise FlowConfigError(f"condition: {kind!r} is none of any, all, field, tag")
    props = config.get("props")
    if not isinstance(props, dict):
        raise FlowConfigError(f"{kind} condition: expected an object under 'props', got {config}")
    name = required_text(props, "name", f"{kind} condition")
    wanted, unwanted = optional_text(props, "is"), optional_text(props, "isnot")
    for pattern in (wanted, unwanted):
        if pattern is not None:
            check_pattern(spark, pattern)
    matches = _field_test(name, scope) if kind == "field" else _tag_test(name, scope)
    tests: list[Test] = []
    if wanted is not None:
        tests.append(matches(wanted))
    if unwanted is not None:
        tests.append(negate(matches(unwanted)))
    return _all(tests)


def negate(test: Test) -> Test:
    return (not test) if isinstance(test, bool) else ~test


def as_column(test: Test) -> Column:
    return F.lit(test) if isinstance(test, bool) else test


def _all(tests: list[Test]) -> Test:
    if any(t is False for t in tests):
        return False
    columns = [t for t in tests if not isinstance(t, bool)]
    return reduce(Column.__and__, columns) if columns else True


def _any(tests: list[Test]) -> Test:
    if any(t is True for t in tests):
        return True
    columns = [t for t in tests if not isinstance(t, bool)]
    return reduce(Column.__or__, columns) if columns else False


def _combined(kind: str, config: dict, scope: Scope, spark: SparkSession) -> Test:
    children = config.get("list")
    if not isinstance(children, list):
        raise FlowConfigError(f"{kind} condition: expected conditions under 'list', got {config}")
    tests = [compile_condition(child if child is not None else {}, scope, spark) for child in children]
    return _any(tests) if kind == "any" else _all(tests)


def _field_test(name: str, scope: Scope):
    fixed = parse_template(name).text
    if fixed is not None:
        return lambda pattern: field_matches(scope, fixed, pattern)
    text = scope.lookup_by(scope.expand(name))
    return lambda pattern: text.rlike(pattern)


def _tag_test(name: str, scope: Scope):
    has_tag = _tag_present(name, scope)
    # Only tags equal to the name are searched, so the pattern meets one fixed text.
    return lambda pattern: False if has_tag is None else has_tag & F.lit(name).rlike(pattern)


def _tag_present(name: str, scope: Scope) -> Column | None:
    """Whether the event's tags hold ``name``; anything but text counts as ''."""
    leaf = scope.value(("tags",))
    if leaf is None:
        return None
    if isinstance(leaf.dtype, T.ArrayType) and isinstance(leaf.dtype.elementType, T.StringType):
        # A NULL tag is not text either.
        found = F.array_contains(leaf.column, name)
        if name == "":
            found = F.coalesce(found, F.exists(leaf.column, lambda t: t.isNull()))
        return F.coalesce(found, F.lit(False))
    if isinstance(leaf.dtype, T.ArrayType) and not is_variant(leaf.dtype.elementType):
        return F.coalesce(F.size(leaf.column) > 0, F.lit(False)) if name == "" else None
    if isinstance(leaf.dtype, T.ArrayType):
        items = leaf.column
    elif is_variant(leaf.dtype):
        items = F.try_variant_get(leaf.column, "$", "array<variant>")
    else:
        return None

    def equal(item: Column) -> Column:
        text = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
        return F.coalesce(text, F.lit("")) == name

    return F.coalesce(F.exists(items, equal), F.lit(False))
