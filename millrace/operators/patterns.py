"""Regular-expression tests, rewritten to pushable comparisons where that is exact."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FlowConfigError
from millrace.plans.scope import Scope

# What "$" lets stand between the match and the end of the text.
LINE_ENDS = ("", "\n", "\r\n", "\r", "\u0085", "\u2028", "\u2029")

_PLAIN = r"(?:[^\\\[\](){}.*+?^$|]|\\[^A-Za-z0-9])"

def check_pattern(spark: SparkSession, pattern: str) -> int:
    """Number of capture groups of a pattern; rejects what Java cannot compile."""
    try:
        return spark._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (IllegalArgumentException, Py4JJavaError) as e:
        raise FlowConfigError(f"Bad pattern {pattern!r}: {e}") from None


def literal_texts(pattern: str) -> tuple[bool, bool, list[str]] | None:
    """``(anchored at start, anchored at end, texts)`` of a pattern that is only text
    or one group of alternative texts; None for any other."""
    found = re.fullmatch(rf"(\^?)(?:\((?:\?:)?({_PLAIN}*(?:\|{_PLAIN}*)*)\)|({_PLAIN}*))(\$?)", pattern, re.DOTALL)
    if found is None:
        return None
    start, group, text, end = found.groups()
    texts = re.findall(rf"(?:^|\|)({_PLAIN}*)", group, re.DOTALL) if group is not None else [text]
    return bool(start), bool(end), [re.sub(r"\\(.)", r"\1", t, flags=re.DOTALL) for t in texts]


def field_matches(scope: Scope, name: str, pattern: str) -> Column:
    """Whether the text of a field has a match, never NULL."""
    leaf = scope.plain_leaf(name)
    literal = literal_texts(pattern)
    if leaf is not None and literal is not None and all(literal[2]):
        test = _comparison(leaf.column, leaf.dtype, *literal)
        if test is not None:
            return leaf.column.isNotNull() & test
    return scope.lookup(name).rlike(pattern)


def _comparison(col: Column, dtype: T.DataType, start: bool, end: bool, texts: list[str]) -> Column | None:
    if isinstance(dtype, T.IntegralType):
        if start and end and all(re.fullmatch(r"0|-?[1-9]\d{0,17}", t) for t in texts):
            return col.isin(*[int(t) for t in texts])
        return None
    if not isinstance(dtype, T.StringType):
        return None
    if start and end:
        return col.isin(*[t + e for t in texts for e in LINE_ENDS])
    if end:
        return None
    tests = [col.startswith(t) if start else col.contains(t) for t in texts]
    return reduce(Column.__or__, tests)
