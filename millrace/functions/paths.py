"""Field paths, the working-form column names made from them, and safe ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import FlowConfigError

Path = tuple[str, ...]


def _split(text: str, sep: str) -> list[str]:
    # An empty text is one empty key; trailing empty keys of other texts are dropped.
    if not text:
        return [""]
    parts = text.split(sep)
    while parts and not parts[-1]:
        parts.pop()
    return parts


def parse_path(text: str) -> Path:
    """``a.b/c`` -> ``("a", "b", "c")``. Object keys only, no array index."""
    path = tuple(key for part in _split(text, ".") for key in _split(part, "/"))
    if not path:
        raise FlowConfigError(f"Path {text!r} has no keys")
    return path


def dotted(path: Path) -> str:
    return ".".join(path)


def overlaps(a: Path, b: Path) -> bool:
    """One path is the other, or lies inside it."""
    n = min(len(a), len(b))
    return a[:n] == b[:n]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _cased(name: str) -> str:
    # Spark takes column names that differ by case for one; JSON keys are two.
    return "".join("^" + c if c == "^" or c != c.lower() else c for c in name)


def leaf_column(path: Path) -> str:
    """Working-form column of an event leaf."""
    return "e:" + "/".join(_cased(key).replace("~", "~0").replace("/", "~1") for key in path)


def ctx_column(name: str) -> str:
    """Working-form column of a context key."""
    return "c:" + _cased(name)


def safe_id(text: str) -> str:
    """Name usable as a directory or query name."""
    return re.sub(r"\W", "_", text, flags=re.ASCII).replace("__", "_")


def safe_id_column(col: Column) -> Column:
    """:func:`safe_id` over a column."""
    return F.regexp_replace(F.regexp_replace(col, r"\W", "_"), "__", "_")
