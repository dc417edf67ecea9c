"""Short ways to write instruction and condition configs, and to flatten results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def enrich(*fields: tuple, tags: list[str] | None = None, when: dict | None = None) -> dict:
    """Each field is ``(name, value)`` or ``(name, value, type)``."""
    entries = [dict(zip(("name", "value", "type"), f)) for f in fields]
    return _step("enrich", {"fields": entries, "tags": tags or []}, when)


def grok(source: str, pattern: str, groups: str, fields: str, values: str, types: str, when: dict | None = None) -> dict:
    props = dict(source=source, pattern=pattern, groups=groups, fields=fields, values=values, types=types)
    return _step("grok", props, when)


def drop(when: dict | None = None) -> dict:
    return _step("drop", {}, when)


def log(when: dict | None = None, **props) -> dict:
    return _step("log", props, when)


def _step(name: str, props: dict, when: dict | None) -> dict:
    step = {"class": name, "props": props}
    return step if when is None else {**step, "condition": when}


def field(name: str, **tests: str) -> dict:
    return {"class": "field", "props": {"name": name, **{k.rstrip("_"): v for k, v in tests.items()}}}


def tag(name: str, **tests: str) -> dict:
    return {"class": "tag", "props": {"name": name, **{k.rstrip("_"): v for k, v in tests.items()}}}


def any_of(*children: dict) -> dict:
    return {"class": "any", "list": list(children)}


def all_of(*children: dict) -> dict:
    return {"class": "all", "list": list(children)}


def joined(col: str | Column) -> Column:
    """An array of texts as one text, in sorted order."""
    return F.array_join(F.array_sort(F.col(col) if isinstance(col, str) else col), "|")


def whole(col: str) -> Column:
    return F.col(col).cast("bigint")


def since_epoch(unit: str, col: str) -> Column:
    """Whole units since 1970 by the clock on the wall, whatever the session's zone."""
    return F.timestamp_diff(unit, F.lit("1970-01-01").cast("timestamp_ntz"), F.col(col).cast("timestamp_ntz"))
