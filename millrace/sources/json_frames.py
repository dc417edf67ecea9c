"""Records from and to JSON text, and the stamps a tap puts on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.paths import quoted
from millrace.options import FlowOptions
from millrace.plans.frame import SOURCE_ID, Frame


def from_json_frames(df: DataFrame, column: str, schema: str | T.DataType, bad: str | None = None) -> DataFrame:
    """Parse one JSON text column in place. A schema keeps the fields it names; ``"variant"``
    keeps every key. Text that is not JSON becomes NULL, and its copy goes to the column
    ``bad`` if one is named."""
    text = quoted(column)
    out = df if bad is None else df.withColumn(bad, F.when(text.isNotNull() & F.try_parse_json(text).isNull(), text))
    parsed = F.try_parse_json(text) if schema == "variant" else F.from_json(text, schema)
    return out.withColumn(column, parsed)


def to_json_frames(df: DataFrame, column: str = "event") -> DataFrame:
    """Each record's event as JSON text in ``column``. NULL fields are left out."""
    return Frame.of(df, FlowOptions()).to_json().withColumnRenamed("event", column)


def stamp_source(df: DataFrame, source_id: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Say where records come from: a ``source`` column with ``sourceId`` and ``tags``."""
    marks = F.array(*[F.lit(t) for t in tags or []]).cast("array<string>")
    return df.withColumn(
        "source",
        F.struct(F.lit("undefined" if source_id is None else source_id).alias("sourceId"), marks.alias("tags")),
    )


def to_envelope(df: DataFrame, id: Column | str = "id", value: str = "value", source: str = "source") -> DataFrame:
    """Wrap raw records for a gate. A table that already has ``event`` and ``ctx`` passes
    unchanged. ``id`` has to be unique per source."""
    if {"event", "ctx"} <= set(df.columns):
        return df
    number = (quoted(id) if isinstance(id, str) else id).cast("long")
    rest = [quoted(c) for c in df.columns if c not in {value, source, id if isinstance(id, str) else None}]
    event = F.struct(
        F.array(F.lit("source")).alias("tags"),
        number.alias("id"),
        quoted(value).alias("value"),
        quoted(source).alias("source"),
    )
    ctx = F.struct(number.cast("string").alias(SOURCE_ID))
    return df.select(event.alias("event"), ctx.alias("ctx"), *rest)
