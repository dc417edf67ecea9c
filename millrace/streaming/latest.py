"""The newest update of each subject, for all time or per tick, and its replay to who joins late."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.errors import FlowConfigError
from millrace.functions.paths import quoted
from millrace.sources import storage
from millrace.streaming.gates import follow_gate, gate_log, query_id, write_gate


def _newest(values: list[str], order: list[str]) -> list[Column]:
    """Columns of the row with the greatest ``order``."""
    rank = quoted(order[0]) if len(order) == 1 else F.struct(*[quoted(c) for c in order])
    if len(values) == 1:
        return [F.max_by(quoted(values[0]), rank).alias(values[0])]
    # One ordering pass for all columns, so that they come from one row.
    return [F.max_by(F.struct(*[quoted(v) for v in values]), rank).alias("x:newest")]


def _unpack(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    if len(values) == 1:
        return df
    return df.select(*[quoted(k) for k in keys], *[F.col("`x:newest`").getField(v).alias(v) for v in values])


def latest_by_key(df: DataFrame, keys: list[str], order: list[str], values: list[str] | None = None) -> DataFrame:
    """Last row per key. ``order`` should be unique per key, as by time and id.

    Rows are reduced to one per key before the shuffle, so a key that holds a third of
    the table costs no more than any other. As a stream: write in ``update`` mode.
    """
    values = values or [c for c in df.columns if c not in keys]
    out = df.groupBy(*[quoted(k) for k in keys]).agg(*_newest(values, order))
    return _unpack(out, keys, values)


def conflate(
    df: DataFrame,
    keys: list[str],
    time: str,
    order: list[str],
    values: list[str] | None = None,
    tick: str = "200 milliseconds",
    watermark: str | None = None,
) -> DataFrame:
    """Last row per key within each tick; adds ``tick_start``.

    On a stream without a ``watermark`` no row is ever late: ticks stay open and their state
    is kept; write in ``update`` mode. With one, ticks older than it are closed and late rows
    for them are dropped, which Spark counts as ``numRowsDroppedByWatermark``."""
    values = values or [c for c in df.columns if c not in keys]
    if df.isStreaming:
        # Watermarks take no timestamp without a zone.
        df = df.withColumn("x:time", quoted(time).cast("timestamp"))
        df = df if watermark is None else df.withWatermark("`x:time`", watermark)
    else:
        df = df.withColumn("x:time", quoted(time))
    out = df.groupBy(*[quoted(k) for k in keys], F.window(F.col("`x:time`"), tick).alias("x:tick")).agg(
        *_newest(values, order)
    )
    out = out.withColumn("tick_start", F.col("`x:tick`.start")).drop("x:tick")
    return _unpack(out, [*keys, "tick_start"], values)


def publish_latest(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    name: str,
    root: str,
    checkpoint: str,
    producer: str = "latest",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the last row per key of a stream, and put each batch's changes into a gate. The state
    of the query is the table of all last rows, which :func:`replay_latest` reads."""
    if not df.isStreaming:
        raise FlowConfigError("Latest values are published from a stream")
    return write_gate(latest_by_key(df, keys, order, values), name, root, producer, checkpoint=checkpoint, trigger=trigger, output_mode="update")


def latest_snapshot(spark: SparkSession, checkpoint: str, keys: list[str], values: list[str], batch: int | None = None) -> DataFrame:
    """The last rows that a :func:`publish_latest` query held after a batch (its last whole one),
    from its state store."""
    batch = last_batch(spark, checkpoint) if batch is None else batch
    state = spark.read.format("statestore").option("batchId", batch).load(checkpoint)
    newest = F.col("value").getField(state.schema["value"].dataType.names[0])
    picked = [newest.alias(values[0])] if len(values) == 1 else [newest.getField(v).alias(v) for v in values]
    return state.select(*[F.col("key").getField(k).alias(k) for k in keys], *picked)


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """Number of the last batch that a query has finished."""
    done = [int(p.rsplit("/", 1)[1]) for p in storage.matching(spark, f"{checkpoint}/commits/[0-9]*")]
    if not done:
        raise FlowConfigError(f"The query at {checkpoint} has finished no batch yet")
    return max(done)


def replay_latest(
    spark: SparkSession,
    name: str,
    root: str,
    published: str,
    keys: list[str],
    values: list[str],
    deliver: Callable[[DataFrame, str], None],
    checkpoint: str,
    trigger: dict | None = None,
    query_name: str | None = None,
    producer: str = "latest",
) -> StreamingQuery:
    """Give a consumer that joins late the last row of every key as it is now (batch name
    ``snapshot``), then each later change from the gate. ``published`` is the checkpoint of the
    query that keeps the rows. Started anew, it goes on where it was: the snapshot comes once, or
    again under its name if the consumer failed on it."""
    note = f"{checkpoint.rstrip('/')}-joined"
    columns = [*keys, *values]
    if not storage.exists(spark, note):
        last, query = last_batch(spark, published), query_id(spark, published)
        # Commits that the snapshot has in it. Days that were compacted are older than it.
        held = [e.high for e in gate_log(spark, name, root).state().live.values() if e.compacted]
        for entry in gate_log(spark, name, root).state().live.values():
            if entry.producer == producer and entry.batch.startswith(f"{query}.") and int(entry.batch.rsplit(".", 1)[1]) <= last:
                held.append(entry.number)
        storage.put_once(spark, note, json.dumps({"batch": last, "after": max(held, default=0)}))
    joined = json.loads(storage.read_text(spark, note))
    if not storage.exists(spark, f"{note}-done"):
        deliver(latest_snapshot(spark, published, keys, values, joined["batch"]).select(*columns), "snapshot")
        storage.create_once(spark, f"{note}-done", "")

    def changes(frames: DataFrame, batch: str) -> None:
        deliver(frames.select("event.*").select(*columns), batch)

    return follow_gate(spark, name, root, changes, checkpoint, trigger, query_name, after=joined["after"])
