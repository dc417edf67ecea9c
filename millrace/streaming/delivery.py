"""Sinks that keep nothing, and one input delivered to many sinks."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.errors import FlowConfigError
from millrace.sources import storage
from millrace.streaming.gates import INGEST_TS, PLACE, as_frames, declare, publish, stream_batch

LOG = logging.getLogger("millrace.delivery")

# A sink takes the records of one batch and the batch's name, by which it can tell a
# repeated delivery. :func:`fan_out` gives names that no other stream's batches have.
Sink = Callable[[DataFrame, int | str], None]


def gate_sink(name: str, root: str, producer: str) -> Sink:
    """Sink that puts each batch into a gate once."""

    def deliver(rows: DataFrame, batch: int | str) -> None:
        frames = as_frames(rows)
        declare(rows.sparkSession, name, root, producer, frames.drop(INGEST_TS, *PLACE).schema)
        publish(frames, name, root, producer, batch)

    return deliver


def blackhole_sink(rows: DataFrame, batch: int | str) -> None:
    """Sink that reads everything and keeps nothing."""
    rows.write.format("noop").mode("overwrite").save()


def write_blackhole(
    df: DataFrame,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    query_name: str | None = None,
) -> StreamingQuery | None:
    """Compute every record and keep none."""
    if not df.isStreaming:
        blackhole_sink(df, 0)
        return None
    writer = df.writeStream.format("noop")
    if checkpoint is not None:
        writer = writer.option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


class _Ledger:
    """Which sinks have had which batch: small files beside the stream's checkpoint."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder = spark, folder
        self.had: set[tuple[str, str]] = set()

    def _file(self, sink: str, batch: int | str) -> str:
        return f"{self.folder}/{quote(sink, safe='')}/{quote(str(batch), safe='')}"

    def has(self, sink: str, batch: int | str) -> bool:
        if self.folder is None:
            return (sink, str(batch)) in self.had
        return storage.exists(self.spark, self._file(sink, batch))

    def note(self, sink: str, batch: int | str) -> None:
        if self.folder is None:
            self.had.add((sink, str(batch)))
        else:
            storage.create_once(self.spark, self._file(sink, batch), "")

    def forget(self, sinks: list[str], batch: int | str) -> None:
        """A stream that has finished a batch never comes back to one before it."""
        for sink in sinks:
            if self.folder is not None:
                storage.delete(self.spark, self._file(sink, batch))


def fan_out(
    df: DataFrame,
    sinks: list[Sink] | dict[str, Sink],
    checkpoint: str | None = None,
    batch: str | None = None,
    trigger: dict | None = None,
    query_name: str | None = None,
    cache: bool = True,
    attempts: int = 1,
    pause: float = 5,
) -> StreamingQuery | None:
    """Deliver every record to every sink.

    A batch counts as done when all sinks have it. Each sink is acknowledged by itself: while one
    fails the others still get the batch, and only those that failed get it again, up to
    ``attempts`` times after ``pause`` seconds each and then when the stream is started anew.
    Sinks are told apart by their names, in a list by their places. ``cache`` keeps a batch for
    the second and later sinks; turn it off where reading twice is cheaper than spilling.
    Consumers that come and go should rather read a gate, each with its own checkpoint.
    """
    named = dict(sinks) if isinstance(sinks, dict) else {str(k): sink for k, sink in enumerate(sinks)}
    if not named:
        raise FlowConfigError("Nobody to deliver to: give at least one sink")
    ledger = _Ledger(df.sparkSession, f"{checkpoint.rstrip('/')}/acknowledged" if checkpoint else None)

    def once(rows: DataFrame, name: int | str, number: int | str) -> Exception | None:
        failed = None
        for key, sink in named.items():
            if ledger.has(key, number):
                continue
            try:
                sink(rows, name)
            except Exception as problem:
                LOG.warning("Sink %s failed on batch %s: %s", key, name, problem)
                failed = failed or problem
            else:
                ledger.note(key, number)
        return failed

    def deliver(rows: DataFrame, number: int | str) -> None:
        waiting = [key for key in named if not ledger.has(key, number)]
        keep = cache and len(waiting) > 1
        if keep:
            rows = rows.persist()
        name = stream_batch(rows.sparkSession, checkpoint, number) if df.isStreaming else number
        try:
            for attempt in range(attempts):
                if attempt:
                    time.sleep(pause)
                failed = once(rows, name, number)
                if failed is None:
                    break
            else:
                raise failed
        finally:
            if keep:
                rows.unpersist()
        if df.isStreaming:
            ledger.forget(list(named), number - 1)

    if not df.isStreaming:
        deliver(df, batch or uuid.uuid4().hex)
        return None
    if checkpoint is None:
        raise FlowConfigError("A stream to many sinks needs a checkpoint")
    writer = df.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
