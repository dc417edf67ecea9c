"""Taps and flows as running queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.errors import FlowConfigError
from millrace.functions.paths import safe_id
from millrace.operators.log import log_records
from millrace.operators.patterns import check_pattern
from millrace.plans.flow import load_config, parse_flow, transform
from millrace.sources import storage
from millrace.sources.files import cursor_place, keep_inventory
from millrace.sources.json_frames import stamp_source, to_envelope
from millrace.sources.tail import register_tail
from millrace.streaming.delivery import blackhole_sink, write_blackhole
from millrace.streaming.gates import (
    INGEST_TS,
    PLACE,
    as_frames,
    declare,
    follow_gate,
    gate_path,
    known_schema,
    publish,
    query_id,
    read_entries,
    stream_batch,
    wait_open,
)


def checkpoint_path(root: str, kind: str, name: str) -> str:
    return f"{root.rstrip('/')}/checkpoints/{kind}-{safe_id(name)}"


def run_flow(
    spark: SparkSession,
    name: str,
    config: dict | str,
    root: str,
    trigger: dict | None = None,
    max_batches: int = 1000,
    closed_wait: float | None = None,
    log_gate: str | None = None,
    **options,
) -> StreamingQuery:
    """Start a flow: follow its gate, apply its pipeline, write its sink.

    The whole config is checked and planned before anything starts. Each part of at most
    ``max_batches`` of the gate's batches is read, transformed and written as a table of its own.
    With ``log_gate``, the records that meet a ``log`` step go to that gate, as part of the same
    batch; else they are counted.
    """
    flow = parse_flow(config)
    checkpoint = checkpoint_path(root, "flow", name)
    producer = f"flow_{name}"
    stamped = read_entries(spark, gate_path(root, flow.tap.gate), [], known_schema(spark, flow.tap.gate, root)).drop(*PLACE)
    planned = transform(stamped, flow.pipeline, "envelope", **options)
    if flow.sink.kind == "gate":
        declare(spark, flow.sink.gate, root, producer, as_frames(planned.df).drop(INGEST_TS, *PLACE).schema)
    if log_gate is not None:
        declare(spark, log_gate, root, producer, as_frames(log_records(spark, planned.logs)).schema)

    def deliver(frames: DataFrame, batch: str) -> None:
        result = transform(frames, flow.pipeline, "envelope", **options)
        gates = [g for g in (log_gate, flow.sink.gate) if g is not None]
        for gate in gates:
            wait_open(spark, gate, root, closed_wait, query_id(spark, checkpoint))
        if log_gate is not None:
            publish(as_frames(log_records(spark, result.logs)), log_gate, root, producer, batch)
        if flow.sink.kind == "blackhole":
            blackhole_sink(result.df, batch)
        elif not publish(as_frames(result.df), flow.sink.gate, root, producer, batch):
            return  # it was there: nothing ran, so there is nothing to count
        for step in result.logs:
            step.report()

    return follow_gate(spark, flow.tap.gate, root, deliver, checkpoint, trigger, f"flow_{safe_id(name)}", max_batches=max_batches)


def _tap_parts(config: dict) -> tuple[dict, str, list, str | None]:
    source = config.get("source")
    if not isinstance(source, dict) or source.get("class") != "file":
        raise FlowConfigError(f"source: a tap reads the class 'file' only, got {source}")
    target = (source.get("props") or {}).get("target") or {}
    for key in ("directory", "mainPattern", "rollPattern"):
        if not isinstance(target.get(key), str):
            raise FlowConfigError(f"source.props.target.{key}: expected a text, got {target}")
    stamps = config.get("preprocessing") if isinstance(config.get("preprocessing"), dict) else {}
    source_id = stamps.get("sourceId") if isinstance(stamps.get("sourceId"), str) else "undefined"
    tags = stamps.get("tags") if isinstance(stamps.get("tags"), list) else []
    return target, source_id, tags, _tap_gate(config.get("endpoint"))


def _tap_gate(endpoint) -> str | None:
    """Gate a tap writes to: by name, or the last part of its address. Any other endpoint
    takes the records and keeps none."""
    endpoint = endpoint if isinstance(endpoint, dict) else {}
    props = endpoint.get("props") if isinstance(endpoint.get("props"), dict) else {}
    key = {"gate": "name", "akka": "url"}.get(endpoint.get("class"))
    if key is None:
        return None
    value = props.get(key)
    if not isinstance(value, str) or not value.strip("/ "):
        raise FlowConfigError(f"endpoint.props.{key}: expected the name of a gate, got {props}")
    return value.rstrip("/").rsplit("/", 1)[-1]


def tap_stream(
    spark: SparkSession, config: dict | str, checkpoint: str | None = None, cursor: str | None = None, catalogue: str | None = None, **reader_options
) -> DataFrame:
    """A tap's records, stamped with their source: ``value``, ``source``, ``file``,
    ``start_pos``, ``end_pos``, ``seq``.

    A new tap may start at a saved ``cursor``. Its file is looked up in the index that is kept in
    the folder ``catalogue`` (:func:`millrace.keep_inventory`), which is brought up to date
    first; a file that is not there any more stands for the first known one.
    """
    target, source_id, tags, _ = _tap_parts(load_config(config))
    for key in ("mainPattern", "rollPattern"):
        check_pattern(spark, target[key])
    register_tail(spark)
    reader = spark.readStream.format("tail").option("path", target["directory"])
    reader = reader.option("mainPattern", target["mainPattern"]).option("rollPattern", target["rollPattern"])
    for key, value in reader_options.items():
        reader = reader.option(key, value)
    if cursor is not None and catalogue is None:
        raise FlowConfigError("A cursor names a file by its number: give the folder of the file index")
    if catalogue is not None:
        known = keep_inventory(spark, target["directory"], target["mainPattern"], target["rollPattern"], catalogue)
        if cursor is not None:
            name, chars = cursor_place(known, cursor) or ("", 0)
            reader = reader.option("cursorFile", name).option("cursorChars", chars)
    resume = storage.last_offset(spark, checkpoint) if checkpoint else None
    if resume is not None:
        reader = reader.option("resumeFrom", resume)
    return stamp_source(reader.load(), source_id, [str(t) for t in tags])


def run_tap(
    spark: SparkSession,
    name: str,
    config: dict | str,
    root: str,
    trigger: dict | None = None,
    closed_wait: float | None = None,
    **reader_options,
) -> StreamingQuery:
    """Start a tap: follow its files and put each line, in an envelope, into its gate.

    The checkpoint is the tap's cursor: it moves on when the gate has the records. A record's
    id is its ``seq``, which no other record of the tap has. While the gate is closed the tap
    waits for it, or only ``closed_wait`` seconds.
    """
    config = load_config(config)
    _, _, _, gate = _tap_parts(config)
    checkpoint = checkpoint_path(root, "tap", name)
    lines = tap_stream(spark, config, checkpoint, **reader_options)
    query_name = f"tap_{safe_id(name)}"
    if gate is None:
        return write_blackhole(lines, checkpoint, trigger, query_name)
    producer = f"tap_{name}"

    def frames_of(rows: DataFrame) -> DataFrame:
        return as_frames(to_envelope(rows.withColumnRenamed("seq", "id")))

    declare(spark, gate, root, producer, frames_of(lines).schema)

    def deliver(rows: DataFrame, batch: int) -> None:
        wait_open(spark, gate, root, closed_wait, query_id(spark, checkpoint))
        publish(frames_of(rows), gate, root, producer, stream_batch(spark, checkpoint, batch))

    writer = lines.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).queryName(query_name)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
