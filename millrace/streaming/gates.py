"""Gates: named, durable hubs that many producers write and every consumer reads whole.

A gate is a folder of Parquet files and a log of commits that says which of them count::

    <root>/gates/<id>/log/...               numbered commits, see millrace.sources.commit_log
    <root>/gates/<id>/data/ingest_date=.../producer=.../batch=.../attempt=.../part-*.parquet
    <root>/gates/<id>/compacted/<day>/...   days whose batches were put together
    <root>/gates/<id>/schema/<producer>-<n>.json   what each producer writes
    <root>/gates/<id>/commits/<producer>/<batch>   the first attempt at each batch

A batch is known by its producer and a name that no other batch has: for a stream the id
that Spark gave its query (kept in its checkpoint) and the batch number. So a batch that is
delivered again is left alone, while a flow that was removed and added again, or another
stream of the same producer, delivers batches of its own. Each attempt writes a folder of its
own, which nobody reads until a commit names it. The first attempt notes the day and how long
the log was then; whoever commits has read all that came after, and a number is taken only
once, so of several attempts one counts. Nothing is listed that grows with a gate's history.
"""

from __future__ import annotations

import datetime
import json
import logging
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.errors import FlowConfigError
from millrace.functions.paths import safe_id
from millrace.options import FlowOptions
from millrace.plans.frame import Frame
from millrace.sources import storage
from millrace.sources.commit_log import COMMIT, EVERY, CommitLog, Entry, State, register_gate

INGEST_TS = "ingest_ts"
PLACE = ("ingest_date", "producer", "batch")
PLACE_SCHEMA = [
    T.StructField("ingest_date", T.DateType()),
    T.StructField("producer", T.StringType()),
    T.StructField("batch", T.StringType()),
]

LOG = logging.getLogger("millrace.gates")
#: How often a stream looks whether a closed gate is open again.
CLOSED_POLL_SECONDS = 1.0


class GateClosed(RuntimeError):
    """The gate takes no records now."""


def gate_path(root: str, name: str) -> str:
    if not name or not name.strip():
        raise FlowConfigError("A gate needs a name that is not blank")
    return f"{root.rstrip('/')}/gates/{safe_id(name)}"


def as_frames(df: DataFrame) -> DataFrame:
    """``event`` and ``ctx`` columns of any table; an envelope keeps its own."""
    return Frame.of(df, FlowOptions()).to_envelope()


# -- schema ----------------------------------------------------------------------------


def _nullable(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_nullable(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(_nullable(dtype.keyType), _nullable(dtype.valueType))
    return dtype


def merge_schemas(a: T.StructType, b: T.StructType, where: str = "") -> T.StructType:
    """Fields of both; one field cannot have two types."""
    fields = {f.name: f.dataType for f in a.fields}
    for f in b.fields:
        old = fields.get(f.name)
        if isinstance(old, T.StructType) and isinstance(f.dataType, T.StructType):
            fields[f.name] = merge_schemas(old, f.dataType, f"{where}{f.name}.")
        elif old is not None and old.simpleString() != f.dataType.simpleString():
            raise FlowConfigError(
                f"Field {where}{f.name} is {f.dataType.simpleString()}, but the gate has {old.simpleString()}"
            )
        else:
            fields.setdefault(f.name, f.dataType)
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def gate_schema(spark: SparkSession, name: str, root: str) -> T.StructType | None:
    """What the gate's producers have declared; None before the first."""
    declared = storage.matching(spark, f"{gate_path(root, name)}/schema/*")
    if not declared:
        return None
    merged = T.StructType([])
    for path in declared:  # a few small files per producer
        merged = merge_schemas(merged, T.StructType.fromJson(json.loads(storage.read_text(spark, path))))
    return merged


def declare(spark: SparkSession, name: str, root: str, producer: str, schema: T.StructType) -> None:
    """Register a producer's schema; it has to agree with those of the others."""
    schema = _nullable(schema)
    known = gate_schema(spark, name, root)
    if known is not None:
        if merge_schemas(known, schema).simpleString() == known.simpleString():
            return
    storage.write_text(
        spark, f"{gate_path(root, name)}/schema/{quote(producer, safe='')}-{uuid.uuid4().hex}.json", schema.json()
    )


# -- state -----------------------------------------------------------------------------


def set_open(spark: SparkSession, name: str, root: str, is_open: bool) -> None:
    """Open or close a gate for all producers."""
    marker = f"{gate_path(root, name)}/closed"
    if is_open:
        storage.delete(spark, marker)
    else:
        storage.write_text(spark, marker, "")


def is_open(spark: SparkSession, name: str, root: str) -> bool:
    return not storage.exists(spark, f"{gate_path(root, name)}/closed")


# -- writing ---------------------------------------------------------------------------


def wait_open(spark: SparkSession, name: str, root: str, seconds: float | None = None, query: str | None = None) -> None:
    """Wait for a closed gate: for so many seconds, or until it opens or ``query`` is stopped."""
    give_up = None if seconds is None else time.monotonic() + seconds
    while not is_open(spark, name, root):
        if give_up is not None and time.monotonic() >= give_up:
            raise GateClosed(f"Gate {name!r} is closed")
        if query is not None and all(q.id != query for q in spark.streams.active):
            raise GateClosed(f"Gate {name!r} is closed, and its writer was stopped")
        time.sleep(CLOSED_POLL_SECONDS)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave a stream's query."""
    return json.loads(storage.read_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]


def stream_batch(spark: SparkSession, checkpoint: str, number: int | str) -> str:
    """Name of a stream's batch: its query's own id and the number."""
    return f"{query_id(spark, checkpoint)}.{number}"


def gate_log(spark: SparkSession, name: str, root: str) -> CommitLog:
    return CommitLog(gate_path(root, name), storage.SparkStore(spark))


def _claimed(spark: SparkSession, claim: str, today: str, head: Callable[[], int]) -> tuple[str, int]:
    """Day and length of the log as the first attempt at a batch has noted them."""
    text = f"{today} {head()}"
    if not storage.create_once(spark, claim, text):
        for _ in range(20):
            if known := storage.read_text(spark, claim):
                text = known
                break
            time.sleep(0.1)
        else:
            storage.write_text(spark, claim, text)  # the first attempt died before it wrote
    day, _, length = text.partition(" ")
    return day, int(length or 0)


def _append(spark: SparkSession, log: CommitLog, entry: Entry, after: int, clashes: Callable[[Entry], bool]) -> int | None:
    """Commit an entry as the next one; None if a commit after ``after`` rules it out."""
    while True:
        for known in log.entries(after):
            if clashes(known):
                return None
            after = known.number
        entry.number, entry.time = after + 1, time.time()
        if storage.put_once(spark, log.file(entry.number), json.dumps(asdict(entry))):
            break
    if entry.number - log.newest_snapshot() >= EVERY:
        state = log.state()
        storage.put_once(spark, log.snapshot_file(state.number), state.dump())
    return entry.number


def _in_compacted(spark: SparkSession, log: CommitLog, after: int, producer: str, batch: str) -> bool:
    """Whether a batch that was first tried long ago is in a gate: by what there is now."""
    for entry in log.state().live.values():
        if (entry.producer, entry.batch) == (producer, batch):
            return True
        if entry.compacted and entry.high > after:
            rows = spark.read.parquet(f"{log.gate}/{entry.path}")
            if not rows.where((F.col("producer") == producer) & (F.col("batch") == batch)).isEmpty():
                return True
    return False


@contextmanager
def _whole_variants(spark: SparkSession, schema: T.StructType):
    """Write VARIANT fields unshredded: readers outside Spark's own Parquet reader know no other form."""
    key = "spark.sql.variant.writeShredding.enabled"
    before = spark.conf.get(key, None)
    if "variant" not in schema.simpleString() or before == "false":
        yield
        return
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def publish(df: DataFrame, name: str, root: str, producer: str, batch: int | str) -> bool:
    """Put one batch of frames into a gate, once. False if it is there already. ``batch``
    has to be a name that no other batch of the producer has."""
    spark, log, batch = df.sparkSession, gate_log(df.sparkSession, name, root), str(batch)
    if not is_open(spark, name, root):
        raise GateClosed(f"Gate {name!r} is closed")
    sender, label = quote(producer, safe=""), quote(batch, safe="")
    now = datetime.datetime.now(datetime.timezone.utc)
    day, after = _claimed(spark, f"{log.gate}/commits/{sender}/{label}", str(now.date()), log.head)

    def same(known: Entry) -> bool:
        return (known.producer, known.batch) == (producer, batch)

    snapshot = log.newest_snapshot()
    known = _in_compacted(spark, log, after, producer, batch) if after < snapshot else any(map(same, log.entries(after)))
    if known:
        LOG.info("Gate %s has batch %s of %s already", name, batch, producer)
        return False
    path = f"data/ingest_date={day}/producer={sender}/batch={label}/attempt=a{uuid.uuid4().hex}"
    stamped = df.drop(*PLACE).withColumn(INGEST_TS, F.timestamp_micros(F.lit(int(now.timestamp() * 1e6))))
    with _whole_variants(spark, stamped.schema):
        stamped.write.parquet(f"{log.gate}/{path}")
    entry = Entry(0, day, path, storage.folder_size(spark, f"{log.gate}/{path}"), producer, batch)
    if _append(spark, log, entry, max(after, snapshot), same) is None:  # another attempt was faster
        storage.delete(spark, f"{log.gate}/{path}")
        return False
    return True


def write_gate(
    df: DataFrame,
    name: str,
    root: str,
    producer: str = "main",
    batch: str | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    query_name: str | None = None,
    closed_wait: float | None = None,
    output_mode: str = "append",
) -> StreamingQuery | None:
    """Write records to a gate.

    A batch DataFrame is written at once; give it a ``batch`` name if the write may be
    tried again (the same producer and name are the same batch). A stream needs a
    ``checkpoint`` and gives its query back; each of its micro-batches arrives exactly once,
    also after a restart. While the gate is closed a stream waits until it opens, or only
    ``closed_wait`` seconds and then fails with :class:`GateClosed`. ``output_mode`` is that of a
    stream with state.
    """
    frames = as_frames(df)
    spark = df.sparkSession
    declare(spark, name, root, producer, frames.drop(INGEST_TS, *PLACE).schema)
    if not df.isStreaming:
        publish(frames, name, root, producer, batch or uuid.uuid4().hex)
        return None
    if checkpoint is None:
        raise FlowConfigError("A stream into a gate needs a checkpoint")

    def deliver(rows: DataFrame, number: int) -> None:
        wait_open(spark, name, root, closed_wait, query_id(spark, checkpoint))
        publish(rows, name, root, producer, stream_batch(spark, checkpoint, number))

    writer = frames.writeStream.outputMode(output_mode).foreachBatch(deliver).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


# -- reading ---------------------------------------------------------------------------


def known_schema(spark: SparkSession, name: str, root: str) -> T.StructType:
    schema = gate_schema(spark, name, root)
    if schema is None:
        raise FlowConfigError(f"Gate {name!r} has no producer yet; give its schema")
    return schema


def read_entries(spark: SparkSession, gate: str, entries: list[Entry], schema: T.StructType, span: tuple[int, int] | None = None) -> DataFrame:
    """The records of some commits, with their places. Of compacted folders, those that came
    with the commits after the first number of ``span`` up to the second."""
    stamped = T.StructType([*schema.fields, T.StructField(INGEST_TS, T.TimestampType()), *PLACE_SCHEMA])
    plain = [f"{gate}/{e.path}" for e in entries if not e.compacted]
    packed = [f"{gate}/{e.path}" for e in entries if e.compacted]
    parts = []
    if plain:
        parts.append(spark.read.schema(stamped).option("basePath", f"{gate}/data").parquet(*plain).select(*stamped.names))
    if packed:
        rows = spark.read.schema(T.StructType([*stamped.fields, T.StructField(COMMIT, T.LongType())])).parquet(*packed)
        if span is not None:
            rows = rows.where((F.col(COMMIT) > span[0]) & (F.col(COMMIT) <= span[1]))
        parts.append(rows.select(*stamped.names))
    if not parts:
        return spark.createDataFrame([], stamped)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_gate(
    spark: SparkSession,
    name: str,
    root: str,
    streaming: bool = False,
    schema: T.StructType | None = None,
    max_batches_per_trigger: int | None = None,
    since: datetime.date | str | None = None,
    with_place: bool = False,
    checkpoint: str | None = None,
) -> DataFrame:
    """All records of a gate: ``event``, ``ctx`` and ``ingest_ts``.

    Every reader sees every record; a stream keeps its own place by its own checkpoint, and
    looks only at the commits that came since. ``since`` leaves older days out before any of
    their folders is looked at. ``max_batches_per_trigger`` bounds a micro-batch; after a restart
    the first one is bounded only if the reader is given the query's ``checkpoint``.
    """
    schema = schema or known_schema(spark, name, root)
    columns = [*schema.names, INGEST_TS, *(PLACE if with_place else ())]
    gate = gate_path(root, name)
    if not streaming:
        live = gate_log(spark, name, root).state().live.values()
        wanted = [e for e in live if since is None or e.day >= str(since)]
        df = read_entries(spark, gate, wanted, schema)
        if since is not None:
            df = df.where(F.col("ingest_date") >= F.lit(since).cast("date"))
        return df.select(*columns)
    register_gate(spark)
    full = T.StructType([*schema.fields, T.StructField(INGEST_TS, T.TimestampType()), *(PLACE_SCHEMA if with_place else ())])
    return _stream(spark, gate, full, since, max_batches_per_trigger, checkpoint).load()


def _stream(spark: SparkSession, gate: str, schema: T.StructType, since, most: int | None, checkpoint: str | None, **options):
    register_gate(spark)
    uri = gate if not gate.startswith("file:/") or gate.startswith("file://") else f"file://{gate[5:]}"
    reader = spark.readStream.format("gate").option("path", uri).option("schema", schema.json())
    resume = storage.last_offset(spark, checkpoint) if checkpoint else None
    options |= {"since": since and str(since), "maxBatchesPerTrigger": most, "resumeFrom": resume}
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, value)
    return reader


def follow_gate(
    spark: SparkSession,
    name: str,
    root: str,
    deliver: Callable[[DataFrame, str], None],
    checkpoint: str,
    trigger: dict | None = None,
    query_name: str | None = None,
    since: datetime.date | str | None = None,
    max_batches: int = 1000,
    after: int = 0,
) -> StreamingQuery:
    """Call ``deliver(records, batch name)`` with each part of a gate's records, in the order of
    its commits and with at most ``max_batches`` of them.

    The records are a table that Spark's own Parquet reader reads, so conditions and columns
    reach the files; only the commit numbers are a stream. A part that comes again after
    a failure has the same records and name. A new reader starts after the commit ``after``.
    """
    log = gate_log(spark, name, root)
    span = T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])

    def each(rows: DataFrame, number: int) -> None:
        (place,) = rows.collect()
        for k, low in enumerate(range(place.low, place.high, max_batches)):
            high = min(low + max_batches, place.high)
            entries = log.between(low, high, since and str(since))
            if entries:
                frames = read_entries(spark, log.gate, entries, known_schema(spark, name, root), (low, high))
                deliver(frames.drop(*PLACE), stream_batch(spark, checkpoint, f"{number}.{k}" if k else number))

    commits = _stream(spark, log.gate, span, None, None, None, rows="span", after=after).load()
    writer = commits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


# -- compaction ------------------------------------------------------------------------


def compact_gate(spark: SparkSession, name: str, root: str, before: datetime.date | str | None = None, file_bytes: int = 128 << 20) -> int:
    """Put the batches of each day before ``before`` (today) together in files of about
    ``file_bytes``; the number of days that changed. One commit puts a day's new folder in the
    place of its batches. Records keep the numbers of their commits, so a stream that has read a
    part of the day goes on with the rest; old folders stay until :func:`clean_gate`."""
    log = gate_log(spark, name, root)
    limit = str(before or datetime.datetime.now(datetime.timezone.utc).date())
    state = log.state()
    days: dict[str, list[Entry]] = {}
    for entry in state.live.values():
        if entry.day < limit:
            days.setdefault(entry.day, []).append(entry)
    done = 0
    for day, entries in sorted(days.items()):
        if len(entries) > 1 and _compact_day(spark, log, known_schema(spark, name, root), state, day, entries, file_bytes):
            done += 1
    return done


def _compact_day(spark: SparkSession, log: CommitLog, schema: T.StructType, state: State, day: str, entries: list[Entry], file_bytes: int) -> bool:
    plain, packed = [e for e in entries if not e.compacted], [e for e in entries if e.compacted]
    parts = []
    if plain:
        # A row for each of the day's batches.
        numbers = spark.createDataFrame([(e.producer, e.batch, e.number) for e in plain], f"producer string, batch string, {COMMIT} bigint")
        parts.append(read_entries(spark, log.gate, plain, schema).join(F.broadcast(numbers), ["producer", "batch"]))
    if packed:
        parts.append(spark.read.schema(T.StructType([*read_entries(spark, log.gate, [], schema).schema.fields, T.StructField(COMMIT, T.LongType())])).parquet(*[f"{log.gate}/{e.path}" for e in packed]))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    size = sum(e.size for e in entries)
    path = f"compacted/{day}/{uuid.uuid4().hex}"
    with _whole_variants(spark, schema):
        rows.coalesce(max(1, -(-size // file_bytes))).write.parquet(f"{log.gate}/{path}")
    replaced = sorted(e.number for e in entries)
    low, high = min([e.number for e in plain] + [e.low for e in packed]), max([e.number for e in plain] + [e.high for e in packed])
    entry = Entry(0, day, path, storage.folder_size(spark, f"{log.gate}/{path}"), low=low, high=high, replaces=replaced)
    if _append(spark, log, entry, state.number, lambda known: bool(set(known.replaces) & set(replaced))) is None:
        storage.delete(spark, f"{log.gate}/{path}")  # somebody else was at it
        return False
    return True


def clean_gate(spark: SparkSession, name: str, root: str, keep_seconds: float = 7 * 86400) -> int:
    """Remove what no reader needs and is older than ``keep_seconds``: folders that were
    replaced, attempts that no commit names, their notes, and the log before a snapshot of that
    age. The number of data folders removed. No writer may take so long for one batch, nor try one
    again after so long a time."""
    log = gate_log(spark, name, root)
    state = log.state()
    if state.number > log.newest_snapshot():
        storage.put_once(spark, log.snapshot_file(state.number), state.dump())
    old = time.time() - keep_seconds

    def aged(path: str) -> bool:
        return storage.exists(spark, path) and storage.modified(spark, path) <= old

    def number(path: str) -> int:
        return int(path.rsplit("/", 1)[1].removesuffix(".json"))

    snapshots = storage.matching(spark, f"{log.gate}/log/snapshots/[0-9]*.json")
    # Writers begin at the newest snapshot, so nobody has looked before this one for as long.
    limit = max((number(f) for f in snapshots if aged(f)), default=0)
    # The log goes first: a reader that does not find a commit looks at what there is now.
    for folder in storage.matching(spark, f"{log.gate}/log/[0-9]*"):
        if number(folder) * EVERY <= limit:
            for file in storage.matching(spark, f"{folder}/[0-9]*.json"):
                if number(file) <= limit and aged(file):
                    storage.delete(spark, file)
    for file in snapshots:
        if number(file) < limit:
            storage.delete(spark, file)
    gone = [path for path, (since, own) in state.replaced.items() if since <= old and own <= limit]
    for path in gone:
        storage.delete(spark, f"{log.gate}/{path}")
    named = {e.path for e in state.live.values()} | set(state.replaced)
    stray = []
    for pattern in ("data/*/*/*/attempt=*", "compacted/*/*"):
        for path in storage.matching(spark, f"{log.gate}/{pattern}"):
            if path[path.index(f"/{pattern[:4]}") + 1 :] not in named and aged(path):
                stray.append(path)
    for path in stray:
        storage.delete(spark, path)
    for note in storage.matching(spark, f"{log.gate}/commits/*/*"):
        if aged(note):
            storage.delete(spark, note)
    if gone:
        _append(spark, log, Entry(0, "", "", removed=gone), state.number, lambda known: False)
    return len(gone) + len(stray)


def _first_of_each(keys: list[str]):
    """Of the rows of each Arrow batch with the same keys, the first."""

    def combine(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            if any(pa.types.is_nested(c.type) for c in columns):
                columns = [pa.array([repr(v) for v in c.to_pylist()]) if pa.types.is_nested(c.type) else c for c in columns]
            names = [f"k{i}" for i in range(len(keys))]
            table = pa.table([*columns, pa.array(range(len(batch)))], names=[*names, "at"])
            firsts = table.group_by(names).aggregate([("at", "min")]).column("at_min").combine_chunks()
            yield batch if len(firsts) == len(batch) else batch.take(firsts.sort())

    return combine


def drop_duplicates(
    df: DataFrame,
    keys: list[str] | None = None,
    watermark: str | None = None,
    time: str = INGEST_TS,
    combine: bool = True,
) -> DataFrame:
    """Keep one record per sender and id (``event.source.sourceId`` and ``event.id``, or
    the given columns). A stream has to say how long it remembers a key: ``watermark`` after
    it was seen. By ``ingest_ts`` nothing is late; by another ``time`` column, records that
    are later than the watermark are dropped, which Spark counts in the query's progress as
    ``numRowsDroppedByWatermark``.

    A table drops most copies before its shuffle. Spark has no such step for a stream, so here each
    task drops the copies within each of its Arrow batches first: a record that is sent a
    million times meets in one task as a hundred rows, and the stream keeps one state. ``combine``
    turns that off where copies are rare, as it takes every record through Python.
    """
    own = keys is None
    if own:
        df = df.withColumns({"x:sender": F.col("event.source.sourceId"), "x:id": F.col("event.id")})
        keys = ["x:sender", "x:id"]
    if df.isStreaming:
        if watermark is None:
            raise FlowConfigError("A stream needs a watermark: how long a key is remembered")
        out = df.mapInArrow(_first_of_each(keys), df.schema) if combine else df
        out = out.withWatermark(f"`{time}`", watermark).dropDuplicatesWithinWatermark(keys)
    else:
        out = df.dropDuplicates(keys)
    return out.drop(*keys) if own else out
