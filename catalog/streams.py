"""Streams over the given tables: gates, taps, delivery and state by key."""

from __future__ import annotations

from pyspark.sql import functions as F

import millrace as m
from catalog.files import MAIN, SUMMARY_SQL, _log_folder, _log_lines, _summary
from catalog.flows import FLAGSHIP, FLAGSHIP_SQL, flagship_columns
from catalog.steps import drop, enrich, field, log, since_epoch, table
from millrace.sources import storage

QUERIES = {}
ORACLE = {}
NOW = {"availableNow": True}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def _event_stream(spark, sf, files: int = 3):
    """The events as several files, one per micro-batch."""
    folder = storage.new_folder(spark, "events")
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(files).write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _finish(query):
    query.awaitTermination()
    return query


def _updates(df, keys):
    """Run a stream in update mode and keep the last update of each key."""
    spark = df.sparkSession
    folder = storage.new_folder(spark, "updates")

    def keep(rows, batch):
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/of={batch}")

    writer = df.writeStream.outputMode("update").foreachBatch(keep)
    _finish(writer.option("checkpointLocation", storage.new_folder(spark, "cp")).trigger(**NOW).start())
    seen = spark.read.parquet(folder).drop("of")
    values = [c for c in df.columns if c not in keys]
    return m.latest_by_key(seen, keys, ["batch"], values)


@query("SELECT event_id, event_type, user_id, props FROM events")
def gate_stream_roundtrip(spark, sf):
    """A stream into a gate, and the gate as a stream into a second one."""
    root = storage.new_folder(spark, "root")
    events = _event_stream(spark, sf)
    _finish(m.write_gate(events, "a", root, checkpoint=f"{root}/cp-a", trigger=NOW))
    again = m.read_gate(spark, "a", root, streaming=True, max_batches_per_trigger=2)
    _finish(m.write_gate(again, "b", root, checkpoint=f"{root}/cp-b", trigger=NOW))
    return m.read_gate(spark, "b", root).select("event.event_id", "event.event_type", "event.user_id", "event.props")


@query("SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events")
def gate_two_producers(spark, sf):
    """Two producers of one gate; a batch that comes again is not written again."""
    root = storage.new_folder(spark, "root")
    events = table(spark, sf, "events").select("event_id", "event_type")
    for producer in ("one", "two", "two"):
        m.write_gate(events, "g", root, producer=producer, batch="0")
    return m.read_gate(spark, "g", root).select("event.event_id", "event.event_type")


@query(
    """SELECT sink, event_type, count(*) AS n FROM events, (VALUES ('left'), ('right')) s(sink)
       GROUP BY sink, event_type"""
)
def fan_out(spark, sf):
    """One stream to two gates and a blackhole."""
    root = storage.new_folder(spark, "root")
    sinks = [m.gate_sink("left", root, "p"), m.gate_sink("right", root, "p"), m.blackhole_sink]
    _finish(m.fan_out(_event_stream(spark, sf), sinks, checkpoint=f"{root}/cp", trigger=NOW))
    both = [m.read_gate(spark, g, root).select(F.lit(g).alias("sink"), "event.event_type") for g in ("left", "right")]
    return both[0].unionAll(both[1]).groupBy("sink", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events")
def gate_compacted(spark, sf):
    """A reader that has had a part of a gate when its days are compacted and the old folders
    removed: each record comes to it once."""
    root = storage.new_folder(spark, "root")
    events = _event_stream(spark, sf, 6).select("event_id", "event_type")
    _finish(m.write_gate(events, "in", root, checkpoint=f"{root}/cp-in", trigger=NOW))
    parts = [m.read_gate(spark, "in", root, streaming=True, max_batches_per_trigger=2, checkpoint=f"{root}/cp")]
    _finish(m.write_gate(parts[0], "out", root, checkpoint=f"{root}/cp", trigger=NOW))
    m.compact_gate(spark, "in", root, before="9999-12-31")
    m.clean_gate(spark, "in", root, keep_seconds=0)
    rest = m.read_gate(spark, "in", root, streaming=True, checkpoint=f"{root}/cp")
    _finish(m.write_gate(rest, "out", root, checkpoint=f"{root}/cp", trigger=NOW))
    return m.read_gate(spark, "out", root).select("event.event_id", "event.event_type")


@query(
    """SELECT 'audit' AS logger, 'WARN' AS level, event_id, event_type FROM events WHERE event_type = 'error'
       UNION ALL SELECT 'default', 'INFO', event_id, event_type FROM events WHERE event_type <> 'view'"""
)
def log_records(spark, sf):
    """Every record that meets a ``log`` step, in a gate of its own beside the flow's sink."""
    root = storage.new_folder(spark, "root")
    m.write_gate(table(spark, sf, "events").select("event_id", "event_type"), "in", root, producer="p", batch="0")
    config = {
        "tap": {"class": "gate", "props": {"name": "in"}},
        "pipeline": [
            log(logger="audit", level="warn", when=field("event_type", is_="^error$")),
            drop(field("event_type", is_="^view$")),
            log(),
        ],
        "sink": {"class": "gate", "props": {"name": "out"}},
    }
    _finish(m.run_flow(spark, "logged", config, root, trigger=NOW, log_gate="log"))
    seen = m.read_gate(spark, "log", root).select("event.logger", "event.level", F.from_json("event.record", "event_id long, event_type string").alias("r"))
    return seen.select("logger", "level", "r.event_id", "r.event_type")


@query("SELECT user_id, max_by(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_replay(spark, sf):
    """A consumer that joins when half of the events are through: the last event of each user
    as it is then, and the changes after it, make the last event of each user."""
    root = storage.new_folder(spark, "root")
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = events.agg(F.max("event_id")).first()[0] // 2
    folder = storage.new_folder(spark, "events")
    seen = []

    def keep(rows, batch):
        part = storage.new_folder(spark, "seen")
        rows.withColumn("at", F.lit(len(seen))).write.parquet(part)
        seen.append(part)

    for k, half in enumerate((events.where(F.col("event_id") <= cut), events.where(F.col("event_id") > cut))):
        half.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        _finish(m.publish_latest(stream, ["user_id"], ["ts", "event_id"], ["event_id", "ts"], "latest", root, f"{root}/cp-latest", trigger=NOW))
        _finish(m.replay_latest(spark, "latest", root, f"{root}/cp-latest", ["user_id"], ["event_id", "ts"], keep, f"{root}/cp-late", NOW))
    return m.latest_by_key(spark.read.parquet(*seen), ["user_id"], ["at"], ["event_id"])


@query(FLAGSHIP_SQL)
def flow_stream(spark, sf):
    """The flagship flow, gate to gate, as a running query."""
    root = storage.new_folder(spark, "root")
    _finish(m.write_gate(_event_stream(spark, sf), "in", root, checkpoint=f"{root}/cp", trigger=NOW))
    config = {
        "tap": {"class": "gate", "props": {"name": "in"}},
        "pipeline": FLAGSHIP,
        "sink": {"class": "gate", "props": {"name": "out"}},
    }
    _finish(m.run_flow(spark, "flagship", config, root, trigger=NOW))
    return flagship_columns(m.read_gate(spark, "out", root).select("event.*"))


@query(
    """SELECT event_type, event_id FROM events WHERE event_type <> 'view'
       UNION ALL SELECT event_type, event_id FROM events WHERE event_type = 'view'"""
)
def flow_readded(spark, sf):
    """A flow that is removed and added again under its name delivers both its outputs whole."""
    root = storage.new_folder(spark, "root")
    m.write_gate(table(spark, sf, "events").select("event_id", "event_type"), "in", root, producer="p", batch="0")
    flows = m.FlowRegistry(spark, root, trigger=NOW)
    for step in (drop(field("event_type", is_="^view$")), drop(field("event_type", isnot="^view$"))):
        config = {
            "tap": {"class": "gate", "props": {"name": "in"}},
            "pipeline": [step],
            "sink": {"class": "gate", "props": {"name": "out"}},
        }
        flows.add("f", config)
        _finish(flows.start("f"))
        flows.remove("f")
    return m.read_gate(spark, "out", root).select("event.event_type", "event.event_id")


@query("SELECT event_id FROM events UNION ALL SELECT event_id FROM events UNION ALL SELECT event_id FROM events")
def gate_two_streams(spark, sf):
    """Two streams of one producer name, and one of a name that only looks alike."""
    root = storage.new_folder(spark, "root")
    for k, producer in enumerate(("a-b", "a-b", "a_b")):
        events = _event_stream(spark, sf).select("event_id")
        _finish(m.write_gate(events, "g", root, producer=producer, checkpoint=f"{root}/cp{k}", trigger=NOW))
    return m.read_gate(spark, "g", root).select("event.event_id")


@query(
    """SELECT event_type, 1 + count(*) AS n FROM events WHERE event_type IN ('error', 'click', 'signup') GROUP BY event_type"""
)
def tail_rotation(spark, sf):
    """Logs that all begin with one line: the main log is rolled and packed, the oldest packed
    file goes and a new main log begins, all between two looks. Every line arrives once."""
    root, folder = storage.new_folder(spark, "root"), storage.new_folder(spark, "logs")
    lines = _log_lines(spark, sf)

    def write(kind: str, name: str, packed: bool):
        part = storage.new_folder(spark, "part")
        rows = lines.where(F.col("event_type") == kind).select(F.concat(F.lit(f"{kind} "), "value").alias("value"))
        # Spark writes lines in order within one file: the common first line, then the others.
        head = spark.range(1).select(F.lit("the same first line of every log file").alias("value"))
        writer = head.withColumn("k", F.lit(0)).unionAll(rows.withColumn("k", F.lit(1)))
        writer = writer.repartition(1).sortWithinPartitions("k").select("value").write
        (writer.option("compression", "gzip") if packed else writer).text(part)
        (made,) = storage.matching(spark, f"{part}/part-*")
        storage.rename(spark, made, f"{folder}/{name}")

    config = {
        "source": {"class": "file", "props": {"target": {"directory": folder, "mainPattern": "^app[.]log$", "rollPattern": "^app-.*[.]gz$"}}},
        "endpoint": {"class": "gate", "props": {"name": "lines"}},
    }
    options = {"startAt": "earliest", "settleSeconds": 0}
    write("click", "app-1.gz", True)
    write("error", "app.log", False)
    _finish(m.run_tap(spark, "t", config, root, NOW, **options))
    storage.delete(spark, f"{folder}/app-1.gz")
    storage.delete(spark, f"{folder}/app.log")
    write("error", "app-2.gz", True)
    write("signup", "app.log", False)
    for _ in range(2):
        _finish(m.run_tap(spark, "t", config, root, NOW, **options))
    value = F.col("event.value")
    seen = m.read_gate(spark, "lines", root).select(F.when(~value.startswith("the same"), F.split(value, " ")[0]).alias("event_type"))
    heads = seen.where("event_type IS NULL").agg(F.count("*").alias("heads"))
    # One first line for each of the three files.
    counts = seen.where("event_type IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(heads).select("event_type", (F.col("n") + F.col("heads") / 3).cast("bigint").alias("n"))


@query(
    """SELECT 'flow' AS what, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type
       UNION ALL SELECT 'state ' || s, 'clean', 1 FROM (VALUES ('passive'), ('active'), ('passive again'), ('unknown')) t(s)"""
)
def flow_registry(spark, sf):
    """A flow that is added, started, edited while it runs, stopped, listed and removed."""
    root = storage.new_folder(spark, "root")
    m.write_gate(table(spark, sf, "events").select("event_id", "event_type"), "in", root, producer="p", batch="0")

    def config(*steps):
        return {
            "tap": {"class": "gate", "props": {"name": "in"}},
            "pipeline": list(steps),
            "sink": {"class": "gate", "props": {"name": "out"}},
        }

    flows = m.FlowRegistry(spark, root, trigger={"processingTime": "0 seconds"})
    flows.add("clean", config(drop(field("event_type", is_="^view$"))))
    states = [flows.info("clean")["state"]]
    flows.start("clean").processAllAvailable()
    states += [r.state for r in flows.list().collect()]
    flows.edit("clean", config(drop(field("event_type", is_="^view$")), enrich(tags=["v2"])))
    flows.start("clean").processAllAvailable()
    flows.stop("clean")
    states.append(flows.state("clean") + " again")
    flows.remove("clean")
    states += ["unknown"] if flows.list().isEmpty() else []
    out = m.read_gate(spark, "out", root).select(F.lit("flow").alias("what"), "event.event_type")
    counts = out.groupBy("what", "event_type").agg(F.count(F.lit(1)).alias("n"))
    seen = spark.createDataFrame([(f"state {s}", "clean", 1) for s in states], "what string, event_type string, n bigint")
    return counts.unionAll(seen)


def _tap_config(folder: str) -> dict:
    return {
        "source": {
            "class": "file",
            "props": {"target": {"directory": folder, "mainPattern": MAIN, "rollPattern": "[.]gz$"}},
        },
        "preprocessing": {"sourceId": "app", "tags": ["prod"]},
        "endpoint": {"class": "gate", "props": {"name": "lines"}},
    }


@query(SUMMARY_SQL.format("").replace("FROM events", "FROM (SELECT * FROM events UNION ALL SELECT * FROM events)"))
def tail_resume(spark, sf):
    """A tap that is stopped and started again goes on where it was: every line once."""
    root, folder = storage.new_folder(spark, "root"), _log_folder(spark, sf)
    options = {"startAt": "earliest", "settleSeconds": 0, "maxFilesPerTrigger": 2}
    _finish(m.run_tap(spark, "t", _tap_config(folder), root, NOW, **options))
    _log_lines(spark, sf).select("value").write.mode("append").text(folder)
    for _ in range(2):
        _finish(m.run_tap(spark, "t", _tap_config(folder), root, NOW, **{**options, "maxFilesPerTrigger": 1000}))
    return _summary(m.read_gate(spark, "lines", root).select("event.value"))


@query(SUMMARY_SQL.format(""))
def rolling_stream(spark, sf):
    """Complete files as a stream, into a gate."""
    root = storage.new_folder(spark, "root")
    lines = m.stream_rolling(spark, _log_folder(spark, sf), MAIN, "[.]gz$", max_files_per_trigger=3)
    _finish(m.write_gate(lines, "lines", root, checkpoint=f"{root}/cp", trigger=NOW))
    return _summary(m.read_gate(spark, "lines", root).select("event.value"))


@query("SELECT event_id, event_type FROM events")
def dedupe_stream(spark, sf):
    """Each record sent twice, in other micro-batches, arrives once."""
    twice = _event_stream(spark, sf).unionAll(_event_stream(spark, sf, 2)).select("event_id", "event_type", "ts")
    once = m.drop_duplicates(twice, ["event_type", "event_id"], watermark="3650 days", time="ts")
    root = storage.new_folder(spark, "root")
    _finish(m.write_gate(once, "g", root, checkpoint=f"{root}/cp", trigger=NOW))
    return m.read_gate(spark, "g", root).select("event.event_id", "event.event_type")


@query("SELECT user_id, max_by(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_stream(spark, sf):
    latest = m.latest_by_key(_event_stream(spark, sf), ["user_id"], ["ts", "event_id"], ["event_id"])
    return _updates(latest, ["user_id"])


@query(
    """SELECT event_type, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS tick,
              max_by(event_id, row(ts, event_id)) AS event_id
       FROM events GROUP BY 1, 2"""
)
def conflate_stream(spark, sf):
    ticks = m.conflate(
        _event_stream(spark, sf), ["event_type"], "ts", ["ts", "event_id"], ["event_id"], "1 hour", "3650 days"
    )
    out = _updates(ticks, ["event_type", "tick_start"])
    return out.select("event_type", since_epoch("SECOND", "tick_start").alias("tick"), "event_id")
