import datetime
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import millrace as m
from catalog.steps import drop, enrich, field, grok, log
from millrace.sources import storage
from millrace.streaming.gates import set_open

NOW = {"availableNow": True}


def run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "root")


def stream(spark, path, schema="k string, n int", **options):
    reader = spark.readStream.schema(schema)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.json(path)


def write(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def events(spark, gate, root):
    return sorted(map(tuple, m.read_gate(spark, gate, root).select("event.*").collect()), key=str)


def test_gate_keeps_batches_once(spark, root):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    for batch in ("0", "0", "1"):
        m.write_gate(df, "g", root, producer="p", batch=batch)
    m.write_gate(df, "g", root, producer="q", batch="0")
    assert len(events(spark, "g", root)) == 6
    place = m.read_gate(spark, "g", root, with_place=True).select("producer", "batch").distinct().collect()
    assert sorted(map(tuple, place)) == [("p", "0"), ("p", "1"), ("q", "0")]


def test_gate_batch_left_half_done_is_redone(spark, root):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    df.write.parquet(f"{root}/gates/g/staging/producer=p/batch=0")  # a writer that died before the move
    m.write_gate(df, "g", root, producer="p", batch="0")
    assert events(spark, "g", root) == [("a", 1)]


def test_gate_schemas_grow_and_must_agree(spark, root):
    m.write_gate(spark.createDataFrame([("a",)], "k string"), "g", root, producer="p")
    m.write_gate(spark.createDataFrame([("b", 2)], "k string, n int"), "g", root, producer="q")
    assert sorted(events(spark, "g", root), key=str) == [("a", None), ("b", 2)]
    with pytest.raises(m.FlowConfigError, match="event.k"):
        m.write_gate(spark.createDataFrame([(1,)], "k int"), "g", root, producer="r")


def test_gate_since(spark, root):
    m.write_gate(spark.createDataFrame([("a",)], "k string"), "g", root)
    today = datetime.date.today()
    assert m.read_gate(spark, "g", root, since=today - datetime.timedelta(1)).count() == 1
    assert m.read_gate(spark, "g", root, since=today + datetime.timedelta(2)).count() == 0
    plan = m.read_gate(spark, "g", root, since=today)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan


def test_closed_gate(spark, root):
    df = spark.createDataFrame([("a",)], "k string")
    m.write_gate(df, "g", root)
    set_open(spark, "g", root, False)
    with pytest.raises(m.GateClosed):
        m.write_gate(df, "g", root)
    set_open(spark, "g", root, True)
    m.write_gate(df, "g", root)
    assert len(events(spark, "g", root)) == 2


def test_gate_needs_a_name_and_a_schema(spark, root):
    df = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(m.FlowConfigError):
        m.write_gate(df, "  ", root)
    with pytest.raises(m.FlowConfigError):
        m.read_gate(spark, "nobody", root)


def test_stream_through_gates_resumes(spark, root, tmp_path):
    source = str(tmp_path / "in")
    write(source, "1.json", [{"k": "a", "n": 1}, {"k": "b", "n": 2}])
    for _ in range(2):
        run(m.write_gate(stream(spark, source), "g", root, checkpoint=f"{root}/cp1", trigger=NOW))
    write(source, "2.json", [{"k": "c", "n": 3}])
    run(m.write_gate(stream(spark, source), "g", root, checkpoint=f"{root}/cp1", trigger=NOW))
    assert events(spark, "g", root) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(m.FlowConfigError):
        m.write_gate(stream(spark, source), "g", root)


def test_sink_that_fails_after_delivery_gives_no_duplicates(spark, root, tmp_path):
    source = str(tmp_path / "in")
    write(source, "1.json", [{"k": "a", "n": 1}])
    fail = [True]

    def flaky(rows, batch):
        if fail.pop() if fail else False:
            raise RuntimeError("sink is down")

    sinks = [m.gate_sink("g", root, "p"), flaky]
    query = m.fan_out(stream(spark, source), sinks, checkpoint=f"{root}/cp", trigger=NOW)
    with pytest.raises(Exception, match="sink is down"):
        query.awaitTermination()
    run(m.fan_out(stream(spark, source), sinks, checkpoint=f"{root}/cp", trigger=NOW))
    assert events(spark, "g", root) == [("a", 1)]


def test_fan_out(spark, root):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    m.fan_out(df, [m.gate_sink("x", root, "p"), m.gate_sink("y", root, "p"), m.blackhole_sink], batch="7")
    m.fan_out(df, [m.gate_sink("x", root, "p")], batch="7")
    assert events(spark, "x", root) == events(spark, "y", root) == [("a", 1), ("b", 2)]
    with pytest.raises(m.FlowConfigError):
        m.fan_out(df, [])


FLOW = [
    grok("k", r"(\d)", "d", "d", "${d}", "n"),
    enrich(("r", "${k}:${d}"), tags=["t"], when=field("n", isnot="^2$")),
    drop(field("k", is_="^z")),
]


def test_flow_is_the_same_on_batch_and_stream(spark, root, tmp_path):
    rows = [{"k": "a1", "n": 1}, {"k": "b", "n": 2}, {"k": "z3", "n": 3}, {"k": None, "n": None}]
    source = str(tmp_path / "in")
    write(source, "1.json", rows)
    run(m.write_gate(stream(spark, source), "in", root, checkpoint=f"{root}/cp", trigger=NOW))
    config = {
        "tap": {"class": "gate", "props": {"name": "in"}},
        "pipeline": FLOW,
        "sink": {"class": "gate", "props": {"name": "out"}},
    }
    run(m.run_flow(spark, "f", config, root, trigger=NOW))
    streamed = m.read_gate(spark, "out", root).select(F.to_json("event").alias("j")).collect()
    batch = m.apply_flow(spark.read.schema("k string, n int").json(source), FLOW)
    expected = batch.select(F.to_json(F.struct("*")).alias("j")).collect()
    assert sorted(r.j for r in streamed) == sorted(r.j for r in expected)


def test_context_goes_through_gates(spark, root):
    df = spark.createDataFrame([("a1",)], "k string")
    m.write_gate(m.apply_flow(df, [FLOW[0]], "envelope"), "g", root)
    out = m.apply_flow(m.read_gate(spark, "g", root), [enrich(("again", "${d}"), ("r", "<${d}>"))])
    assert out.select("event.r", "ctx.d").first() == ("<1>", "1")


def test_dynamic_fields_go_through_gates(spark, root):
    df = spark.createDataFrame([("x",)], "k string")
    m.write_gate(m.apply_flow(df, [enrich(("${k}", "v"))], "envelope"), "g", root)
    out = m.apply_flow(m.read_gate(spark, "g", root), [enrich(("r", "${x}"))], "json")
    assert json.loads(out.first().event) == {"k": "x", "x": "v", "r": "v"}


def test_log_listener(spark, root, tmp_path, caplog):
    import logging
    import time

    source = str(tmp_path / "in")
    write(source, "1.json", [{"k": "a", "n": 1}, {"k": "b", "n": 2}])
    listener = m.FlowLogListener()
    spark.streams.addListener(listener)
    try:
        with caplog.at_level(logging.INFO, "audit"):
            flow = m.apply_flow(stream(spark, source), [log(logger="audit", level="INFO", sample=True, when=field("k", is_="a"))])
            run(m.write_blackhole(flow, f"{root}/cp", NOW))
            for _ in range(50):
                if caplog.records:
                    break
                time.sleep(0.1)
        assert any("1 records" in r.getMessage() and '"k":"a"' in r.getMessage() for r in caplog.records)
    finally:
        spark.streams.removeListener(listener)


def test_dedupe(spark):
    df = spark.createDataFrame([("s", 1), ("s", 1), ("t", 1)], "source_id string, id long")
    assert m.drop_duplicates(df, ["source_id", "id"]).count() == 2
    frames = m.to_envelope(m.stamp_source(df.withColumn("value", F.lit("v")).drop("source_id")))
    assert m.drop_duplicates(frames).count() == 1
    assert m.drop_duplicates(frames).columns == frames.columns


def test_dedupe_stream(spark, root, tmp_path):
    source = str(tmp_path / "in")
    write(source, "1.json", [{"id": 1, "t": 0}, {"id": 1, "t": 0}, {"id": 2, "t": 0}])
    write(source, "2.json", [{"id": 2, "t": 1}, {"id": 3, "t": 1}])
    df = stream(spark, source, "id long, t long", maxFilesPerTrigger=1).withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    run(m.write_gate(m.drop_duplicates(df, ["id"], "1 hour", "ts"), "g", root, checkpoint=f"{root}/cp", trigger=NOW))
    assert sorted(r.id for r in m.read_gate(spark, "g", root).select("event.id").collect()) == [1, 2, 3]


def test_latest_and_conflate(spark):
    rows = [("a", 100, 1, "x"), ("a", 150, 2, "y"), ("a", 150, 3, None), ("a", 250, 4, "w"), ("b", 10, 5, "v")]
    df = spark.createDataFrame(rows, "k string, ms long, id long, v string").withColumn("ts", F.timestamp_millis("ms"))
    latest = m.latest_by_key(df, ["k"], ["ts", "id"], ["id", "v"])
    assert sorted(map(tuple, latest.collect())) == [("a", 4, "w"), ("b", 5, "v")]
    ticks = m.conflate(df, ["k"], "ts", ["ts", "id"], ["id", "v"]).drop("tick_start")
    assert sorted(map(tuple, ticks.collect()), key=str) == [("a", 3, None), ("a", 4, "w"), ("b", 5, "v")]
    single = m.conflate(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["k"], "ts", ["ts", "id"], ["id"])
    assert single.count() == 3


def tap_config(folder, endpoint):
    target = {"directory": folder, "mainPattern": "^app[.]log$", "rollPattern": "^app-"}
    return {
        "source": {"class": "file", "props": {"target": target}},
        "preprocessing": {"sourceId": "app1", "tags": ["prod"]},
        "endpoint": endpoint,
    }


def test_tap_follows_a_file_and_resumes(spark, root, tmp_path):
    folder = str(tmp_path / "logs")
    os.makedirs(folder)

    def append(text):
        with open(os.path.join(folder, "app.log"), "a") as f:
            f.write(text)

    def lines():
        out = m.read_gate(spark, "in", root)
        assert out.select("event.id").distinct().count() == out.count()
        return [r.value for r in out.orderBy("event.id").select("event.value").collect()]

    config = tap_config(folder, {"class": "akka", "props": {"url": "akka.tcp://hub@host/user/gates/in"}})
    append("one of the lines\ntwo\nhal")
    run(m.run_tap(spark, "t", config, root, NOW))
    assert lines() == ["one of the lines", "two"]
    append("f\n")
    run(m.run_tap(spark, "t", config, root, NOW, maxBytesPerTrigger=1))
    os.rename(os.path.join(folder, "app.log"), os.path.join(folder, "app-1"))
    append("a new file with a line\n")
    run(m.run_tap(spark, "t", json.dumps(config), root, NOW))
    run(m.run_tap(spark, "t", config, root, NOW))
    assert lines() == ["one of the lines", "two", "half", "a new file with a line"]
    frame = m.read_gate(spark, "in", root).first()
    assert frame.event.source.asDict() == {"sourceId": "app1", "tags": ["prod"]} and frame.event.tags == ["source"]
    assert frame.ctx["source.id"] == str(frame.event.id)


def test_tap_without_known_endpoint_keeps_nothing(spark, root, tmp_path):
    folder = str(tmp_path)
    with open(os.path.join(folder, "app.log"), "w") as f:
        f.write("one of the lines\n")
    query = run(m.run_tap(spark, "t", tap_config(folder, {"class": "other"}), root, NOW))
    assert sum(p.numInputRows for p in query.recentProgress) == 1
    assert not storage.matching(spark, f"{root}/gates/*")


@pytest.mark.parametrize("change", [{"source": {"class": "net"}}, {"source": None}, {"endpoint": {"class": "akka"}}])
def test_bad_tap(spark, root, change):
    with pytest.raises(m.FlowConfigError):
        m.run_tap(spark, "t", {**tap_config("/tmp", {"class": "x"}), **change}, root)


def test_registry(spark, root):
    def config(*steps, sink="out"):
        return {
            "tap": {"class": "gate", "props": {"name": "in"}},
            "pipeline": list(steps),
            "sink": {"class": "gate", "props": {"name": sink}},
        }

    df = spark.createDataFrame([("a",), ("b",)], "k string")
    flows = m.FlowRegistry(spark, root, trigger={"processingTime": "0 seconds"})
    flows.add_gate("in", m.apply_flow(df, [], "envelope").schema)
    with pytest.raises(m.FlowConfigError):
        flows.add_gate("in")
    flows.add("f", config(drop(field("k", is_="^b$"))))
    for bad in ("f", " ", ""):
        with pytest.raises(m.FlowConfigError):
            flows.add(bad, config())
    assert flows.info("f")["state"] == "passive"

    query = flows.start("f")  # before the gate has any record
    assert flows.start("f") is query and flows.info("f")["state"] == "active"
    m.write_gate(df, "in", root, batch="0")
    query.processAllAvailable()
    assert events(spark, "out", root) == [("a",)]

    bad = config({"class": "nope", "props": {}})
    with pytest.raises(m.FlowConfigError):
        flows.edit("f", bad)
    assert flows.info("f") == {"name": "f", "config": json.dumps(bad), "state": "active"} and query.isActive

    flows.edit("f", config(enrich(("v", "2"))))
    m.write_gate(df, "in", root, batch="1")
    flows.start("f").processAllAvailable()
    assert sorted(events(spark, "out", root), key=str) == [("a", "2"), ("a", None), ("b", "2")]

    flows.stop_gate("out")
    assert flows.gate_state("out") == "passive" and flows.info("f")["state"] == "passive"
    m.write_gate(df, "in", root, batch="2")
    flows.start_gate("out")
    flows.start("f").processAllAvailable()
    assert len(events(spark, "out", root)) == 5
    assert sorted(map(tuple, flows.list_gates().collect())) == [("in", "active"), ("out", "active")]

    flows.stop("f")
    assert [tuple(r) for r in m.FlowRegistry(spark, root).list().select("name", "state").collect()] == [("f", "passive")]
    flows.remove("f")
    assert flows.list().count() == 0
    with pytest.raises(m.FlowConfigError):
        flows.start("f")


def test_shared_folder_comes_from_the_session(spark):
    class Session:
        def __init__(self, master, folder):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = type("Context", (), {"master": master})

    assert storage.new_folder(Session("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert storage.new_folder(Session("local[2]", None), "x").startswith(tempfile.gettempdir())
    with pytest.raises(m.FlowConfigError):
        storage.new_folder(Session("yarn", None), "x")


def test_streams_and_lookalike_producers_keep_their_batches(spark, tmp_path):
    root, folder = str(tmp_path / "root"), str(tmp_path / "in")
    spark.range(5).write.parquet(folder)
    for k, producer in enumerate(("a-b", "a-b", "a_b", "a/b", "a b")):
        stream = spark.readStream.schema("id long").parquet(folder)
        run(m.write_gate(stream, "g", root, producer=producer, checkpoint=f"{root}/cp{k}", trigger=NOW))
    rows = m.read_gate(spark, "g", root, with_place=True)
    assert rows.count() == 25
    assert {r.producer for r in rows.collect()} == {"a-b", "a_b", "a/b", "a b"}


def test_batch_goes_to_the_day_of_its_first_attempt(spark, tmp_path):
    from millrace.streaming import gates

    root = str(tmp_path)
    frames = gates.as_frames(spark.range(3))
    gates.declare(spark, "g", root, "p", frames.schema)
    gate = gates.gate_path(root, "g")
    assert storage.create_once(spark, f"{gate}/commits/p/b", "2024-05-06")  # an attempt that died
    assert gates.publish(frames, "g", root, "p", "b") and not gates.publish(frames, "g", root, "p", "b")
    rows = m.read_gate(spark, "g", root, with_place=True).collect()
    assert len(rows) == 3 and {str(r.ingest_date) for r in rows} == {"2024-05-06"}


def test_stream_waits_for_a_closed_gate(spark, tmp_path):
    import threading

    root, folder = str(tmp_path / "root"), str(tmp_path / "in")
    spark.range(5).write.parquet(folder)
    stream = spark.readStream.schema("id long").parquet(folder)
    set_open(spark, "g", root, False)
    threading.Timer(3, lambda: set_open(spark, "g", root, True)).start()
    run(m.write_gate(stream, "g", root, checkpoint=f"{root}/cp", trigger=NOW, closed_wait=60))
    assert m.read_gate(spark, "g", root).count() == 5


def test_stream_dedupe_needs_a_watermark(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    with pytest.raises(m.FlowConfigError, match="watermark"):
        m.drop_duplicates(stream, ["id"])


def test_conditions_reach_the_files_of_a_gate(spark, tmp_path):
    root = str(tmp_path)
    m.write_gate(spark.createDataFrame([("error", 1), ("view", 2)], "kind string, n int"), "g", root, batch="0")
    out = m.apply_flow(m.read_gate(spark, "g", root), [drop(field("kind", isnot="^error$"))])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "event.kind" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert [r.event.n for r in out.collect()] == [1]


def test_gate_info_and_removal(spark, tmp_path):
    root = str(tmp_path)
    flows = m.FlowRegistry(spark, root)
    flows.add_gate("g")
    assert flows.gate_info("g") == {"name": "g", "state": "active", "schema": None}
    m.write_gate(spark.range(3), "g", root, batch="0")
    assert "id:bigint" in flows.gate_info("g")["schema"]
    flows.remove_gate("g")
    assert flows.list_gates().isEmpty()
    with pytest.raises(m.FlowConfigError):
        flows.gate_state("g")
    m.write_gate(spark.range(2), "g", root, batch="0")
    assert m.read_gate(spark, "g", root).count() == 2
