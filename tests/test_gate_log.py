"""The commit log of gates: what is looked at, what counts, and what a compaction leaves."""

import datetime
import json
import os
import threading
import time
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

import millrace as m
from catalog.steps import drop, field, log
from millrace.sources import storage
from millrace.sources.commit_log import EVERY, ArrowStore, CommitLog, Entry, State
from millrace.streaming import gates

NOW = {"availableNow": True}
EVER = "9999-12-31"


def run(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "root")


def fill(spark, root, numbers, gate="g"):
    for k in numbers:
        m.write_gate(spark.createDataFrame([(k,)], "n int"), gate, root, producer="p", batch=str(k))


def numbers(df):
    return sorted(r.n for r in df.select("event.n").collect())


class Counting:
    """A store that counts what is asked of it."""

    def __init__(self, store):
        self.store, self.listed, self.read = store, 0, 0

    def names(self, folder):
        found = self.store.names(folder)
        self.listed += len(found)
        return found

    def text(self, path):
        self.read += 1
        return self.store.text(path)


def long_log(folder, n):
    """A log of so many commits, a hundred to a day, as publishing them would have left it."""
    log, state = CommitLog(folder, None), State()
    for k in range(1, n + 1):
        day = str(datetime.date(2024, 1, 1) + datetime.timedelta(k // 100))
        entry = Entry(k, day, f"data/ingest_date={day}/producer=p/batch={k}/attempt=a", producer="p", batch=str(k))
        os.makedirs(log.folder(k), exist_ok=True)
        with open(log.file(k), "w") as f:
            json.dump(asdict(entry), f)
        state.apply(entry)
        if k % EVERY == 0:
            path = log.snapshot_file(k)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            if k + EVERY > n:
                with open(path, "w") as f:
                    f.write(state.dump())


def test_planning_costs_the_same_after_many_commits(tmp_path):
    cost = {}
    for n in (110, 10_010):
        folder = str(tmp_path / str(n))
        long_log(folder, n)
        store = Counting(ArrowStore(folder))
        log = CommitLog(folder, store)
        assert log.head() == n
        found = log.between(n - 5, n)
        assert [e.number for e in found] == list(range(n - 4, n + 1))
        cost[n] = (store.listed, store.read)
    assert cost[110] == cost[10_010]


def test_since_leaves_days_out_before_their_folders_are_looked_at(tmp_path):
    folder = str(tmp_path / "g")
    long_log(folder, 1010)
    store = Counting(ArrowStore(folder))
    found = CommitLog(folder, store).between(0, 1010, "2024-01-11")
    assert {e.day for e in found} == {"2024-01-11"} and [e.number for e in found] == list(range(1000, 1011))
    assert store.read <= 1 + EVERY  # a snapshot and what came after it; no data folder exists here


def test_batch_is_read_only_once_it_is_committed(spark, root):
    fill(spark, root, [1])
    log = gates.gate_log(spark, "g", root)
    stray = f"{log.gate}/data/ingest_date=2024-01-01/producer=p/batch=9/attempt=a9"
    spark.range(5).write.parquet(stray)  # a writer that died before its commit
    assert numbers(m.read_gate(spark, "g", root)) == [1]
    fill(spark, root, [9, 9])
    assert numbers(m.read_gate(spark, "g", root)) == [1, 9]
    assert m.clean_gate(spark, "g", root, keep_seconds=0) == 1 and not os.path.exists(stray)
    assert numbers(m.read_gate(spark, "g", root)) == [1, 9]


def test_of_two_attempts_one_counts(spark, root, monkeypatch):
    frames = gates.as_frames(spark.createDataFrame([(1,)], "n int"))
    gates.declare(spark, "g", root, "p", frames.schema)
    append, other = gates._append, []

    def late(*args):
        if not other:  # before this attempt commits, another one does
            other.append(True)
            assert gates.publish(frames, "g", root, "p", "b")
        return append(*args)

    monkeypatch.setattr(gates, "_append", late)
    assert not gates.publish(frames, "g", root, "p", "b")
    assert numbers(m.read_gate(spark, "g", root)) == [1]


def test_many_writers_lose_nothing(spark, root):
    gates.declare(spark, "g", root, "p", gates.as_frames(spark.createDataFrame([(1,)], "n int")).schema)
    threads = [threading.Thread(target=fill, args=(spark, root, range(k, k + 4))) for k in (0, 4, 8, 10)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert numbers(m.read_gate(spark, "g", root)) == list(range(14))
    state = gates.gate_log(spark, "g", root).state()
    assert sorted(state.live) == list(range(1, 15))


def test_snapshots_are_made_on_the_way(spark, root, monkeypatch):
    monkeypatch.setattr(gates, "EVERY", 3)
    fill(spark, root, range(8))
    log = gates.gate_log(spark, "g", root)
    assert log.newest_snapshot() == 6 and log.state().number == 8
    assert numbers(m.read_gate(spark, "g", root)) == list(range(8))
    fill(spark, root, [0, 5])  # long known: not in the log after the snapshot
    assert log.head() == 8


@pytest.mark.parametrize("records", [True, False])
def test_reader_gets_each_record_once_across_compactions(spark, root, records):
    gates.declare(spark, "out", root, "x", gates.as_frames(spark.createDataFrame([(1,)], "n int")).schema)

    def read(most=None):
        if records:
            rows = m.read_gate(spark, "g", root, streaming=True, max_batches_per_trigger=most, checkpoint=f"{root}/cp")
            return run(m.write_gate(rows, "out", root, producer="x", checkpoint=f"{root}/cp", trigger=NOW))
        deliver = lambda rows, batch: gates.publish(gates.as_frames(rows), "out", root, "x", batch)
        return run(m.follow_gate(spark, "g", root, deliver, f"{root}/cp", NOW, max_batches=2))

    fill(spark, root, range(4))
    read(3)
    assert m.compact_gate(spark, "g", root, before=EVER) == 1 and m.compact_gate(spark, "g", root, before=EVER) == 0
    fill(spark, root, range(4, 7))
    read(1)
    assert m.compact_gate(spark, "g", root, before=EVER) == 1  # the compacted one and three new ones
    assert m.clean_gate(spark, "g", root, keep_seconds=0) == 8
    assert len(storage.matching(spark, f"{root}/gates/g/data/*/*/*/attempt=*")) == 0
    fill(spark, root, range(7, 9))
    fill(spark, root, [7])
    for _ in range(4):
        read(2)
    assert numbers(m.read_gate(spark, "out", root)) == list(range(9))
    assert numbers(m.read_gate(spark, "g", root)) == list(range(9))
    place = m.read_gate(spark, "g", root, with_place=True).select("producer", "batch").collect()
    assert sorted(map(tuple, place)) == [("p", str(k)) for k in range(9)]


def test_batch_of_a_compacted_day_is_not_taken_again(spark, root, monkeypatch):
    monkeypatch.setattr(gates, "EVERY", 2)
    fill(spark, root, range(3))
    m.compact_gate(spark, "g", root, before=EVER)
    fill(spark, root, range(3, 6))
    fill(spark, root, range(6))
    assert numbers(m.read_gate(spark, "g", root)) == list(range(6))


def test_two_compactions_at_once(spark, root):
    fill(spark, root, range(3))
    log = gates.gate_log(spark, "g", root)
    before, schema = log.state(), gates.known_schema(spark, "g", root)
    entries = list(before.live.values())
    assert gates._compact_day(spark, log, schema, before, entries[0].day, entries, 1 << 20)
    assert not gates._compact_day(spark, log, schema, before, entries[0].day, entries, 1 << 20)
    assert numbers(m.read_gate(spark, "g", root)) == [0, 1, 2]


def test_compaction_keeps_to_closed_days_and_grown_schemas(spark, root):
    fill(spark, root, range(2))
    assert m.compact_gate(spark, "g", root) == 0  # today is not closed
    m.write_gate(spark.createDataFrame([(7, "a")], "n int, k string"), "g", root, producer="q")
    m.compact_gate(spark, "g", root, before=EVER)
    m.write_gate(spark.createDataFrame([(8, "b", 1.5)], "n int, k string, v double"), "g", root, producer="r")
    for streaming in (False, True):
        rows = m.read_gate(spark, "g", root, streaming=streaming)
        if streaming:
            seen = []
            run(rows.writeStream.foreachBatch(lambda df, _: seen.extend(df.select("event.*").collect())).trigger(**NOW).start())
        else:
            seen = rows.select("event.*").collect()
        assert sorted((r.n, r.k, r.v) for r in seen) == [(0, None, None), (1, None, None), (7, "a", None), (8, "b", 1.5)]


def test_all_kinds_of_values_come_through_a_stream(spark, root):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string").select(
        "n", "s",
        F.lit("2024-05-06 07:08:09.123456").cast("timestamp").alias("t"),
        F.lit("2024-05-06").cast("date").alias("d"),
        F.expr("cast(n as decimal(38,18)) / 3").cast("decimal(38,18)").alias("dec"),
        F.when(F.col("n") == 1, F.array(F.struct(F.lit(1).alias("x"), F.col("s").alias("y")))).alias("list"),
        F.expr("map('k', s)").alias("map"),
        F.expr("parse_json('{\"q\": [1, 2]}')").alias("v"),
        F.expr("cast(null as struct<a: int>)").alias("none"),
    )
    m.write_gate(df, "g", root)
    want = sorted(r.j for r in m.read_gate(spark, "g", root).select(F.to_json("event").alias("j")).collect())
    seen = []
    rows = m.read_gate(spark, "g", root, streaming=True, with_place=True)
    run(rows.writeStream.foreachBatch(lambda b, _: seen.extend(b.select(F.to_json("event").alias("j"), "ingest_date", "producer").collect())).trigger(**NOW).start())
    assert sorted(r.j for r in seen) == want and {r.producer for r in seen} == {"main"}
    assert {r.ingest_date for r in seen} == {datetime.datetime.now(datetime.timezone.utc).date()}


def flow(*steps, sink="out"):
    return {"tap": {"class": "gate", "props": {"name": "g"}}, "pipeline": list(steps), "sink": {"class": "gate", "props": {"name": sink}}}


def test_log_records_come_once_with_their_batch(spark, root):
    fill(spark, root, range(5))
    steps = [log(logger="a", level="ERROR", when=field("n", is_="^[12]$")), drop(field("n", is_="^1$")), log(logger="b")]
    for _ in range(2):
        run(m.run_flow(spark, "f", flow(*steps), root, trigger=NOW, log_gate="logged", max_batches=2))
    rows = m.read_gate(spark, "logged", root).select("event.*").collect()
    assert sorted((r.step, r.logger, r.level, json.loads(r.record)["n"]) for r in rows) == [
        (0, "a", "ERROR", 1), (0, "a", "ERROR", 2), (1, "b", "INFO", 0), (1, "b", "INFO", 2), (1, "b", "INFO", 3), (1, "b", "INFO", 4),
    ]
    assert numbers(m.read_gate(spark, "out", root)) == [0, 2, 3, 4]


def test_log_counts_of_a_running_flow(spark, root, caplog):
    fill(spark, root, range(3))
    with caplog.at_level("WARNING", "audit"):
        run(m.run_flow(spark, "f", flow(log(logger="audit", level="WARN", when=field("n", is_="[12]"))), root, trigger=NOW))
    assert any("2 records" in r.getMessage() for r in caplog.records)


def test_flow_waits_for_a_closed_gate_without_end(spark, root):
    fill(spark, root, range(2))
    flows = m.FlowRegistry(spark, root, trigger={"processingTime": "0 seconds"})
    flows.add("f", flow())
    gates.set_open(spark, "out", root, False)
    query = flows.start("f")
    assert flows.info("f")["waiting"] == "out"
    time.sleep(4)
    assert query.isActive
    gates.set_open(spark, "out", root, True)
    query.processAllAvailable()
    assert "waiting" not in flows.info("f") and numbers(m.read_gate(spark, "out", root)) == [0, 1]
    flows.stop("f")


def test_each_sink_is_acknowledged_by_itself(spark, root):
    fill(spark, root, range(3))
    calls = {"good": 0, "bad": 0}

    def good(rows, batch):
        calls["good"] += rows.count()

    def bad(rows, batch):
        calls["bad"] += 1
        if calls["bad"] <= 2:
            raise RuntimeError("sink is down")

    sinks = {"bad": bad, "good": good, "gate": m.gate_sink("x", root, "p")}
    rows = lambda: m.read_gate(spark, "g", root, streaming=True)
    for _ in range(2):
        with pytest.raises(Exception, match="sink is down"):
            run(m.fan_out(rows(), sinks, checkpoint=f"{root}/cp", trigger=NOW))
    run(m.fan_out(rows(), sinks, checkpoint=f"{root}/cp", trigger=NOW))
    assert calls == {"good": 3, "bad": 3} and numbers(m.read_gate(spark, "x", root)) == [0, 1, 2]
    calls["bad"] = 0
    fill(spark, root, [3])
    run(m.fan_out(rows(), sinks, checkpoint=f"{root}/cp", trigger=NOW, attempts=3, pause=0))
    assert calls == {"good": 4, "bad": 3} and numbers(m.read_gate(spark, "x", root)) == [0, 1, 2, 3]


def test_duplicates_of_a_stream_need_one_state(spark, root):
    rows = [(k % 3, k // 10) for k in range(2000)] + [(k, 9) for k in range(100, 200)]
    df = spark.createDataFrame(rows, "n int, part int").repartition(4)
    m.write_gate(df, "g", root)
    stream = m.read_gate(spark, "g", root, streaming=True).select("event.n", "event.part", "ingest_ts")
    query = run(m.write_gate(m.drop_duplicates(stream, ["n"], "1 hour"), "out", root, checkpoint=f"{root}/cp", trigger=NOW))
    assert numbers(m.read_gate(spark, "out", root)) == [0, 1, 2, *range(100, 200)]
    progress = [p for p in query.recentProgress if p.numInputRows]
    (state,) = progress[0].stateOperators
    # What reaches the state is what was left of each task's batches.
    assert state.numRowsTotal == 103 and state.customMetrics["numDroppedDuplicateRows"] < 60


def test_late_consumer_gets_the_last_rows_and_the_changes(spark, root, tmp_path):
    source = str(tmp_path / "in")
    seen = []

    def write(k, rows):
        spark.createDataFrame(rows, "k string, at int, v string").coalesce(1).write.mode("append").json(source)

    def both(fail=False):
        stream = spark.readStream.schema("k string, at int, v string").json(source)
        run(m.publish_latest(stream, ["k"], ["at"], ["at", "v"], "latest", root, f"{root}/cp", trigger=NOW))

        def deliver(rows, batch):
            if fail:
                raise RuntimeError("consumer is down")
            seen.append((batch == "snapshot", sorted(map(tuple, rows.collect()))))

        run(m.replay_latest(spark, "latest", root, f"{root}/cp", ["k"], ["at", "v"], deliver, f"{root}/late", NOW))

    write(0, [("a", 1, "x"), ("b", 1, "y")])
    run(m.publish_latest(spark.readStream.schema("k string, at int, v string").json(source), ["k"], ["at"], ["at", "v"], "latest", root, f"{root}/cp", trigger=NOW))
    write(1, [("a", 2, "z")])
    with pytest.raises(RuntimeError):
        both(fail=True)
    both()
    assert seen == [(True, [("a", 2, "z"), ("b", 1, "y")])]
    write(2, [("c", 3, "n"), ("b", 0, "old")])
    both()
    both()
    assert seen[1:] == [(False, [("b", 1, "y"), ("c", 3, "n")])]
    single = m.latest_snapshot(spark, f"{root}/cp", ["k"], ["at", "v"])
    assert single.count() == 3
    with pytest.raises(m.FlowConfigError):
        m.replay_latest(spark, "latest", root, f"{root}/nobody", ["k"], ["v"], print, f"{root}/late2", NOW)
