import gzip
import json
import os
import time

import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace.sources.tail import Tail, parse_cursor

MAIN, ROLL = r"^app[.]log$", r"^app-\d+[.]log([.]gz)?$"


def put(folder, name, text, mode="w", age=None):
    path = os.path.join(folder, name)
    data = text if isinstance(text, bytes) else text.encode()
    if name.endswith("gz"):
        data = gzip.compress(data)
    with open(path, "ab" if mode == "a" else "wb") as f:
        f.write(data)
    if age is not None:
        os.utime(path, (time.time() - age,) * 2)
    return path


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    return str(folder)


def test_rolling_scan(spark, logs):
    put(logs, "app-2.log.gz", "second file\nof two lines\n")
    put(logs, "app-1.log", "x" * 15 + "\n")  # exactly 16 bytes
    put(logs, "app-3.log", "x" * 16 + "\n")  # 17 bytes
    put(logs, ".app.log", "a hidden file is skipped\n")
    put(logs, "app-4.log.zip", "a zip file yields nothing\n")
    put(logs, "app.log", "main log with more text\n")
    put(logs, "other.txt", "matches neither pattern\n")
    out = m.read_rolling(spark, logs, MAIN, ROLL + "|zip|hidden|^[.]")
    assert sorted((r.file_name, r.rolled, r.value) for r in out.collect()) == [
        ("app-2.log.gz", True, "of two lines"),
        ("app-2.log.gz", True, "second file"),
        ("app-3.log", True, "x" * 16),
        ("app.log", False, "main log with more text"),
    ]


def test_file_that_matches_both_patterns_is_read_once(spark, logs):
    put(logs, "app.log", "one line of the log\n")
    assert m.read_rolling(spark, logs, "app", "app").count() == 1


def test_unwanted_files_are_not_opened(spark, logs):
    for i in range(5):
        put(logs, f"app-{i}.log", f"a line of file number {i}\n")
        put(logs, f"other-{i}.txt", f"a line of file number {i}\n")
    df = m.read_rolling(spark, logs, MAIN, ROLL)
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    scans = plan.collectLeaves()
    scan = scans.apply(0)
    assert scan.metrics().apply("numFiles").value() == 5


def test_charset(spark, logs):
    put(logs, "app.log", "café and other words\n".encode("latin-1"))
    assert m.read_rolling(spark, logs, MAIN, ROLL, charset="ISO-8859-1").first().value == "café and other words"
    with pytest.raises(m.FlowConfigError):
        m.read_rolling(spark, logs, MAIN, ROLL, charset="UTF-16")


def test_bad_file_pattern(spark, logs):
    with pytest.raises(m.FlowConfigError):
        m.read_rolling(spark, logs, "(", ROLL)


def listed(inventory):
    return [(r.seed, r.resourceId, r.name) for r in inventory.orderBy("seed", "resourceId").collect()]


def test_inventory(spark, logs):
    put(logs, "app.log", "the main log file\n", age=50)
    put(logs, "app-1.log", "the oldest of the rolled files\n", age=20)
    put(logs, "app-2.log", "another rolled file\n", age=10)
    put(logs, "app-3.log", "of the same age, by name\n", age=10)
    first = m.file_inventory(spark, logs, MAIN, ROLL, seed=7)
    assert listed(first) == [(7, 0, "app-1.log"), (7, 1, "app-2.log"), (7, 2, "app-3.log"), (7, 3, "app.log")]
    assert m.first_file(first).first().name == "app-1.log" and m.last_file(first).first().name == "app.log"
    assert [r.nextResourceId for r in m.with_next(first).orderBy("resourceId").collect()] == [1, 2, 3, None]

    kept = spark.createDataFrame(first.collect(), first.schema)
    os.remove(os.path.join(logs, "app-1.log"))
    put(logs, "app-4.log", "one more rolled file\n", age=5)
    assert listed(m.file_inventory(spark, logs, MAIN, ROLL, kept, seed=9)) == [
        (7, 1, "app-2.log"),
        (7, 2, "app-3.log"),
        (7, 3, "app-4.log"),
        (7, 4, "app.log"),
    ]
    put(logs, "app-2.log", "has shrunk since..\n", age=900)  # the head is not the same file any more
    assert listed(m.file_inventory(spark, logs, MAIN, ROLL, kept, seed=9))[0] == (9, 0, "app-2.log")


def test_inventory_of_a_file_alone(spark, logs):
    put(logs, "app.log", "the main log file\n")
    first = m.file_inventory(spark, logs, MAIN, ROLL, seed=7)
    kept = spark.createDataFrame(first.collect(), first.schema)
    assert listed(m.file_inventory(spark, logs, MAIN, ROLL, kept, seed=9)) == [(7, 0, "app.log")]
    moved = kept.withColumn("resourceId", F.lit(3).cast("long"))
    assert listed(m.file_inventory(spark, logs, MAIN, ROLL, moved, seed=9)) == [(9, 0, "app.log")]
    put(logs, ".hidden", "x")
    os.remove(os.path.join(logs, "app.log"))
    assert listed(m.file_inventory(spark, logs, MAIN, ROLL, kept, seed=9)) == []


# -- tail: the planner and reader as plain objects ------------------------------------------------


def tail(logs, start_at="earliest", **options):
    return Tail({"path": logs, "mainPattern": MAIN, "rollPattern": ROLL, "settleSeconds": "0", **options}, start_at)


def read(source, start, end):
    rows = []
    for part in source.plan(start, end):
        for batch in source.records(part):
            rows += batch.to_pylist()
    assert len({r["seq"] for r in rows}) == len(rows)
    return rows


def values(source, start, end):
    return [r["value"] for r in read(source, start, end)]


def test_tail_starts_at_the_newest_file(logs):
    put(logs, "app-1.log", "an older line, long enough\n", age=20)
    put(logs, "app.log", "first line of the newest\nsecond\n", age=10)
    source = tail(logs, "newest")
    start = source.initial()
    assert values(source, start, source.latest(start)) == ["first line of the newest", "second"]
    source = tail(logs, "earliest")
    start = source.initial()
    assert len(values(source, start, source.latest(start))) == 3


@pytest.mark.parametrize("slice_bytes", [1, 7, 64, 10_000])
def test_slices_hold_every_line_once(logs, slice_bytes):
    lines = [f"line {i} " + "x" * (i * 7 % 50) for i in range(60)] + ["", "é中", "last"]
    put(logs, "app.log", "\n".join(lines) + "\n")
    source = tail(logs, sliceBytes=str(slice_bytes))
    rows = read(source, {}, source.latest({}))
    assert [r["value"] for r in rows] == lines
    data = "\n".join(lines).encode() + b"\n"
    assert all(data[r["start_pos"] : r["end_pos"]].decode() == r["value"] + "\n" for r in rows)


def test_half_written_line_waits(logs):
    source = tail(logs, settleSeconds="3600")
    put(logs, "app.log", "a complete line\nhalf")
    one = source.latest({})
    assert values(source, {}, one) == ["a complete line"]
    put(logs, "app.log", " a line\n", mode="a")
    two = source.latest(one)
    assert values(source, one, two) == ["half a line"]
    assert values(source, two, source.latest(two)) == []


def test_last_line_of_a_finished_file_needs_no_end(logs):
    put(logs, "app-1.log", "first of the rolled\nno line end", age=100)
    put(logs, "app.log", "main, still in use\nhalf", age=1)
    source = tail(logs, settleSeconds="0.5")
    assert values(source, {}, source.latest({})) == ["first of the rolled", "no line end", "main, still in use"]


def test_renamed_file_goes_on(logs):
    source = tail(logs)
    put(logs, "app.log", "one of the lines\ntwo\n")
    one = source.latest({})
    put(logs, "app.log", "three\n", mode="a")
    os.rename(os.path.join(logs, "app.log"), os.path.join(logs, "app-1.log"))
    put(logs, "app.log", "a fresh file with lines\n")
    assert values(source, one, source.latest(one)) == ["three", "a fresh file with lines"]


@pytest.mark.parametrize("longer", [False, True])
@pytest.mark.parametrize("rolled", ["app-1.log", "app-1.log.gz"])
def test_rolled_file_and_its_successor_start_alike(logs, longer, rolled):
    source = tail(logs)
    head = "time,level,message\n"
    put(logs, "app.log", head + "1,info,old\n")
    one = source.latest({})
    put(logs, rolled, head + "1,info,old\n2,info,late\n", age=10)
    fresh = ["9,info,new"] + (["9,info,a line that makes the file longer than the old one"] if longer else [])
    put(logs, "app.log", head + "\n".join(fresh) + "\n")
    two = source.latest(one)
    assert values(source, one, two) == ["2,info,late", head.strip(), *fresh]
    assert source.plan(two, source.latest(two)) == []


def test_rolled_and_gzipped_file_goes_on(logs):
    source = tail(logs)
    put(logs, "app.log", "one of the lines\ntwo\n")
    one = source.latest({})
    put(logs, "app-1.log.gz", "one of the lines\ntwo\nthree\n", age=10)
    put(logs, "app.log", "a fresh file with lines\n")
    two = source.latest(one)
    assert values(source, one, two) == ["three", "a fresh file with lines"]
    assert source.plan(two, source.latest(two)) == []


def test_file_between_two_names_keeps_its_place(logs):
    source = tail(logs)
    put(logs, "app.log", "one of the lines\ntwo\n")
    one = source.latest({})
    os.rename(os.path.join(logs, "app.log"), os.path.join(logs, "hidden.tmp"))
    two = source.latest(one)
    assert source.plan(one, two) == []
    os.rename(os.path.join(logs, "hidden.tmp"), os.path.join(logs, "app-1.log"))
    put(logs, "app-1.log", "three\n", mode="a")
    assert values(source, two, source.latest(two)) == ["three"]


def test_new_file_with_the_first_line_of_a_deleted_one(logs):
    source = tail(logs)
    put(logs, "app-1.log", "time,level,message\n1,info,old text\n")
    one = source.latest({})
    os.remove(os.path.join(logs, "app-1.log"))
    put(logs, "app-2.log", "time,level,message\n9,info,new text is longer\n")
    assert len(values(source, one, source.latest(one))) == 2


def test_truncated_file_starts_anew(logs):
    source = tail(logs)
    put(logs, "app.log", "one of the lines\ntwo\nthree\n")
    one = source.latest({})
    put(logs, "app.log", "other text, as short\n")
    two = source.latest(one)
    assert values(source, one, two) == ["other text, as short"]
    put(logs, "app.log", "one of the lines\nnew\n")
    three = source.latest(one)
    assert values(source, one, three) == ["one of the lines", "new"]


def test_file_renamed_after_planning(logs):
    put(logs, "app.log", "one of the lines\ntwo\n")
    source = tail(logs)
    parts = source.plan({}, source.latest({}))
    os.rename(os.path.join(logs, "app.log"), os.path.join(logs, "app-1.log"))
    assert [r["value"] for p in parts for b in source.records(p) for r in b.to_pylist()] == ["one of the lines", "two"]
    put(logs, "app-1.log.gz", "one of the lines\ntwo\nthree\n")
    os.remove(os.path.join(logs, "app-1.log"))
    assert [r["value"] for p in parts for b in source.records(p) for r in b.to_pylist()] == ["one of the lines", "two"]
    os.remove(os.path.join(logs, "app-1.log.gz"))
    with pytest.raises(FileNotFoundError):
        list(source.records(parts[0]))


def test_caps(logs):
    for i in range(3):
        put(logs, f"app-{i}.log", "".join(f"file {i} line {j}\n" for j in range(20)), age=30 - i)
    source = tail(logs, maxBytesPerTrigger="100")
    offset, rows, batches = {}, [], 0
    while True:
        after = source.latest(offset)
        got = values(source, offset, after)
        if not got:
            break
        assert len(got) <= 8
        rows += got
        offset, batches = after, batches + 1
    assert rows == [f"file {i} line {j}" for i in range(3) for j in range(20)] and batches > 5
    source = tail(logs, maxFilesPerTrigger="1")
    assert len(values(source, {}, source.latest({}))) == 20


def test_unsettled_gzip_waits(logs):
    put(logs, "app-1.log.gz", "one of the lines\n")
    source = tail(logs, settleSeconds="3600")
    assert source.latest({}) == {}
    assert values(tail(logs), {}, tail(logs).latest({})) == ["one of the lines"]


def test_chunks(logs):
    text = "".join(f"lïne {i}\n" for i in range(50))
    put(logs, "app.log", text.encode() + b"bad \xff byte\n")
    for size in ("1000000", "64", "1"):
        source = tail(logs, chunkChars=size, sliceBytes="100")
        got = values(source, {}, source.latest({}))
        assert "".join(got) == text + "bad � byte\n" and max(map(len, got)) <= int(size)


@pytest.mark.parametrize("options", [{}, {"chunkChars": "7"}])
def test_many_small_slices_share_tasks(logs, monkeypatch, options):
    from millrace.sources import tail as module

    put(logs, "app-1.log", "".join(f"lïne {i}\n" for i in range(3000)), age=9)
    put(logs, "app.log", "".join(f"main {i}\n" for i in range(50)) + "half a line")
    source = tail(logs, sliceBytes="20", **options)
    known = {module.IDS: {"head": "", "pos": 1000}}
    after = source.numbered(known, source.latest({}))
    parts, rows = source.plan(known, after), read(source, known, after)
    assert 200 < len(parts) <= module.TASKS + 2 and sum(1 for p in parts for _ in p.slices()) > 1000
    assert [p.base + p.room for p in parts] == [*(p.base for p in parts[1:]), after[module.IDS]["pos"]] and parts[0].base == 1000
    # The same as with a task for each slice, record numbers included.
    monkeypatch.setattr(module, "TASKS", 1 << 40)
    assert len(source.plan(known, after)) > 1000 and read(source, known, after) == rows
    # Slices as large as a task may be stay alone.
    monkeypatch.setattr(module, "TASKS", 1)
    monkeypatch.setattr(module, "TASK_BYTES", 40)
    assert max(p.end - p.start for p in source.plan(known, after)) == 40


def test_saved_cursor(logs):
    assert parse_cursor('{"fileCursor":{"idx":{"seed":1,"rId":2},"pos":3}}') == (2, 3)
    put(logs, "app-1.log", "an older line, long enough\n", age=20)
    put(logs, "app.log", "ééé and more text\nsecond\n", age=10)
    source = tail(logs, cursor='{"fileCursor":{"idx":{"seed":1,"rId":1},"pos":18}}')
    start = source.initial()
    assert values(source, start, source.latest(start)) == ["second"]
    gone = tail(logs, cursor='{"fileCursor":{"idx":{"seed":1,"rId":9},"pos":18}}')
    start = gone.initial()
    assert len(values(gone, start, gone.latest(start))) == 3


def test_bad_options(logs):
    for bad in ({"startAt": "middle"}, {"charset": "utf-16"}, {"sliceBytes": "0"}):
        with pytest.raises(ValueError):
            tail(logs, **bad)


# -- json -------------------------------------------------------------------------------------------


def test_json_in_and_out(spark):
    df = spark.createDataFrame([('{"a":{"b":1}}',), ("no json",), (None,)], "j string")
    parsed = m.from_json_frames(df, "j", "a struct<b:int>")
    assert [r.j.a.b if r.j and r.j.a else None for r in parsed.collect()] == [1, None, None]
    assert [r.body for r in m.to_json_frames(parsed, "body").collect()] == ['{"j":{"a":{"b":1}}}', "{}", "{}"]


def test_envelope(spark):
    df = m.stamp_source(spark.createDataFrame([(5, "text")], "id int, value string"), tags=["x"])
    frame = m.to_envelope(df).first()
    assert frame.event.asDict(True) == {
        "tags": ["source"],
        "id": 5,
        "value": "text",
        "source": {"sourceId": "undefined", "tags": ["x"]},
    }
    assert frame.ctx.asDict() == {"source.id": "5"}
    assert m.to_envelope(m.to_envelope(df)).columns == ["event", "ctx"]


def test_record_numbers_follow_the_offset(tmp_path):
    """However many batches there were, the next one's numbers begin where the last ended."""
    from millrace.sources.tail import IDS, Tail

    (tmp_path / "app.log").write_text("a line that is long enough\n" * 3)
    tail = Tail({"path": str(tmp_path), "mainPattern": "app", "settleSeconds": "0"}, "earliest")
    known = {IDS: {"head": "", "pos": (1 << 43) * ((1 << 19) + 1)}}
    after = tail.numbered(known, tail.latest(known))
    (part,) = tail.plan(known, after)
    assert part.base == known[IDS]["pos"] and part.base + part.room == after[IDS]["pos"]
    late = {**after, IDS: {"head": "", "pos": 1 << 63}}
    with pytest.raises(ValueError, match="numbers"):
        tail.plan(known, late)


def test_gzipped_file_with_another_content_is_read_from_the_start(tmp_path):
    import gzip

    from millrace.sources.tail import Tail

    head = "the same first line\n"
    (tmp_path / "app.log").write_text(head + "old one\nold two\n")
    tail = Tail({"path": str(tmp_path), "mainPattern": "app[.]log$", "rollPattern": "gz$", "settleSeconds": "0"}, "earliest")
    known = tail.latest({})
    (tmp_path / "app.log").unlink()
    (tmp_path / "app-1.gz").write_bytes(gzip.compress((head + "new one\nnew two\n").encode()))
    parts = tail.plan(known, tail.latest(known))
    lines = [row for part in parts for batch in tail.records(part) for row in batch.column(0).to_pylist()]
    assert lines == (head + "new one\nnew two").split("\n")


def test_json_that_does_not_parse_is_kept(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ("no json",), (None,)], "v string")
    rows = m.from_json_frames(df, "v", "a int", bad="bad").collect()
    assert [(r.v and r.v.a, r.bad) for r in rows] == [(1, None), (None, "no json"), (None, None)]
    kept = m.from_json_frames(df, "v", "variant").selectExpr("to_json(v) AS j").collect()
    assert kept[0].j == '{"a":1,"b":2}'


@pytest.mark.parametrize("rolled", ["app-1.log", "app-1.log.gz"])
@pytest.mark.parametrize("more", [1, 40])
def test_rolled_after_planning_with_a_shared_header(logs, rolled, more):
    """Files share their first line; the log is rolled, and a shorter or a longer one begins."""
    header, old = "time,level,message\n", "".join(f"{k},info,old text\n" for k in range(9))
    path = put(logs, "app.log", header)
    put(logs, "app-0.log", header + "7,info,another one\n" * 30)
    source = tail(logs, sliceBytes="40")
    one = source.latest({})
    put(logs, "app.log", old, mode="a")
    parts = source.plan(one, source.latest(one))
    assert len(parts) > 2
    if rolled.endswith("gz"):
        put(logs, rolled, header + old)
        os.remove(path)
    else:
        os.rename(path, os.path.join(logs, rolled))
    put(logs, "app.log", header + "9,info,new text is longer\n" * more)
    lines = [v for part in parts for batch in source.records(part) for v in batch.column("value").to_pylist()]
    assert lines == old.splitlines()
    os.remove(os.path.join(logs, rolled))
    with pytest.raises(FileNotFoundError):
        list(source.records(parts[0]))


def test_packed_file_shifted_after_planning(logs):
    header = "time,level,message\n"
    put(logs, "app-1.log.gz", header + "1,info,old text\n", age=60)
    source = tail(logs)
    parts = source.plan({}, source.latest({}))
    os.rename(os.path.join(logs, "app-1.log.gz"), os.path.join(logs, "app-2.log.gz"))
    put(logs, "app-1.log.gz", header + "2,info,newer text\n", age=60)
    assert [v for part in parts for batch in source.records(part) for v in batch.column("value").to_pylist()] == [header.strip(), "1,info,old text"]


@pytest.mark.parametrize("charset", ["UTF-16LE", "UTF-16BE", "UTF-32LE", "UTF-32BE"])
@pytest.mark.parametrize("slice_bytes", [7, 64, 1 << 20])
def test_code_units_of_more_bytes(logs, charset, slice_bytes):
    # Line ends of one byte inside characters: U+0A00, U+000A's bytes the other way round, U+0D0A.
    lines = [f"l {i} ਊ਀ഊ \U0001f600 " + "Ċ" * (i % 9) for i in range(40)] + ["", "crlf\r", "last"]
    text = "\n".join(lines) + "\n"
    put(logs, "app.log", text.encode(charset))
    source = tail(logs, charset=charset, sliceBytes=str(slice_bytes))
    rows = read(source, {}, source.latest({}))
    assert [r["value"] for r in rows] == [x.removesuffix("\r") for x in lines]
    data = text.encode(charset)
    assert all(data[r["start_pos"] : r["end_pos"]].decode(charset).rstrip("\r\n") == r["value"] for r in rows)
    assert len({r["seq"] for r in rows}) == len(rows)
    for size in ("1", "50", "100000"):
        pieces = tail(logs, charset=charset, sliceBytes=str(slice_bytes), chunkChars=size)
        got = values(pieces, {}, pieces.latest({}))
        assert "".join(got) == text and max(map(len, got)) <= int(size)


def test_byte_order_mark_is_no_text(logs):
    put(logs, "app.log", "﻿first line\nsecond\n".encode("UTF-16LE"))
    source = tail(logs, charset="UTF-16LE")
    assert values(source, {}, source.latest({})) == ["first line", "second"]


@pytest.mark.parametrize("charset", ["UTF-8", "ISO-8859-1", "UTF-16LE", "windows-1252"])
def test_pieces_come_without_a_line_end(logs, charset):
    """A file that grows by single bytes and has no line end: each character comes once."""
    text = "no line end, é ü ß " + ("\U0001f600 中" if charset.startswith("UTF") else "") + " and more"
    data = text.encode(charset)
    source = tail(logs, charset=charset, chunkChars="5")
    offset, got = {}, ""
    for k in range(20, len(data) + 1):
        put(logs, "app.log", data[:k])
        after = source.latest(offset)
        got += "".join(values(source, offset, after))
        offset = after
    assert got == text
    assert source.plan(offset, source.latest(offset)) == []


def test_driver_looks_for_no_line_ends(logs, monkeypatch):
    from millrace.sources.tail import Tail

    monkeypatch.setattr(Tail, "_boundary", lambda *a: pytest.fail("a line end was looked for"))
    put(logs, "app.log", "a line that is long\nhalf")
    source = tail(logs, maxBytesPerTrigger="25")
    one = source.latest({})
    put(logs, "app.log", " a line\n" + "x" * 100, mode="a")
    two = source.latest(one)
    source.plan(one, two)
    assert two["app.log"]["pos"] == 49


def test_lines_longer_than_batches_and_slices(logs):
    lines = ["x" * 300, "y" * 50, "", "z" * 1000]
    put(logs, "app.log", "\n".join(lines) + "\n")
    source = tail(logs, maxBytesPerTrigger="40", sliceBytes="16")
    offset, rows = {}, []
    while True:
        after = source.latest(offset)
        if after == offset:
            break
        rows += read(source, offset, after)
        offset = after
    assert [r["value"] for r in rows] == lines and len({r["seq"] for r in rows}) == len(rows)


def test_last_line_comes_when_its_file_is_rolled(logs):
    """Read to its end while it was the newest; without a line end, and never touched again."""
    source = tail(logs, settleSeconds="0.2")
    put(logs, "app.log", "a line that is long\nno end", age=5)
    one = source.latest({})
    assert values(source, {}, one) == ["a line that is long"]
    os.rename(os.path.join(logs, "app.log"), os.path.join(logs, "app-1.log"))
    put(logs, "app.log", "a new log that is long\n", age=2)
    two = source.latest(one)
    assert values(source, one, two) == ["no end", "a new log that is long"]
    assert source.plan(two, source.latest(two)) == []


def test_offset_does_not_grow_with_finished_files(logs):
    sizes = []
    for n in (5, 60):
        for k in range(n):
            put(logs, f"app-{k:03d}.log", f"file {k} and its only line\n", age=100_000 - k)
        put(logs, "app.log", "the newest of the files\nhalf")
        source = tail(logs, keepFinishedSeconds="50000")
        one = source.latest({})
        assert len(values(source, {}, one)) == n + 1 and len(one) == n + 1
        two = source.latest(one)
        assert values(source, one, two) == []
        sizes.append(len(two))
        put(logs, "app.log", " a line\n", mode="a")
        three = source.latest(two)
        assert values(source, two, three) == ["half a line"] and set(three) == {"app.log", "#done"}
    assert sizes[0] == sizes[1] == 2


def test_gone_files_are_kept_as_long_as_wanted(logs):
    put(logs, "app.log", "one of the lines\ntwo\n")
    for seconds, more in (("3600", ["three"]), ("0", ["one of the lines", "two", "three"])):
        source = tail(logs, keepGoneSeconds=seconds)
        one = source.latest({})
        os.rename(os.path.join(logs, "app.log"), os.path.join(logs, "away.tmp"))
        two = source.latest(one)
        os.rename(os.path.join(logs, "away.tmp"), os.path.join(logs, "app-1.log"))
        put(logs, "app-1.log", "three\n", mode="a")
        assert values(source, two, source.latest(two)) == more
        os.remove(os.path.join(logs, "app-1.log"))
        put(logs, "app.log", "one of the lines\ntwo\n")


def test_cursor_by_seed_and_number(spark, logs, tmp_path):
    kept = str(tmp_path / "index")
    names = ["app-1.log", "app-2.log", "app.log"]
    for k, name in enumerate(names):
        put(logs, name, f"the lines of file {k}\nsecond\n", age=30 - k)
    assert m.kept_inventory(spark, kept) is None
    first = m.keep_inventory(spark, logs, "^app[.]log$", "^app-", kept, seed=7)
    assert [(r.seed, r.resourceId, r.name) for r in first.orderBy("resourceId").collect()] == [(7, k, n) for k, n in enumerate(names)]
    os.remove(os.path.join(logs, "app-1.log"))
    put(logs, "app-3.log", "the lines of file 3\nsecond\n", age=25)
    again = m.keep_inventory(spark, logs, "^app[.]log$", "^app-", kept, seed=8)
    assert [(r.seed, r.resourceId, r.name) for r in again.orderBy("resourceId").collect()] == [(7, 1, "app-2.log"), (7, 2, "app-3.log"), (7, 3, "app.log")]
    cursor = lambda seed, number, pos=0: json.dumps({"fileCursor": {"idx": {"seed": seed, "rId": number}, "pos": pos}})
    assert m.cursor_place(again, cursor(7, 2, 5)) == ("app-3.log", 5)
    assert m.cursor_place(again, cursor(7, 0)) is None and m.cursor_place(again, cursor(9, 2)) is None
    config = {
        "source": {"class": "file", "props": {"target": {"directory": logs, "mainPattern": "^app[.]log$", "rollPattern": "^app-"}}},
        "endpoint": {"class": "gate", "props": {"name": "g"}},
    }
    root = str(tmp_path / "root")
    with pytest.raises(m.FlowConfigError):
        m.tap_stream(spark, config, cursor=cursor(7, 2))
    for name, place, want in (("a", cursor(7, 2, 20), ["second", "second", "the lines of file 2"]), ("b", cursor(9, 2), ["second"] * 3 + ["the lines of file 1", "the lines of file 2", "the lines of file 3"])):
        config["endpoint"]["props"]["name"] = name
        m.run_tap(spark, name, config, root, {"availableNow": True}, cursor=place, catalogue=kept, settleSeconds=0).awaitTermination()
        assert sorted(r.value for r in m.read_gate(spark, name, root).select("event.value").collect()) == want


def test_lines_in_wide_charsets_are_not_dealt_by_file(spark, logs):
    put(logs, "app.log", "a line, 中\n".encode("UTF-16LE") * 9)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large files
    try:
        rows = m.read_rolling(spark, logs, MAIN, ROLL, charset="UTF-16LE")
        assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
        assert [(r.value, r.file_name, r.file_size) for r in rows.collect()] == [("a line, 中", "app.log", 180)] * 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["tail_chunks_open", "charset_scan_utf16", "charset_scan"])
def test_more_documents_make_more_files(spark, tmp_path, monkeypatch, name):
    """No task writes or reads a fixed share of the table."""
    import catalog

    rows = spark.range(400).selectExpr("id AS doc_id", "concat_ws('', transform(sequence(1, 8), x -> sha2(string(10 * id + x), 512))) AS text")
    rows.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    folder = tmp_path / "files"
    monkeypatch.setattr(catalog.files.storage, "new_folder", lambda spark, label: str(folder))
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(list(folder.glob("part-*.txt"))) > 4
        if name == "tail_chunks_open":
            assert got[0].chars == 400 * (8 * 128 + 2)
        else:
            assert sorted(map(tuple, got)) == sorted(map(tuple, rows.collect()))
    finally:
        for key in sizes:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["tail_chunks_open", "charset_scan_utf16", "charset_scan"])
def test_documents_of_one_row_group_make_more_files(spark, tmp_path, monkeypatch, name):
    """One task reads them, so no partition can be split after the shuffle."""
    import catalog

    rows = spark.range(400).selectExpr("id AS doc_id", "concat_ws('', transform(sequence(1, 8), x -> sha2(string(10 * id + x), 512))) AS text")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    folder = tmp_path / "files"
    monkeypatch.setattr(catalog.files.storage, "new_folder", lambda spark, label: str(folder))
    monkeypatch.setattr(catalog.files, "PART_BYTES", 16 << 10, raising=False)
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    try:
        got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(list(folder.glob("part-*.txt"))) > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert [tuple(r) for r in got] == [(400 * (8 * 128 + 2),)] if name == "tail_chunks_open" else sorted(map(tuple, got)) == sorted(map(tuple, rows.collect()))
    finally:
        for key in sizes:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["tail_chunks_open", "charset_scan_utf16", "charset_scan"])
def test_short_documents_are_read(spark, tmp_path, name):
    """A file with one short document is read like any other, however the rows are dealt."""
    import catalog

    spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "ü")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == ([(8,)] if name == "tail_chunks_open" else [(1, "a"), (2, ""), (3, None), (4, "ü")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rolling_files_in_wide_charsets(spark, logs):
    put(logs, "app-1.log", "älter und länger ਊ\nzwei\n".encode("UTF-16BE"), age=5)
    put(logs, "app.log", "neu, mit Text 中\n".encode("UTF-16BE"))
    rows = m.read_rolling(spark, logs, "^app[.]log$", "^app-", charset="UTF-16BE").collect()
    assert sorted((r.value, r.file_name, r.rolled, r.file_size) for r in rows) == [
        ("neu, mit Text 中", "app.log", False, 32), ("zwei", "app-1.log", True, 48), ("älter und länger ਊ", "app-1.log", True, 48),
    ]
    put(logs, "euro.log", "preis 5 € und mehr\n".encode("windows-1252"))
    assert [r.value for r in m.read_rolling(spark, logs, "euro", "(?!)", charset="windows-1252").collect()] == ["preis 5 € und mehr"]
    with pytest.raises(m.FlowConfigError):
        m.read_rolling(spark, logs, "a", "b", charset="no-such-charset")
    with pytest.raises(m.FlowConfigError):
        m.stream_rolling(spark, logs, "a", "b", charset="UTF-16BE")
