"""The commit log of a gate, and the stream source that follows it: ``format("gate")``.

A gate's log is a row of numbered small files, each of which adds one batch or puts one
compacted folder in the place of several. A batch exists as soon as its number does::

    <gate>/log/<number / 100>/<number>.json      one commit each, numbers without gaps
    <gate>/log/snapshots/<number>.json           what there is after that commit

To find the end of the log takes a look at the newest snapshot and at the one or two folders
that come after it, however many commits there are. A stream's offset is one number.

This module imports nothing else from the package: its classes travel to the executors.
"""

from __future__ import annotations

import json
import sys
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Commits in a folder of the log, and from one snapshot to the next.
EVERY = 100
COMMIT = "commit"  # in compacted files, the number of the commit that a record came with
#: Rows of an Arrow batch that a task gives Spark.
ROWS = 10_000


@dataclass
class Entry:
    """One commit: a batch, or a folder that holds the batches of commits ``low`` to ``high``."""

    number: int
    day: str
    path: str
    size: int = 0
    producer: str = ""
    batch: str = ""
    low: int = 0
    high: int = 0
    replaces: list[int] = field(default_factory=list)
    time: float = 0.0
    removed: list[str] = field(default_factory=list)

    @property
    def compacted(self) -> bool:
        return bool(self.replaces)


@dataclass
class State:
    """What a gate holds after commit ``number``; ``replaced`` are folders that no new reader
    opens any more, with the time since when and the number of their own commit."""

    number: int = 0
    live: dict[int, Entry] = field(default_factory=dict)
    replaced: dict[str, list] = field(default_factory=dict)

    def apply(self, entry: Entry) -> None:
        for old in entry.replaces:
            gone = self.live.pop(old, None)
            if gone is not None:
                self.replaced[gone.path] = [entry.time, gone.number]
        for path in entry.removed:
            self.replaced.pop(path, None)
        if entry.path:
            self.live[entry.number] = entry
        self.number = entry.number

    def dump(self) -> str:
        return json.dumps({"number": self.number, "live": [asdict(e) for e in self.live.values()], "replaced": self.replaced})

    @classmethod
    def load(cls, text: str) -> State:
        parts = json.loads(text)
        return cls(parts["number"], {e["number"]: Entry(**e) for e in parts["live"]}, parts["replaced"])


class CommitLog:
    """Reading a log. ``store`` lists the names in a folder and gives the text of a file."""

    def __init__(self, gate: str, store):
        self.gate, self.store = gate.rstrip("/"), store

    def folder(self, number: int) -> str:
        return f"{self.gate}/log/{number // EVERY:09d}"

    def file(self, number: int) -> str:
        return f"{self.folder(number)}/{number:012d}.json"

    def snapshot_file(self, number: int) -> str:
        return f"{self.gate}/log/snapshots/{number:012d}.json"

    def _numbers(self, folder: str) -> list[int]:
        names = (n.removesuffix(".json") for n in self.store.names(folder) if n.endswith(".json"))
        return sorted(int(n) for n in names if n.isdigit())

    def newest_snapshot(self) -> int:
        return max(self._numbers(f"{self.gate}/log/snapshots"), default=0)

    def snapshot(self) -> State:
        number = self.newest_snapshot()
        return State.load(self.store.text(self.snapshot_file(number))) if number else State()

    def numbers(self, after: int) -> list[int]:
        """Commits after one, as far as they follow without a gap."""
        found: list[int] = []
        at = after + 1
        while True:
            known = set(self._numbers(self.folder(at)))
            stop = (at // EVERY + 1) * EVERY
            while at < stop and at in known:
                found.append(at)
                at += 1
            if at < stop:
                return found

    def head(self) -> int:
        """Number of the last commit."""
        number = self.newest_snapshot()
        return max(self.numbers(number), default=number)

    def entry(self, number: int) -> Entry:
        return Entry(**json.loads(self.store.text(self.file(number))))

    def entries(self, after: int) -> list[Entry]:
        return [self.entry(n) for n in self.numbers(after)]

    def state(self) -> State:
        state = self.snapshot()
        for entry in self.entries(state.number):
            state.apply(entry)
        return state

    def between(self, low: int, high: int, since: str | None = None) -> list[Entry]:
        """What holds the records of the commits after ``low`` up to ``high``: folders to be
        read whole, and compacted ones of which only those commits count. A reader that is
        close behind needs the new commits alone; any other takes what the gate holds now."""
        if 0 < low and high - low <= EVERY:
            try:
                entries = [self.entry(n) for n in range(low + 1, high + 1)]
                found = [e for e in entries if e.path and not e.compacted]
                if since is None and any(e.compacted for e in entries):
                    raise FileNotFoundError  # of what was compacted some may be gone
                return [e for e in found if since is None or e.day >= since]
            except FileNotFoundError:
                pass
        live = self.state().live.values()
        found = [e for e in live if (e.low <= high and e.high > low if e.compacted else low < e.number <= high)]
        return sorted((e for e in found if since is None or e.day >= since), key=lambda e: e.number)


class ArrowStore:
    """Files by way of Arrow, where there is no Spark session."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.uri = uri.rstrip("/")

    def local(self, path: str) -> str:
        return f"{self.root}{path[len(self.uri):]}"

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.local(folder), allow_not_found=True))
        return [f.base_name for f in found]

    def text(self, path: str) -> str:
        with self.fs.open_input_stream(self.local(path)) as stream:
            return stream.readall().decode()

    def files(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.local(folder)))
        return [f.path for f in found if not f.base_name.startswith(("_", ".")) and f.size]


@dataclass
class Part(InputPartition):
    """One file; of a compacted one, the commits after ``low`` up to ``high``."""

    file: str
    entry: Entry | None
    low: int
    high: int


def fitted(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """A column as another type: fields that are not there are null, others are left out."""
    if column.type == kind:
        return column
    if pa.types.is_struct(kind):
        own = {column.type.field(i).name: column.field(i) for i in range(column.type.num_fields)}
        parts = [fitted(own[f.name], f.type) if f.name in own else pa.nulls(len(column), f.type) for f in kind]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=column.is_null())
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(column.offsets, fitted(column.values, kind.value_type), type=kind, mask=column.is_null() if column.null_count else None)
    return column.cast(kind)


class GateReader(DataSourceStreamReader):
    """Records of the commits between two offsets, or with ``rows`` ``span`` only the offsets."""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.since = options.get("since")
        self.most = int(options.get("maxBatchesPerTrigger", 0))
        self.known = json.loads(options["resumeFrom"])[COMMIT] if options.get("resumeFrom") else None

    def _log(self) -> CommitLog:
        return CommitLog(self.options["path"], ArrowStore(self.options["path"]))

    def initialOffset(self) -> dict:
        self.known = int(self.options.get("after", 0))
        return {COMMIT: self.known}

    def latestOffset(self) -> dict:
        head = self._log().head()
        if self.known is not None:
            head = max(head, self.known)
            if self.most:
                head = min(head, self.known + self.most)
        self.known = head
        return {COMMIT: head}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start[COMMIT], end[COMMIT]
        if self.options.get("rows") == "span":
            return [Part("", None, low, high)]
        log = self._log()
        return [Part(file, e, low, high) for e in log.between(low, high, self.since) for file in log.store.files(f"{log.gate}/{e.path}")]

    def read(self, part: Part):
        target = to_arrow_schema(self.schema)
        if part.entry is None:
            yield pa.RecordBatch.from_arrays([pa.array([part.low]), pa.array([part.high])], schema=target)
            return
        entry = part.entry
        named = {"ingest_date": entry.day, "producer": entry.producer, "batch": entry.batch}
        with ArrowStore(self.options["path"]).fs.open_input_file(part.file) as opened:
            file = pq.ParquetFile(opened)
            wanted = [n for n in file.schema_arrow.names if n in target.names or n == COMMIT and entry.compacted]
            for rows in file.iter_batches(batch_size=ROWS, columns=wanted):
                if entry.compacted:
                    numbers = rows.column(rows.schema.get_field_index(COMMIT))
                    rows = rows.filter(pc.and_(pc.greater(numbers, part.low), pc.less_equal(numbers, part.high)))
                columns = []
                for want in target:
                    at = rows.schema.get_field_index(want.name)
                    if at >= 0:
                        columns.append(fitted(rows.column(at), want.type))
                    else:
                        value = named.get(want.name)
                        columns.append(pa.array([value] * len(rows), pa.string()).cast(want.type))
                yield pa.RecordBatch.from_arrays(columns, schema=target)


class GateDataSource(DataSource):
    @classmethod
    def name(cls):
        return "gate"

    def schema(self):
        return StructType.fromJson(json.loads(self.options["schema"]))

    def streamReader(self, schema):
        return GateReader(self.options, schema)


def register_gate(spark) -> None:
    """Make ``format("gate")`` known to a session."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(GateDataSource)
