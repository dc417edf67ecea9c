"""Streaming source of files that still grow: ``spark.readStream.format("tail")``.

Spark's file source reads a path once. This one remembers a byte position per file, so
appended lines are read where the last batch stopped, on the executors, in slices of a
bounded size; where slices are small, a task reads several that follow each other. Positions are
plain sizes: the driver does not look for line ends. A record belongs to the slice that its last byte lies in, so a task looks backwards from both ends of its
slice for where a record ends, and a half-written line comes with the batch that has its end.
A file is known by its name, its first line and a mark (a digest of the bytes
before a position), which a task checks again before it reads. One that was renamed, or
rolled and gzipped, is recognised by its first line and read on from where it was left.

Options: ``path`` (folder), ``mainPattern``, ``rollPattern``, ``startAt`` (``newest``: from
the start of the newest file, or ``earliest``), ``cursor`` (a saved cursor, see
:func:`parse_cursor`), ``maxBytesPerTrigger``, ``maxFilesPerTrigger``, ``sliceBytes``,
``chunkChars`` (pieces of at most so many characters instead of lines, which wait for no line
end), ``charset`` (with UTF-16 and UTF-32 the byte order is part of the name), ``cursorFile`` and
``cursorChars`` (start in this file, behind so many characters),
``smallestBytes`` (files of so many bytes or fewer are left out),
``settleSeconds`` (a file untouched for so long is complete), ``keepGoneSeconds`` (how long the
place of a file is kept that is listed under no name), ``keepFinishedSeconds`` (files that were
read whole and are older than this leave the offset, which so stays small; a file that old
which turns up later is taken for one of them), ``resumeFrom`` (offset JSON
of the last planned batch: without it the first batch after a restart has no caps and
cannot follow a file that was renamed while the query was down and is still missing).

This module imports nothing else from the package: its classes travel to the executors.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import time
import zlib
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, start_pos bigint, end_pos bigint, seq bigint"
SMALLEST_FILE = 16
BLOCK = 4 << 20
HEAD = 4096
MARK = 256
IDS = "#ids"  # in an offset, how many record numbers have been given away
WHOLE = -1  # position of a gzipped file that is read to its end
DONE = "#done"  # in an offset, the time up to which files were read whole and left it
KEEP_GONE_SECONDS, KEEP_FINISHED_SECONDS = 86_400, 30 * 86_400
# Looks at a file that is gone, and the time between them.
ATTEMPTS, ATTEMPT_SECONDS = 3, 0.5
# A batch has about so many tasks, unless they would read more than so many bytes.
TASKS, TASK_BYTES = 256, 128 << 20
# Room for the numbers of one gzipped file's lines: deflate expands at most 1032 times.
GZIP_RATIO, GZIP_LINES = 1032, 1 << 40


@dataclass
class Slice(InputPartition):
    """Records of one file whose last byte lies in ``[start, end)``. The batch reads this file
    from ``first`` to ``limit``; both ends are None for a gzipped file. ``mark`` is what has to
    stand before ``first`` and ``last`` what before ``limit`` (for a gzipped file: that of the
    whole). Its records are numbered from ``base``, at most ``room`` of them. ``exact``: a record
    begins at ``first``; ``closes``: one ends at ``limit``, with or without a line end. With a
    ``step`` these are several slices of so many bytes (the last may have fewer)."""

    path: str
    name: str
    head: str
    first: int
    start: int
    end: int | None
    limit: int | None
    base: int
    room: int
    mark: str = ""
    last: str = ""
    exact: bool = False
    closes: bool = False
    step: int = 0

    def slices(self):
        """Its slices one by one. Each has a record number more than bytes."""
        if not self.step:
            yield self
            return
        for k, cut in enumerate(range(self.start, max(self.end, self.start + 1), self.step)):
            stop = min(cut + self.step, self.end)
            yield replace(self, start=cut, end=stop, base=self.base + k * (self.step + 1), room=stop - cut + 1, step=0)


@dataclass(frozen=True)
class Found:
    """One listed file; ``head`` is a digest of its first line."""

    name: str
    path: str
    size: int
    mtime: float
    rolled: bool
    head: str

    @property
    def gzipped(self) -> bool:
        return self.name.endswith("gz")


def parse_cursor(text: str) -> tuple[int, int]:
    """``{"fileCursor": {"idx": {"seed", "rId"}, "pos"}}`` -> file number and position."""
    cursor = json.loads(text)["fileCursor"]
    return int(cursor["idx"]["rId"]), int(cursor["pos"])


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:32]


class Tail:
    """Listing, planning and reading, shared by the batch and the stream reader."""

    def __init__(self, options, start_at: str):
        self.directory = options["path"]
        self.main = re.compile(options.get("mainPattern", "."))
        self.roll = re.compile(options.get("rollPattern", "(?!)"))
        self.start_at = options.get("startAt", start_at)
        self.cursor = options.get("cursor")
        self.max_bytes = int(options.get("maxBytesPerTrigger", 64 << 30))
        self.max_files = int(options.get("maxFilesPerTrigger", 10_000))
        self.slice_bytes = int(options.get("sliceBytes", 128 << 20))
        self.chunk_chars = int(options.get("chunkChars", 0))
        self.charset = options.get("charset", "UTF-8")
        self.smallest = int(options.get("smallestBytes", SMALLEST_FILE))
        self.keep_gone = float(options.get("keepGoneSeconds", KEEP_GONE_SECONDS))
        self.keep_finished = float(options.get("keepFinishedSeconds", KEEP_FINISHED_SECONDS))
        self.cursor_file, self.cursor_chars = options.get("cursorFile"), int(options.get("cursorChars", 0))
        self.settle = float(options.get("settleSeconds", 5))
        self.heads: dict[str, tuple] = {}
        self.held: dict[str, tuple] = {}
        if self.start_at not in ("newest", "earliest"):
            raise ValueError(f"Unknown startAt {self.start_at!r}")
        if min(self.max_bytes, self.max_files, self.slice_bytes) < 1:
            raise ValueError("Caps and slices must be positive")
        self.end_mark = "\n".encode(self.charset)
        self.unit = len(self.end_mark)  # bytes of a code unit
        if self.unit not in (1, 2, 4) or "\n\n".encode(self.charset) != 2 * self.end_mark:
            raise ValueError(f"Charset {self.charset!r} has no fixed line end; name the byte order of UTF-16 and UTF-32")
        name = codecs.lookup(self.charset).name
        # Whether the end of a character can be told from the bytes before it.
        self.telling = self.unit > 1 or name in ("utf-8", "ascii") or len(bytes(range(256)).decode(self.charset, "replace")) == 256
        self.utf8, self.utf16 = name == "utf-8", name.startswith("utf-16")
        self.pieces = bool(self.chunk_chars) and self.telling
        self.slice_bytes = max(self.unit, self.slice_bytes - self.slice_bytes % self.unit)

    def _fs(self):
        return pafs.FileSystem.from_uri(self.directory)

    # -- listing, on the driver: names, sizes and first lines ---------------------

    def listing(self) -> list[Found]:
        """Files in index order: rolled ones first, then by time and name."""
        store, root = self._fs()
        wanted = []
        for info in store.get_file_info(pafs.FileSelector(root)):
            name = info.base_name
            listed = self.roll.search(name) or self.main.search(name)
            if not listed or name.startswith((".", "_")) or name.endswith("zip"):
                continue
            if info.type == pafs.FileType.File and info.size > self.smallest:
                wanted.append(info)
        # Only files that have changed since the last listing are opened.
        with ThreadPoolExecutor(16) as pool:
            heads = list(pool.map(lambda info: self._known_head(store, info), wanted))
        self.heads = {i.base_name: (i.size, i.mtime_ns, head) for i, head in zip(wanted, heads)}
        found = [
            Found(i.base_name, i.path, i.size, (i.mtime_ns or 0) / 1e9, bool(self.roll.search(i.base_name)), head)
            for i, head in zip(wanted, heads)
            if head is not None
        ]
        return sorted(found, key=lambda f: (not f.rolled, f.mtime, f.name))

    def _known_head(self, store, info) -> str | None:
        size, mtime, head = self.heads.get(info.base_name, (None, None, None))
        if (size, mtime) == (info.size, info.mtime_ns):
            return head
        try:
            return self._head(store, info.path)
        except FileNotFoundError:
            return None  # rolled away between listing and opening

    def _head(self, store, path: str) -> str | None:
        """None while the first line is not complete. For pieces, which have no lines, it is the
        first bytes that any listed file has."""
        with store.open_input_file(path) as stream:
            return self._head_in(stream, path)

    def _head_in(self, stream, path: str) -> str | None:
        data = stream.read(HEAD)
        if path.endswith("gz"):
            try:
                data = zlib.decompressobj(31).decompress(data, HEAD)
            except zlib.error:
                return None
        if self.pieces:
            return _digest(data[: min(self.smallest, HEAD - 1) + 1])
        cut = data.find(b"\n")
        if cut < 0:
            return _digest(data) if len(data) == HEAD else None
        return _digest(data[: cut + 1])

    def _mark(self, path: str, pos: int) -> str:
        """Digest of the bytes right before a position of a plain file; of a gzipped file
        read whole, of its size and the checksum at its end."""
        store, _ = self._fs()
        if path.endswith("gz"):
            if pos != WHOLE:
                return ""
            with store.open_input_file(path) as stream:
                size = stream.size()
                stream.seek(max(0, size - 8))
                return _digest(str(size).encode() + stream.read(8))
        if pos <= 0:
            return ""
        with store.open_input_file(path) as stream:
            return self._mark_in(stream, path, pos)

    @staticmethod
    def _mark_in(stream, path: str, pos: int) -> str:
        low = max(0, pos - MARK)
        stream.seek(low)
        data = stream.read(pos - low)
        if len(data) < pos - low:  # another file has come under this name
            raise FileNotFoundError(f"{path} ends before byte {pos}")
        return _digest(data)

    def _settled(self, file: Found) -> bool:
        return time.time() - file.mtime >= self.settle

    # -- where records end ---------------------------------------------------------------

    def _find_last(self, data: bytes, at: int) -> int:
        """Place behind the last line end in ``data``, which stands at ``at`` in its file; -1: none."""
        cut = data.rfind(self.end_mark)
        while cut >= 0 and (at + cut) % self.unit:
            cut = data.rfind(self.end_mark, 0, cut + self.unit - 1)
        return cut + self.unit if cut >= 0 else -1

    def _partial(self, data: bytes, at: int) -> int:
        """How many of the last bytes before place ``at`` of a file belong to a character that
        goes on behind it."""
        if self.unit > 1:
            odd = at % self.unit
            unit = data[len(data) - odd - 2 : len(data) - odd] if self.utf16 else b""
            if len(unit) == 2 and 0xD8 <= unit[1 if self.end_mark[0] else 0] < 0xDC:
                return odd + 2
            return odd
        if self.utf8:
            for k in range(1, min(3, len(data)) + 1):
                lead = data[-k]
                if lead & 0xC0 != 0x80:
                    return k if k < (4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1) else 0
        return 0

    def _boundary(self, path: str, pos: int, opened=None) -> int:
        """The last place at or before ``pos`` where a record ends: a line, or for pieces a character."""
        if pos <= 0:
            return 0
        if self.pieces:
            before = b"".join(self._blocks(path, max(0, pos - 6), pos, opened))
            return pos - self._partial(before, pos)
        if path.endswith("gz"):
            at = last = 0
            for data in self._blocks(path, 0, pos):
                cut = self._find_last(data, at)
                last = at + cut if cut >= 0 else last
                at += len(data)
            return last
        high, window = pos - pos % self.unit, 16 << 10
        while high > 0:
            low = max(0, high - window)
            cut = self._find_last(b"".join(self._blocks(path, low, high, opened)), low)
            if cut >= 0:
                return low + cut
            high, window = low, min(BLOCK, 4 * window)
        return 0

    # -- offsets: {file name: {"head", "pos", "mark"}} --------------------------------

    def _entry(self, file: Found, pos: int, exact: bool = False) -> dict:
        """``exact``: a record ends at the position, whatever stands before it."""
        entry = {"head": file.head, "pos": pos, "mark": self._mark(file.path, pos)}
        return {**entry, "exact": True} if exact else entry

    def _holds(self, path: str, entry: dict) -> bool:
        """Whether a file has the text before an entry's position. One that was read whole is
        only ever the same gzipped file. For another position, a gzipped file would have to
        be unpacked to tell: the executor that does so looks at the entry's mark."""
        gzipped, whole = path.endswith("gz"), entry["pos"] == WHOLE
        if whole and not gzipped:
            return False
        if not whole and (gzipped or entry["pos"] == 0):
            return True
        stamp = (self.heads.get(path.rsplit("/", 1)[-1]), entry["pos"], entry["mark"])
        if self.held.get(path, (None, None))[0] != stamp:
            try:
                size = self._fs()[0].get_file_info(path).size
                self.held[path] = stamp, (whole or size is None or size >= entry["pos"]) and self._mark(path, entry["pos"]) == entry["mark"]
            except FileNotFoundError:
                return True
        return self.held[path][1]

    def _known(self, name: str, head: str, path: str, offset: dict, present: dict) -> dict:
        """Where reading of a file goes on: its own entry, or that of the file it was
        renamed from, which is not under its old name any more."""
        own = offset.get(name)
        if own is not None and own["head"] == head and self._holds(path, own):
            return own
        folder = path.rsplit("/", 1)[0]
        for other, entry in offset.items():
            if other == name or other.startswith("#") or entry["head"] != head:
                continue
            stays = present.get(other) == head and self._holds(f"{folder}/{other}", entry)
            if not stays and self._holds(path, entry):
                return entry
        return {"head": head, "pos": 0, "mark": "", "exact": True}

    def initial(self) -> dict:
        files = self.listing()
        if not files:
            return {}
        at, pos = (len(files) - 1 if self.start_at == "newest" else 0), 0
        if self.cursor is not None:
            number, chars = parse_cursor(self.cursor)
            # A cursor into a file that is gone stands for the first known one.
            at = number if number < len(files) else 0
            pos = self._byte_position(files[at], chars) if number < len(files) else 0
        if self.cursor_file is not None:
            named = [k for k, f in enumerate(files) if f.name == self.cursor_file]
            at = named[0] if named else 0
            pos = self._byte_position(files[at], self.cursor_chars) if named else 0
        offset = {f.name: self._entry(f, WHOLE if f.gzipped else f.size, not f.gzipped) for f in files[:at]}
        if pos:
            offset[files[at].name] = self._entry(files[at], pos, True)
        return offset

    def _byte_position(self, file: Found, chars: int) -> int:
        # Saved cursors count characters.
        decoder = codecs.getincrementaldecoder(self.charset)("surrogateescape")
        at = 0
        for data in self._blocks(file.path, 0, None):
            text = decoder.decode(data)
            if len(text) >= chars:
                text = text[:chars]
            at += len(text.encode(self.charset, "surrogateescape"))
            chars -= len(text)
            if chars <= 0:
                break
        return at

    def latest(self, known: dict | None) -> dict:
        """Offset up to which there is something to read, within the caps if the last
        offset is known."""
        files = self.listing()
        while known is None and any(f.gzipped and not self._settled(f) for f in files):
            # Without the last offset there is no position to keep for such a file.
            time.sleep(min(self.settle, 1))
            files = self.listing()
        present = {f.name: f.head for f in files}
        done = (known or {}).get(DONE, {"pos": 0.0})["pos"]
        bytes_left, files_left = self.max_bytes, self.max_files
        wanted: list[tuple[Found, dict, int, bool]] = []
        for file in files:
            try:
                if file.mtime <= done and file.name not in (known or {}):
                    continue  # read whole long ago
                before = self._known(file.name, file.head, file.path, known or {}, present)
            except FileNotFoundError:
                continue  # gone meanwhile; the next listing has it under its new name
            pos, exact = before["pos"], before.get("exact", False)
            end = self._end(file, pos)
            changed = end != pos or not file.gzipped and not exact and self._closed(file, file is files[-1])
            if known is not None and changed:
                if files_left <= 0 or bytes_left <= 0:
                    end, changed = pos, False
                elif not file.gzipped:
                    end = min(end, pos + bytes_left) if end > pos else end
            if changed:
                files_left -= 1
                bytes_left -= file.size if file.gzipped else max(0, end - pos)
            closed = not file.gzipped and end == file.size and (changed and self._closed(file, file is files[-1]) or exact and not changed)
            wanted.append((file, before, end, closed))
        offset = {}
        with ThreadPoolExecutor(16) as pool:
            for (file, *_), entry in zip(wanted, pool.map(lambda w: self._next(known or {}, *w), wanted)):
                if entry is not None:
                    offset[file.name] = entry
        heads = {entry["head"] for entry in offset.values()}
        for name, entry in (known or {}).items():
            if name.startswith("#"):
                continue
            # A file between two names keeps its place for a while.
            if name not in offset and entry["head"] not in heads:
                since = entry.get("gone", int(time.time()))
                if time.time() - since < self.keep_gone:
                    offset[name] = {**entry, "gone": since}
        return self._forgotten(offset, known or {}, {f.name: f for f in files}, done)

    def _next(self, known: dict, file: Found, before: dict, end: int, closed: bool) -> dict | None:
        """The offset's entry for a file that is read up to ``end``."""
        if end == 0:
            return None
        try:
            old = known.get(file.name)
            same = old is not None and (old["head"], old["pos"]) == (file.head, end) and self._holds(file.path, old)
            if same or file.gzipped and end == before["pos"]:
                entry = {k: before[k] for k in ("head", "pos", "mark")}
                return {**entry, "exact": True} if closed or before.get("exact") else entry
            return self._entry(file, end, closed)
        except FileNotFoundError:
            return None

    def _forgotten(self, offset: dict, known: dict, files: dict[str, Found], done: float) -> dict:
        """The offset without files that were read whole long ago; one time stands for them. What
        this batch still reads of a file has to be in its offset."""
        limit = time.time() - self.keep_finished
        old = [
            n
            for n, e in offset.items()
            if n in files and files[n].mtime < limit and known.get(n) == e and (e["pos"] == WHOLE or e.get("exact") and e["pos"] == files[n].size)
        ]
        newest = max((files[n].mtime for n in old), default=0.0)
        # Files that are as old and not read whole keep all of that time from being given up.
        waiting = [f.mtime for n, f in files.items() if n not in old and f.mtime <= newest]
        if waiting:
            old = [n for n in old if files[n].mtime < min(waiting)]
        done = max([done, *(files[n].mtime for n in old)])
        kept = {n: e for n, e in offset.items() if n not in old}
        return {**kept, DONE: {"head": "", "pos": done}} if done else kept

    def numbered(self, known: dict | None, offset: dict) -> dict:
        """The offset with the record numbers given away up to it. The first ones lie above
        the time in nanoseconds, so that a tap set up anew gives none of an older one's."""
        if known is not None and IDS in known:
            last = known[IDS]["pos"] + sum(s.room for s in self.plan(known, offset))
        else:  # where the batch starts is not known here: room for all there is
            last = time.time_ns() + sum(f.size * (GZIP_RATIO if f.gzipped else 1) + f.size // self.slice_bytes + 2 for f in self.listing())
        return {**offset, IDS: {"head": "", "pos": last}}

    def _end(self, file: Found, pos: int) -> int:
        if pos == WHOLE:
            return WHOLE
        if file.gzipped:
            return WHOLE if self._settled(file) else pos
        return file.size

    def _closed(self, file: Found, newest: bool) -> bool:
        """Whether nothing more is written to a file, so that its last line needs no end."""
        return not newest and self._settled(file)

    # -- planning, on the driver --------------------------------------------------------

    def plan(self, start: dict, end: dict) -> list[Slice]:
        store, root = self._fs()
        present = {name: entry["head"] for name, entry in end.items() if "gone" not in entry and not name.startswith("#")}
        slices: list[Slice] = []
        base = 0
        for name, entry in end.items():
            if "gone" in entry or name.startswith("#"):
                continue
            head, high = entry["head"], entry["pos"]
            path = f"{root.rstrip('/')}/{name}"
            before = self._known(name, head, path, start, present)
            low, exact, closes = before["pos"], before.get("exact", False), entry.get("exact", False)
            if low == WHOLE or low == high and (exact or not closes):
                continue
            if high == WHOLE:
                size = store.get_file_info(path).size
                room = GZIP_LINES if size is None else min(size * GZIP_RATIO + 1, GZIP_LINES)
                slices.append(Slice(path, name, head, low, low, None, None, base, room, before["mark"], entry["mark"], exact))
                base += room
                continue
            low, mark, exact = (0, "", True) if low > high else (low, before["mark"], exact)  # written anew
            room = self._room(high - low)
            slices.append(Slice(path, name, head, low, low, high, high, base, room, mark, entry["mark"], exact, closes, self.slice_bytes))
            base += room
        if IDS in end:  # a stream's batch has the numbers right before its offset's
            first = end[IDS]["pos"] - base
            if first + base >= 1 << 63:
                raise ValueError("The tap has no record numbers left")
            slices = [replace(s, base=s.base + first) for s in slices]
        return self._tasks(slices)

    def _count(self, size: int) -> int:
        return max(1, -(-size // self.slice_bytes))

    def _room(self, size: int) -> int:
        return size + self._count(size)

    def _tasks(self, files: list[Slice]) -> list[Slice]:
        """What each task reads: slices of one file, as many as keep the number of tasks from growing
        with that of small slices. Neither records nor their numbers depend on it."""
        count = sum(self._count(f.end - f.start) for f in files if f.step)
        span = self.slice_bytes * max(1, min(-(-count // TASKS), TASK_BYTES // self.slice_bytes))
        tasks: list[Slice] = []
        for file in files:
            if not file.step:
                tasks.append(file)
                continue
            for cut in range(file.start, max(file.end, file.start + 1), span):
                stop = min(cut + span, file.end)
                base = file.base + (cut - file.start) // file.step * (file.step + 1)
                tasks.append(replace(file, start=cut, end=stop, base=base, room=self._room(stop - cut)))
        return tasks

    # -- reading, on the executors ---------------------------------------------------------

    def _blocks(self, path: str, start: int, end: int | None, opened=None):
        """Bytes of ``[start, end)``, all of them, or else an error. A gzipped file has to be
        unpacked up to there; of a plain one, ``opened`` is the open file."""
        at = start
        if not path.endswith("gz"):
            with nullcontext(opened) if opened else self._fs()[0].open_input_file(path) as stream:
                stream.seek(start)
                while end is None or at < end:
                    data = stream.read(BLOCK if end is None else min(BLOCK, end - at))
                    if not data:
                        if end is not None:
                            raise FileNotFoundError(f"{path} ends at byte {at}, before {end}")
                        return
                    at += len(data)
                    yield data
            return
        skip = start
        store, _ = self._fs()
        with store.open_input_stream(path, compression="gzip") as stream:
            while end is None or at < end:
                data = stream.read(BLOCK)
                if not data:
                    if end is not None:
                        raise FileNotFoundError(f"{path} ends at byte {at}, before {end}")
                    return
                drop = min(skip, len(data))
                skip -= drop
                data = data[drop:] if end is None else data[drop : drop + end - at]
                at += len(data)
                if data:
                    yield data

    def _locate(self, part: Slice) -> tuple[str, object]:
        """Path of the planned file and, if it is plain, the open file: the planned path or,
        if it was renamed meanwhile, another listed one, with the planned first line and
        marks. A file that is just being renamed gets a few more looks."""
        for attempt in range(ATTEMPTS):
            if attempt:
                time.sleep(ATTEMPT_SECONDS)
            try:
                fits, stream = self._fits(part.path, part)
                if fits:
                    return part.path, stream
            except FileNotFoundError:
                pass
            for file in self.listing():
                try:
                    fits, stream = self._fits(file.path, part) if file.head == part.head else (False, None)
                except FileNotFoundError:
                    continue
                if fits:
                    return file.path, stream
        raise FileNotFoundError(f"{part.path} is gone")

    def _fits(self, path: str, part: Slice) -> tuple[bool, object]:
        """Whether a file is the planned one, and the open file if so and plain. Looking and
        reading by one handle, a rename between them does no harm."""
        store, _ = self._fs()
        if part.end is None:
            return path.endswith("gz") and self._head(store, path) == part.head and self._mark(path, WHOLE) == part.last, None
        if path.endswith("gz"):  # rolled and packed meanwhile: unpacked to tell
            return self._head(store, path) == part.head and self._unpacked_marks(path, part), None
        stream = store.open_input_file(path)
        fits = False
        try:
            fits = self._head_in(stream, path) == part.head and all(
                not mark or self._mark_in(stream, path, pos) == mark for pos, mark in ((part.first, part.mark), (part.limit, part.last))
            )
        finally:
            if not fits:
                stream.close()
        return fits, stream if fits else None

    def _unpacked_marks(self, path: str, part: Slice) -> bool:
        for pos, mark in ((part.first, part.mark), (part.limit, part.last)):
            if mark and _digest(b"".join(self._blocks(path, max(0, pos - MARK), pos))) != mark:
                return False
        return True

    def _continues(self, path: str, part: Slice) -> bool:
        """Whether a gzipped file has, before the position, what the plain one had there."""
        low = max(0, part.start - MARK)
        try:
            before = b"".join(self._blocks(path, low, part.start))
        except FileNotFoundError:
            return False  # shorter than that
        return part.mark in ("", _digest(before))

    def _lines_in(self, path: str, opened, part: Slice):
        """``(position, bytes)`` of whole lines, some blocks at a time; a line of any length
        is put together once."""
        at, end = part.start, part.end
        if end is None and at > 0 and not self._continues(path, part):
            at = 0  # another file with the same first line
        if at != part.first or not part.exact:
            at = self._boundary(path, at, opened)
        if end is not None and not (part.closes and end == part.limit):
            end = self._boundary(path, end, opened)
        if end is not None and at >= end:
            return
        held: list[bytes] = []
        for data in self._blocks(path, at, end, opened):
            size = sum(map(len, held))
            if self.pieces:
                cut = len(data) - self._partial(data, at + size + len(data))
            else:
                cut = self._find_last(data, at + size)
            if cut <= 0:
                held.append(data)
                continue
            whole = b"".join([*held, data[:cut]])
            held = [data[cut:]] if cut < len(data) else []
            yield at, whole
            at += len(whole)
        rest = b"".join(held)
        if rest:
            yield at, rest

    def records(self, part: Slice):
        """Arrow batches of a task's slices, read by one handle."""
        path, opened = self._locate(part)
        with opened or nullcontext():
            for one in part.slices():
                yield from self._records_in(path, opened, one)

    def _records_in(self, path: str, opened, part: Slice):
        number = 0
        for at, data in self._lines_in(path, opened, part):
            values, starts, ends = self._chunks(data) if self.chunk_chars else self._rows(data)
            if part.end is None:
                seqs = np.arange(number, number + len(values))
                number += len(values)
                if number > part.room:
                    raise ValueError(f"{part.path} has too many lines")
            else:
                # By the position of a record's end, which lies in one slice only.
                seqs = ends + (at - part.start)
            yield pa.RecordBatch.from_arrays(
                [values, pa.repeat(pa.scalar(part.name, pa.string()), len(values)), pa.array(starts + at), pa.array(ends + at), pa.array(seqs + part.base)],
                names=["value", "file", "start_pos", "end_pos", "seq"],
            )

    def _rows(self, data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts of lines without their ends, and where they start and end."""
        if self.unit > 1:
            return self._wide_rows(data)
        raw = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(raw == 10) + 1
        if not len(ends) or ends[-1] < len(raw):
            ends = np.append(ends, len(raw))
        starts = np.concatenate(([0], ends[:-1]))
        keep = raw != 10
        last = ends - 1 - (raw[ends - 1] == 10)  # the last byte of each text
        keep[last[(last >= starts) & (raw[np.maximum(last, 0)] == 13)]] = False
        offsets = np.concatenate(([0], np.cumsum(keep)[ends - 1])).astype(np.int64)
        binary = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])
        if codecs.lookup(self.charset).name == "utf-8":
            try:
                return binary.cast(pa.large_string()).cast(pa.string()), starts, ends
            except pa.ArrowInvalid:
                pass
        return pa.array([row.decode(self.charset, "replace") for row in binary.to_pylist()], pa.string()), starts, ends

    def _wide_rows(self, data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The same for code units of two or four bytes."""
        kind = f"{'<' if self.end_mark[0] else '>'}u{self.unit}"
        codes = np.frombuffer(data[: len(data) - len(data) % self.unit], kind)
        ends = np.flatnonzero(codes == 10) + 1
        if not len(ends) or ends[-1] * self.unit < len(data):
            ends = np.append(ends, -(-len(data) // self.unit))
        ends = np.minimum(ends * self.unit, len(data))
        starts = np.concatenate(([0], ends[:-1]))
        texts = [data[a:b].decode(self.charset, "replace").removesuffix("\n").removesuffix("\r").removeprefix("\ufeff") for a, b in zip(starts, ends)]
        return pa.array(texts, pa.string()), starts, ends

    def _chunks(self, data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of at most ``chunk_chars`` characters."""
        errors = "surrogateescape" if self.unit == 1 else "surrogatepass"
        odd = len(data) % self.unit  # a broken last character
        text = data[: len(data) - odd].decode(self.charset, errors)
        pieces = [text[i : i + self.chunk_chars].encode(self.charset, errors) for i in range(0, len(text), self.chunk_chars)]
        pieces += [data[len(data) - odd :]] if odd else []
        ends = np.cumsum([len(p) for p in pieces])
        return pa.array([p.decode(self.charset, "replace") for p in pieces], pa.string()), ends - [len(p) for p in pieces], ends


class TailReader(DataSourceReader):
    """One pass over everything that is there now."""

    def __init__(self, options):
        self.tail = Tail(options, "earliest")

    def partitions(self):
        return self.tail.plan(self.tail.initial(), self.tail.latest(None)) or [InputPartition(None)]

    def read(self, partition):
        return self.tail.records(partition) if isinstance(partition, Slice) else iter(())


class TailStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.tail = Tail(options, "newest")
        resume = options.get("resumeFrom")
        self.known = json.loads(resume) if resume else None

    def initialOffset(self):
        self.known = self.tail.initial()
        return self.known

    def latestOffset(self):
        self.known = self.tail.numbered(self.known, self.tail.latest(self.known))
        return self.known

    def partitions(self, start, end):
        return self.tail.plan(start, end)

    def read(self, partition):
        return self.tail.records(partition)


class TailDataSource(DataSource):
    @classmethod
    def name(cls):
        return "tail"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TailReader(self.options)

    def streamReader(self, schema):
        return TailStreamReader(self.options)


def register_tail(spark) -> None:
    """Make ``format("tail")`` known to a session."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TailDataSource)
