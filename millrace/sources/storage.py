"""Folders on whatever file system the cluster uses, through Spark's own client."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from millrace.errors import FlowConfigError


_LOCAL: list[str] = []  # the local session's folder, made once


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``. Only a local
    session without it gets a folder on this machine, one for the whole process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise FlowConfigError("Set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="millrace-"))
    return _LOCAL[0]


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder nobody has used; it is not created."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _open(spark: SparkSession, path: str):
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()), handle


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a glob pattern finds."""
    fs, handle = _open(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(handle) or []]


def exists(spark: SparkSession, path: str) -> bool:
    fs, handle = _open(spark, path)
    return fs.exists(handle)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a folder to its place in one step."""
    fs, handle = _open(spark, source)
    _, goal = _open(spark, target)
    fs.mkdirs(goal.getParent())
    if not fs.rename(handle, goal):
        raise IOError(f"Cannot move {source} to {target}")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it exists: of several writers one succeeds."""
    fs, handle = _open(spark, path)
    fs.mkdirs(handle.getParent())
    try:
        stream = fs.create(handle, False)
    except Exception:
        if fs.exists(handle):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file, whole, unless there is one: of several writers one succeeds, and
    no reader sees a part of it. Local files are linked to their name; elsewhere a rename
    has to refuse a name that is taken, as it does on HDFS."""
    fs, handle = _open(spark, path)
    if fs.exists(handle):
        return False
    fs.mkdirs(handle.getParent())
    aside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    write_text(spark, aside, text)
    _, made = _open(spark, aside)
    if fs.getUri().getScheme() != "file":
        done = fs.rename(made, handle)
        if not done:
            fs.delete(made, False)
        return done
    files = spark._jvm.java.nio.file.Files
    place = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
    try:
        files.createLink(place(handle), place(made))
    except Exception:
        if fs.exists(handle):
            return False
        raise
    finally:
        fs.delete(made, False)
    return True


class SparkStore:
    """What :class:`millrace.sources.commit_log.CommitLog` reads by way of Spark."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def names(self, folder: str) -> list[str]:
        fs, handle = _open(self.spark, folder)
        try:
            return [status.getPath().getName() for status in fs.listStatus(handle)]
        except Exception:
            if fs.exists(handle):
                raise
            return []

    def text(self, path: str) -> str:
        try:
            return read_text(self.spark, path)
        except Exception:
            if exists(self.spark, path):
                raise
            raise FileNotFoundError(path) from None


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    fs, handle = _open(spark, path)
    return fs.getContentSummary(handle).getLength()


def modified(spark: SparkSession, path: str) -> float:
    """When a file or folder was last changed, in seconds."""
    fs, handle = _open(spark, path)
    return fs.getFileStatus(handle).getModificationTime() / 1000


def make_folder(spark: SparkSession, path: str) -> None:
    fs, handle = _open(spark, path)
    fs.mkdirs(handle)


def delete(spark: SparkSession, path: str) -> None:
    fs, handle = _open(spark, path)
    fs.delete(handle, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in place of any older one."""
    fs, handle = _open(spark, path)
    stream = fs.create(handle, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, handle = _open(spark, path)
    stream = fs.open(handle)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def last_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """Offset JSON of the last batch that a one-source query has planned."""
    numbered = [p for p in matching(spark, f"{checkpoint}/offsets/*") if re.search(r"/\d+$", p)]
    if not numbered:
        return None
    newest = max(numbered, key=lambda p: int(p.rsplit("/", 1)[1]))
    return read_text(spark, newest).strip().split("\n")[-1]
