"""Rolling log files as a table, and the numbered index of such files."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.errors import FlowConfigError
from millrace.operators.patterns import check_pattern
from millrace.sources import storage
from millrace.sources.tail import register_tail

# Fixed value: by default, files of this many bytes or fewer are not worth a look.
SMALLEST_FILE = 16
# Spark's file source skips files this much older than the newest one; here none are.
MAX_FILE_AGE = "36500d"
LINE_CHARSETS = ("UTF-8", "US-ASCII", "ISO-8859-1")


def _wanted(name: Column, size: Column, main: str, roll: str, smallest: int) -> Column:
    listed = name.rlike(roll) | name.rlike(main)
    return listed & ~name.startswith(".") & ~name.startswith("_") & ~name.endswith("zip") & (size > smallest)


def _lines(df: DataFrame, main: str, roll: str, charset: str, smallest: int) -> DataFrame:
    meta = F.col("_metadata")
    name, size = meta["file_name"], meta["file_size"]
    value = F.col("value")
    if charset.upper() != "UTF-8":
        # The text reader hands bytes through, so they can still be decoded.
        value = F.decode(value.cast("binary"), charset.upper())
    return df.where(_wanted(name, size, main, roll, smallest)).select(
        value.alias("value"),
        name.alias("file_name"),
        size.alias("file_size"),
        meta["file_modification_time"].alias("file_time"),
        name.rlike(roll).alias("rolled"),
        meta["file_block_start"].alias("block_start"),
    )


def _check(spark: SparkSession, main: str, roll: str, charset: str) -> None:
    check_pattern(spark, main)
    check_pattern(spark, roll)
    try:
        known = "\n\n".encode(charset) == 2 * "\n".encode(charset)
    except LookupError:
        known = False
    if not known:
        raise FlowConfigError(f"Charset {charset!r} is unknown or has no fixed line end: name the byte order of UTF-16 and UTF-32")


def read_rolling(
    spark: SparkSession, directory: str, main: str, roll: str, charset: str = "UTF-8", smallest: int = SMALLEST_FILE
) -> DataFrame:
    """Lines of the files whose name has a match of ``roll`` or ``main``.

    ``.gz`` files are unpacked; names that begin with a dot or ``_``, zip files and files of
    at most ``smallest`` bytes are left out, before they are opened. Order lines by ``rolled DESC, file_time, file_name`` for
    the order of the file index.

    Spark's text reader splits at single bytes; charsets beyond its three (UTF-16 and UTF-32 with
    their byte order, national ones) are read by the ``tail`` source, in slices that begin at whole
    characters.
    """
    _check(spark, main, roll, charset)
    if charset.upper() not in LINE_CHARSETS:
        return _wide_lines(spark, directory, main, roll, charset, smallest)
    return _lines(spark.read.text(directory), main, roll, charset, smallest)


def _wide_lines(spark: SparkSession, directory: str, main: str, roll: str, charset: str, smallest: int) -> DataFrame:
    register_tail(spark)
    options = {"path": directory, "mainPattern": main, "rollPattern": roll, "charset": charset, "smallestBytes": smallest, "startAt": "earliest", "settleSeconds": 0}
    lines = spark.read.format("tail").options(**options).load()
    files = spark.read.format("binaryFile").load(directory).select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_time")
    )
    # A row a file; dealt by file, all lines of one would go to one task.
    return lines.join(F.broadcast(files), "file").select(
        "value", F.col("file").alias("file_name"), "file_size", "file_time", F.col("file").rlike(roll).alias("rolled"), F.col("start_pos").alias("block_start")
    )


def stream_rolling(
    spark: SparkSession,
    directory: str,
    main: str,
    roll: str,
    charset: str = "UTF-8",
    max_files_per_trigger: int | None = None,
    smallest: int = SMALLEST_FILE,
) -> DataFrame:
    """:func:`read_rolling` as a stream of files that are complete when they appear. Files
    that still grow, and other charsets than Spark's three, need the ``tail`` source."""
    _check(spark, main, roll, charset)
    if charset.upper() not in LINE_CHARSETS:
        raise FlowConfigError(f"Files in {charset!r} are streamed by the tail source")
    reader = spark.readStream.format("text").option("maxFileAge", MAX_FILE_AGE)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _lines(reader.load(directory), main, roll, charset, smallest)


INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("seed", T.LongType()),
        T.StructField("resourceId", T.LongType()),
        T.StructField("dir", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("createdTimestamp", T.LongType()),
        T.StructField("sizeNow", T.LongType()),
    ]
)


def file_inventory(
    spark: SparkSession,
    directory: str,
    main: str,
    roll: str,
    previous: DataFrame | None = None,
    seed: int | None = None,
    smallest: int = SMALLEST_FILE,
) -> DataFrame:
    """Numbered index of a folder's log files, rolled ones first, oldest first.

    With the ``previous`` index, numbers continue from that of the oldest file if it is
    still known (same folder and name, not shrunk). Otherwise they start at 0 under
    ``seed``, by default the time now. A file that is alone keeps number 0 or starts anew.
    One row per file, never a file's content.
    """
    _check(spark, main, roll, "UTF-8")
    seed = int(time.time() * 1000) if seed is None else seed
    path = F.col("path")
    files = (
        spark.read.format("binaryFile")
        .load(directory)
        .select(
            F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"),
            F.regexp_extract(path, r"([^/]*)$", 1).alias("name"),
            F.unix_millis("modificationTime").alias("createdTimestamp"),
            F.col("length").alias("sizeNow"),
        )
        .where(_wanted(F.col("name"), F.col("sizeNow"), main, roll, smallest))
    )
    order = Window.partitionBy("dir").orderBy(~F.col("name").rlike(roll), "createdTimestamp", "name")
    numbered = files.withColumn("place", F.row_number().over(order) - F.lit(1))
    if previous is None:
        base = numbered.withColumns({"seed": F.lit(seed).cast("long"), "resourceId": F.col("place").cast("long")})
        return base.select(*INVENTORY_SCHEMA.names)
    known = previous.select(
        "dir", "name", F.col("seed").alias("oldSeed"), F.col("resourceId").alias("oldId"), F.col("sizeNow").alias("oldSize")
    )
    start = (
        numbered.groupBy("dir")
        .agg(F.count(F.lit(1)).alias("files"), F.min_by(F.struct("name", "sizeNow"), "place").alias("head"))
        .select("dir", "files", F.col("head.name").alias("name"), F.col("head.sizeNow").alias("sizeNow"))
        .join(known, ["dir", "name"], "left")
        .withColumn("known", F.coalesce(F.col("sizeNow") >= F.col("oldSize"), F.lit(False)))
        .withColumn("kept", F.col("known") & ((F.col("files") > 1) | (F.col("oldId") == 0)))
        .select(
            "dir",
            F.when(F.col("kept"), F.col("oldSeed")).otherwise(F.lit(seed)).cast("long").alias("seed"),
            F.when(F.col("kept"), F.col("oldId")).otherwise(F.lit(0)).cast("long").alias("first"),
        )
    )
    return (
        numbered.join(start, "dir")
        .withColumn("resourceId", F.col("first") + F.col("place"))
        .select(*INVENTORY_SCHEMA.names)
    )


def kept_inventory(spark: SparkSession, folder: str) -> DataFrame | None:
    """The index as :func:`keep_inventory` has left it last; None before the first time."""
    versions = sorted(p.rsplit("/", 1)[0] for p in storage.matching(spark, f"{folder}/*/_SUCCESS"))
    return spark.read.schema(INVENTORY_SCHEMA).parquet(versions[-1]) if versions else None


def keep_inventory(
    spark: SparkSession, directory: str, main: str, roll: str, folder: str, seed: int | None = None, smallest: int = SMALLEST_FILE
) -> DataFrame:
    """Bring the index kept in ``folder`` up to date with a folder of log files, and give it. Files
    keep their numbers as long as the oldest file that was known is still there, so a cursor
    that names a file by ``seed`` and number finds it in another session and after others went."""
    versions = sorted(p.rsplit("/", 2)[1] for p in storage.matching(spark, f"{folder}/*/_SUCCESS"))
    previous = kept_inventory(spark, folder)
    number = int(versions[-1]) + 1 if versions else 0
    index = file_inventory(spark, directory, main, roll, _surviving(previous), seed, smallest)
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{number:012d}")
    for old in versions[:-1]:
        storage.delete(spark, f"{folder}/{old}")
    return kept_inventory(spark, folder)


def _surviving(previous: DataFrame | None) -> DataFrame | None:
    """An index that stays readable while its folder is replaced."""
    return None if previous is None else previous.sparkSession.createDataFrame(previous.collect(), INVENTORY_SCHEMA)


def cursor_place(inventory: DataFrame, cursor: str) -> tuple[str, int] | None:
    """Name of the file that a saved cursor ``{"fileCursor": {"idx": {"seed", "rId"}, "pos"}}`` names,
    and how many characters of it were read; None if the index knows no such file."""
    place = json.loads(cursor)["fileCursor"]
    seed, number = int(place["idx"]["seed"]), int(place["idx"]["rId"])
    row = inventory.where((F.col("seed") == seed) & (F.col("resourceId") == number)).select("name").first()
    return None if row is None else (row["name"], int(place["pos"]))


def first_file(inventory: DataFrame) -> DataFrame:
    """Oldest file of each folder's index."""
    return _edge(inventory, F.min_by)


def last_file(inventory: DataFrame) -> DataFrame:
    """Newest file of each folder's index."""
    return _edge(inventory, F.max_by)


def _edge(inventory: DataFrame, pick) -> DataFrame:
    row = F.struct(*INVENTORY_SCHEMA.names)
    return inventory.groupBy("dir").agg(pick(row, F.struct("seed", "resourceId")).alias("file")).select("file.*")


def with_next(inventory: DataFrame) -> DataFrame:
    """Each file with the number of the one to read after it."""
    order = Window.partitionBy("dir", "seed").orderBy("resourceId")
    return inventory.withColumn("nextResourceId", F.lead("resourceId").over(order))
