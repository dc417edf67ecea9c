"""Log files that Spark writes from the events table, scanned, indexed and tailed."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

import millrace as m
from catalog.steps import table
from millrace.sources import storage

QUERIES = {}
ORACLE = {}

LINE = "event_id bigint, event_type string, props string"
MAIN, ROLLED = r"^part-.*[.]txt$", r"^part-.*[.]txt[.]gz$"
# Bytes of a table for each partition that it is dealt to. Up to so many partitions Spark knows the sizes
# of their blocks exactly.
PART_BYTES, MOST_PARTS = 32 << 20, 2000


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def _log_lines(spark, sf):
    return table(spark, sf, "events").select(
        "event_type", F.to_json(F.struct("event_id", "event_type", "props")).alias("value")
    )


def _log_folder(spark, sf) -> str:
    """Errors as the main log, all else as rolled, gzipped files."""
    folder = storage.new_folder(spark, "logs")
    lines = _log_lines(spark, sf)
    error = F.col("event_type") == "error"
    # A fixed number of files, so that their index is known beforehand.
    lines.where(error).select("value").repartition(1).write.text(folder)
    lines.where(~error).select("value").repartition(2).write.mode("append").option("compression", "gzip").text(folder)
    return folder


LINE_SQL = """to_json({'event_id': event_id, 'event_type': event_type, 'props': props})"""


def _summary(lines):
    parsed = lines.withColumn("line", F.from_json("value", LINE))
    return parsed.groupBy(F.col("line.event_type").alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("line.event_id").alias("ids"),
        F.sum(F.length("line.props")).alias("chars"),
    )


SUMMARY_SQL = """SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids,
                        CAST(sum(length(props)) AS BIGINT) AS chars
                 FROM events {} GROUP BY event_type"""


@query(SUMMARY_SQL.format(""))
def rolling_scan(spark, sf):
    return _summary(m.read_rolling(spark, _log_folder(spark, sf), MAIN, ROLLED))


@query(SUMMARY_SQL.format("WHERE event_type <> 'error'"))
def gz_scan(spark, sf):
    """Rolled files alone."""
    return _summary(m.read_rolling(spark, _log_folder(spark, sf), "^nothing$", ROLLED))


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\xff]', '', 'g') AS text FROM documents")
def charset_scan(spark, sf):
    """Lines in ISO-8859-1."""
    return _coded_lines(spark, sf, "ISO-8859-1", F.regexp_replace("text", r"[^\x00-\xff]", ""))


@query("SELECT doc_id, text FROM documents")
def charset_scan_utf16(spark, sf):
    """Lines in UTF-16, whose line ends are two bytes."""
    return _coded_lines(spark, sf, "UTF-16LE", F.col("text"))


def _dealt_documents(spark, sf):
    """Documents in partitions of an even size, so that more of them make more files, not larger
    ones. A file may hold a single short one, so none is too small to be read."""
    # Spark splits a partition between the tasks that wrote it: with few of them (one row group is one
    # task) there have to be enough partitions from the start.
    parts = min(MOST_PARTS, storage.folder_size(spark, f"{sf}/documents.parquet") // PART_BYTES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    return table(spark, sf, "documents").hint("rebalance", parts, F.col("doc_id"))


def _coded_lines(spark, sf, charset, text):
    """Documents as JSON lines in a charset, written and read."""
    folder = storage.new_folder(spark, "coded")
    rows = _dealt_documents(spark, sf).select(F.to_json(F.struct("doc_id", text.alias("text"))).alias("value"))
    # The text writer hands bytes through, and writes the line end in the charset it is told.
    coded = rows.select(F.encode("value", charset).cast("string").alias("value"))
    coded.write.option("encoding", charset).option("lineSep", "\n").text(folder)
    lines = m.read_rolling(spark, folder, MAIN, "(?!)", charset=charset, smallest=0)
    return lines.select(F.from_json("value", "doc_id bigint, text string").alias("r")).select("r.*")


@query("SELECT CAST(sum(length(text) + 2) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL")
def tail_chunks_open(spark, sf):
    """Pieces of files that have no line end at all."""
    folder = storage.new_folder(spark, "open")
    # The writer's line end is one byte; all others are spaces here.
    rows = _dealt_documents(spark, sf).where("text IS NOT NULL").select(F.concat(F.lit("."), F.translate("text", "\n\r", "  ")).alias("value"))
    rows.write.option("lineSep", ".").text(folder)
    return _tail(spark, folder, chunkChars=1000, sliceBytes=30_000, smallestBytes=0).agg(F.sum(F.length("value")).alias("chars"))


@query(SUMMARY_SQL.format("WHERE event_type = 'error'"))
def tail_cursor(spark, sf):
    """A saved cursor finds its file by seed and number after an older file has gone."""
    folder, kept = _log_folder(spark, sf), storage.new_folder(spark, "index")
    index = m.keep_inventory(spark, folder, MAIN, ROLLED, kept, seed=1)
    main = m.last_file(index).first()
    storage.delete(spark, f"{folder}/{m.first_file(index).first()['name']}")
    cursor = json.dumps({"fileCursor": {"idx": {"seed": main["seed"], "rId": main["resourceId"]}, "pos": 0}})
    name, chars = m.cursor_place(m.keep_inventory(spark, folder, MAIN, ROLLED, kept, seed=2), cursor)
    return _summary(_tail(spark, folder, cursorFile=name, cursorChars=chars))


@query(
    f"""SELECT 1::BIGINT AS seed, i::BIGINT AS "resourceId", CASE WHEN i < 2 THEN i + 1 END::BIGINT AS "nextResourceId",
               i < 2 AS rolled,
               CASE WHEN i = 2 THEN (SELECT sum(octet_length(encode({LINE_SQL})) + 1) FROM events WHERE event_type = 'error') END::BIGINT AS "sizeNow"
        FROM range(3) t(i)"""
)
def file_inventory(spark, sf):
    """Numbers of the files: rolled ones first. Packed sizes depend on the packer."""
    inventory = m.file_inventory(spark, _log_folder(spark, sf), MAIN, ROLLED, seed=1)
    rolled = F.col("name").endswith("gz")
    return m.with_next(inventory).select("seed", "resourceId", "nextResourceId", rolled.alias("rolled"), F.when(~rolled, F.col("sizeNow")).alias("sizeNow"))


@query("SELECT 'first' AS place, TRUE AS rolled UNION ALL SELECT 'last', FALSE")
def file_edges(spark, sf):
    """The oldest file of the index is a rolled one, the newest the main log."""
    inventory = m.file_inventory(spark, _log_folder(spark, sf), MAIN, ROLLED, seed=1)
    first, last = m.first_file(inventory), m.last_file(inventory)
    both = first.withColumn("place", F.lit("first")).unionAll(last.withColumn("place", F.lit("last")))
    return both.select("place", F.col("name").endswith("gz").alias("rolled"))


@query(
    f"""SELECT 1::BIGINT AS seed, i::BIGINT AS "resourceId", i < 2 AS rolled,
               CASE WHEN i = 2 THEN (SELECT sum(octet_length(encode({LINE_SQL})) + 1) FROM events WHERE event_type = 'error')
                    WHEN i = 3 THEN (SELECT sum(octet_length(encode({LINE_SQL})) + 1) FROM events) END::BIGINT AS "sizeNow"
        FROM range(4) t(i)"""
)
def file_inventory_continued(spark, sf):
    """Numbers go on from the oldest file that is still known."""
    folder = _log_folder(spark, sf)
    before = m.file_inventory(spark, folder, MAIN, ROLLED, seed=1)
    before = spark.createDataFrame(before.collect(), before.schema)  # a few files, as they were
    _log_lines(spark, sf).select("value").repartition(1).write.mode("append").text(folder)
    after = m.file_inventory(spark, folder, MAIN, ROLLED, previous=before, seed=2)
    rolled = F.col("name").endswith("gz")
    return after.select("seed", "resourceId", rolled.alias("rolled"), F.when(~rolled, F.col("sizeNow")).alias("sizeNow"))


def _tail(spark, folder: str, **options):
    m.register_tail(spark)
    reader = spark.read.format("tail").option("path", folder).option("mainPattern", MAIN)
    reader = reader.option("rollPattern", ROLLED).option("settleSeconds", 0)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


@query(SUMMARY_SQL.format(""))
def tail_read(spark, sf):
    """The growing-file source, read once, in small slices."""
    return _summary(_tail(spark, _log_folder(spark, sf), sliceBytes=50_000))


@query(
    """SELECT CAST(sum(length(line) + 1) AS BIGINT) AS chars FROM
         (SELECT to_json({'event_id': event_id, 'event_type': event_type, 'props': props}) AS line FROM events)"""
)
def tail_chunks(spark, sf):
    """Pieces of at most 65,536 characters instead of lines."""
    chunks = _tail(spark, _log_folder(spark, sf), chunkChars=65_536)
    return chunks.agg(F.sum(F.length("value")).alias("chars"))
