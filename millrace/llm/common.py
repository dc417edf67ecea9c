"""What the operators of this subpackage share: Arrow columns from texts, bounded samples,
intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.sources.storage import new_folder

#: Texts that a task turns into Python objects at once.
SLICE = 256

LETTERS_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_LOW = "abcdefghijklmnopqrstuvwxyz"

#: Separators of words: the ASCII white space, which is also what ``bytes.split()`` splits at.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, from a table in the shared folder: computed once, and with no lineage
    that a lost executor could make Spark run again. All tables of one application are in one
    folder below the shared one, which may go when the application has ended."""
    folder = new_folder(df.sparkSession, f"{df.sparkSession.sparkContext.applicationId}/{label}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def per_text(schema: pa.Schema, make: Callable[[], Callable[[list], list[list]]]) -> Callable[..., Column]:
    """A column function: a struct of ``schema`` for each text.

    ``make()`` runs once in each task and gives a function from a list of texts (None for
    null) to one list of values for each field. Texts come in Arrow batches and are worked
    on in slices, so memory follows the longest texts, not the batch.
    """
    kinds = list(schema)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            parts = []
            for at in range(0, len(batch), SLICE):
                values = work(batch.slice(at, SLICE).to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, kinds)], fields=kinds))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(kinds))

    return F.arrow_udf(column, from_arrow_schema(schema)).asNondeterministic()


def remainder5(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5: the fold that learning leaves out is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def held_out(doc_id: str) -> Column:
    return F.coalesce(remainder5(doc_id) == 0, F.lit(False))


def low_hash(hashed: Column, share: Column) -> Column:
    """Whether a signed 64-bit hash lies in the lowest ``share`` of all. Of many rows this
    leaves, before anything is sorted, few more than the lowest ones that are wanted."""
    return hashed.cast("double") <= -(2.0**63) + share * 2.0**64


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7) -> tuple[DataFrame, dict[int, int]]:
    """``(doc_id, label, text)`` of at most ``per_class`` rows of labels 0 and of 1, and how
    many labels of each there are. Only rows outside the held-out fold count.

    The ids are chosen by a seeded hash from the narrow label table, so that only the chosen
    documents' texts move; repeated ids count once (the larger label, the smallest text).
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder5("doc_id") != 0))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
    )
    ids = ids.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    counts = {r["_label"]: r["count"] for r in ids.groupBy("_label").count().collect() if r["_label"] in (0, 1)}
    chosen = None
    for value in (0, 1):
        share = F.lit(2.0 * per_class / max(1, counts.get(value, 0)) + 1e-6)
        part = ids.where((F.col("_label") == value) & low_hash(F.col("_h"), share)).orderBy("_h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    chosen = F.broadcast(chosen.select("doc_id", "_label"))  # at most 2 * per_class rows
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")
    return texts.groupBy("doc_id", "_label").agg(F.min("text").alias("text")), counts
