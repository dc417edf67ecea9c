"""A training corpus from ``documents``, in stages; each works on all rows its predecessor kept.

1. ``toxicity``: documents that the classifier predicts toxic go.
2. ``simhash``: of each group of near duplicates one document stays.
3. ``decontaminate``: contaminated documents go; windows of benchmark items in others are cut.
4. ``pii``: personal data is masked; every document stays.
5. ``mix``: sources in the target weights; a row for each epoch a document is in, its text
   cut where a leaf's prefix ends.

Every stage but the last returns the columns of ``documents``. Stages are written as Parquet
to the shared folder and read again. SQL cannot express the learned stages, so there is no
``ORACLE_SQL``; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import read_table, written
from millrace.llm.decontaminate import decontaminate
from millrace.llm.mix import taken
from millrace.llm.pii import mask_pii
from millrace.llm.queries import mixed
from millrace.llm.simhash import keep_one
from millrace.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return taken(mixed(docs))


STAGES = [
    ("toxicity", toxicity),
    ("simhash", simhash),
    ("decontaminate", contamination),
    ("pii", pii),
    ("mix", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
