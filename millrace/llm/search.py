"""Ranked lexical search by an Aho-Corasick scan of the documents.

The items' terms go into one automaton, each guarded by a space on both sides. A document is
turned into its terms with single guards between them (A-Z lowered, all other ASCII characters
but letters and digits to spaces), and one run of the automaton over that text gives every
occurrence of every item's term, so there is no index of the documents and no word of theirs
is looked up on its own.

Two scans: the first counts the documents, their terms, and for each item term the documents
that hold it; the second knows all weights, adds up each document's score for every item through
the lists of items that a term belongs to, and keeps the ``k`` best documents of an item in
each task. What leaves the tasks is ranked in two steps, first within salted groups of tasks.

Score: a term's weight ``w`` is ``floor(1000 * ln((2N + 2) / (2df + 1)))``; a document of ``n``
terms has ``m = 100 - 75 + (75 * n * N) div L``; an item's score is the sum over its terms,
repeats included, of ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``.

Defined results: null texts have no terms; documents without a term count nowhere; a null
``doc_id`` comes after all others of its score; documents that repeat are ranked each; each row
of the benchmark is an item, also if its id is null or repeats; items without a term, or of which
no document has any, have no rows; empty tables give none. Other columns are not read.

Scale: narrow scans. The automaton, the weights and the score table of a task grow with the
benchmark, so items are dealt into blocks of at most ``block_terms`` terms, and each block
makes its own two scans; nothing in a task or on the driver grows with the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
BLOCK_TERMS = 200_000
#: Tasks whose candidates are ranked together before all meet.
SALTS = 64

#: For each byte, itself if it belongs to a term (A-Z lowered), or a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str) -> list[str]:
    """A text's terms; their bytes are single characters."""
    return text.encode().translate(_FOLD).decode("latin-1").split()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        made.add_word(f" {term} ", number)
    if terms:
        made.make_automaton()
    return made


def occurrences(made: ahocorasick.Automaton, words: list[str]) -> Counter:
    """How often each item term occurs."""
    return Counter(number for _, number in made.iter(f" {' '.join(words)} "))


class Block:
    """Items, their distinct terms, and for each term the items that have it."""

    def __init__(self, items: list[tuple]):
        self.ids = [item for item, _ in items]
        self.terms: list[str] = []
        numbers: dict[str, int] = {}
        self.holders: list[dict[int, int]] = []
        for place, (_, text) in enumerate(items):
            for term in folded(text):
                if term not in numbers:
                    numbers[term] = len(self.terms)
                    self.terms.append(term)
                    self.holders.append({})
                whose = self.holders[numbers[term]]
                whose[place] = whose.get(place, 0) + 1


def blocks(benchmark: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """The benchmark in blocks of at most so many terms (or one item); the driver holds one at a time."""
    some: list[tuple] = []
    size = 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        n = len(folded(row["text"]))
        if some and size + n > block_terms:
            yield Block(some)
            some, size = [], 0
        some.append((row["item_id"], row["text"]))
        size += n
    if some:
        yield Block(some)


def _texts(column: pa.Array) -> Iterator[list[str]]:
    for value in column:
        yield [] if not value.is_valid else folded(value.as_py())


def _counting(shared):
    """Of each task: how many documents hold each term; under -1 the documents, under -2 their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        made = automaton(terms)
        held = np.zeros(len(terms), np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            for words in _texts(batch.column(0)):
                if not words:
                    continue
                n_docs += 1
                n_terms += len(words)
                found = occurrences(made, words)
                held[np.fromiter(found, np.int64, len(found))] += 1
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((held[some], [n_docs, n_terms])))], ["term", "n"])

    return count


class Best:
    """The ``k`` best documents of each item that a task has seen."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(n_items)]
        self.floor = np.zeros(n_items, np.int64)  # what a document has to reach

    def add(self, scores: np.ndarray, doc_id) -> None:
        for place in np.flatnonzero((scores >= self.floor) & (scores > 0)).tolist():
            rows = self.rows[place]
            rows.append((-int(scores[place]), doc_id is None, doc_id or 0))
            if len(rows) >= 4 * self.k:
                self._cut(place)

    def _cut(self, place: int) -> None:
        rows = self.rows[place]
        rows.sort()
        del rows[self.k :]
        if len(rows) == self.k:
            self.floor[place] = -rows[-1][0]

    def batch(self) -> pa.RecordBatch:
        columns: list[list] = [[], [], []]
        for place, rows in enumerate(self.rows):
            self._cut(place)
            for score, no_id, doc_id in rows:
                for column, value in zip(columns, (place, None if no_id else doc_id, -score)):
                    column.append(value)
        return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["place", "doc_id", "score"])


def _scoring(shared, n_docs: int, n_terms: int, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, starts, places, times, n_items = shared.value
        made = automaton(terms)
        best = Best(n_items, k)
        for batch in batches:
            for doc_id, words in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                found = occurrences(made, words) if words else None
                if not found:
                    continue
                m = 100 - 75 + (75 * len(words) * n_docs) // n_terms
                term = np.fromiter(found.keys(), np.int64, len(found))
                tf = np.fromiter(found.values(), np.int64, len(found))
                gain = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                # The items of all terms found, end to end.
                low, size = starts[term], starts[term + 1] - starts[term]
                at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                scores = np.zeros(n_items, np.int64)
                np.add.at(scores, places[at], times[at] * np.repeat(gain, size))
                best.add(scores, doc_id)
        yield best.batch()

    return score


def _ranked(docs: DataFrame, block: Block, k: int) -> DataFrame | None:
    """``(place, rank, doc_id, score)`` of the items of one block; None if no document has a term."""
    if not block.terms:
        return None
    context = docs.sparkSession.sparkContext
    counts = docs.select("text").mapInArrow(_counting(context.broadcast(block.terms)), "term long, n long")
    # A row for each term of the block, and two.
    known = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_terms = known.get(-1, 0), known.get(-2, 0)
    if not n_terms:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * known.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
    sizes = [len(h) for h in block.holders]
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    places = np.array([p for h in block.holders for p in h], np.int64)
    times = np.array([n for h in block.holders for n in h.values()], np.int64)
    shared = context.broadcast((block.terms, weights, starts, places, times, len(block.ids)))
    best = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scoring(shared, n_docs, n_terms, k), "place int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = best.withColumn("salt", F.spark_partition_id() % SALTS)
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("place", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= k)


def ranked_documents(docs: DataFrame, benchmark: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` best documents of each item."""
    spark, kind = docs.sparkSession, benchmark.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in blocks(benchmark, block_terms):
        found = _ranked(docs, block, k)
        if found is not None:
            ids = spark.createDataFrame(list(enumerate(block.ids)), f"place int, item_id {kind}")
            out = out.union(found.join(F.broadcast(ids), "place").select("item_id", "rank", "doc_id", "score"))
    return out
