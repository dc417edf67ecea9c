"""Spelling variants by permuterm rotations.

Words are maximal runs of Latin letters, with A-Z lowered. A word's permuterm rotations are
those of the word with a terminator behind it: ``cat`` gives ``cat$``, ``at$c``, ``t$ca`` and
``$cat``. Turned so that a character comes last, a rotation is a prefix (all the rest of the
word) and that character. So the words that differ from it by a replacement of the character
have a rotation that begins with the prefix and is as long, and the word that lacks the
character has a rotation that *is* the prefix. Rotations are sorted; each prefix range is
scanned once, its members being the shorter word, if there is one, and one word for each
character that can stand there. Two words that are a replacement apart meet in one range. A
character can be taken out of a run of equal ones at several places with the same result; only
the first of the run counts, so an indel too is met once.

A range does not emit its pairs. Of each member it emits how many near words it has there and
the most frequent of them, which is one row a member.

Forms: a word's form is its near word with the most occurrences (ties: the smallest in code-point
order) if it has ``ratio`` times as many as the word itself. Roots follow forms to their end
by pointer doubling; as occurrences grow by ``ratio`` at each step, chains are short.

Defined results: null and empty texts have no words; a null ``doc_id`` counts as the empty text
where slips are planted; repeated rows count each; an empty table gives no rows; other columns
are left alone.

Scale: texts are read once, in Arrow batches, and counted in each task before the shuffle. What
moves then is the vocabulary: ``2 * length + 1`` prefixes a word. A range has at most one member
for each of the 90 letters and the shorter word, however large the corpus, so no range is hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

LEAST_LENGTH, LEAST_TIMES, RATIO = 6, 5, 5
#: One in so many (document, word) pairs loses a letter; see :func:`word_counts`.
SLIP_EVERY = 199
TERMINATOR = "$"  # no letter
#: Distinct words that a task counts before it passes the counts on.
HELD = 300_000


def slipped(doc_id: bytes, word: str, every: int) -> str:
    """The word, or, if the checksum of document and word says so, the word without one letter."""
    mark = crc32(word.encode(), crc32(b":", crc32(doc_id)))
    if mark % every:
        return word
    at = mark % len(word)
    return word[:at] + word[at + 1 :]


def _counted(least: int, every: int):
    letters = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Counter(letters.findall(text.as_py().encode().lower().decode()))
                if every:
                    key = (doc_id or "").encode()
                    start = crc32(b":", crc32(key))
                    slips = [(w, own.pop(w)) for w in list(own) if not crc32(w.encode(), start) % every]
                    for word, n in slips:
                        own[slipped(key, word, every)] += n
                held.update({w: n for w, n in own.items() if len(w) >= least})
                if len(held) >= HELD:
                    yield emit(held)
                    held = Counter()
        yield emit(held)

    return count


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, slip_every: int = 0) -> DataFrame:
    """``(word, n)`` of all words of ``least_length`` letters and ``least_times`` occurrences.

    ``slip_every`` plants misspellings, for measurements: in about one of so many pairs of a
    document and a word, the word loses a letter there. 0 plants none.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # A word that has lost a letter has to have been one longer, so all runs that can matter are found.
    counts = rows.mapInArrow(_counted(least_length, slip_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def rotated(word: Column, at: Column, skip: int) -> Column:
    """What follows place ``at`` (from 0; ``skip`` characters left out), the terminator, and what is before it."""
    return F.concat(F.substring(word, at + 1 + skip, F.length(word)), F.lit(TERMINATOR), F.substring(word, 1, at))


def prefixes(words: DataFrame) -> DataFrame:
    """``(prefix, word, n, whole, first)``: for each place of a word the rotation that ends
    in its character, without it; and each rotation whole. ``first`` is false where the same
    character stands before it in the word."""
    at, word = F.col("at"), F.col("word")
    places = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    own = F.struct(rotated(word, at, 0).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first"))
    first = (at == 0) | (F.substring(word, at, 1) != F.substring(word, at + 1, 1))
    less = F.struct(rotated(word, at, 1).alias("prefix"), F.lit(False).alias("whole"), first.alias("first"))
    both = F.when(at < F.length(word), F.array(own, less)).otherwise(F.array(own))
    return places.select("word", "n", F.explode(both).alias("r")).select("r.prefix", "word", "n", "r.whole", "r.first")


def _best(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The two best words: most occurrences, then smallest."""
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:2]


def _range(members: list[tuple[str, int, bool, bool]]) -> Iterator[tuple[str, int, str, int]]:
    """Of each member of a prefix range: near words there, and the best of them."""
    whole = [(w, n) for w, n, is_whole, _ in members if is_whole]
    ended = [(w, n) for w, n, is_whole, _ in members if not is_whole]
    longer = [(w, n) for w, n, is_whole, first in members if first and not is_whole]
    best, best_longer = _best(ended), _best(longer)
    for w, n, is_whole, first in members:
        if is_whole:
            near, count = best_longer, len(longer)
        else:
            near = [b for b in best if b[0] != w]
            if first:
                near = near + whole
            count = len(ended) - 1 + first * len(whole)
        if count:
            yield (w, count, *_best(near)[0])


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix ranges, from rows sorted by prefix."""
    found: list[list] = [[], [], [], []]
    last, members = None, []

    def close() -> None:
        if len(members) > 1:
            for row in _range(members):
                for column, value in zip(found, row):
                    column.append(value)

    def emit() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(found, kinds)], ["word", "n_near", "near", "near_n"])
        for column in found:
            column.clear()
        return batch

    for batch in batches:
        # Most prefixes stand alone: of those only the batch's first and last can have company.
        alike = pc.equal(batch.column(0).slice(1), batch.column(0).slice(0, max(0, len(batch) - 1))).to_numpy(zero_copy_only=False)
        keep = np.ones(len(batch), bool)
        keep[1:-1] = alike[:-1] | alike[1:]
        for prefix, *member in zip(*(c.to_pylist() for c in batch.filter(pa.array(keep)).columns)):
            if prefix != last:
                close()
                last, members = prefix, []
            members.append(tuple(member))
        yield emit()
    close()
    yield emit()


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n_near, near, near_n)``: of each word that has near words, how many, the most
    frequent of them, and how often that one occurs."""
    ranges = prefixes(words).repartition("prefix").sortWithinPartitions("prefix")
    parts = ranges.mapInArrow(scanned, "word string, n_near long, near string, near_n long")
    # Most occurrences first, then the smallest word.
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    merged = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return merged.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n"))


def spelling_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Of ``(word, n)`` with distinct words: ``word, form, root, n, n_near, form_n``."""
    words = written(words.select("word", "n"), "words")
    near = neighbours(words).withColumnRenamed("word", "of")
    joined = words.join(near, F.col("word") == F.col("of"), "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    table = written(
        joined.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")),
        "forms",
    )
    roots = _roots(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    found = table.join(roots.withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Pointer doubling: each round joins every link to that of its end."""
    while True:
        ends = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        links = written(links.join(ends, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = links.where("moved").limit(1).count()
        links = links.drop("moved")
        if not moved:
            return links


def spelling_report(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, ratio: int = RATIO, slip_every: int = 0) -> DataFrame:
    """Words of the documents with their near words, forms and roots."""
    return spelling_forms(word_counts(docs, least_length=least_length, least_times=least_times, slip_every=slip_every), ratio)
