"""Benchmark decontamination with a generalised suffix automaton.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered: ASCII letters
and digits, and every character beyond ASCII. The items' word sequences go into one suffix
automaton. A document's words run through it, and at each word it holds the longest match
that ends there. A match of ``window`` words or more means that the last ``window`` words
are a window of some item; an item shorter than that, but not empty, is one window itself.

Defined results: null and empty texts have no words and no hits; a null ``item_id`` makes
its words count as hits but is in no list; items that repeat count once by their id; an empty
benchmark leaves every document clean; other columns of the inputs are left alone.

Scale: one narrow pass over the documents, no shuffle. The automaton grows with the
benchmark, so items are dealt into blocks of at most ``block_words`` words, each with an
automaton of its own (two states a word at most), and every document runs through each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import per_text

WINDOW = 13
BLOCK_WORDS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: For each byte, itself if it belongs to a word (A-Z lowered), or a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])


def fold_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class SuffixAutomaton:
    """All substrings of many sequences of small integers, with the items they come from.

    ``shorts`` are the lengths of whole items shorter than the window, by the state that
    holds them; ``owners`` the items of each state whose substrings can reach ``window``.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str | None]] = []
        whole: list[tuple[list[int], str | None]] = []
        for item, words in items:
            if not words:
                continue
            sequence = [self.ids.setdefault(w, len(self.ids)) for w in words]
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
                ends.append((last, item))
            if len(sequence) < window:
                whole.append((sequence, item))
        # An item owns each state that holds an end of one of its prefixes, and all above it.
        self.owners: dict[int, set] = {}
        for state, item in ends:
            while state > 0 and self.length[state] >= window:
                known = self.owners.setdefault(state, set())
                if item in known:
                    break
                known.add(item)
                state = self.link[state]
        self.shorts: dict[int, dict[int, set]] = {}
        for sequence, item in whole:
            state = 0
            for symbol in sequence:
                state = self.next[state][symbol]
            self.shorts.setdefault(state, {}).setdefault(len(sequence), set()).add(item)
        self.least = min([window, *(len(s) for s, _ in whole)])

    @classmethod
    def of(cls, parts: dict) -> SuffixAutomaton:
        made = cls.__new__(cls)
        vars(made).update(parts)
        return made

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A copy of ``target`` for the shorter of its substrings."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:  # another item has been here
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        new = self._state(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target)
        return new

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans ``(start, end)`` of windows that occur, merged, and their items."""
        get = self.ids.get
        symbols = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], symbols >= 0, [0]))))
        spans: list[tuple[int, int]] = []
        items: set = set()
        for start, stop in zip(known[::2], known[1::2]):
            if stop - start >= self.least:
                self._run(symbols[start:stop].tolist(), int(start), spans, items)
        return spans, items

    def _run(self, symbols: list[int], at: int, spans: list, items: set) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state = size = 0
        for end, symbol in enumerate(symbols, at + 1):
            while state and symbol not in following[state]:
                state = link[state]
                size = length[state]
            state = following[state].get(symbol, 0)
            size = size + 1 if state else 0
            if size < self.least:
                continue
            longest = 0
            if size >= window:
                longest = size
                holder = state
                while length[link[holder]] >= window:
                    holder = link[holder]
                items |= self.owners[holder]
            if self.shorts:
                holder = state
                while holder > 0:
                    for short, whose in self.shorts.get(holder, {}).items():
                        if short <= size:
                            items |= whose
                            longest = max(longest, short)
                    holder = link[holder]
            if longest:
                start = end - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of at most ``block_words`` words (or one item); the driver holds
    one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    block: list = []
    size = 0
    for row in items.toLocalIterator():
        n = len(fold_words(row["text"]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += n
    yield block


def _matcher(shared) -> Callable[..., Column]:
    def make():
        automaton = SuffixAutomaton.of(shared.value)

        def work(texts):
            out = [[], [], [], []]
            for text in texts:
                words = fold_words(text)
                spans, items = automaton.matches(words)
                for column, value in zip(out, (len(words), sum(e - s for s, e in spans), sorted(i for i in items if i is not None), [x for s in spans for x in s])):
                    column.append(value)
            return out

        return work

    return per_text(RESULT, make)


def with_contamination(docs: DataFrame, benchmark: DataFrame, into: str = "found", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with a struct column more: ``n_words``, ``n_hit`` (words inside windows
    that occur), ``items`` (their ids, sorted as text) and ``spans`` (word starts and ends, flat).

    One block of items needs no shuffle. With more, each block is a pass of its own over the
    texts, whose hits meet by the texts' digests.
    """
    context = docs.sparkSession.sparkContext
    matchers = []
    for block in benchmark_blocks(benchmark, block_words):
        automaton = SuffixAutomaton(((item, fold_words(body)) for item, body in block), window)
        matchers.append(_matcher(context.broadcast(vars(automaton))))
    if len(matchers) == 1:
        return docs.withColumn(into, matchers[0](F.col(text)))
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    hits = None
    for number, matcher in enumerate(matchers):
        part = docs.select(digest.alias("key"), matcher(F.col(text)).alias("f")).where("f.n_hit > 0")
        part = part.select("key", F.lit(number).alias("block"), "f.items", "f.spans").dropDuplicates(["key", "block"])
        hits = part if hits is None else hits.union(part)
    hits = hits.groupBy("key").agg(F.flatten(F.collect_list("items")).alias("items"), F.collect_list("spans").alias("parts"))
    count = F.arrow_udf(lambda texts: pa.array([len(fold_words(t)) for t in texts.to_pylist()], pa.int64()), "long")
    unite = F.arrow_udf(
        lambda parts: pa.array([[x for s in merged([(a, b) for p in ps or [] for a, b in zip(p[::2], p[1::2])]) for x in s] for ps in parts.to_pylist()], pa.list_(pa.int64())),
        "array<long>",
    )
    joined = docs.withColumn("__key", digest).join(hits.select(F.col("key").alias("__key"), F.col("items").alias("__items"), unite("parts").alias("__spans")), "__key", "left")
    places = F.transform("__spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    n_hit = F.aggregate(places, F.lit(0).cast("long"), lambda total, x: total + x)
    found = F.struct(
        count(F.col(text)).alias("n_words"),
        F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct("__items")), F.array().cast("array<string>")).alias("items"),
        F.coalesce("__spans", F.array().cast("array<long>")).alias("spans"),
    )
    return joined.withColumn(into, found).select(*docs.columns, into)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def is_contaminated(found: str, coverage_percent: int = 5) -> Column:
    hit, words = F.col(f"{found}.n_hit"), F.col(f"{found}.n_words")
    return (hit > 0) & (100 * hit >= coverage_percent * words)


def cut_spans(text: str | None, spans: list[int]) -> str | None:
    """The text without the given word spans; what stood around words stays."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    ends, at = [], 0
    for word in folded.split():
        at = folded.index(word, at)
        ends.append((at, at + len(word)))
        at += len(word)
    pieces, last = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        pieces.append(raw[last : ends[start][0]])
        last = ends[end - 1][1]
    return b"".join([*pieces, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage_percent: int = 5) -> DataFrame:
    """The documents that are not contaminated, with the columns they had; spans of windows
    in them (too little of the text to give it up) are cut out."""
    remove = F.arrow_udf(lambda texts, spans: pa.array([cut_spans(t, s or []) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string()), "string")
    found = with_contamination(docs, benchmark, "__found", window=window).where(~is_contaminated("__found", coverage_percent))
    # Only texts with spans travel to Python again; the others go as nulls.
    touched = F.when(F.size("__found.spans") > 0, F.col("text"))
    return found.withColumn("text", F.coalesce(remove(touched, "__found.spans"), F.col("text"))).select(*docs.columns)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage_percent: int = 5) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items, contaminated``."""
    found = with_contamination(docs.select("doc_id", "text"), benchmark, window=window)
    return found.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), "found.items", is_contaminated("found", coverage_percent).alias("contaminated"))
