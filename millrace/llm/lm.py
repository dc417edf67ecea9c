"""Language-model scores by stupid backoff over corpus counts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered. For every word of a text, the
longest n-gram ending there (``order`` words at most, within the text) that also occurs
elsewhere gives ``count(n-gram) / count(its first n - 1 words)``; every word of context given
up on the way costs a factor ``ALPHA``. A word that occurs nowhere else gets ``1 / N`` at one
factor more. *Elsewhere* is leaving-one-out: one occurrence, the one being scored, is taken off
every count. Logarithms are whole millionths, so sums do not depend on their order.

How: texts are cut into chunks of about ``CHUNK_WORDS`` words. A chunk's distinct n-grams of
each order are 64-bit hashes; they are dealt, packed, to count tables partitioned by hash. Each
part of the tables sums the counts of all chunks and joins them back to the chunks that asked;
a chunk, gathered by its key, turns its counts into its texts' sums.

Defined results: null and empty texts have no words and sum zero; rows that repeat are texts
like others (they see each other's words); an empty table gives no rows; only ``doc_id`` and
``text`` are read, and ids may be null or repeat. Texts are read twice and have to come in the
same order both times, as they do from a table; otherwise chunks miss their counts and the
query fails.

Scale: an n-gram travels once per chunk, at about six bytes, and its count back at about one;
texts travel once as word numbers. Hot n-grams are one entry per chunk. A part of the tables
about ``PART_GRAMS`` n-grams, as the number of parts grows with the corpus (up to 65,536 an
order, some 30 billion words; beyond that parts grow).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER, ALPHA = 3, 0.4
#: Words of a chunk, about, and n-grams of a part of a count table, about.
CHUNK_WORDS, PART_GRAMS = 3_000_000, 500_000
#: Words of a chunk that are scored at once, about.
BLOCK_WORDS = 250_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xBF58476D1CE4E5B9)


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pack(values: np.ndarray, level: int = 3) -> bytes:
    """A whole-number array as bytes: planes of its bytes, compressed."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + raw.itemsize.to_bytes(1, "little") + pa.Codec("zstd", level).compress(planes, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = pa.decompress(data[9:], n * width, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel()


class Chunk:
    """Texts as word numbers, with the hashes of their distinct words."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, lengths: np.ndarray):
        self.vocabulary, self.words, self.lengths = vocabulary, words, lengths

    @classmethod
    def of(cls, texts: Iterable[list[bytes]]) -> Chunk:
        """Words become numbers text by text, so each word's bytes are held once."""
        numbers: dict[bytes, int] = {}
        number = numbers.setdefault
        parts = [np.fromiter((number(w, len(numbers)) for w in text), np.uint32, len(text)) for text in texts]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
        return cls(hashes, np.concatenate([np.empty(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64))

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each n: the hash of the n words that end at each position, and where there
        are so many in the text."""
        begin = np.repeat((np.cumsum(self.lengths) - self.lengths).astype(np.int32), self.lengths)
        depth = np.arange(len(self.words), dtype=np.int32) - begin
        del begin
        own = self.vocabulary[self.words]
        gram = own
        for n in range(1, order + 1):
            if n > 1:
                longer = (gram[:-1] ^ (gram[:-1] >> np.uint64(29))) * _FINAL + own[1:] * _STEP + np.uint64(n)
                gram = np.concatenate((gram[:1], longer))
                del longer
            yield n, gram, depth >= n - 1

    def orders(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each n: the sorted hashes of distinct n-grams, and how often each occurs."""
        for n, gram, there in self.grams(order):
            yield n, *np.unique(gram[there], return_counts=True)

    def blocks(self, size: int) -> Iterator[Chunk]:
        """The texts in blocks of about ``size`` words."""
        ends = np.cumsum(self.lengths)
        at = word = 0
        while at < len(self.lengths):
            stop = max(at + 1, int(np.searchsorted(ends, word + size, "right")))
            yield Chunk(self.vocabulary, self.words[word : ends[stop - 1]], self.lengths[at:stop])
            at, word = stop, int(ends[stop - 1])

    def pack(self) -> bytes:
        parts = [pack(self.vocabulary), pack(self.words, 9), pack(self.lengths)]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def unpack(cls, data: bytes) -> Chunk:
        parts, at = [], 0
        while at < len(data):
            size = int.from_bytes(data[at : at + 8], "little")
            parts.append(unpack(data[at + 8 : at + 8 + size]))
            at += 8 + size
        return cls(parts[0], parts[1], parts[2].astype(np.int64))

    def key(self, ids: list) -> str:
        """The same for the same texts and ids, in whatever task they are read."""
        state = hashlib.blake2b(repr(ids).encode(), digest_size=10)
        for part in (self.vocabulary, self.words, self.lengths):
            state.update(part.tobytes())
        return state.hexdigest()


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list, Chunk]]:
    """Key, ids and texts of consecutive rows with about ``size`` words."""
    rows = (
        row
        for batch in batches
        for at in range(0, batch.num_rows, 256)
        for row in zip(*(batch.column(k).slice(at, 256).to_pylist() for k in (0, 1)))
    )

    def some(ids: list) -> Iterator[list[bytes]]:
        held = 0
        for doc_id, text in rows:
            words = split_words(text)
            ids.append(doc_id)
            held += len(words)
            yield words
            if held >= size:
                return

    serial = 0
    while True:
        ids: list = []
        chunk = Chunk.of(some(ids))
        if not ids:
            return
        yield f"{chunk.key(ids)}-{serial}", ids, chunk
        serial += 1


def _ask(order: int, size: int, bits: int):
    """Rows ``part, chunk, n, grams, times``: a chunk's distinct n-grams by their hash."""

    def ask(batches):
        for key, _, chunk in _chunks(batches, size):
            for n, found, times in chunk.orders(order):
                edges = np.searchsorted(found, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                rows = []
                for part, (grams, count) in enumerate(zip(np.split(found, edges), np.split(times, edges))):
                    if len(grams):
                        gaps = np.diff(grams, prepend=np.uint64(0))
                        rows.append((part, key, n, pack(gaps), pack(count.astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ASKED)], names=["part", "chunk", "n", "grams", "times"]) if rows else _NONE_ASKED

    return ask


_ASKED = (pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary())
_NONE_ASKED = pa.RecordBatch.from_arrays([pa.array([], t) for t in _ASKED], names=["part", "chunk", "n", "grams", "times"])


def _count(part: pa.Table) -> pa.Table:
    """One part of one order's table: counts over all chunks, joined back to each chunk."""
    chunks = part.column("chunk").to_pylist()
    number = part.column("part")[0].as_py()
    n = part.column("n")[0].as_py()
    grams = [np.cumsum(unpack(g), dtype=np.uint64) for g in part.column("grams").to_pylist()]
    times = [unpack(t) for t in part.column("times").to_pylist()]
    every, back = np.unique(np.concatenate(grams), return_inverse=True)
    # Sums of doubles are exact up to 2**53.
    total = np.bincount(back, weights=np.concatenate(times), minlength=len(every)).astype(np.int64)
    edges = np.cumsum([len(g) for g in grams])[:-1]
    replies = [pack(_narrow(total[b])) for b in np.split(back, edges)]
    return pa.table({"chunk": pa.array(chunks, pa.string()), "part": pa.array([number] * len(chunks), pa.int32()), "n": pa.array([n] * len(chunks), pa.int32()), "data": pa.array(replies, pa.binary()), "ids": pa.nulls(len(chunks), pa.list_(pa.string()))})


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 1 << 32 else np.uint64)


def _texts(size: int):
    def texts(batches):
        for key, ids, chunk in _chunks(batches, size):
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.string()), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([chunk.pack()], pa.binary()), pa.array([[None if i is None else str(i) for i in ids]], pa.list_(pa.string()))],
                names=["chunk", "part", "n", "data", "ids"],
            )

    return texts


def _score(order: int, alpha: float, total: int):
    def score(rows: pa.Table) -> pa.Table:
        replies: dict[int, list] = {}
        chunk = ids = None
        copies = 0
        for part, n, data, names in zip(*(rows.column(c).to_pylist() for c in ("part", "n", "data", "ids"))):
            if part < 0:
                chunk, ids, copies = Chunk.unpack(data), names, copies + 1
            else:
                replies.setdefault(n, []).append((part, data))
        del rows
        tables = []
        for n, found, _ in chunk.orders(order):
            parts = dict(replies.pop(n, ()))
            counts = np.concatenate([np.empty(0, np.uint8), *(unpack(parts[p]) for p in sorted(parts))])
            if len(counts) != len(found):
                raise ValueError("A chunk misses counts: the texts came in another order when they were read again")
            tables.append((found, counts))
        results = [block_scores(block, tables) for block in chunk.blocks(BLOCK_WORDS)]
        out = {"doc_id": pa.array(ids, pa.string()), "n_words": pa.array(chunk.lengths, pa.int64())}
        names = ["micro", *(f"n{n}" for n in range(order + 1))]
        out |= {name: pa.array(np.concatenate([r[k] for r in results]), pa.int64()) for k, name in enumerate(names)}
        return pa.concat_tables([pa.table(out)] * copies)

    def block_scores(block: Chunk, tables: list) -> list[np.ndarray]:
        n_words = len(block.words)
        known = np.zeros(n_words, np.int64)  # order of the n-gram that scores a word
        value = np.zeros(n_words)
        depth = np.ones(n_words, np.int64)  # words of context that could have been used, plus one
        shorter = np.full(n_words, total - 1, np.int64)
        for n, gram, here in block.grams(order):
            found, counts = tables[n - 1]
            own = np.zeros(n_words, np.int64)
            # Looked up in order, neighbours in the table come one after the other.
            order_here = np.flatnonzero(here)[np.argsort(gram[here])]
            own[order_here] = counts[np.searchsorted(found, gram[order_here])].astype(np.int64) - 1
            depth[here] = n
            # The context of the n-gram that ends here is the (n - 1)-gram that ends a word before.
            context = shorter if n == 1 else np.concatenate((shorter[:1], shorter[:-1]))
            use = here & (own > 0)
            value[use] = np.log(own[use] / context[use])
            known[use] = n
            shorter = own
        value[known == 0] = -math.log(max(total, 1))
        micro = np.floor((value + (depth - known) * math.log(alpha)) * 1e6 + 0.5).astype(np.int64)
        ends = np.cumsum(block.lengths)

        def by_text(numbers: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(numbers)))
            return sums[ends] - sums[ends - block.lengths]

        return [by_text(micro), *(by_text(known == n) for n in range(order + 1))]

    return score


#: Bytes that stand between words, as ``bytes.split()`` has it.
_BETWEEN = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def words_in(texts: pa.Array) -> int:
    """Words of all texts: where a byte of a word follows one that is not, or a text begins."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return 0
    between = _BETWEEN[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    starts = ~between
    starts[1:] &= between[:-1]
    begin = ends[:-1][np.diff(ends) > 0] - ends[0]
    starts[begin] = ~between[begin]
    return int(starts.sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.record_batch([pa.array([sum(words_in(b.column(0).slice(at, 1024)) for b in batches for at in range(0, len(b), 1024))], pa.int64())], ["n"])


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per document: ``doc_id, n_words, micro`` (sum of log scores, in millionths), and
    ``n0`` ... ``n{order}``: words scored by n-grams of each length (0: seen nowhere else)."""
    slim = docs.select("doc_id", "text")
    kind = dict(slim.dtypes)["doc_id"]
    total = slim.select("text").mapInArrow(_counted, "n long").agg(F.sum("n")).first()[0] or 0
    bits = min(16, max(4, (total // PART_GRAMS).bit_length()))
    asked = slim.mapInArrow(_ask(order, chunk_words, bits), "part int, chunk string, n int, grams binary, times binary")
    row = "chunk string, part int, n int, data binary, ids array<string>"
    replies = asked.groupBy("n", "part").applyInArrow(_count, row)
    texts = slim.mapInArrow(_texts(chunk_words), row)
    hits = ", ".join(f"n{n} long" for n in range(order + 1))
    scored = replies.union(texts).groupBy("chunk").applyInArrow(_score(order, alpha, total), f"doc_id string, n_words long, micro long, {hits}")
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))
