"""SimHash near duplicates by multi-index hashing.

Fingerprint: XXH64 (seed 42) of every shingle of 4 words, of the text with A-Z lowered; a bit
is set if it is set in over half of the hashes. Texts of fewer words hash their whole word
sequence, texts without words (null among them) have fingerprint zero.

Links: fingerprints at ``distance`` bits or fewer. The 64 bits are cut into segments. If every
segment ``k`` of two fingerprints differed in more than ``r_k`` bits, they would differ in at
least ``sum(r_k + 1)`` bits; the radii are chosen so that this exceeds ``distance``. So of two
linked fingerprints one lies, in some segment, in the Hamming ball of that segment's radius
around the other. Each fingerprint is entered once per segment, each asks for all keys of its
balls, and whatever meets is verified over all 64 bits.

Components: where many fingerprints share a key (near copies by the thousand), a task does
not emit all their pairs but only what joins them: each asker is linked to one member of each
group that its neighbours there already form. Components of links are the same. Keys with
over ``CHUNK`` members are dealt over several tasks, each of which holds one chunk of members
while the askers stream by.

Defined results: ``doc_id`` null stays null and is never the component's id unless no member
has one; rows that repeat are members like others; an empty table gives no rows; only
``doc_id`` and ``text`` are read.

Scale: whole texts are read in one narrow pass; then only (id, fingerprint) pairs move, and
for linking only distinct fingerprints do, about 50 rows of 24 bytes for each. Components are
found by alternating star contractions over links, with a written table after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import per_text, written

SHINGLE, DISTANCE, SEGMENTS = 4, 4, 3
#: Members of one key that a task holds at once.
CHUNK = 8192
RESULT = pa.schema([("fp", pa.int64())])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        raw = np.array(hashes[at : at + 4096], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, into: str = "fp", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    def make():
        return lambda texts: [[fingerprint(t, shingle) for t in texts]]

    return docs.withColumn(into, per_text(RESULT, make)(text)["fp"])


def layout(distance: int = DISTANCE, segments: int = SEGMENTS) -> list[tuple[int, int, int]]:
    """``(shift, bits, radius)`` of each segment."""
    spare = distance - segments + 1  # the radii must add up to this at least
    if spare < 0:
        segments, spare = distance + 1, 0
    parts, shift = [], 0
    for k in range(segments):
        bits = (64 - shift) // (segments - k)
        parts.append((shift, bits, spare // segments + (k < spare % segments)))
        shift += bits
    return parts


def _ball(bits: int, radius: int) -> np.ndarray:
    """All masks of up to ``radius`` set bits out of ``bits``."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in range(bits)}
    return np.array(sorted(masks), np.uint64)


def _probes(parts: list[tuple[int, int, int]]):
    """Arrow batches of fingerprints to their entries and questions: ``key`` (segment and
    value in one number), ``asks`` and ``fp``."""
    balls = [_ball(bits, radius) for _, bits, radius in parts]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 20_000):
                some = fps[at : at + 20_000]
                keys, asks, whose = [], [], []
                for number, ((shift, bits, _), ball) in enumerate(zip(parts, balls)):
                    own = (some >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
                    tag = np.uint64(number << 58)
                    keys += [own | tag, ((own[:, None] ^ ball[None, :]) | tag).ravel()]
                    asks += [np.zeros(len(own), bool), np.ones(len(own) * len(ball), bool)]
                    whose += [some, np.repeat(some, len(ball))]
                yield pa.record_batch(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(asks)), pa.array(np.concatenate(whose).view(np.int64))],
                    ["key", "asks", "fp"],
                )

    return expand


class _Run:
    """The members of one key and chunk, and the groups that links have formed among them."""

    def __init__(self, key):
        self.key = key
        self.members: list[np.ndarray] = []
        self.table: np.ndarray | None = None

    def ready(self) -> np.ndarray:
        if self.table is None:
            self.table = np.concatenate(self.members) if self.members else np.empty(0, np.uint64)
            self.group = np.arange(len(self.table))
        return self.table

    def ask(self, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
        table, links = self.ready(), []
        if not len(table):
            return links
        step = max(1, 2_000_000 // len(table))
        for at in range(0, len(fps), step):
            some = fps[at : at + step]
            near = np.bitwise_count(some[:, None] ^ table[None, :]) <= distance
            for row, fp in zip(near, some):
                found = np.flatnonzero(row)
                if not len(found):
                    continue
                # One member of each group; afterwards these groups are one.
                groups, first = np.unique(self.group[found], return_index=True)
                links += [(int(fp), int(table[found[k]])) for k in first if table[found[k]] != fp]
                if len(groups) > 1:
                    self.group[np.isin(self.group, groups)] = groups[0]
        return links


def _linker(distance: int):
    """Rows sorted by key, chunk and asks to links that keep components as they are."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(None)
        for batch in batches:
            key, chunk = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            fps = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            turns = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]) | (asks[1:] != asks[:-1])) + 1
            edges = np.concatenate(([0], turns, [len(key)])) if len(key) else np.zeros(1, int)
            links: list[tuple[int, int]] = []
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                name = (key[start], chunk[start])
                if asks[start]:
                    if name == run.key:
                        links += run.ask(fps[start:stop], distance)
                else:
                    if name != run.key:
                        run = _Run(name)
                    run.members.append(fps[start:stop])
            a = np.array([x for x, _ in links], np.uint64).view(np.int64)
            b = np.array([y for _, y in links], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return link


def links_of(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)`` with ``a < b``: linked pairs of the distinct fingerprints ``fp`` (its one
    column), enough of them to give the same components as all links. Each is verified."""
    parts = layout(distance, segments)
    rows = fps.mapInArrow(_probes(parts), "key long, asks boolean, fp long")
    # Each key's members and askers; keys nobody is in or nobody else asks for can't give links.
    crowd = _members(fps, parts).groupBy("key").count().where(F.col("count") > chunk)
    crowd = written(crowd.select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "simhash-crowds")
    if crowd.isEmpty():
        dealt = rows.withColumn("chunk", F.lit(0))
    else:
        joined = rows.join(crowd, "key", "left")
        n = F.coalesce("chunks", F.lit(1))
        spread = F.when(F.col("asks"), F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), n).cast("int")))
        dealt = joined.withColumn("chunk", F.explode(spread))
    dealt = dealt.select("key", "chunk", "asks", "fp").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "asks")
    return dealt.mapInArrow(_linker(distance), "a long, b long").distinct()


def _members(fps: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    keys = [F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(number << 58) for number, (shift, bits, _) in enumerate(parts)]
    return fps.select(F.explode(F.array(*keys)).alias("key"))


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: the smallest node reachable.

    Alternating star contractions: every node hands its larger neighbours to its smallest
    (large star), then its smaller ones (small star), until nothing changes; the number of
    rounds grows with the logarithm of the longest chain. A node's smallest neighbour comes
    from an aggregation, which reduces before it shuffles, and meets its links in a join,
    whose hot keys Spark splits.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    before = None
    while True:
        large = _star(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        small = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger=False)
        edges = written(small, label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = tuple(state)


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Join each node's neighbours ``b`` of ``a`` to the smallest of them and of itself."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = pairs.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = joined.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(marked: DataFrame, distance: int, segments: int) -> DataFrame:
    """``(fp, least, root)`` per distinct fingerprint of ``(doc_id, fp)`` rows, with its smallest id."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links_of(distinct.select("fp"), distance, segments), "simhash-links")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return rooted.select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, shingle: int = SHINGLE) -> DataFrame:
    """Per document: ``doc_id, fp, component_id``, the last being the smallest id reachable."""
    marked = written(with_fingerprint(docs.select("doc_id", "text"), shingle=shingle).select("doc_id", "fp"), "simhash-fingerprints")
    rooted = _rooted(marked, distance, segments)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # A root has as many rows as it has distinct fingerprints, not documents.
    named = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group of near duplicates, with the columns it had: the one with
    the smallest id (rows without id come last), then with the smallest fingerprint; of rows
    alike in both, the one with the smallest text and other columns. The documents are written
    with their fingerprints once, and read again when it is known which stay.
    """
    whole = written(with_fingerprint(docs, "__own", shingle=shingle), "simhash-texts")
    marked = whole.select("doc_id", F.col("__own").alias("fp"))
    rooted = _rooted(marked, distance, segments)
    rank = F.struct(F.col("least").isNull().alias("no_id"), F.col("least").alias("id"), "fp")
    chosen = rooted.groupBy("root").agg(F.min(rank).alias("best")).select(F.col("best.id").alias("__id"), F.col("best.fp").alias("__fp"))
    alike = marked.groupBy(F.col("doc_id").alias("__id2"), F.col("fp").alias("__fp2")).count().where("count > 1")
    same = (F.col("__fp") == F.col("__fp2")) & F.col("__id").eqNullSafe(F.col("__id2"))
    chosen = written(chosen.join(alike, same, "left").select("__id", "__fp", F.col("count").isNotNull().alias("__many")), "simhash-kept")
    there = (F.col("__own") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    held = whole.join(chosen, there)
    single = held.where("NOT __many").select(*docs.columns)
    if chosen.where("__many").isEmpty():
        return single
    return single.unionByName(_one_each(held.where("__many"), docs.columns))


def _one_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each (id, fingerprint): the smallest text, reduced before the shuffle."""
    whole = F.struct(F.col("text"), F.struct(*[F.col(c) for c in columns if c != "text"]).alias("rest"))
    least = rows.groupBy("__id", "__fp").agg(F.min(whole).alias("row"))
    return least.select(*[F.col("row.text") if c == "text" else F.col(f"row.rest.{c}") for c in columns])
