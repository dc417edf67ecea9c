"""Ranked search against a plain Python version."""

import math
import re
from collections import Counter

import pytest

from millrace.llm import search


def fold(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, items, k=10):
    docs = [(i, fold(t)) for i, t in rows]
    docs = [(i, w, Counter(w)) for i, w in docs if w]
    n_docs, n_terms = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, words, counts in docs:
            m = 100 - 75 + (75 * len(words) * n_docs) // n_terms
            score = 0
            for term in fold(text):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += weight * ((1000000000 * counts[term]) // (1000 * counts[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]


@pytest.mark.parametrize("block_terms,k,parts", [(200_000, 10, 3), (100, 10, 1), (1, 3, 7)])
def test_ranks_against_brute_force(spark, small, items, block_terms, k, parts):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    some = items if block_terms > 50 else items[:6]
    bench = spark.createDataFrame(some, "item_id long, text string")
    assert got(search.ranked_documents(docs, bench, k, block_terms)) == brute(rows, some, k)


def test_terms_stand_alone(spark):
    rows = [(1, "the cat, the-dog"), (2, "cathedral concat"), (3, "THE  CAT\tcat"), (4, "caté cat_cat é"), (5, "dog"), (6, "bird " * 3)]
    bench = [(1, "cat"), (2, "the the dog"), (3, "é"), (4, "nothing of it"), (5, "--"), (6, "cat the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(search.ranked_documents(docs, spark.createDataFrame(bench, "item_id long, text string")))
    assert found == brute(rows, bench)
    assert {(r[0], r[2]) for r in found if r[0] == 1} == {(1, 1), (1, 3), (1, 4)}


def test_ties_go_by_id(spark):
    rows = [(k % 40 if k else None, "one same text of words") for k in range(60)]
    docs = spark.createDataFrame(rows + [(100 + k, f"other{k}") for k in range(80)], "doc_id long, text string").repartition(5)
    bench = [(1, "same words"), (1, "same words"), (None, "same")]
    want = brute(rows + [(100 + k, f"other{k}") for k in range(80)], bench)
    assert got(search.ranked_documents(docs, spark.createDataFrame(bench, "item_id long, text string"))) == want
    assert len(want) == 30


def test_odd_rows(spark, hostile, nothing):
    rows = [(r.doc_id, r.text) for r in hostile.select("doc_id", "text").collect()]
    bench = [(1, "brown fox wort"), (None, "own words"), (2, None), (3, ""), (1, "brown fox jumps"), (4, "wörds \U0001f600 x")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    assert got(search.ranked_documents(hostile, table)) == brute(rows, bench)
    assert search.ranked_documents(nothing, table).count() == 0
    assert search.ranked_documents(hostile, table.where("false")).count() == 0
    assert search.ranked_documents(hostile, table.where("item_id = 3")).count() == 0
    named = spark.createDataFrame([("a", "brown fox")], "item_id string, text string")
    assert [r.item_id for r in search.ranked_documents(hostile, named).collect()] == ["a"] * 3
