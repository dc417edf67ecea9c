"""Spelling variants against all pairs on small vocabularies."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from millrace.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(counts, ratio=5):
    out, forms = {}, {}
    for word, n in counts.items():
        close = sorted((-m, w) for w, m in counts.items() if near(word, w))
        if close and -close[0][0] >= ratio * n:
            forms[word] = close[0][1]
        out[word] = (n, len(close))
    rows = []
    for word, (n, k) in out.items():
        root = word
        while root in forms:
            root = forms[root]
        form = forms.get(word)
        rows.append((word, form, root, n, k, counts[form] if form else None))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed", range(4))
def test_forms_against_all_pairs(spark, seed):
    pick = random.Random(seed)
    words = {"".join(pick.choice("abé") for _ in range(pick.randint(1, 6))) for _ in range(150)}
    counts = {w: 5 ** pick.randint(0, 5) + pick.randint(0, 1) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.spelling_forms(table)) == brute(counts)


def test_runs_of_equal_letters_meet_once(spark):
    counts = {"aaa": 100, "aa": 10, "aaaa": 1, "baa": 3, "aab": 3, "a": 1}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.spelling_forms(table)) == brute(counts)


def test_long_chains_of_forms(spark):
    counts = {"x" * k: 5**k for k in range(1, 14)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.spelling_forms(table))
    assert got == brute(counts) and {r[2] for r in got} == {"x" * 13}


def brute_counts(rows, least, times, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and mark % every == 0:
                at = mark % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= times}


@pytest.mark.parametrize("every,least,times", [(0, 6, 5), (199, 6, 5), (3, 2, 1), (1, 1, 1)])
def test_counts_and_planted_slips(spark, small, every, least, times):
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(None, "Élan ÉLAN ÀÿÞ×÷ÞÀ  abcdefg"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.word_counts(docs, least_length=least, least_times=times, slip_every=every)
    assert {r.word: r.n for r in got.collect()} == brute_counts(rows, least, times, every)


def test_counts_leave_a_task_in_parts(spark, monkeypatch, small):
    whole = {tuple(r) for r in spelling.word_counts(small).collect()}
    counted = spelling._counted(6, 0)
    monkeypatch.setattr(spelling, "HELD", 50)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([str(r.doc_id) for r in small.collect()]), pa.array([r.text for r in small.collect()])], ["id", "text"])
    parts = Counter()
    batches = list(counted(iter([batch])))
    for part in batches:
        parts.update(dict(zip(*(c.to_pylist() for c in part.columns))))
    assert len(batches) > 5 and {(w, n) for w, n in parts.items() if n >= 5} == whole


def test_ranges_may_cross_batches():
    import pyarrow as pa

    rows = [("p$", "pa", 3, False, True), ("p$", "pb", 9, False, True), ("p$", "p", 1, True, False), ("q$", "q", 1, True, False)]
    names = ["prefix", "word", "n", "whole", "first"]
    batches = [pa.record_batch([pa.array([v]) for v in row], names) for row in rows]
    out = [r for b in spelling.scanned(iter(batches)) for r in b.to_pylist()]
    assert {r["word"]: (r["n_near"], r["near"]) for r in out} == {"pa": (2, "pb"), "pb": (2, "pa"), "p": (2, "pb")}
    assert [r for b in spelling.scanned(iter([])) for r in b.to_pylist()] == []


def test_odd_rows(spark, hostile, nothing):
    rows = [(r.doc_id, r.text) for r in hostile.select("doc_id", "text").collect()]
    assert rows_of(spelling.spelling_report(hostile, 3, 1)) == brute(brute_counts(rows, 3, 1, 0))
    assert spelling.spelling_report(nothing).count() == 0
    assert spelling.spelling_report(hostile, 40, 1).count() == 0
