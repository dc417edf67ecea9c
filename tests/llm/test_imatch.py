"""I-Match fingerprints against a plain Python version."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import imatch


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def terms(text):
    return set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))


def code(text):
    return int(md5(text)[:15], 16)


def lexicon(texts, low, high):
    df = Counter(t for text in texts for t in terms(text))
    return {t for t, n in df.items() if n >= 2 and low <= math.log2(len(texts) / n) + 1e-12 and math.log2(len(texts) / n) <= high + 1e-12}


def fingerprint(text, words):
    own = terms(text)
    codes = sorted(code(t) for t in own & words) or ([code(" ".join(sorted(own)))] if own else [])
    parts = []
    for shift, bits, subsets in imatch.SUBSETS:
        for number in range(subsets):
            some = [c for c in codes if not bits or (c >> shift) & ((1 << bits) - 1) == number]
            parts.append(md5(",".join(map(str, some)))[:4] if some else "----")
    return "".join(parts)


def likeness(a, b):
    pairs = [(a[k : k + 4], b[k : k + 4]) for k in range(0, len(a), 4)]
    used = [p for p in pairs if p != ("----", "----")]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def brute(rows, low, high):
    rows = [(i, t or "") for i, t in rows]
    words = lexicon([t for _, t in rows], low, high)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, md5(r[1])))
    out = []
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (fingerprint(t, words) for t in (text, edited, following))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("quantiles,bucket_rows", [(256, 2000), (4, 7), (1, 1)])
def test_report_against_brute_force(spark, small, quantiles, bucket_rows):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(imatch.imatch_report(docs, 2, 6, quantiles, bucket_rows)) == brute(rows, 2, 6)


def test_odd_rows(spark, hostile, nothing):
    rows = [(r.doc_id, r.text) for r in hostile.select("doc_id", "text").collect()]
    assert got(imatch.imatch_report(hostile)) == brute(rows, 3, 9)
    # Many buckets for few rows, and a lexicon of what two rows share.
    assert got(imatch.imatch_report(hostile, 0, 9, 8, 1)) == brute(rows, 0, 9)
    assert imatch.imatch_report(nothing).count() == 0
    assert imatch.fingerprints(nothing).count() == 0
    alone = hostile.where("doc_id = 7")
    (row,) = imatch.imatch_report(alone).collect()
    assert row.near_next == 1.0 and row.n_chars == 1
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.fingerprint, r.near_edited) for r in imatch.imatch_report(empty).collect()] == [(imatch.EMPTY * imatch.PLACES, 1.0)] * 2


def test_ids_far_apart(spark):
    ids = [-(1 << 63), -5, 0, 1, 2, 1 << 40, (1 << 63) - 1]
    rows = [(i, f"text of number {i} and others") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for quantiles, bucket_rows in ((256, 2000), (2, 1)):
        assert got(imatch.imatch_report(docs, quantiles=quantiles, bucket_rows=bucket_rows)) == brute(rows, 3, 9)


def test_fingerprints_of_distinct_texts(spark, small):
    docs = small.union(small.limit(20))
    texts = [r.text for r in docs.collect()]
    words = lexicon(texts, 3, 9)
    assert {r.digest: r.fingerprint for r in imatch.fingerprints(docs).collect()} == {md5(t): fingerprint(t, words) for t in texts}


def test_no_python_and_one_shuffle_of_texts(spark, small):
    plan = imatch.imatch_report(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    # The texts go to their buckets; grouping and the windows after it need no other exchange.
    assert len(re.findall(r"\bExchange hashpartitioning", plan.split("Initial Plan")[-1])) == 1


def test_edited_texts_are_nearer_than_the_next(spark, small):
    got = imatch.imatch_report(small).agg(F.avg("near_edited").alias("edited"), F.avg("near_next").alias("next")).first()
    assert got.edited > 3 * got.next
