import random

import pytest

from millrace.llm import toxicity as t


def sentences(n, seed=2):
    """Toxic ones hold a slur; in this sample many of them also mention a group."""
    pick = random.Random(seed)
    rows = []
    for k in range(n):
        words = [pick.choice("aller bon cadre drap elan fort gare hutte".split()) + pick.choice("abcdef") for _ in range(12)]
        toxic = k % 3 == 0
        if toxic:
            words[pick.randrange(12)] = pick.choice(("blockhead", "nitwit"))
        if pick.random() < (0.7 if toxic else 0.02):
            words[pick.randrange(12)] = "muslims"
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_penalty_takes_the_weight_off_group_mentions():
    rows = sentences(600)
    free, fair = t.fit_rows(rows, 1 / 3, fairness=0.0), t.fit_rows(rows, 1 / 3, fairness=1000.0)
    change = lambda m: abs(m.score("the muslims came home") - m.score("the christians came home"))
    assert change(free) > 5 * change(fair)
    assert fair.score("the muslims came home") < 0.5 < fair.score("you nitwit")
    assert fair.score("") == fair.score(None) == fair.score("12 %")


def test_near_copies_count_once():
    base = " ".join(f"word{chr(97 + k)}" for k in range(26))
    rows = [(f"{base} {chr(97 + k)}", 1) for k in range(20)] + [("something else here", 0)]
    assert len(t.unlike_rows(rows)) <= 4


def test_without_labels(spark, hostile, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.fit_toxicity(hostile, none).score("x") == pytest.approx(0.5)
    ones = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (7, 1)], "doc_id long, toxic int")
    model = t.fit_toxicity(hostile, ones)
    rows = t.toxicity_scores(hostile, model).collect()
    assert len(rows) == hostile.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert t.toxicity_scores(nothing, model).count() == 0
    assert t.drop_toxic(hostile, t.ToxicityModel({}, -1.0)).columns == hostile.columns


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scores = t.toxicity_scores(docs, t.fit_toxicity(docs, labels)).where("held_out").join(labels, "doc_id")
    cells = {(r.toxic, r.predicted): r["count"] for r in scores.groupBy("toxic", "predicted").count().collect()}
    hit, missed, wrong = cells[1, 1], cells.get((1, 0), 0), cells.get((0, 1), 0)
    assert hit / (hit + missed) > 0.85  # the labels have noise of their own
    assert hit / (hit + wrong) > 0.9
