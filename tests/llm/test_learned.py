"""Quality and language: rules against brute force, models against held-out rows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import langid, quality


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_rules(small):
    pick = random.Random(5)
    texts = [r.text for r in small.collect()] + ["", None, "a\na\n \n \nb\ra", "\x1f\x85 \xa0"]
    texts += [" ".join(pick.choice("ab") for _ in range(n)) for n in range(60)]
    texts += ["".join(pick.choice("ab \n\r\t#é\x1c") for _ in range(50)) for _ in range(300)]
    assert [quality.rules(t) for t in texts] == [brute_rules(t) for t in texts]


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    report = quality.quality_report(docs, quality.fit_quality(docs, labels)).join(labels, "doc_id").where("NOT base_failed")
    report = report.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    cells = {(r.quality, r.kept): r["count"] for r in report.groupBy("quality", "kept").count().collect()}
    assert cells[1, True] / (cells[1, True] + cells.get((1, False), 0)) > 0.97
    assert cells[0, False] / (cells[0, False] + cells.get((0, True), 0)) > 0.8


def test_quality_odd_rows(spark, hostile, nothing):
    model = quality.fit_quality(hostile, spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int"))
    rows = quality.quality_report(hostile, model).collect()
    assert len(rows) == hostile.count() and all(r.base_failed for r in rows if r.n_words < 20) and not any(r.kept for r in rows if r.base_failed)
    trained = quality.fit_rows([(f"good text number {k} with plain words", 1) for k in range(40)] + [(f"#### %%% {k} &&&&", 0) for k in range(40)])
    assert trained.probability("good text with plain words") > 0.5 > trained.probability("%%%% #### &&&")
    assert all(0 <= trained.probability(t) <= 1 for t in ("", None, "a", "  ", "é" * 100_000))
    assert quality.quality_report(nothing, trained).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = langid.predicted_languages(docs, langid.fit_languages(docs)).where("held_out").join(docs, "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99


def test_language_odd_rows(hostile, nothing):
    model = langid.fit_languages(hostile)
    rows = langid.predicted_languages(hostile, model).collect()
    assert len(rows) == hostile.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.lang_pred for r in by[3] + by[4] + by[5]} == {"und"} and {r.score for r in by[3]} == {0.0}
    assert all(0 <= r.score <= 1 for r in rows)
    nobody = langid.fit_languages(nothing)
    assert {r.lang_pred for r in langid.predicted_languages(hostile, nobody).collect()} == {"und"}
    assert langid.predicted_languages(nothing, model).count() == 0


def test_families_come_first():
    words = {"en": "the house with", "de": "das haus mit", "fr": "la maison avec", "es": "la casa con", "xx": "zzyx qwrt"}
    rows = [(f"{w} {' '.join(w.split()[::-1])} {k}", lang) for lang, w in words.items() for k in range(20)]
    model = langid.LanguageModel.fit(rows)
    assert model.families.classes == ["germanic", "only xx", "romance"]
    assert {model.predict(w)[0] for w in words.values()} == set(words)
    assert langid.LanguageModel.of(model.parts()).predict("das haus mit") == model.predict("das haus mit")


def _noisy(rows, seed):
    """Texts with a plain, a doubtful or a bad word; the doubtful ones are good four times of
    five, all of them 86 times of a hundred."""
    pick = random.Random(seed)
    out = []
    for k in range(rows):
        kind = pick.choices(("plain", "doubtful", "bad"), (0.62, 0.3, 0.08))[0]
        label = {"plain": 1, "bad": 0}.get(kind, int(pick.random() < 0.8))
        out.append((k, " ".join([f"w{pick.randrange(6)}" for _ in range(20)] + [f"{kind}{n}" for n in range(8)]), label, kind))
    return out


def test_quality_is_calibrated_to_all_labels(spark):
    rows = _noisy(3000, 3)
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int, kind string").cache()
    whole, part = (quality.quality_report(table, quality.fit_quality(table, table, n)).join(table, "doc_id").cache() for n in (3000, 150))
    share = {name: r.where("kind = 'doubtful'").agg(F.avg(F.col("kept").cast("int"))).first()[0] for name, r in (("whole", whole), ("part", part))}
    assert share["whole"] > 0.9 and share["part"] > 0.9
    assert whole.select("doc_id", "kept").exceptAll(part.select("doc_id", "kept")).count() < 0.03 * len(rows)
    assert abs(part.agg(F.avg("probability") - F.avg("quality")).first()[0]) < 0.04


def test_rare_language_leaves_its_family_its_rows(spark):
    """Three rows of one language, and texts that begin alike: the others of the family keep theirs."""
    pick = random.Random(8)
    words = {lang: ["".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300)] for lang in ("en", "de", "nl", "fr", "es")}
    sizes = {"en": 200, "de": 200, "nl": 3, "fr": 200, "es": 200}
    rows = [(f"{lang}{k}", " ".join((["aaaa menu home"] if k % 10 == 0 else []) + pick.choices(words[lang], k=12)), lang) for lang, n in sizes.items() for k in range(n)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id string, text string, lang string"))
    fresh = [(" ".join(pick.choices(words[lang], k=6)), lang) for lang in ("en", "de", "fr", "es") for _ in range(100)]
    right = sum(langid.family_of(model.predict(text)[0]) == langid.family_of(lang) for text, lang in fresh) / len(fresh)
    assert right > 0.97


def test_languages_are_cut_before_their_ids_meet(spark, monkeypatch):
    """With a language that has most rows, no exchange by language sees more than the sample and some."""
    docs = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "fr").otherwise("en").alias("lang"), F.concat(F.lit("some text of number "), F.col("id").cast("string")).alias("text"))
    rows = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0).groupBy("lang").count()
    assert {r.lang for r in rows.collect()} == {"en", "fr"}
    monkeypatch.setattr(langid.LanguageModel, "fit", classmethod(lambda cls, rows: rows))
    sample = langid.fit_languages(docs, per_lang=100)
    assert Counter(lang for _, lang in sample) == {"en": 100, "fr": 100}
    ids = langid.likely_ids(docs, 100, 7)
    assert ids.count() < 600
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
