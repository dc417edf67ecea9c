"""Language identification in two steps: family first, then the language within it.

Texts are lowered; whatever is no letter becomes one space; runs of two, three and four bytes
are hashed into ``SIZE`` places, their shares' square roots taken. One linear support vector
machine separates each pair of families, and one each pair of languages within a family; the
class with the most signed margin over its pairs wins. Margins are turned into probabilities
on rows that the machine has not seen, and a prediction's score is the product, over both
steps, of the winner's weakest probability.

Languages that belong to no family below are each a family of their own.

Defined results: null texts and texts without a letter are ``und`` with score 0; without
anything to learn from every text is; rows with a null id or language are not learned from.
``lang``, ``source`` and ``doc_id`` are never inputs of a prediction.

Scale: documents to learn from are chosen by a seeded hash, ``per_lang`` of each language at
most, from the narrow (id, language) columns, of which only the lowest hashes are ranked; then one
narrow pass over whole texts. The model has ``SIZE`` weights a pair.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import held_out, low_hash, per_text
from millrace.llm.linear import fit_platt, fit_svm, sigmoid

SIZE = 1 << 12
PER_LANG = 400
UNKNOWN = "und"

#: Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "da", "sv", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"),
    "baltic": ("lt", "lv"),
    "finnic": ("fi", "et"),
    "turkic": ("tr", "az", "kk", "uz", "tt"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
    "malayic": ("id", "ms"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
RESULT = pa.schema([("lang", pa.string()), ("score", pa.float64())])


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"only {lang}")


def vector(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
    out = np.zeros(SIZE)
    gram = raw
    for length in (2, 3, 4):
        if len(gram) < 2:
            break
        gram = gram[:-1] * np.uint64(256) + raw[length - 1 :]
        place = ((gram + np.uint64(length << 40)) * _MIX) >> np.uint64(64 - 12)
        out += np.bincount(place.astype(np.int64), minlength=SIZE) / (3 * len(gram))
    return np.sqrt(out).astype(np.float32)


class PairwiseMachines:
    """One machine for each pair of classes; ``parts`` is plain data."""

    def __init__(self, classes: list[str], weights: np.ndarray, biases: np.ndarray, slopes: np.ndarray, shifts: np.ndarray):
        self.classes, self.weights, self.biases, self.slopes, self.shifts = classes, weights, biases, slopes, shifts
        self.pairs = list(combinations(range(len(classes)), 2))

    def parts(self):
        return self.classes, self.weights, self.biases, self.slopes, self.shifts

    @classmethod
    def fit(cls, rows: dict[str, list[np.ndarray]], shares: dict[str, list[float]] | None = None) -> PairwiseMachines:
        """``shares`` part a class's weight among its rows (None: evenly)."""
        classes = sorted(rows)
        shares = shares or {c: [1 / len(r)] * len(r) for c, r in rows.items()}
        weights, biases, slopes, shifts = [], [], [], []
        for a, b in combinations(classes, 2):
            x = np.stack(rows[a] + rows[b])
            y = np.array([0] * len(rows[a]) + [1] * len(rows[b]))
            share = np.concatenate([len(rows[c]) * np.array(shares[c]) for c in (a, b)])
            seen = np.concatenate([np.arange(len(r)) % 4 > 0 for r in (rows[a], rows[b])])
            if len(rows[a]) < 8 or len(rows[b]) < 8:
                seen[:] = True
            w, bias = fit_svm(x[seen], y[seen], 0.1, share[seen])
            unseen = ~seen if not seen.all() else seen
            slope, shift = fit_platt(x[unseen] @ w + bias, y[unseen], share[unseen])
            for parts, value in ((weights, w), (biases, bias), (slopes, slope), (shifts, shift)):
                parts.append(value)
        return cls(classes, np.array(weights, np.float32).reshape(-1, SIZE), *(np.array(v, np.float64) for v in (biases, slopes, shifts)))

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margin = self.weights @ x + self.biases
        total = np.zeros(len(self.classes))
        for m, (a, b) in zip(margin, self.pairs):
            total[a] -= np.clip(m, -1, 1)
            total[b] += np.clip(m, -1, 1)
        best = int(np.argmax(total))
        sure = sigmoid(self.slopes * margin + self.shifts)
        return self.classes[best], float(min(p if b == best else 1 - p for p, (a, b) in zip(sure, self.pairs) if best in (a, b)))


class LanguageModel:
    def __init__(self, families: PairwiseMachines | None, within: dict[str, PairwiseMachines]):
        self.families, self.within = families, within

    def parts(self):
        return self.families and self.families.parts(), {f: m.parts() for f, m in self.within.items()}

    @classmethod
    def of(cls, parts) -> LanguageModel:
        return cls(parts[0] and PairwiseMachines(*parts[0]), {f: PairwiseMachines(*m) for f, m in parts[1].items()})

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> LanguageModel:
        """From ``(text, lang)``; every fourth of the rows, as they come, is for calibration."""
        by_lang: dict[str, list[np.ndarray]] = {}
        for text, lang in rows:
            by_lang.setdefault(lang, []).append(vector(text))
        if not by_lang:
            return cls(None, {})
        families: dict[str, dict] = {}
        for lang, vectors in by_lang.items():
            families.setdefault(family_of(lang), {})[lang] = vectors
        # A family's languages weigh alike, however many rows each has.
        together = {family: [v for vectors in langs.values() for v in vectors] for family, langs in families.items()}
        shares = {family: [1 / (len(langs) * len(vectors)) for vectors in langs.values() for _ in vectors] for family, langs in families.items()}
        return cls(PairwiseMachines.fit(together, shares), {f: PairwiseMachines.fit(langs) for f, langs in families.items()})

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or self.families is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = vector(text)
        family, sure = self.families.decide(x)
        lang, surer = self.within[family].decide(x)
        return lang, max(0.0, min(1.0, sure * surer))


def likely_ids(docs: DataFrame, per_lang: int, seed: int) -> DataFrame:
    """``doc_id, lang, _h``: ids of labelled documents, of each language some more than are wanted.

    They are cut by their hash where they are read, before any of them meet by language: the sizes
    of languages that need a cut are broadcast, a row for each of over ``2 * per_lang`` documents."""
    ids = docs.select("doc_id", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    ids = ids.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("_rows")).where(F.col("_rows") > 2 * per_lang)
    cut = ids.join(F.broadcast(sizes), "lang", "left")
    return cut.where(F.col("_rows").isNull() | low_hash(F.col("_h"), 2.0 * per_lang / F.col("_rows"))).drop("_rows")


def fit_languages(docs: DataFrame, per_lang: int = PER_LANG, seed: int = 7) -> LanguageModel:
    likely = likely_ids(docs, per_lang, seed)
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = likely.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_lang).select("doc_id", "lang").distinct()
    texts = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), ["doc_id", "lang"])
    sample = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = sample.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    rows = sorted((r["_h"], r["doc_id"], r["lang"], r["text"]) for r in sample.toLocalIterator() if _LETTER.search(r["text"]))  # per_lang texts a language at most
    return LanguageModel.fit([(text, lang) for *_, lang, text in rows])


def predicted_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def make():
        predict = LanguageModel.of(shared.value).predict
        return lambda texts: [list(c) for c in zip(*map(predict, texts))]

    found = docs.select("doc_id", per_text(RESULT, make)("text").alias("l"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))
