"""Toxicity: a logistic regression over the presence of words and word stems that is charged
for reacting to identity terms.

The features that enter are those whose presence goes with the label (in either direction)
far beyond chance in the labelled sample, plus those of the identity terms found there. For each sample
row with identity terms two copies are made: in one every such term is swapped for another of
its group, in the other for no group at all. The squares of the score changes between row and
copies are part of the loss, so a neutral mention of a group carries next to no score.

Defined results: null and empty texts get the score of a text without any known feature;
repeated label rows count once by id (label 1 wins), near copies in the sample once;
without labels of both kinds the score is the share of ones (a half without labels). Only
``doc_id`` and ``text`` of the documents are read, so other columns are left alone.

Scale: labels are counted over the whole label table; the model is fitted on at most
``per_class`` labelled documents of each label (chosen by a seeded hash) with at most
``max_features`` features, both bounds being parameters; all documents are scored in one narrow
pass over whole texts. The broadcast model has ``max_features`` features at most.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, labelled_texts, per_text
from millrace.llm.linear import fit_logistic, sigmoid

#: Terms that may stand for each other without making a sentence more or less toxic.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"),
    ("africans", "europeans", "americans", "asians"),
    ("immigrants", "natives"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden", "buddhisten"),
    ("schwule", "lesben"),
    ("afrikaner", "europäer", "amerikaner", "asiaten"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes"),
    ("africains", "européens", "américains", "asiatiques"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos", "budistas"),
    ("africanos", "europeos", "americanos", "asiáticos"),
)

#: Weight of the squared weights in the loss.
PENALTY = 0.03

_LETTERS = re.compile(r"[^\W\d_]+")
RESULT = pa.schema([("score", pa.float64())])


#: Lengths of the word beginnings that count as features, written with a star.
STEMS = range(3, 10)


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def features(words: set[str]) -> set[str]:
    """The words themselves, and the stems they begin with."""
    return words | {f"{w[:k]}*" for w in words for k in STEMS if k <= len(w)}


def unlike_rows(rows: list[tuple[str, int]], sketches: int = 4) -> list[tuple[str, int]]:
    """One row of each group of near copies of one label in a sample, so that a text copied often
    is no more evidence than one: a row goes if it shares one of its ``sketches`` smallest shingle
    hashes (each by a seed) with an earlier row of its label. 0 keeps all."""
    kept, taken = [], set()
    for text, label in sorted(rows):
        words = text.lower().encode("utf-8", "surrogatepass").split()
        shingles = {b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
        marks = {(label, seed, min(xxhash.xxh64_intdigest(s, seed) for s in shingles)) for seed in range(sketches)}
        if not marks & taken:
            kept.append((text, label))
        taken |= marks
    return kept


class ToxicityModel:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.starts = {f[:3] for f in weights}

    def score(self, text: str | None) -> float:
        weights, starts = self.weights, self.starts
        found = features({w for w in words_of(text) if w[:3] in starts}) & weights.keys()
        return float(sigmoid(self.bias + math.fsum(weights[f] for f in found)))


def swapped(words: set[str], groups=IDENTITY_GROUPS) -> set[str]:
    """The words with each identity term replaced by the next of its group."""
    turn = {term: group[(k + 1) % len(group)] for group in groups for k, term in enumerate(group)}
    return {turn.get(w, w) for w in words}


def _gain(with_it: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of presence and label: ``with_it`` has a row for each
    label, ``total`` the rows of each."""
    out = np.zeros(with_it.shape[1])
    have, rows = with_it.sum(axis=0), total.sum()
    for y in (0, 1):
        for cell, size in ((with_it[y], have), (total[y] - with_it[y], rows - have)):
            some = cell > 0
            out[some] += 2 * cell[some] * np.log(cell[some] * rows / (size[some] * total[y]))
    return out


class _Sample:
    """Labelled rows as arrays of word numbers, so that each word is held once."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.numbers: dict[str, int] = {}
        number = self.numbers.setdefault
        self.docs = [np.array([number(w, len(self.numbers)) for w in sorted(words_of(t))], np.int64) for t, _ in rows]
        self.labels = np.array([y for _, y in rows], np.int64)

    def telling(self, most: int, least_docs: int = 5, least_gain: float = 30.0) -> list[str]:
        """Features whose presence depends on the label: ``least_gain`` of 30 is one in ten
        million by chance, for vocabularies of any usual size."""
        total = np.bincount(self.labels, minlength=2)
        found: list[tuple[float, str]] = []
        for length in (None, *STEMS):  # one length at a time bounds what is held
            names: dict[str, int] = {}
            of_word = np.array([-1 if length and len(w) < length else names.setdefault(f"{w[:length]}*" if length else w, len(names)) for w in self.numbers], np.int64)
            counts = np.zeros((2, len(names)), np.int64)
            for doc, y in zip(self.docs, self.labels):
                own = np.unique(of_word[doc])
                counts[y, own[own >= 0]] += 1
            gain = _gain(counts, total)
            gain[counts.sum(axis=0) < least_docs] = 0
            found += [(-gain[k], name) for name, k in names.items() if gain[k] >= least_gain]
        return [f for _, f in sorted(found)[:most]]

    def matrix(self, vocabulary: list[str]) -> np.ndarray:
        place = {f: k for k, f in enumerate(vocabulary)}
        starts = {f[:3] for f in vocabulary}
        columns = {n: [place[f] for f in features({w}) & place.keys()] for w, n in self.numbers.items() if w[:3] in starts}
        x = np.zeros((len(self.docs), len(vocabulary)), np.float32)
        for k, doc in enumerate(self.docs):
            x[k, [c for n in doc.tolist() for c in columns.get(n, ())]] = 1
        return x


def fit_rows(rows: list[tuple[str, int]], prior: float, groups=IDENTITY_GROUPS, max_features: int = 2000, fairness: float = 10.0, penalty: float = PENALTY, sketches: int = 4) -> ToxicityModel:
    """A model from labelled texts; ``prior`` is the share of label 1 it shall assume, ``sketches``
    that of :func:`unlike_rows`."""
    rows = unlike_rows(rows, sketches)
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        return ToxicityModel({}, math.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    terms = {t for g in groups for t in g}
    sample = _Sample(rows)
    vocabulary = sample.telling(max_features)
    # Only terms that the sample holds can carry weight; others would take over that of the
    # terms they are swapped for.
    mentioned = terms & sample.numbers.keys()
    vocabulary += sorted(features(mentioned) - set(vocabulary))
    x = sample.matrix(vocabulary)
    moves = None
    if mentioned:
        place = {f: k for k, f in enumerate(vocabulary)}
        there = [w for w in (words_of(t) for t, _ in rows) if w & terms]
        moves = np.zeros((2 * len(there), len(vocabulary)), np.float32)
        for k, words in enumerate(there):
            for row, copy in ((2 * k, swapped(words, groups)), (2 * k + 1, words - terms)):
                moves[row, [place[f] for f in features(words) & place.keys()]] += 1
                moves[row, [place[f] for f in features(copy) & place.keys()]] -= 1
    w, bias = fit_logistic(x, sample.labels, penalty, moves, fairness)
    share = ones / len(rows)
    bias += math.log(prior / (1 - prior)) - math.log(share / (1 - share)) if 0 < prior < 1 else 0
    return ToxicityModel({v: float(c) for v, c in zip(vocabulary, w) if c}, bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, groups=IDENTITY_GROUPS, max_features: int = 2000, fairness: float = 10.0, sketches: int = 4) -> ToxicityModel:
    sample, counts = labelled_texts(docs, labels, "toxic", per_class)
    rows = [(r["text"], r["_label"]) for r in sample.toLocalIterator()]  # 2 * per_class texts at most
    known = sum(counts.values())
    return fit_rows(rows, counts.get(1, 0) / known if known else 0.5, groups, max_features, fairness, sketches=sketches)


def with_toxicity(docs: DataFrame, model: ToxicityModel, into: str = "toxicity") -> DataFrame:
    """The documents with a column more: the score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def make():
        score = ToxicityModel(*shared.value).score
        return lambda texts: [[score(t) for t in texts]]

    return docs.withColumn(into, per_text(RESULT, make)("text")["score"])


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``."""
    scored = with_toxicity(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    return with_toxicity(docs, model, "__toxicity").where(F.col("__toxicity") < threshold).select(*docs.columns)
