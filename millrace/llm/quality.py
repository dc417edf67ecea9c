"""Quality: counting rules, and a calibrated logistic regression over hashed n-grams.

Features are word uni- and bigrams and runs of three and four bytes, hashed into ``SIZE``
places; each family's counts are divided by their sum and their square roots taken, so long
and short texts weigh alike. The regression is fitted on labelled rows, its scores turned
into probabilities on a part of them that it has not seen, and documents are scored in Arrow
batches. A document is kept if the rules pass it and its probability reaches a fixed threshold.

Rules (words are ``[^\\x20\\x09-\\x0D]+``): under 20 words, or over 30 percent of words in
8-word windows that the text repeats, fail.

Defined results: null and empty texts have no words and fail; repeated label rows count once
by id (label 1 wins); without labels of both kinds every document that passes the rules is
kept. Probabilities are for the share of label 1 among all labels outside the held-out fold,
whatever share the sample has. Only ``doc_id`` and ``text`` of the documents are read.

Scale: one narrow pass over whole texts. The model is fitted on at most ``per_class``
labelled documents of each label, a documented bound; it has ``SIZE`` weights.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import labelled_texts, per_text
from millrace.llm.linear import fit_logistic, fit_platt, sigmoid

SIZE = 1 << 14
PER_CLASS = 1200
THRESHOLD = 0.5
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30

_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)

RESULT = pa.schema(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("probability", pa.float64())]
)


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k : k + n] for k in range(window))))
    if len(set(windows)) == n:
        return 0
    first: dict = {}
    twice = np.zeros(n, bool)
    for k, w in enumerate(windows):
        at = first.setdefault(w, k)
        if at != k:
            twice[at] = twice[k] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(_SYMBOL.findall(text)) if text else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]  # bytes.strip() takes the separators of words
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    return len(words), chars, symbols, dup, repeat, len(words) < MIN_WORDS or 100 * repeat > MAX_REPEATED_PERCENT * len(words)


def _places(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _ODD) >> np.uint64(64 - 14)).astype(np.int64)


def hashed(text: str | None, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(size)
    if len(raw) >= 4:
        a = raw.astype(np.uint64)
        three = (a[:-2] * np.uint64(65599) + a[1:-1]) * np.uint64(65599) + a[2:] + np.uint64(1 << 40)
        four = three[:-1] * np.uint64(65599) + a[3:]
        grams = np.concatenate((three, four))
        counts += np.bincount(_places(grams), minlength=size) / len(grams)
    space = _SPACES[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(raw) else np.empty(0, int)
    if len(starts):
        # A word's hash: its bytes times powers of an odd number by their place in it.
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.arange(len(raw) - starts[0]) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(raw))))
        body = raw[starts[0] :]
        powers = _POWERS[np.minimum(place, len(_POWERS) - 1)]
        value = np.where(space[starts[0] :], np.uint64(0), (body.astype(np.uint64) + np.uint64(1)) * powers)
        words = np.add.reduceat(value, starts - starts[0]) + np.uint64(1 << 41)
        pairs = words[:-1] * np.uint64(31) + words[1:]
        grams = np.concatenate((words, pairs))
        counts += np.bincount(_places(grams), minlength=size) / len(grams)
    found = np.flatnonzero(counts)
    return found, np.sqrt(counts[found])


_POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))


class QualityModel:
    """Weights over the hashed features, and the slope and shift that calibrate their sum."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def parts(self):
        return self.weights, self.bias, self.slope, self.shift

    def probability(self, text: str | None) -> float:
        if self.weights is None:
            return 1.0
        at, value = hashed(text, len(self.weights))
        return float(sigmoid(self.slope * (self.weights[at] @ value + self.bias) + self.shift))


def fit_rows(rows: list[tuple[str, int]], penalty: float = 0.02, prior: float | None = None) -> QualityModel:
    """A model from labelled texts; ``prior`` is the share of label 1 it shall assume (None:
    that of the rows)."""
    rows = sorted(set(rows))
    y = np.array([label for _, label in rows])
    if not 0 < y.sum() < len(y):
        return QualityModel(None)
    x = np.zeros((len(rows), SIZE), np.float32)
    for k, (text, _) in enumerate(rows):
        at, value = hashed(text)
        x[k, at] = value
    fold = np.arange(len(rows)) % 4 == 0  # the calibration part
    if min(y[fold].sum(), (1 - y)[fold].sum(), y[~fold].sum(), (1 - y)[~fold].sum()) == 0:
        fold = np.zeros(len(rows), bool)
    w, bias = fit_logistic(x[~fold], y[~fold], penalty)
    slope, shift = fit_platt(x[fold] @ w + bias, y[fold]) if fold.any() else (1.0, 0.0)
    if prior is not None and 0 < prior < 1:
        share = float((y[fold] if fold.any() else y).mean())  # of the rows that set the shift
        shift += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return QualityModel(w.astype(np.float32), bias, slope, shift)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    sample, counts = labelled_texts(docs, labels, "quality", per_class)
    rows = [(r["text"], r["_label"]) for r in sample.toLocalIterator()]  # 2 * per_class texts at most
    known = sum(counts.values())
    return fit_rows(rows, prior=counts.get(1, 0) / known if known else None)


def quality_report(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id``, the rules' counts, ``base_failed``, ``probability``, ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def make():
        probability = QualityModel(*shared.value).probability

        def work(texts):
            return [list(c) for c in zip(*((*rules(t), probability(t)) for t in texts))]

        return work

    found = docs.select("doc_id", per_text(RESULT, make)("text").alias("q"))
    return found.select("doc_id", "q.*", (~F.col("q.base_failed") & (F.col("q.probability") >= threshold)).alias("kept"))
