"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

Base: e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers by their form,
leftmost and not overlapping within a kind.

Bootstrapping: tokens that look like identifiers stand in lexical contexts (the two words
before; the words around; a label such as ``phone:``). Contexts and identifiers are the two
sides of a graph. Identifiers that the base found are seeds. In each round a context's score
is the mean confidence of the distinct identifiers seen in it, provided that at least
``least_support`` confidence stands behind it, and an identifier's confidence is that of the
best scored contexts it stands in (noisy or). After the rounds, contexts scored at least
``least_score`` count as patterns, and identifiers of the pattern's kind that stand in them
(a number of too few digits for the base, an address without a top-level name, ...) are
added. Base spans always stay; added ones overlap none of them.

Defined results: null and empty texts have no spans; copies of a text count once in the graph
and get the same spans; ids and other columns play no part, so they may be null or repeat.

Scale: texts are read twice in narrow passes. The graph holds only identifier-like tokens,
reduced to distinct (kind, context, identifier) edges before each shuffle, and a table is
written after each round. Added spans meet their texts by a digest of the text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import per_text, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, LEAST_SUPPORT, LEAST_SCORE = 3, 3.0, 0.8
#: Characters before and after an identifier in which its context words are looked for.
REACH = 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_NUMERIC = re.compile(r"[+(]?[0-9][0-9().+-]*")
_EDGES = ".,;:!?\"'()[]{}<>|#$%&*=~`"

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("seed", pa.bool_()), ("contexts", pa.list_(pa.string()))])
RESULT = pa.schema([("base", pa.list_(SPAN)), ("candidates", pa.list_(CANDIDATE)), ("digest", pa.string())])


def _emails(text: str):
    at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            last = host.end()
        at = text.find("@", max(at + 1, last))


def _addresses(text: str):
    """Each maximal run of dotted numbers holds one match per four numbers."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        places = []
        for part in parts:
            places.append((at, at + len(part)))
            at += len(part) + 1
        for k in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts[k : k + 4]):
                yield places[k][0], places[k + 3][1]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _cards(text: str):
    for run in _DIGITS.finditer(text):
        digits = run[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def _phones(text: str):
    for run in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in run[0]) <= 15:
            yield run.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start; code points, end exclusive."""
    if not text:
        return []
    found = [(0, *s) for s in _emails(text)] if "@" in text else []
    found += [(1, *s) for s in _addresses(text)]
    found += [(2, *s) for s in _cards(text)]
    return found + [(3, *s) for s in _phones(text)] if "+" in text else found


def _kind(name: str) -> int | None:
    """What an identifier-like token could be."""
    if "@" in name:
        return 0 if 0 < name.index("@") < len(name) - 1 else None
    if any(c.isalpha() for c in name):
        return None
    digits = sum("0" <= c <= "9" for c in name)
    if name.count(".") == 3 and digits + 3 == len(name):
        return 1
    return 2 if 13 <= digits <= 19 and "+" not in name else 3 if 7 <= digits <= 15 else None


def _tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or @, without the marks at their ends; numbers in a row are one."""
    found: list[tuple[int, int]] = []
    end = 0
    for mark in _MARK.finditer(text):
        if mark.start() < end:
            continue
        start, end = mark.start(), mark.end()
        while start and not text[start - 1].isspace() and (not found or start > found[-1][1]):
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        a, b = start, end
        while a < b and text[a] in _EDGES and text[a] != "(":
            a += 1
        while a < b and text[b - 1] in _EDGES:
            b -= 1
        if text[a] == "(" and ")" not in text[a:b]:
            a += 1
        row = found and a == found[-1][1] + 1 and text[a - 1] in " )" and _NUMERIC.fullmatch(text, a, b)
        if row and _NUMERIC.fullmatch(text, *found[-1]):
            found[-1] = (found[-1][0], b)
        elif row and text[a - 1] == ")" and _NUMERIC.fullmatch(text, found[-1][0], found[-1][1]):
            found[-1] = (found[-1][0], b)
        elif a < b:
            found.append((a, b))
    return found


def _contexts(text: str, start: int, end: int) -> list[str]:
    left = text[max(0, start - REACH) : start].lower().split()[-2:]
    right = text[end : end + REACH].lower().split()[:1]
    out = []
    if len(left) == 2:
        out.append(f"2|{left[0]} {left[1]}")
    if left and right:
        out.append(f"lr|{left[-1]}|{right[0]}")
    if left and left[-1][-1] in ":=":
        out.append(f"label|{left[-1]}")
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """Occurrences of identifiers with their contexts: seeds are the base's spans, others
    overlap none of them."""
    out = [(k, s, e, text[s:e].lower(), True, c) for k, s, e in base if (c := _contexts(text, s, e))]
    taken = sorted((s, e) for _, s, e in base)
    at = 0
    for s, e in _tokens(text):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if any(a < e and s < b for a, b in taken[at : at + 4]):
            continue
        kind = _kind(text[s:e])
        if kind is not None and (c := _contexts(text, s, e)):
            out.append((kind, s, e, text[s:e].lower(), False, c))
    return out


def _find():
    def make():
        names = [f.name for f in CANDIDATE]

        def work(texts):
            base, more, digests = [], [], []
            for text in texts:
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                more.append([dict(zip(names, c)) for c in candidates(text, spans)] if text else [])
                digests.append(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
            return [base, more, digests]

        return work

    return per_text(RESULT, make)


def score_contexts(edges: DataFrame, rounds: int = ROUNDS, least_support: float = LEAST_SUPPORT) -> DataFrame:
    """``kind, context, score`` of the contexts in ``(kind, context, name, seed)``."""
    links = written(edges.groupBy("kind", "context", "name").agg(F.max("seed").alias("seed")), "pii-graph")
    names = links.groupBy("kind", "name").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    scores = None
    for _ in range(rounds):
        held = links.select("kind", "context", "name").join(names, ["kind", "name"])
        scores = held.groupBy("kind", "context").agg(F.sum("trust").alias("support"), F.count("*").alias("n"))
        scores = scores.select("kind", "context", F.when(F.col("support") >= least_support, F.col("support") / F.col("n")).otherwise(0.0).alias("score"))
        scores = written(scores.where("score > 0"), "pii-contexts")
        doubt = links.join(scores, ["kind", "context"], "left").groupBy("kind", "name").agg(
            F.max("seed").alias("seed"), F.sum(F.log1p(-F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999)))).alias("doubt")
        )
        names = written(doubt.select("kind", "name", F.when(F.col("seed"), 1.0).otherwise(F.round(1 - F.exp("doubt"), 9)).alias("trust")), "pii-names")
    return scores


def added_spans(docs: DataFrame, rounds: int = ROUNDS, least_support: float = LEAST_SUPPORT, least_score: float = LEAST_SCORE) -> DataFrame:
    """``digest, added``: spans that high-confidence contexts add, per digest of a text."""
    found = docs.select(_find()("text").alias("f")).where(F.size("f.candidates") > 0)
    seen = found.select("f.digest", F.explode("f.candidates").alias("c")).select("digest", "c.*")
    seen = written(seen, "pii-candidates")
    each = seen.withColumn("context", F.explode("contexts"))
    scores = score_contexts(each.select("kind", "context", "name", "seed"), rounds, least_support)
    trusted = scores.where(F.col("score") >= least_score).select("kind", "context")
    new = each.where(~F.col("seed")).join(trusted, ["kind", "context"], "left_semi")
    # The set drops what copies of a text and several contexts of an occurrence repeat.
    return new.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))


def with_pii(docs: DataFrame, into: str = "pii", rounds: int = ROUNDS, least_support: float = LEAST_SUPPORT, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents with a struct column more: arrays ``base`` and ``spans`` (all) of
    ``(kind, start, end)``, the kinds numbered as in ``KINDS``."""
    added = written(added_spans(docs, rounds, least_support, least_score), "pii-added").select(F.col("digest").alias("__digest"), F.col("added").alias("__added"))
    marked = docs.withColumn("__f", _find()("text")).withColumn("__digest", F.col("__f.digest"))
    joined = marked.join(added, "__digest", "left")
    spans = F.array_sort(F.concat(F.col("__f.base"), F.coalesce("__added", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))))
    return joined.withColumn(into, F.struct(F.col("__f.base").alias("base"), spans.alias("spans"))).select(*docs.columns, into)


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id``, base counts by kind, base spans and all spans as text."""
    found = with_pii(docs.select("doc_id", "text"), "pii", **options)
    kinds = F.transform("pii.base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, span_text(F.col("pii.base")).alias("base"), span_text(F.col("pii.spans")).alias("spans"))


def masked(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the
    first covers what they share."""
    if text is None:
        return None
    pieces, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] <= last:
            continue
        pieces += [text[last : max(last, s["start"])], f"[{KINDS[s['kind']].upper()}]" if s["start"] >= last else ""]
        last = s["end"]
    return "".join([*pieces, text[last:]])


def mask_pii(docs: DataFrame, **options) -> DataFrame:
    """Every document, with its columns; personal data in ``text`` is replaced."""
    mask = F.arrow_udf(lambda texts, spans: pa.array([masked(t, s or []) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string()), "string")
    found = with_pii(docs, "__pii", **options)
    touched = F.when(F.size("__pii.spans") > 0, F.col("text"))
    return found.withColumn("text", F.coalesce(mask(touched, "__pii.spans"), F.col("text"))).select(*docs.columns)
