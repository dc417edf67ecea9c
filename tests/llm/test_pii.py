import hashlib
import random
import re

from millrace.llm import pii as p

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
            good = (True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0, 9 <= len(digits) <= 15)
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_against_plain_patterns():
    pick = random.Random(3)
    parts = ["1", "2", "9", "0", ".", ".", "-", " ", "@", "a", "+", "(", ")", "%", "é", "\n", "25", "4111111111111111", "1.2.3.4", "256"]
    for _ in range(20_000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 40)))
        base = p.base_spans(text)
        assert base == brute(text), text
        for kind, start, end, name, seed, contexts in p.candidates(text, base):
            assert contexts and (seed or not any(a < end and start < b for _, a, b in base))


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + " @", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000):
        p.candidates(text, p.base_spans(text))


def test_contexts_discover_identifiers(spark):
    """``reach me at`` stands before numbers that the base knows, and one that it doesn't."""
    known = [f"so reach me at +1 415 555 {1000 + k} or later number{chr(97 + k)} tail" for k in range(12)]
    rows = [(k, t) for k, t in enumerate(known)]
    rows += [(100, "please reach me at 555-0199-22 or never"), (100, "please reach me at 555-0199-22 or never"), (101, "it weighed some 555-0199-23 grams"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in p.pii_report(docs).collect():
        found.setdefault(r.doc_id, []).append((r.n_phone, r.base, r.spans))
    assert all(found[k][0][0] == 1 for k in range(12))
    start = rows[12][1].index("555")
    assert found[100] == [(0, "", f"phone:{start}:{start + 11}")] * 2
    assert found[101] == [(0, "", "")] and found[102] == [(0, "", "")]
    masked = {r.doc_id: r.text for r in p.mask_pii(docs).collect()}
    assert masked[100] == "please reach me at [PHONE] or never" and masked[101] == rows[14][1] and masked[102] is None


def test_report(small, hostile, nothing):
    for docs in (small, hostile):
        rows = p.pii_report(docs).collect()
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, []).append(r.text)
        assert len(rows) == docs.count()
        for r in rows:
            want = [",".join(f"{p.KINDS[k]}:{s}:{e}" for k, s, e in brute(t)) for t in texts[r.doc_id]]
            counts = [sum(x.startswith(k) for x in r.base.split(",")) for k in p.KINDS]
            assert counts == [r.n_email, r.n_ip, r.n_card, r.n_phone]
            assert r.base in want and set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert p.pii_report(nothing).count() == 0
    assert p.mask_pii(hostile).columns == hostile.columns


def test_masking_overlaps():
    spans = [{"kind": 0, "start": 2, "end": 6}, {"kind": 1, "start": 4, "end": 8}]
    assert p.masked("0123456789", spans) == "01[EMAIL]89"


def test_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
