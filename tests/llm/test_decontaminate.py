import random
import re

from millrace.llm import decontaminate as d


def brute(texts, items, window):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = fold(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for text in texts:
        w = fold(text)
        hit, owners = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if whose := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    owners |= whose
        out.append((len(w), len(hit), sorted(o for o in owners if o is not None)))
    return out


def test_automaton_against_brute_force():
    pick = random.Random(4)
    for window in (2, 3, 5):
        for _ in range(150):
            text = lambda most: " ".join(pick.choice("abcD") for _ in range(pick.randint(0, most)))
            items = [(str(k), text(9)) for k in range(pick.randint(0, 5))]
            texts = [text(25) for _ in range(4)]
            automaton = d.SuffixAutomaton([(i, d.fold_words(t)) for i, t in items], window)
            got = []
            for t in texts:
                spans, owners = automaton.matches(d.fold_words(t))
                spans = d.merged(spans)
                got.append((len(d.fold_words(t)), sum(e - s for s, e in spans), sorted(owners)))
            assert got == brute(texts, items, window), (items, texts, window)


def test_words():
    text = "A-Z0_é’s naïve{x}~\x7fß"
    assert [w.decode() for w in d.fold_words(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def test_report_over_blocks(spark, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = d.contamination_report(small, bench)
    want = brute([r.text for r in small.orderBy("doc_id").collect()], [(str(r.item_id), r.text) for r in bench.collect()], 13)
    got = [(r.n_words, r.n_hit, r["items"]) for r in one.orderBy("doc_id").collect()]
    assert got == want and any(r[1] for r in got)
    many = d.with_contamination(small, bench, block_words=300)
    assert [(r.n_words, r.n_hit, r["items"]) for r in many.select("doc_id", "found.*").orderBy("doc_id").collect()] == want


def test_odd_rows(spark, hostile, nothing):
    bench = spark.createDataFrame([(1, "brown fox jumps"), (None, "own words"), (2, None), (3, ""), (1, "brown fox jumps")], "item_id long, text string")
    rows = d.contamination_report(hostile, bench).collect()
    assert len(rows) == hostile.count()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in rows if r.n_hit) == [(1, 3, 1), (1, 3, 1), (2, 2, 0), (2, 3, 1)]
    assert not any(r.contaminated for r in rows if r.n_words == 0)
    assert d.contamination_report(nothing, bench).count() == 0
    assert not d.contamination_report(hostile, bench.where("false")).where("contaminated OR n_hit > 0").count()


def test_spans_are_cut_and_contaminated_go(spark):
    item = " ".join(f"w{k}" for k in range(13))
    filler = " ".join(f"f{k}" for k in range(400))
    docs = spark.createDataFrame([(1, f"{filler}, {item.upper()}. {filler}"), (2, f"start {item} end"), (3, filler), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = {r.doc_id: r.text for r in d.decontaminate(docs, bench).collect()}
    assert kept == {1: f"{filler}, . {filler}", 3: filler, 4: None}
