import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash as s


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, distance):
    nodes = sorted(set(fps))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {x: find(x) for x in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(small):
    pick = random.Random(1)
    texts = [r.text for r in small.collect()] + [" ".join(pick.choice("aBcé ") for _ in range(n)) for n in range(12)] + ["", None, " \t"]
    assert [s.fingerprint(t) & (1 << 64) - 1 for t in texts] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("segments,chunk", [(3, 8192), (2, 8192), (4, 8192), (5, 8192), (3, 7)])
def test_components_of_links_are_those_of_all_pairs(spark, segments, chunk):
    pick = random.Random(segments)
    fps = []
    for _ in range(30):  # clouds of near copies, and chains
        seed = pick.getrandbits(64)
        for _ in range(pick.choice((1, 2, 20))):
            fps.append(seed)
            for _ in range(pick.randint(0, 4)):
                seed ^= 1 << pick.randrange(64)
    fps = sorted(set(fps)) + [0]
    table = spark.createDataFrame([(signed(f),) for f in sorted(set(fps))], "fp long")
    links = s.links_of(table, 4, segments, chunk)
    pairs = links.collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in pairs)
    got = {r.node: r.root for r in s.components(links).collect()}
    want = {signed(k): v for k, v in brute_roots(fps, 4).items()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    full = {k: got.get(k, k) for k in want}
    assert groups(full) == groups(want)


def test_layout_covers_the_distance():
    for distance in range(7):
        for segments in range(1, 9):
            parts = s.layout(distance, segments)
            assert sum(r + 1 for _, _, r in parts) > distance and sum(b for _, b, _ in parts) == 64


def test_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r.root for r in s.components(links).collect()} == {0}


def test_odd_rows(hostile, nothing):
    rows = s.near_duplicates(hostile).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.fp, r.component_id))
    assert len(rows) == hostile.count()
    assert by[1] == by[1][:1] * 2 and by[1][0] in by[2] and by[1][0][1] == 1
    assert by[3] == by[4] == by[5] == [(0, 3)] and (0, 3) in by[None]
    assert any(c is None for _, c in by[None])
    assert s.near_duplicates(nothing).count() == 0
    assert s.keep_one(nothing).count() == 0
    kept = s.keep_one(hostile)
    assert kept.columns == hostile.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, 1), (False, 2), (False, 3), (False, 6), (False, 7), (False, 8), (True, 0)]


def test_keep_one_against_brute_force(small):
    rows = small.collect()
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    root = brute_roots(fp.values(), 4)
    want = {}
    for i in sorted(fp):
        want.setdefault(root[fp[i]], i)
    assert sorted(r.doc_id for r in s.keep_one(small).collect()) == sorted(want.values())
    assert len(want) < len(rows)


def test_hot_run_is_bounded():
    run = s._Run((0, 0))
    table = np.arange(2000, dtype=np.uint64)
    run.members.append(table)
    links = run.ask(table, 64)
    assert len(links) <= 2 * len(table)  # not all pairs
