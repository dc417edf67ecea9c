"""Licences, language-model scores and the registered queries."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses, lm, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_is_what_its_sql_says(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in queries.ORACLE:
        assert rows
        return
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr([r[c] for c in sorted(columns)]) for r in rows) == sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in want.fetchall())


def test_licences_come_from_the_nearest_directory(spark):
    files = [
        ("LICENSE", "Released under the MIT License."),
        ("a/x.c", "int main() {}"),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/y.c", "int f;"),
        ("a/b/z.c", "// Licensed under the Apache License, Version 2.0.\n" + "int g; " * 50),
        ("a/b/z.c", "// a repeated path"),
        ("e/empty", ""),
        ("e/null", None),
        (None, "Released under the MIT License."),
        ("d/w.c", "a licence of its own kind, licensed to nobody in particular for nothing"),
    ]
    table = spark.createDataFrame([(p, t, "clash") for p, t in files], "path string, text string, license string")
    got = sorted((r.path or "", r.own_license, r.license, r.license_dir) for r in licenses.license_scan(table).collect())
    assert got == [
        ("", None, None, None),
        ("LICENSE", "MIT", "MIT", None),
        ("a/b/COPYING", "GPL-3.0", "GPL-3.0", None),
        ("a/b/c/y.c", None, "GPL-3.0", "a/b"),
        ("a/b/z.c", "Apache-2.0", "Apache-2.0", None),
        ("a/b/z.c", "Apache-2.0", "Apache-2.0", None),
        ("a/x.c", None, "MIT", ""),
        ("d/w.c", None, "MIT", ""),
        ("e/empty", None, "MIT", ""),
        ("e/null", None, "MIT", ""),
    ]
    assert licenses.license_scan(table.where("false")).count() == 0


def test_headers_titles_and_tags(spark):
    gpl = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int x;"""
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n"
    files = {
        "gpl.c": (gpl, "GPL-3.0"),
        "gpl2.c": (gpl.replace("3", "2"), "GPL-2.0"),
        "lgpl.c": (gpl.replace("program", "library").replace("General", "Lesser General").replace("3", "2.1"), "LGPL-2.1"),
        "agpl.c": (gpl.replace("General", "Affero General"), "AGPL-3.0"),
        "bsd.py": (bsd + "x = 1\n", "BSD-3-Clause"),
        "a/LICENSE": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Somebody\n", "GPL-3.0"),
        "b/LICENSE": ("\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS", "Apache-2.0"),
        "c/LICENSE": ("Mozilla Public License Version 2.0\n==================================\n", "MPL-2.0"),
        "d.h": ("// SPDX-License-Identifier: LGPL-2.1-only\n", "LGPL-2.1-only"),
        "e.h": ("/* spdx-license-identifier: ISC */ int y;", "ISC"),
        "f.h": ("// SPDX-License-Identifier: Made-Up-1.0.\n", "Made-Up-1.0"),
        "g/LICENSE": ("ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n", "ISC"),
        "h.py": ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n", "Apache-2.0"),
        "i.js": ("// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy", "MPL-2.0"),
        "j.txt": ("prose before\nReleased under the MIT License.\nprose behind it", "MIT"),
        "k.txt": ("this text speaks of a licence\nand of nothing else at all, in many words", None),
    }
    table = spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "path string, text string")
    got = {r.path: r.own_license for r in licenses.license_scan(table).collect()}
    assert got == {p: want for p, (_, want) in files.items()}


def test_licence_cosines(spark):
    """Against vectors worked out by hand in Python."""
    notices = ["licensed under the apache license, version 2.0.", "licensed under a license", "all rights reserved worldwide"]
    table = spark.createDataFrame([("p", 5, n) for n in notices], "path string, n_words int, notice string")
    templates = licenses.template_table(spark)
    got = {r.notice: (r.license, r.score) for r in licenses.match_notices(table, templates, 0.0).collect()}
    terms = lambda t: Counter(re.findall(licenses.TERM, t.lower()))
    lines = [(r.license, r.line) for r in templates.collect()]
    both = [terms(n) for n in notices] + [terms(x) for _, x in lines]
    idf = {w: math.log((1 + len(both)) / (1 + sum(w in t for t in both))) + 1 for t in both for w in t}
    vector = lambda t: {w: c * idf[w] for w, c in t.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for notice in notices:
        v = vector(terms(notice))
        scores = [(-math.floor(10000 * sum(x * u.get(w, 0) for w, x in v.items()) / size(v) / size(u) + 0.5), name) for name, line in lines for u in [vector(terms(line))] if v.keys() & u.keys()]
        assert got[notice] == (min(scores)[1], -min(scores)[0])


def brute_scores(texts, order, alpha):
    words = [lm.split_words(t) for t in texts]
    counts = Counter(tuple(w[k : k + n]) for w in words for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = sum(map(len, words))
    out = []
    for w in words:
        micro, hits = 0, Counter()
        for i in range(len(w)):
            deep = min(order, i + 1)
            for n in range(deep, 0, -1):
                own = counts[tuple(w[i - n + 1 : i + 1])] - 1
                if own:
                    value = math.log(own / (counts[tuple(w[i - n + 1 : i])] - 1 if n > 1 else total - 1))
                    break
            else:
                n, value = 0, -math.log(total)
            hits[n] += 1
            micro += math.floor((value + (deep - n) * math.log(alpha)) * 1e6 + 0.5)
        out.append((len(w), micro, *(hits[n] for n in range(order + 1))))
    return out


@pytest.mark.parametrize("order,size", [(1, 50), (2, 1000), (3, 77), (4, 10**6)])
def test_scores_against_brute_force(spark, small, order, size):
    texts = [r.text for r in small.where("doc_id < 60").collect()] + ["", None, "one", "one", "A a a A a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(lm.lm_scores(docs, order, chunk_words=size).collect())
    want = brute_scores(texts, order, lm.ALPHA)
    assert [r[3:] for r in rows] == [w[2:] for w in want]
    assert all(abs(r[2] - w[1]) <= w[0] for r, w in zip(rows, want))  # a millionth a word, at rounding edges


def test_counting_words(small):
    import pyarrow as pa

    texts = [r.text for r in small.collect()] + ["", None, " ", "a", "a b", " a", "b ", "\x0b\x0c\ta\n\rb", "é\u00a0ü\u2003x", None]
    want = sum(len(lm.split_words(t)) for t in texts)
    assert lm.words_in(pa.array(texts, pa.string())) == want == sum(lm.words_in(pa.array(texts).slice(k, 7)) for k in range(0, len(texts), 7))
    assert lm.words_in(pa.array([], pa.string())) == 0 and lm.words_in(pa.array([None, ""], pa.string())) == 0


def test_scores_of_odd_rows(spark, hostile, nothing):
    rows = lm.lm_scores(hostile).collect()
    assert len(rows) == hostile.count() and all(r.micro == 0 for r in rows if not r.n_words) and all(r.micro < 0 for r in rows if 0 < r.n_words < 100)
    assert sum(r.doc_id is None for r in rows) == 2
    assert lm.lm_scores(nothing).count() == 0
    twin = spark.createDataFrame([(1, "same text")] * 4, "doc_id long, text string").repartition(4)
    assert len(lm.lm_scores(twin).collect()) == 4


def test_folded_counts(spark):
    rows = queries.op10_decontaminate(spark, SF).where(F.length("items_sha256") != 64)
    assert not rows.count()
