"""License scan: sparse TF-IDF cosine of notices to templates, then inheritance by directory.

A file's text is cut into sentences twice: at line ends and after full stops, and once more
with the lines of a paragraph put together, without the comment marks before them, so that
headers and licence texts that are wrapped are compared as a whole. Sentences with a word that
every template family uses are notices. Notices and templates are vectors of term frequency
times inverse document frequency over the distinct notices and templates; their cosines come
from a join on terms. A notice belongs to its best template from ``threshold`` on, a file to the
best of its notices. An SPDX tag names its licence itself, whether there is a template or not.

A file is a directory's licence file if its name says so (LICENSE, COPYING, NOTICE), or if
its notice makes up at least ``notice_percent`` of its words. Files without a licence of their
own take that of the nearest directory above them that has one.

DataFrame functions only.

Defined results: null and empty texts have no notice; a null path has no directory, so it
inherits nothing; rows that repeat a path are one file and share their results (the best
notice counts); ties go to the smaller template and path; empty tables give no rows.

Scale: texts are read in two passes that keep only notices and tags. Notices are counted before they
shuffle, so one that a third of the files carry is one row; a file's notices meet their scores
in a join whose hot keys Spark splits, and directories, not files, are joined to ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LETTERS_LOW, LETTERS_UP, WORD, written

#: Usual wordings of notices, of standard headers, and the titles and first sentences of
#: licence texts, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal license public domain dedication"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LicenseRef-proprietary", "All rights reserved."),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. unlicense"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. zlib license"),
)
TRIGGER = r"licen[sc]e|rights reserved|permission is hereby|permission to use|redistribution and use|spdx|name of the copyright holder|free and unencumbered"
#: A line end that stands within a paragraph, with the comment marks behind it.
WRAP = r"[ \t\r]*\n[ \t]*(?:(?://+|#+|[*]+/?|;+|--+)[ \t]*)*([^ \t\r\n])"
SPDX = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9.+-]*[a-z0-9+])"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
SENTENCE_END = r"\n|(?<=[.])[ \t]+"
RESULT = ("own_license", "own_score", "license", "license_dir")
THRESHOLD, NOTICE_PERCENT = 0.7, 30


def lowered(text: Column) -> Column:
    return F.translate(text, LETTERS_UP, LETTERS_LOW)


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    lines = [*templates, *((name, f"SPDX-License-Identifier: {name}") for name in sorted({t[0] for t in templates}))]
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(line).alias("line")) for name, line in lines])
    return spark.range(1).select(F.inline(rows))


def notices_of(files: DataFrame) -> DataFrame:
    """``path, n_words, notice`` (lowered) of the files that have any."""
    low = lowered(F.col("text"))
    found = files.where(F.col("path").isNotNull()).select("path", low.alias("low")).where(F.col("low").rlike(TRIGGER))
    unwrapped = F.regexp_replace("low", WRAP, " $1")
    sentences = F.array_distinct(F.concat(F.split("low", SENTENCE_END), F.split(unwrapped, SENTENCE_END)))
    found = found.select("path", F.regexp_count("low", F.lit(WORD)).alias("n_words"), F.explode(sentences).alias("notice"))
    return found.where(F.col("notice").rlike(TRIGGER))


def tags_of(files: DataFrame) -> DataFrame:
    """``path, n_words, license`` of the files with SPDX tags, a row for each tag."""
    found = files.where(F.col("path").isNotNull() & F.col("text").rlike(SPDX))
    return found.select("path", F.regexp_count("text", F.lit(WORD)).alias("n_words"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)))).alias("license"))


def _weighted(terms: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, term, w`` with rows of unit length."""
    w = terms.groupBy(*keys, "term").count().join(idf, "term").withColumn("w", F.col("count") * F.col("idf"))
    length = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, keys).select(*keys, "term", (F.col("w") / F.col("length")).alias("w"))


def match_notices(notices: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``notice, license, score`` (ten-thousandths) of the distinct notices that fit a template."""
    terms_of = lambda text: F.explode(F.regexp_extract_all(lowered(text), F.lit(TERM), F.lit(0))).alias("term")
    ours = written(notices.select("notice").distinct(), "license-notices").select("notice", terms_of(F.col("notice")))
    theirs = templates.select("license", "line", terms_of(F.col("line")))
    both = ours.select(F.concat(F.lit("n"), "notice").alias("text"), "term").union(theirs.select(F.concat(F.lit("t"), "line").alias("text"), "term"))
    total = both.agg(F.countDistinct("text")).first()[0]
    idf = both.groupBy("term").agg(F.countDistinct("text").alias("df")).select("term", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = written(idf, "license-terms")
    left = _weighted(ours, idf, ["notice"])
    right = _weighted(theirs, idf, ["license", "line"]).withColumnRenamed("w", "v")
    scored = left.join(right, "term").groupBy("notice", "license", "line").agg(F.floor(10000 * F.sum(F.col("w") * F.col("v")) + 0.5).cast("long").alias("score"))
    fit = scored.where(F.col("score") >= threshold * 10000)
    best = fit.groupBy("notice").agg(F.min(F.struct((-F.col("score")).alias("rank"), "license")).alias("best"))
    return best.select("notice", "best.license", (-F.col("best.rank")).alias("score"))


def license_scan(files: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, notice_percent: int = NOTICE_PERCENT) -> DataFrame:
    """Per row of ``files`` (``path``, ``text`` and others): its columns but ``text``, and
    ``own_license, own_score, license, license_dir`` (the directory it is inherited from)."""
    spark = files.sparkSession
    files = files.drop(*RESULT)  # columns of these names give way
    templates = template_table(spark) if templates is None else templates
    notices = written(notices_of(files), "license-found")
    matched = written(match_notices(notices, templates, threshold), "license-matched")
    hits = notices.join(matched, "notice").withColumn("size", F.regexp_count("notice", F.lit(WORD))).drop("notice")
    # A tag is two words and fits exactly.
    hits = hits.unionByName(tags_of(files).select("path", "n_words", "license", F.lit(10000).cast("long").alias("score"), F.lit(2).alias("size")))
    rank = F.struct((-F.col("score")).alias("rank"), "license", (-F.col("size")).alias("size"), "n_words")
    own = hits.groupBy("path").agg(F.min(rank).alias("best"))
    own = written(own.select("path", F.col("best.license").alias("own_license"), (-F.col("best.rank")).alias("own_score"), (-F.col("best.size")).alias("size"), F.col("best.n_words").alias("n_words")), "license-own")

    name = F.element_at(F.split("path", "/"), -1)
    is_file = name.rlike(r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$") | (100 * F.col("size") >= notice_percent * F.col("n_words"))
    by_dir = own.where(is_file).groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("own_score")).alias("rank"), "own_license", "path")).alias("best"))
    by_dir = by_dir.select("dir", F.col("best.own_license").alias("dir_license"))

    slim = files.drop("text").withColumn("__dir", directory(F.col("path")))
    dirs = slim.where(F.col("__dir").isNotNull()).select(F.col("__dir").alias("below")).distinct()
    above = dirs.select("below", F.posexplode(ancestors(F.col("below"))).alias("depth", "dir")).join(by_dir, "dir")
    nearest = above.groupBy("below").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("best"))
    nearest = nearest.select(F.col("below").alias("__dir"), F.col("best.dir").alias("__from"), F.col("best.dir_license").alias("__inherited"))

    found = own.select(F.col("path").alias("__path"), "own_license", "own_score")
    joined = slim.join(found, F.col("path") == F.col("__path"), "left").join(nearest, "__dir", "left")
    return joined.select(
        *[c for c in files.columns if c != "text"],
        "own_license",
        "own_score",
        F.coalesce("own_license", "__inherited").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("__from")).alias("license_dir"),
    )


def directory(path: Column) -> Column:
    """What stands before the last slash; the empty text for a file at the root."""
    return F.when(path.isNull(), None).otherwise(F.regexp_replace(path, r"/?[^/]*$", ""))


def ancestors(directory: Column) -> Column:
    """The root, and every directory down to this one."""
    parts = F.split(directory, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), below))
