"""Document fingerprints by I-Match over randomised lexicons, in DataFrame functions only.

Terms are runs of letters and digits (and of all characters beyond ASCII) of the lowered text. The
lexicon holds the terms whose inverse document frequency lies in a band: ``min_idf`` to
``max_idf`` bits, that is terms that one document in ``2 ** min_idf`` or fewer and one in
``2 ** max_idf`` or more hold (two documents at least). Frequent terms say nothing about a
document, and rare ones are slips, names and numbers that copies change.

A term's code is 60 bits of its MD5. Bit fields of the code deal the lexicon into randomised
subsets: ``SUBSETS`` has one that is the whole lexicon and others of a 4th to a 256th of it.
Of each text the distinct lexicon terms are sorted, those of a subset are hashed together, and
4 hex digits of the hash are the subset's place in the fingerprint (``----`` if the text has no
term of the subset). Dense subsets tell copies from near copies, sparse ones still agree when
much has changed. A text without any lexicon term is taken as one term, the hash of all its
sorted terms. Likeness is the share of subsets that agree, of those that are not empty in both
fingerprints; it is 1 if all are.

Defined results: null is the empty text; equal texts have equal fingerprints; texts without
terms have a fingerprint of empty places only. An empty table gives no rows. Rows of one
``doc_id`` stand in the order of their texts' MD5, null ids before all others. Other columns
are not read.

Scale: the lexicon is broadcast. It has at most ``2 ** max_idf`` times as many terms as a
document has on average (each of its terms is in that share of all documents), whatever the
number of documents. Texts are read three times and shuffled once: to put each document beside
its follower, they go to buckets of neighbouring ids, found by arithmetic from a fixed number of
quantiles; only the first document of a bucket goes to two of them. All further steps keep that
partitioning. A bucket is at most one quantile's share of the rows, and where ids lie evenly
within a quantile, ``bucket_rows`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_IDF, MAX_IDF = 3, 9
#: ``(shift, bits, subsets)``: of the codes' bit field, values below ``subsets`` are a subset
#: each. The first is the whole lexicon.
SUBSETS = ((0, 0, 1), (0, 2, 4), (2, 2, 3), (4, 4, 8), (8, 6, 24), (14, 8, 24))
PLACES, DIGITS = sum(s[2] for s in SUBSETS), 4
EMPTY = "-" * DIGITS
QUANTILES, BUCKET_ROWS, MOST_BUCKETS = 256, 2000, 1 << 17


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), BETWEEN)), "")


def code(text: Column) -> Column:
    """60 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lexicon(docs: DataFrame, text: str = "text", min_idf: int = MIN_IDF, max_idf: int = MAX_IDF) -> DataFrame:
    """``(term, df)`` of the terms in the band."""
    size = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, df = size.scalar(), F.col("df")
    return counts.where((df >= 2) & (df * 2**min_idf <= n) & (df * 2**max_idf >= n))


def signature(codes: Column) -> Column:
    """Fingerprint of sorted codes: a list of the places of all subsets."""
    parts = []
    for shift, bits, subsets in SUBSETS:
        field = lambda c, s=shift, b=bits: F.shiftright(c, s).bitwiseAND(F.lit((1 << b) - 1).cast("long"))
        if not bits:
            parts.append(F.array(_place(codes)))
            continue
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(subsets - 1).cast("long"))
        own = F.filter(codes, lambda c: field(c) < subsets)
        # An array of one list, so that the list is made once and not for each subset.
        dealt = F.transform(F.array(own), lambda some: F.transform(numbers, lambda j: _place(F.filter(some, lambda c: field(c) == j))))
        parts.append(dealt[0])
    return F.concat(*parts)


def _place(some: Column) -> Column:
    return F.when(F.size(some) == 0, EMPTY).otherwise(F.substring(F.md5(F.array_join(some.cast("array<string>"), ",")), 1, DIGITS))


def likeness(a: Column, b: Column) -> Column:
    """Share of the places that agree in two fingerprints, of those that are not empty in both."""
    # 0: empty in both, 1: alike, 2: not.
    pairs = F.zip_with(a, b, lambda x, y: F.when(x != y, 2).when(x == EMPTY, 0).otherwise(1))
    # An array of one list, so that the list is made once.
    share = F.transform(F.array(F.filter(pairs, lambda p: p > 0)), lambda used: F.when(F.size(used) == 0, 1.0).otherwise(F.size(F.filter(used, lambda p: p == 1)) / F.size(used)))
    return share[0]


# -- documents beside their followers -----------------------------------------------------


def _buckets(ids: DataFrame, quantiles: int, bucket_rows: int) -> tuple:
    """A function from an id column to its bucket, which never falls as ids rise."""
    # These numbers come to the driver, however many rows there are.
    found = ids.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [k / quantiles for k in range(quantiles + 1)], 100 * quantiles).alias("q")).first()
    bounds = sorted(set(found["q"] or []))
    per = max(1, min(MOST_BUCKETS, -(-found["n"] // bucket_rows)) // max(1, len(bounds)))
    if not bounds:
        return lambda doc_id: F.lit(0)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    upper = F.array(*[F.lit(float(b)) for b in [*bounds[1:], bounds[-1] + 1]])

    def bucket(doc_id: Column) -> Column:
        at = F.greatest(F.size(F.filter(edges, lambda b: b <= doc_id)), F.lit(1))
        low, high, here = F.element_at(edges, at).cast("double"), F.element_at(upper, at), doc_id.cast("double")
        part = F.floor(F.least(F.greatest((here - low) / F.greatest(high - low, F.lit(1.0)), F.lit(0.0)), F.lit(0.999999)) * per)
        return F.coalesce((at - 1) * per + part.cast("int"), F.lit(0))

    return bucket


def beside_followers(docs: DataFrame, text: str = "text", quantiles: int = QUANTILES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(bucket, place, visits, doc_id, text, next_text)``: each document with the text of the
    next one, in the order of ``doc_id`` and then of the texts' MD5; after the last comes the
    first. Rows that visit are the followers of other buckets' last ones."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bucket = _buckets(rows.select("doc_id"), quantiles, bucket_rows)
    rows = rows.withColumns({"digest": F.md5("text"), "own": bucket(F.col("doc_id"))})
    # Of each bucket its first row; the bucket before it (that before the first is the last).
    firsts = rows.groupBy("own").agg(F.min(F.struct("doc_id", "digest")).alias("row"))
    around = Window.orderBy("own")  # one row a bucket, at most MOST_BUCKETS
    last = F.max("own").over(Window.partitionBy())
    firsts = written(firsts.select(F.col("own").alias("from"), "row.*", F.coalesce(F.lag("own").over(around), last).alias("to")), "firsts")
    visitors = F.broadcast(firsts.select(F.col("from"), F.col("doc_id").alias("id"), F.col("digest").alias("md"), F.col("to")))
    met = (F.col("own") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("md"))
    homes = F.when(F.col("to").isNull(), F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("visits"))))
    homes = homes.otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("visits")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("visits"))))
    dealt = rows.join(visitors, met, "left").select("doc_id", "digest", "text", F.explode(homes).alias("home"))
    order = Window.partitionBy("bucket").orderBy("visits", "doc_id", "digest")
    dealt = dealt.select("home.*", "doc_id", "digest", "text")
    return dealt.withColumns({"place": F.row_number().over(order), "next_text": F.lead("text").over(order)}).drop("digest")


def fingerprinted(texts: DataFrame, keys: list[str], names: list[str], words: DataFrame) -> DataFrame:
    """A fingerprint, as a list of places, for each text column of ``names``; ``keys`` are unique. No further
    shuffle if the rows are partitioned by one of the keys."""
    # Each text has a first term '' that is in the lexicon, so that none is lost; that row alone carries what is kept.
    kept = [c for c in texts.columns if c not in keys and c not in names]
    parts = F.array(*[F.struct(F.lit(k).alias("which"), terms(F.col(n)).alias("terms")) for k, n in enumerate(names)])
    rows = texts.select(*keys, *kept, F.explode(parts).alias("t")).select(*keys, *kept, "t.which", "t.terms")
    whole = F.when(F.size("terms") > 0, code(F.array_join(F.sort_array("terms"), " ")))
    rows = rows.withColumn("whole", whole).select(*keys, *kept, "which", "whole", F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    is_first = F.col("term") == ""
    rows = rows.withColumn("key", F.xxhash64("term")).select(*keys, "which", "key", *[F.when(is_first, F.col(c)).alias(c) for c in ("whole", *kept)], is_first.alias("head"))
    codes = words.select(F.xxhash64("term").alias("key"), code(F.col("term")).alias("code"))
    codes = codes.union(codes.sparkSession.range(1).select(F.xxhash64(F.lit("")), F.lit(None).cast("long")))
    joined = rows.join(F.broadcast(codes), "key")
    lists = [F.sort_array(F.collect_list(F.when(F.col("which") == k, F.col("code")))).alias(f"codes{k}") for k in range(len(names))]
    wholes = [F.max(F.when(F.col("which") == k, F.col("whole"))).alias(f"whole{k}") for k in range(len(names))]
    grouped = joined.groupBy(*keys).agg(*lists, *wholes, *[F.max(F.when(F.col("which") == 0, F.col(c))).alias(c) for c in kept])
    one = [F.when((F.size(f"codes{k}") == 0) & F.col(f"whole{k}").isNotNull(), F.array(f"whole{k}")).otherwise(F.col(f"codes{k}")) for k in range(len(names))]
    return grouped.select(*keys, *kept, *[signature(c).alias(n) for c, n in zip(one, names)])


def fingerprints(docs: DataFrame, text: str = "text", min_idf: int = MIN_IDF, max_idf: int = MAX_IDF) -> DataFrame:
    """``(digest, fingerprint)`` of the distinct texts (by their MD5) of a table."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = written(lexicon(texts, "text", min_idf, max_idf), "lexicon")
    distinct = texts.select(F.md5("text").alias("digest"), F.col("text").alias("fingerprint")).dropDuplicates(["digest"])
    return fingerprinted(distinct, ["digest"], ["fingerprint"], words).select("digest", F.array_join("fingerprint", "").alias("fingerprint"))


def imatch_report(docs: DataFrame, min_idf: int = MIN_IDF, max_idf: int = MAX_IDF, quantiles: int = QUANTILES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per document its fingerprint, that of its edited text (whose second half is the start of
    the next document), and how alike they and the next document's are."""
    words = written(lexicon(docs.select("text"), "text", min_idf, max_idf), "lexicon")
    rows = beside_followers(docs, "text", quantiles, bucket_rows)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", 1, n - half), F.substring(F.coalesce("next_text", F.lit("")), 1, half))
    rows = rows.select("bucket", "place", "visits", "doc_id", n.cast("long").alias("n_chars"), F.col("text").alias("fingerprint"), edited.alias("edited_fingerprint"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited_fingerprint", 256))
    marked = fingerprinted(rows, ["bucket", "place"], ["fingerprint", "edited_fingerprint"], words)
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    marked = marked.withColumn("following", following).where(~F.col("visits"))
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("fingerprint", "").alias("fingerprint"),
        F.array_join("edited_fingerprint", "").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )
