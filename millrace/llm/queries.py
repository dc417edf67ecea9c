"""One query for each operator, over whole tables and whole texts, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read_table
from millrace.llm.decontaminate import contamination_report
from millrace.llm.html import extracted
from millrace.llm.imatch import DIGITS, EMPTY, MAX_IDF, MIN_IDF, SUBSETS, imatch_report
from millrace.llm.langid import fit_languages, predicted_languages
from millrace.llm.licenses import NOTICE_PERCENT, SPDX, TEMPLATES, TERM, THRESHOLD, TRIGGER, WRAP, license_scan
from millrace.llm.lm import lm_scores
from millrace.llm.mix import mix, source_group
from millrace.llm.pii import pii_report
from millrace.llm.quality import fit_quality, quality_report
from millrace.llm.search import TOP, ranked_documents
from millrace.llm.simhash import hex_of, near_duplicates
from millrace.llm.spelling import LEAST_LENGTH, LEAST_TIMES, RATIO, SLIP_EVERY, spelling_report
from millrace.llm.toxicity import fit_toxicity, toxicity_scores


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages"))


#: Production mix: half of the tokens there are, weighted by domain, language and source.
MIX_PERCENT, MIX_EPOCHS, MIX_SEED, MIX_DOMAINS = 50, 4, 11, 4


def mix_weights() -> dict:
    domain = F.when(F.col("domain") == "d0", 1).when(F.col("domain") == "d1", 2).when(F.col("domain") == "d2", 3).otherwise(4)
    lang = F.when(F.col("lang") == "en", 4).when(F.col("lang").isin("de", "fr"), 2).otherwise(1)
    return {"domain": domain, "lang": lang, "source": F.when(F.col("source").endswith("0"), 2).otherwise(1)}


def mixed(docs: DataFrame) -> DataFrame:
    return mix(docs, source_group(MIX_DOMAINS), budget_percent=MIX_PERCENT, weights=mix_weights(), max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "mix_domain", "lang", "source", "mix_epoch", "mix_tokens", "mix_take")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_report(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand as files in folders of a hundred below their source and language."""
    docs = read_table(spark, sf_dir, "documents")
    folder = F.expr("doc_id div 100").cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(folder, F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predicted_languages(docs, fit_languages(docs))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = pii_report(read_table(spark, sf_dir, "documents"))
    return report.withColumn("base_sha256", F.sha2(F.col("base"), 256)).drop("base")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return report.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_report(read_table(spark, sf_dir, "documents"), slip_every=SLIP_EVERY)


def op12_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch_report(read_table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_html": op1_html,
    "op2_mix": op2_mix,
    "op3_lm": op3_lm,
    "op4_quality": op4_quality,
    "op5_licenses": op5_licenses,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling": op11_spelling,
    "op12_imatch": op12_imatch,
    "op13_search": op13_search,
}

#: Words of a text as in ``decontaminate``: A-Z lowered, ASCII letters, digits and all beyond ASCII.
_FOLDED = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _fill_sql(name: str, children: str, parent: list[str], level: str) -> str:
    """Shares of a node's children in whole tokens, as in ``mix``."""
    by = ", ".join(parent)
    order = f"ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {level} NULLS FIRST"
    return f"""
{name}_a AS (SELECT *, row_number() OVER (PARTITION BY {by} {order}) AS place,
    coalesce(sum(cap) OVER (PARTITION BY {by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (PARTITION BY {by}) - coalesce(sum(weight) OVER (PARTITION BY {by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS leftover
    FROM ({children})),
{name}_b AS (SELECT *, place >= coalesce(min(CASE WHEN cap * leftover > weight * (budget - filled) THEN place END) OVER (PARTITION BY {by}), 1000000000) AS open FROM {name}_a),
{name}_c AS (SELECT *, budget - sum(CASE WHEN open THEN 0 ELSE cap END) OVER (PARTITION BY {by}) AS rest,
    sum(CASE WHEN open THEN weight END) OVER (PARTITION BY {by}) AS shares,
    sum(CASE WHEN open THEN weight ELSE 0 END) OVER (PARTITION BY {by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {name}_b),
{name} AS (SELECT {by}, {level}, CAST(CASE WHEN open THEN (rest * upto) // shares - (rest * (upto - weight)) // shares ELSE cap END AS HUGEINT) AS budget FROM {name}_c)"""


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SENTENCES = "string_split(regexp_replace({0}, '[.][ \\t]+', '.' || chr(10), 'g'), chr(10))"
_LINES = [*TEMPLATES, *((name, f"SPDX-License-Identifier: {name}") for name in sorted({t[0] for t in TEMPLATES}))]



def _signature_sql() -> str:
    """Fingerprint of the sorted list ``codes``, as in ``imatch``."""
    place = f"CASE WHEN len({{0}}) = 0 THEN '{EMPTY}' ELSE substr(md5(array_to_string({{0}}, ',')), 1, {DIGITS}) END"
    parts = []
    for shift, bits, subsets in SUBSETS:
        for number in range(subsets):
            some = f"list_filter(codes, lambda c: ((c >> {shift}) & {(1 << bits) - 1}) = {number})" if bits else "codes"
            parts.append(place.format(some))
    return " || ".join(parts)


def _likeness_sql(a: str, b: str) -> str:
    place = "substr({0}, " + f"{DIGITS} * i + 1, {DIGITS})"
    x, y = place.format(a), place.format(b)
    used = f"len(list_filter(range({sum(s[2] for s in SUBSETS)}), lambda i: {x} <> '{EMPTY}' OR {y} <> '{EMPTY}'))"
    same = f"len(list_filter(range({sum(s[2] for s in SUBSETS)}), lambda i: {x} = {y} AND {x} <> '{EMPTY}'))"
    return f"CASE WHEN {used} = 0 THEN 1.0 ELSE CAST({same} AS DOUBLE) / {used} END"


ORACLE = {
    "op3_lm": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOW.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), tok AS (
  SELECT r, i, w[i] AS a, CASE WHEN i > 1 THEN w[i-1] END AS b, CASE WHEN i > 2 THEN w[i-2] END AS c FROM d, unnest(range(1, len(w) + 1)) AS t(i)
), c1 AS (SELECT a, count(*) - 1 AS n FROM tok GROUP BY a
), c2 AS (SELECT b, a, count(*) - 1 AS n FROM tok WHERE b IS NOT NULL GROUP BY b, a
), c3 AS (SELECT c, b, a, count(*) - 1 AS n FROM tok WHERE c IS NOT NULL GROUP BY c, b, a
), big AS (SELECT count(*) AS n FROM tok
), seen AS (
  SELECT r, least(i, 3) AS depth, coalesce(g3.n, 0) AS n3, coalesce(x2.n, 0) AS ctx2, coalesce(g2.n, 0) AS n2, coalesce(x1.n, 0) AS ctx1, g1.n AS n1, big.n AS total
  FROM tok t CROSS JOIN big JOIN c1 g1 ON t.a = g1.a
  LEFT JOIN c1 x1 ON t.b = x1.a LEFT JOIN c2 g2 ON t.b = g2.b AND t.a = g2.a
  LEFT JOIN c2 x2 ON t.c = x2.b AND t.b = x2.a LEFT JOIN c3 g3 ON t.c = g3.c AND t.b = g3.b AND t.a = g3.a
), scored AS (
  SELECT r, depth, CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 WHEN n1 > 0 THEN 1 ELSE 0 END AS known,
         CASE WHEN n3 > 0 THEN ln(CAST(n3 AS DOUBLE) / ctx2) WHEN n2 > 0 THEN ln(CAST(n2 AS DOUBLE) / ctx1) WHEN n1 > 0 THEN ln(CAST(n1 AS DOUBLE) / (total - 1)) ELSE -ln(CAST(total AS DOUBLE)) END AS v
  FROM seen
), sums AS (
  SELECT r, CAST(sum(CAST(floor((v + (depth - known) * ln(0.4)) * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS micro,
         count(*) FILTER (known = 0) AS n0, count(*) FILTER (known = 1) AS n1, count(*) FILTER (known = 2) AS n2, count(*) FILTER (known = 3) AS n3
  FROM scored GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(micro, 0) AS micro, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3
FROM d LEFT JOIN sums USING (r)
""",
    "op5_licenses": f"""
WITH files AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), coalesce(CAST(doc_id // 100 AS VARCHAR), 'none')) AS dir,
         coalesce(CAST(doc_id AS VARCHAR), 'none') AS name FROM documents
), lines AS (
  SELECT dir, name, len(regexp_extract_all(low, '[^\\x20\\x09-\\x0D]+')) AS n_words, notice
  FROM (SELECT dir, name, {_LOW.format("text")} AS low FROM files), unnest(list_distinct(list_concat(
    {_SENTENCES.format("low")}, {_SENTENCES.format("regexp_replace(low, '" + WRAP + "', ' \\1', 'g')")}))) AS t(notice)
  WHERE regexp_matches(notice, '{TRIGGER}')
), template(license, line) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _LINES)}
), ours AS (
  SELECT 'n' || notice AS text, notice, unnest(regexp_extract_all(notice, '{TERM}')) AS term FROM (SELECT DISTINCT notice FROM lines)
), theirs AS (
  SELECT 't' || line AS text, license, line, unnest(regexp_extract_all({_LOW.format("line")}, '{TERM}')) AS term FROM template
), both_sides AS (SELECT text, term FROM ours UNION ALL SELECT text, term FROM theirs
), idf AS (
  SELECT term, ln((1 + (SELECT count(DISTINCT text) FROM both_sides)) / (1 + count(DISTINCT text))) + 1 AS idf FROM both_sides GROUP BY term
), left_w AS (
  SELECT notice, term, w / sqrt(sum(w * w) OVER (PARTITION BY notice)) AS w
  FROM (SELECT notice, term, count(*) * any_value(idf) AS w FROM ours JOIN idf USING (term) GROUP BY notice, term)
), right_w AS (
  SELECT license, line, term, w / sqrt(sum(w * w) OVER (PARTITION BY license, line)) AS v
  FROM (SELECT license, line, term, count(*) * any_value(idf) AS w FROM theirs JOIN idf USING (term) GROUP BY license, line, term)
), scored AS (
  SELECT notice, license, line, CAST(floor(10000 * sum(w * v) + 0.5) AS BIGINT) AS score FROM left_w JOIN right_w USING (term) GROUP BY notice, license, line
), matched AS (
  SELECT notice, license, score FROM (SELECT *, row_number() OVER (PARTITION BY notice ORDER BY score DESC, license) AS k FROM scored WHERE score >= {THRESHOLD} * 10000) WHERE k = 1
), own AS (
  SELECT * FROM (
    SELECT dir, name, license, score, n_words, size, row_number() OVER (PARTITION BY dir, name ORDER BY score DESC, license, size DESC, n_words) AS k
    FROM (
      SELECT dir, name, n_words, license, score, len(regexp_extract_all(notice, '[^\\x20\\x09-\\x0D]+')) AS size FROM lines JOIN matched USING (notice)
      UNION ALL
      SELECT dir, name, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), unnest(regexp_extract_all(text, '{SPDX}', 1)), 10000, 2 FROM files
    )
  ) WHERE k = 1
), by_dir AS (
  SELECT dir, license FROM (
    SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license, name) AS k2 FROM own WHERE 100 * size >= {NOTICE_PERCENT} * n_words
  ) WHERE k2 = 1
), nearest AS (
  SELECT below, dir, license FROM (
    SELECT b.dir AS below, a.dir, a.license, row_number() OVER (PARTITION BY b.dir ORDER BY length(a.dir) DESC) AS k
    FROM (SELECT DISTINCT dir FROM files) b JOIN by_dir a ON b.dir = a.dir OR starts_with(b.dir, a.dir || '/')
  ) WHERE k = 1
)
SELECT doc_id, f.dir || '/' || f.name AS path, own.license AS own_license, own.score AS own_score,
       coalesce(own.license, n.license) AS license, CASE WHEN own.license IS NULL THEN n.dir END AS license_dir
FROM files f LEFT JOIN own ON f.dir = own.dir AND f.name = own.name LEFT JOIN nearest n ON f.dir = n.below
""",
    "op2_mix": f"""
WITH docs AS (
  SELECT doc_id, lang, source, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n, md5(coalesce(text, '')) AS digest,
         CASE WHEN regexp_matches(source, '[0-9]+$') THEN concat('d', CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % {MIX_DOMAINS} AS VARCHAR)) END AS domain
  FROM documents
), leaf AS (
  SELECT 0 AS root, domain, lang, source, CAST(sum(n) AS HUGEINT) AS tokens, CAST(sum(n) * {MIX_EPOCHS} AS HUGEINT) AS cap,
         CAST(CASE domain WHEN 'd0' THEN 1 WHEN 'd1' THEN 2 WHEN 'd2' THEN 3 ELSE 4 END AS HUGEINT) AS domain_weight,
         CAST(CASE WHEN lang = 'en' THEN 4 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END AS HUGEINT) AS lang_weight,
         CAST(CASE WHEN source LIKE '%0' THEN 2 ELSE 1 END AS HUGEINT) AS source_weight
  FROM docs WHERE n > 0 GROUP BY domain, lang, source
), top AS (
  SELECT CAST(least((SELECT sum(tokens) FROM leaf) * {MIX_PERCENT} // 100, (SELECT sum(cap) FROM leaf)) AS HUGEINT) AS budget
), {_fill_sql("d", "SELECT root, domain, sum(cap) AS cap, max(domain_weight) AS weight, (SELECT budget FROM top) AS budget FROM leaf GROUP BY root, domain", ["root"], "domain")},
{_fill_sql("l", "SELECT c.*, d.budget FROM (SELECT root, domain, lang, sum(cap) AS cap, max(lang_weight) AS weight FROM leaf GROUP BY root, domain, lang) c JOIN d ON c.domain IS NOT DISTINCT FROM d.domain", ["root", "domain"], "lang")},
{_fill_sql("s", "SELECT c.*, l.budget FROM (SELECT root, domain, lang, source, sum(cap) AS cap, max(source_weight) AS weight FROM leaf GROUP BY root, domain, lang, source) c JOIN l ON c.domain IS NOT DISTINCT FROM l.domain AND c.lang IS NOT DISTINCT FROM l.lang", ["root", "domain", "lang"], "source")},
plan AS (
  SELECT leaf.domain, leaf.lang, leaf.source, CAST(budget // tokens AS BIGINT) AS epochs, CAST(budget % tokens AS BIGINT) AS prefix
  FROM leaf JOIN s ON leaf.domain IS NOT DISTINCT FROM s.domain AND leaf.lang IS NOT DISTINCT FROM s.lang AND leaf.source IS NOT DISTINCT FROM s.source WHERE budget > 0
), placed AS (
  SELECT docs.*, epochs, prefix, md5(concat_ws('|', '{MIX_SEED}', CAST(epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''), digest)) AS key
  FROM docs JOIN plan ON docs.domain IS NOT DISTINCT FROM plan.domain AND docs.lang IS NOT DISTINCT FROM plan.lang AND docs.source IS NOT DISTINCT FROM plan.source WHERE n > 0
), places AS (
  SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(n) OVER (PARTITION BY domain, lang, source, key) AS here, count(*) OVER (PARTITION BY domain, lang, source, key) AS copies FROM placed
), last AS (
  SELECT *, CAST(greatest(0, CASE WHEN upto <= prefix THEN n ELSE least(n, ceil(CAST(greatest(0, prefix - (upto - here)) AS DOUBLE) / copies)) END) AS BIGINT) AS take FROM places
)
SELECT doc_id, domain AS mix_domain, lang, source, e AS mix_epoch, n AS mix_tokens, CASE WHEN e < epochs THEN n ELSE take END AS mix_take
FROM last, unnest(range(0, epochs + CASE WHEN take > 0 THEN 1 ELSE 0 END)) AS t(e)
""",
    "op10_decontaminate": f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_FOLDED.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS win FROM item WHERE len(w) BETWEEN 1 AND 12
  UNION ALL
  SELECT item_id, 13, array_to_string(w[i:i+12], ' ') FROM item, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_FOLDED.format("text")}, []) AS w FROM documents
), place AS (
  SELECT r, w, n, i FROM d, (SELECT DISTINCT n FROM windows) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), found AS (
  SELECT r, i, p.n, item_id FROM place p JOIN windows v ON p.n = v.n AND array_to_string(w[i:i+p.n-1], ' ') = win
), hit AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS t(k) GROUP BY r
), owners AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN owners USING (r)
""",
    "op11_spelling": f"""
WITH RECURSIVE checksum AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS tab
), pairs AS (
  SELECT id, w, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOW.format("text")}, '[a-zÀ-ÿ]{{{LEAST_LENGTH},}}')) AS w FROM documents
  ) GROUP BY id, w
), marked AS (
  SELECT w, n, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(concat(id, ':', w), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END)),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) AS h FROM pairs, checksum
), words AS MATERIALIZED (
  SELECT w AS word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {SLIP_EVERY} = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS w, n FROM marked)
  WHERE length(w) >= {LEAST_LENGTH} GROUP BY w HAVING sum(n) >= {LEAST_TIMES}
), cuts AS MATERIALIZED (
  SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), pair AS (
  SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pair GROUP BY word
), forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS last FROM words UNION ALL SELECT path.word, form FROM path JOIN forms ON path.last = forms.word WHERE form IS NOT NULL
), root AS (
  SELECT path.word, last AS root FROM path JOIN forms ON path.last = forms.word WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN root USING (word)
""",
    "op12_imatch": f"""
WITH d AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text)) AS r FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), e AS MATERIALIZED (
  SELECT r, doc_id, text, length(text) AS n, follower,
         concat(substr(text, 1, length(text) - length(text) // 2), substr(follower, 1, length(text) // 2)) AS edited, next_r
  FROM (SELECT *, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS follower, coalesce(lead(r) OVER (ORDER BY r), 1) AS next_r FROM d)
), bag AS MATERIALIZED (
  SELECT r, kind, list_distinct(regexp_extract_all(lower(t), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT r, 0 AS kind, text AS t FROM e UNION ALL SELECT r, 1, edited FROM e)
), term AS MATERIALIZED (
  SELECT r, kind, unnest(w) AS term FROM bag
), lexicon AS (
  SELECT term, CAST(concat('0x', substr(md5(term), 1, 15)) AS BIGINT) AS code FROM term WHERE kind = 0 GROUP BY term
  HAVING count(*) >= 2 AND count(*) * {2**MIN_IDF} <= (SELECT count(*) FROM d) AND count(*) * {2**MAX_IDF} >= (SELECT count(*) FROM d)
), list AS (
  SELECT r, kind, list(code ORDER BY code) AS codes FROM term JOIN lexicon USING (term) GROUP BY r, kind
), own AS (
  SELECT r, kind, CASE WHEN codes IS NOT NULL THEN codes WHEN len(w) > 0 THEN [CAST(concat('0x', substr(md5(array_to_string(list_sort(w), ' ')), 1, 15)) AS BIGINT)] ELSE [] END AS codes
  FROM bag LEFT JOIN list USING (r, kind)
), print AS MATERIALIZED (
  SELECT r, kind, {_signature_sql()} AS fp FROM own
)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
       {_likeness_sql("a.fp", "b.fp")} AS near_edited, {_likeness_sql("a.fp", "c.fp")} AS near_next
FROM e JOIN print a ON a.r = e.r AND a.kind = 0 JOIN print b ON b.r = e.r AND b.kind = 1 JOIN print c ON c.r = e.next_r AND c.kind = 0
""",
    "op13_search": f"""
WITH item AS (
  SELECT row_number() OVER () AS place, item_id, {_FOLDED.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
), wanted AS (
  SELECT place, term, count(*) AS times FROM (SELECT place, unnest(w) AS term FROM item) GROUP BY place, term
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_FOLDED.format("text")} AS w FROM documents WHERE text IS NOT NULL
), held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, total GROUP BY term
), gain AS (
  SELECT r, term, weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * CAST(len(d.w) AS BIGINT) * n_docs) // n_terms))) AS g
  FROM held JOIN d USING (r) JOIN weight USING (term), total
), scored AS (
  SELECT place, r, CAST(sum(times * g) AS BIGINT) AS score FROM gain JOIN wanted USING (term) GROUP BY place, r
), ranked AS (
  SELECT place, doc_id, score, row_number() OVER (PARTITION BY place ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN d USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN item USING (place) WHERE rank <= {TOP}
""",
}
