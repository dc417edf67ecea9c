"""Mixing sources to target weights over a domain, language, source tree.

Budget: the token budget flows from the root down. Every node gives its children shares in
proportion to their weights, but none more than its subtree can deliver (its tokens times
``max_epochs``). What a child cannot use goes to its siblings by their weights, again up to
what they can deliver, and only what all of them cannot use was never given to their parent,
which so left it to its own siblings: shortages move among siblings before ancestors.

The shares are whole tokens and exact: children sorted by capacity per weight fill up one
after the other as long as their capacity lies below their share of what is left; the rest
is dealt by cumulative flooring, so no token is lost.

Selection: a leaf's documents stand in a seeded order that is new in every epoch (md5 of
seed, epoch, id and text). A leaf of ``n`` tokens and quota ``q`` gives ``q div n`` whole
epochs and of the next the prefix with ``q mod n`` tokens. The document at its end gives only
its first tokens (``mix_take``).

Defined results: a null language or source is a leaf of its own; documents without words are
never selected; rows alike in id and text share one place in the order (at the end of the prefix each gives
the same number of tokens, rounded up); an empty table
or a budget of zero gives no rows.

Scale: tokens are summed per leaf before any shuffle. The order of a hot leaf is cut into
hash ranges of about ``BIN`` documents, whose sums give the range where the prefix ends; only
that range is sorted. Documents meet their leaf's cut in one join with a table of leaves,
so no text is shuffled while that table is small enough for Spark to broadcast it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, written

SPACE_AND_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Documents of one sorted range of a leaf, about.
BIN = 4096
LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``quota`` of every child: rows have ``parent`` columns, ``name``, ``cap``, ``weight``
    and the parent's ``budget`` (at most the sum of its children's caps)."""
    big = "decimal(38,0)"
    rows = children.where("cap > 0 AND weight > 0").withColumn("weight", F.col("weight").cast(big)).withColumn("cap", F.col("cap").cast(big))
    order = [(F.col("cap").cast("double") / F.col("weight").cast("double")), F.col(name).asc_nulls_first()]
    ranked = Window.partitionBy(*parent).orderBy(*order)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    rows = rows.withColumn("place", F.row_number().over(ranked)).withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0).cast(big)))
    rows = rows.withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0).cast(big)))
    full = (F.col("cap") * F.col("left")).cast(big) <= (F.col("weight") * (F.col("budget") - F.col("filled"))).cast(big)
    # Full children are the first ones; the first that is not ends them.
    rows = rows.withColumn("first_open", F.coalesce(F.min(F.when(~full, F.col("place"))).over(whole), F.lit(1 << 62)))
    rows = rows.withColumn("open", F.col("place") >= F.col("first_open"))
    rows = rows.withColumn("spent", F.sum(F.when(~F.col("open"), F.col("cap")).otherwise(F.lit(0).cast(big))).over(whole))
    rows = rows.withColumn("rest", F.col("budget") - F.col("spent")).withColumn("shares", F.sum(F.when(F.col("open"), F.col("weight"))).over(whole))
    upto = F.sum(F.when(F.col("open"), F.col("weight")).otherwise(F.lit(0).cast(big))).over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto)
    dealt = F.expr("(CAST(rest * upto AS DECIMAL(38,0)) div shares) - (CAST(rest * (upto - weight) AS DECIMAL(38,0)) div shares)")
    return rows.withColumn("quota", F.when(F.col("open"), dealt).otherwise(F.col("cap")).cast("long")).select(*parent, name, "quota")


def leaf_quotas(leaves: DataFrame, budget: int, weights: dict[str, Column] | None = None, max_epochs: int = 4) -> DataFrame:
    """``domain, lang, source, tokens, quota`` from ``leaves`` (``domain, lang, source,
    tokens``). ``weights`` has, by level, a whole number relative to the siblings as a column
    over ``domain, lang, source``; where it is null or missing, 1 is taken."""
    keys = [F.col(k) for k in LEVELS]
    named = leaves
    for k in LEVELS:
        weight = (weights or {}).get(k, F.lit(1))
        named = named.withColumn(f"{k}_weight", F.coalesce(weight.cast("long"), F.lit(1)))
    named = named.withColumn("cap", F.col("tokens") * max_epochs)
    # Capacity of what can be reached: a child of weight zero delivers nothing.
    named = named.where((F.col("domain_weight") > 0) & (F.col("lang_weight") > 0) & (F.col("source_weight") > 0))
    all_tokens = named.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("all"))
    budget_row = all_tokens.select(F.least(F.lit(budget).cast("long"), F.col("all")).cast("decimal(38,0)").alias("budget"), F.lit(0).alias("root"))
    above = budget_row
    parents: list[str] = ["root"]
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        children = named.withColumn("root", F.lit(0)).groupBy("root", *path).agg(F.sum("cap").alias("cap"), F.max(f"{level}_weight").alias("weight"))
        above = above.select(*[F.col(p).alias(f"_{p}") for p in parents], "budget")
        match = None
        for p in parents:
            test = F.col(p).eqNullSafe(F.col(f"_{p}"))
            match = test if match is None else match & test
        filled = _fill(children.join(above, match).drop(*[f"_{p}" for p in parents]), parents, level)
        parents = ["root", *path]
        above = filled.withColumn("budget", F.col("quota").cast("decimal(38,0)")).select(*parents, "budget")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in LEVELS]
    quotas = above.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], F.col("budget").cast("long").alias("quota"))
    return leaves.join(quotas, same[0] & same[1] & same[2]).select(*keys, "tokens", "quota").where("quota > 0")


def order_key(seed: int, epoch: Column, doc_id: Column, text: Column) -> Column:
    """Place of a document in its leaf's order of an epoch, as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def mix(docs: DataFrame, domain: Column, budget: int | None = None, budget_percent: int = 100, weights: dict[str, Column] | None = None, max_epochs: int = 4, seed: int = 11) -> DataFrame:
    """The selected documents, a row for each epoch they are in: their columns, and
    ``mix_domain, mix_epoch`` (from 0), ``mix_tokens`` and ``mix_take`` (tokens to take).

    The budget is ``budget`` tokens, or ``budget_percent`` of all tokens there are.
    """
    docs = docs.drop("mix_domain", "mix_epoch", "mix_tokens", "mix_take")  # columns of these names give way
    marked = docs.withColumn("__domain", domain).withColumn("__tokens", token_count(F.col("text")))
    slim = marked.where("__tokens > 0").select(F.col("__domain").alias("domain"), "lang", "source", F.col("__tokens").alias("n"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    slim = written(slim, "mix-documents")
    leaves = written(slim.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")), "mix-leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")).first()[0]
    quotas = leaf_quotas(leaves.drop("rows"), budget if budget is not None else total * budget_percent // 100, weights, max_epochs)
    cuts = written(_cuts(slim, leaves, quotas, seed), "mix-cuts")
    leaf = cuts.select(*[F.col(k).alias(f"__of_{k}") for k in LEVELS], *[F.col(c).alias(f"__{c}") for c in ("epochs", "key", "spare")])
    match = F.col("__domain").eqNullSafe(F.col("__of_domain")) & F.col("lang").eqNullSafe(F.col("__of_lang")) & F.col("source").eqNullSafe(F.col("__of_source"))
    chosen = marked.where("__tokens > 0").join(leaf, match)
    own = order_key(seed, F.col("__epochs"), F.col("doc_id"), F.col("text"))
    chosen = chosen.withColumn("__own", own)
    last = F.when(F.col("__own") < F.col("__key"), F.col("__tokens")).when(F.col("__own") == F.col("__key"), F.least("__tokens", F.col("__spare"))).otherwise(F.lit(0))
    times = F.col("__epochs") + F.when(last > 0, 1).otherwise(0)
    chosen = chosen.withColumn("__last", last).where(times > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), (times - 1).cast("long"))))
    take = F.when(F.col("__epoch") < F.col("__epochs"), F.col("__tokens")).otherwise(F.col("__last"))
    return chosen.select(*docs.columns, F.col("__domain").alias("mix_domain"), F.col("__epoch").alias("mix_epoch"), F.col("__tokens").alias("mix_tokens"), take.cast("long").alias("mix_take"))


def cut_words(text: Column, take: Column) -> Column:
    """A text up to the end of its ``take``-th word."""
    pieces = F.regexp_extract_all(text, F.lit(SPACE_AND_WORD), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), take.cast("int")), "")


def taken(mixed: DataFrame) -> DataFrame:
    """Rows of :func:`mix` with no more of their texts than their leaves' quotas take."""
    return mixed.withColumn("text", F.when(F.col("mix_take") < F.col("mix_tokens"), cut_words(F.col("text"), F.col("mix_take"))).otherwise(F.col("text")))


def _cuts(slim: DataFrame, leaves: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """Per leaf: whole ``epochs``, the order ``key`` at which the next one's prefix ends, and
    the tokens ``spare`` that each document there still gives."""
    renamed = quotas.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], "quota")
    match = F.col("domain").eqNullSafe(F.col("_domain")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    plan = leaves.join(renamed, match).select(
        F.xxhash64(*LEVELS).alias("leaf"), *LEVELS, (F.expr("quota div tokens")).cast("long").alias("epochs"), (F.col("quota") % F.col("tokens")).alias("prefix"), F.ceil(F.col("rows") / BIN).alias("bins")
    )
    plan = written(plan, "mix-plan")
    partial = plan.where("prefix > 0").select(*[F.col(k).alias(f"_{k}") for k in LEVELS], "epochs", "prefix", "bins")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")))
    placed = slim.join(partial, match).drop(*[f"_{k}" for k in LEVELS]).withColumn("key", key)
    placed = placed.withColumn("bin", (F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * F.col("bins")).cast("long"))
    bins = written(placed.groupBy(*LEVELS, "bin", "prefix", "epochs", "bins").agg(F.sum("n").alias("n")), "mix-bins")
    upto = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = bins.withColumn("upto", F.sum("n").over(upto)).where((F.col("upto") >= F.col("prefix")) & (F.col("upto") - F.col("n") < F.col("prefix")))
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], F.col("bin").alias("_bin"), (F.col("prefix") - (F.col("upto") - F.col("n"))).alias("need"))
    inside = placed.join(ends, match & (F.col("bin") == F.col("_bin"))).groupBy(*LEVELS, "need", "key").agg(F.sum("n").alias("n"), F.count("*").alias("copies"))
    sums = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = sums.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    # Rows alike in id and text: each gives an equal part of what is still needed, rounded up.
    spare = F.ceil((F.col("need") - (F.col("upto") - F.col("n"))) / F.col("copies")).cast("long")
    last = last.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], "key", spare.alias("spare"))
    return plan.join(last, match, "left").select(*LEVELS, "epochs", "key", "spare")


def source_group(groups: int = 4) -> Column:
    """A domain for tables that have none: sources by their number's remainder."""
    number = F.regexp_extract(F.col("source"), "([0-9]+)$", 1)
    return F.when(F.length(number) > 0, F.concat(F.lit("d"), (number.cast("long") % groups).cast("string")))
