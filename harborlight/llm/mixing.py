"""Mixing sources to target weights by hierarchical budgets.

Weights form a tree: domain, language, source. A node's budget is dealt to its
children by weight. No leaf can give more than its tokens times the epochs
allowed, so a node's room is the sum of its leaves' room; what a child cannot
take goes to its siblings by weight, and only what a whole subtree cannot take
reaches the siblings of the node above. All budgets are whole tokens.

A leaf's documents are put in a seeded order for each epoch; the leaf gives as
many whole epochs as its budget holds and a prefix of the next one, up to and
including the document that reaches the budget.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborlight.llm.common import SPACE, saved, whole

LEAF = ["domain", "language", "source_name"]
BUCKETS = 3  # hex digits of the order key that deal a leaf out: 4096 buckets


def tokens_of(text: str = "text") -> Column:
    """Words of a text; null counts as empty."""
    return F.regexp_count(whole(text), F.lit(SPACE.replace("[", "[^") + "+")).cast("long")


def weight_of(column: str, weights: Mapping[str, int]) -> Column:
    """The weight of a name, 1 for a name without one."""
    known = [x for name, w in weights.items() for x in (F.lit(name), F.lit(int(w)))]
    return F.coalesce(F.create_map(*known)[F.col(column)] if known else F.lit(None), F.lit(1)).cast("long")


def dealt(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Deal ``given`` (the parent's budget) to its children by ``weight``, none above its ``room``.

    Children fill up in the order of room over weight. The first one that does not
    fill up and all behind it share what is left by weight; tokens that the
    division leaves over go one each to the first of them. Adds ``budget``. A weight of 0 gets nothing.
    """
    nodes = nodes.filter("weight > 0")
    group = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = group.orderBy(F.col("room") / F.col("weight"), "name")
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    behind = order.rowsBetween(0, W.unboundedFollowing)
    nodes = nodes.withColumn(
        "left", F.greatest(F.col("given") - F.coalesce(F.sum("room").over(before), F.lit(0)), F.lit(0))
    ).withColumn("rest", F.sum("weight").over(behind))
    short = F.expr("room * rest > left * weight")
    nodes = nodes.withColumn("base", F.first(F.when(short, F.struct("left", "rest")), ignorenulls=True).over(upto))
    shares = F.col("base").isNotNull()
    nodes = nodes.withColumn("part", F.when(shares, F.expr("base.left * weight div base.rest")).otherwise(F.col("room")))
    spare = F.col("base.left") - F.sum(F.when(shares, F.col("part"))).over(group)
    rank = F.sum(shares.cast("int")).over(upto)
    return nodes.withColumn(
        "budget", F.col("part") + F.when(shares & (rank <= spare), 1).otherwise(0)
    ).drop("left", "rest", "base", "part")


def budgets(leaves: DataFrame, total: int, epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """(domain, language, source_name, avail, budget) of every leaf with a budget above 0.

    The table has one row per leaf, however many documents it stands for.
    """
    leaves = leaves.withColumn("room", F.col("avail") * epochs)
    found = None
    for depth, column in enumerate(LEAF):
        path = LEAF[:depth + 1]
        level = leaves.groupBy(*path).agg(F.sum("room").alias("room"))
        level = level.withColumn("given", F.lit(total).cast("long")) if found is None else level.join(
            found.select(*path[:-1], F.col("budget").alias("given")), path[:-1])
        level = level.withColumn("weight", weight_of(column, weights.get(column, {}))).withColumn("name", F.col(column))
        found = dealt(level, path[:-1])
    return found.join(leaves.select(*LEAF, "avail"), LEAF).filter("budget > 0").select(*LEAF, "avail", "budget")


def _key(seed: int) -> Column:
    """Where a document stands in its leaf's order of the epoch that is cut; ids given twice stand together."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mixture(
    docs: DataFrame, domain: Column, share: tuple[int, int], epochs: int,
    weights: Mapping[str, Mapping[str, int]], seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """The plan of a mixture: documents (doc_id, domain, language, source_name, tokens) and cuts per leaf.

    The total budget is ``share`` (numerator, denominator) of all tokens. Cuts
    have budget, avail, epoch (whole epochs that are taken) and cut: in the next epoch the documents
    whose key is at most ``cut`` are taken, none if it is null. Null domains, languages and sources are named ''.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = saved(docs.select(
        "doc_id", name(domain).alias("domain"), name(F.col("lang")).alias("language"),
        name(F.col("source")).alias("source_name"), tokens_of().alias("tokens")), "mix-rows")
    leaves = saved(rows.groupBy(*LEAF).agg(F.sum("tokens").alias("avail")), "mix-leaves")
    all_tokens = leaves.agg(F.sum("avail").alias("n")).first().n or 0
    plan = budgets(leaves, all_tokens * share[0] // share[1], epochs, weights)
    plan = saved(plan.withColumn("epoch", F.expr("budget div avail")).withColumn(
        "rest", F.col("budget") % F.col("avail")), "mix-plan")
    keyed = rows.join(plan.filter("rest > 0").select(*LEAF, "epoch", "rest"), LEAF).select(
        *LEAF, "rest", "tokens", _key(seed).alias("key"), F.substring(_key(seed), 1, BUCKETS).alias("bucket"))
    # a leaf's running sum goes over its buckets first, then over the documents of the one bucket that is cut
    sums = keyed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("tokens").alias("n")).withColumn(
        "end", F.sum("n").over(W.partitionBy(*LEAF).orderBy("bucket")))
    cut_bucket = sums.filter("end >= rest AND end - n < rest").select(
        *LEAF, "bucket", (F.col("end") - F.col("n")).alias("before"))
    inside = keyed.join(cut_bucket, [*LEAF, "bucket"]).groupBy(*LEAF, "rest", "before", "key").agg(
        F.sum("tokens").alias("n"))
    start = F.col("before") + F.sum("n").over(W.partitionBy(*LEAF).orderBy("key")) - F.col("n")
    cuts = inside.withColumn("start", start).filter("start < rest").groupBy(*LEAF).agg(F.max("key").alias("cut"))
    return rows, saved(plan.join(cuts, LEAF, "left").select(*LEAF, "budget", "avail", "epoch", "cut"), "mix-cuts")


def chosen(rows: DataFrame, cuts: DataFrame, seed: int = 1) -> DataFrame:
    """Rows with the leaf's names joined to the cuts: adds ``copies``, how often the document is taken."""
    copies = F.col("epoch") + F.coalesce((_key(seed) <= F.col("cut")).cast("long"), F.lit(0))
    return rows.join(cuts, LEAF, "left").withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long"))


def mixed(
    docs: DataFrame, domain: Column, share: tuple[int, int], epochs: int,
    weights: Mapping[str, Mapping[str, int]], seed: int = 1,
) -> DataFrame:
    """One row per document: doc_id, domain, language, source_name, tokens, budget (of the leaf), copies.

    Rows that are not taken have 0 copies. A document without words takes no
    tokens and is taken if its place in the order lies before the cut. Rows with
    one id in one leaf are taken together. An empty table gives no rows; columns other than doc_id,
    text, lang, source and those of ``domain`` are not read.
    """
    rows, cuts = mixture(docs, domain, share, epochs, weights, seed)
    return chosen(rows, cuts, seed).select(
        "doc_id", *LEAF, "tokens", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"), "copies")
