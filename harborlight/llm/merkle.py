"""Merkle manifest of a dataset, by slot pivots.

Rows are leaves. The leaves of a source, in order of doc_id, are cut into runs of
``FANOUT``; conditional aggregates spread a run over one column for each slot, and the
hash of the columns one after another is the parent. Levels are built until one node is
left, the source's subroot; the subroots are joined in the same way into the root.

Going down again, a child's siblings are the columns of its parent without its own slot.
What stands left and right of the child on each level is its path: it proves the leaf,
and folding a leaf along it gives a root to compare with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from harborlight.llm.common import parallelism, saved
from harborlight.llm.language_id import fold

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What stands left and right of a node on its own level and on each one above.
PATH = "array<struct<left:string,right:string>>"


def digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs one after another; null ones are left out."""
    return F.sha2(F.concat_ws("", *inputs), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: each value behind its length in bytes, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return digest(*(
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``idx``, their number within ``place`` from 0 on, and ``n``, the rows of the place.

    The table is cut into ranges of (place, order), so a place with most rows lies in many of
    them; each range adds what the ranges before it hold of the place. Ties beyond ``order`` are numbered as they come.
    """
    keys = ["place", *order]
    ranged = saved(
        rows.repartitionByRange(parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys)
        .withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33)), "ranged")
    runs = ranged.groupBy("place", "range").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    place = W.partitionBy("place")  # one row for each range that holds some of the place
    before = F.sum("size").over(place.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = saved(runs.select(
        "place", "range", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(place).alias("n")), "starts")
    return ranged.join(starts, ["place", "range"]).withColumn(
        "idx", F.col("before") + F.col("at") - F.col("first")).drop("at", "range", "first", "before")


def parents(nodes: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """The level above: place, idx, n, node and one column c0, c1, ... for each slot.

    A slot holds its child as (node, carried columns) and is null behind the end of a last run. Nodes
    that are the only ones of their place are left out.
    """
    child = F.struct("node", *carried)
    slots = [F.max(F.when(F.col("idx") % fanout == k, child)).alias(f"c{k}") for k in range(fanout)]
    spread = nodes.filter("n > 1").groupBy(
        "place", F.expr(f"idx div {fanout}").alias("up"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")).agg(*slots)
    return spread.withColumnRenamed("up", "idx").withColumn(
        "node", digest(*(F.col(f"c{k}.node") for k in range(fanout))))


def levels(nodes: DataFrame, carried: list[str], fanout: int) -> list[DataFrame]:
    """All levels above the nodes, each written down; a level has a sixteenth of the rows of the one below."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out: list[DataFrame] = []
    while most > 1:
        nodes = saved(parents(nodes, carried if not out else [], fanout), f"level-{len(out) + 1}")
        out.append(nodes)
        most = -(-most // fanout)
    return out


def subroots(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(place, node): the last node left of each place."""
    out = nodes.filter("n = 1").select("place", "node")
    for level in above:
        out = out.unionByName(level.filter("n = 1").select("place", "node"))
    return out


def children(level: DataFrame, kept: list[str], fanout: int) -> DataFrame:
    """The nodes below a level whose rows have a path: place, idx, child (node, carried columns), kept columns, path."""
    slots = F.array(*(F.col(f"c{k}") for k in range(fanout)))
    rows = level.select("place", "idx", "path", *kept, slots.alias("slots"), F.posexplode(slots).alias("slot", "child")).filter(
        "child IS NOT NULL")
    side = lambda part: F.array_join(F.transform(part, lambda c: c["node"]), "")
    own = F.struct(
        side(F.slice("slots", F.lit(1), F.col("slot"))).alias("left"),
        side(F.slice("slots", F.col("slot") + 2, F.lit(fanout))).alias("right"))
    return rows.select(
        "place", (F.col("idx") * fanout + F.col("slot")).alias("idx"), "child", *kept,
        F.concat(F.array(own), "path").alias("path"))


def descend(above: list[DataFrame], tops: DataFrame, kept: list[str], fanout: int) -> DataFrame | None:
    """Paths of all nodes below the levels; None without any level.

    ``tops`` (place, kept columns, path) is what is known of each place's last node.
    """
    below = None
    for level in reversed(above):
        known = level.filter("n = 1").join(tops, "place")
        if below is not None:
            rest = level.filter("n > 1").join(below.select("place", "idx", *kept, "path"), ["place", "idx"])
            known = known.unionByName(rest.select(known.columns))
        below = children(known, kept, fanout)
    return below


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, x: digest(x["left"], node, x["right"]))


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are made of doc_id, source, lang, n_chars and text, null or not; the documents of a source stand in the
    order of doc_id (null first, equal ids by leaf), the sources in the order of their bytes (null first).
    ``proof_sha256`` is the digest of all siblings on the way up. For documents for which ``tampered`` is
    true, the fold starts from the leaf with A-Z of the text in lower case. A text of any
    length is read once for its leaf and nothing but digests moves after that. Rows given twice are two leaves; an empty
    table has no rows; other columns are not read.
    """
    values = [F.col(c) for c in FIELDS]
    changed = leaf(*values[:-1], F.translate(F.col("text"), UPPER, LOWER))
    # the place is empty for null, and sorts as the source does
    rows = saved(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("place"),
        leaf(*values).alias("node"), F.when(F.lit(False) if tampered is None else tampered, changed).alias("changed")), "leaves")
    nodes = numbered(rows, "doc_id", "node")
    above = levels(nodes, ["doc_id", "changed"], fanout)

    tops = numbered(subroots(nodes, above).select(F.lit("").alias("place"), F.col("place").alias("of"), "node"), "of")
    top_above = levels(tops, ["of"], fanout)
    last = subroots(tops, top_above).select("node").first()
    root = last["node"] if last else None  # one digest comes to the driver

    start = rows.sparkSession.createDataFrame([("",)], "place string").withColumn("path", F.array().cast(PATH))
    known = descend(top_above, start, [], fanout)
    if known is None:  # one source or none: its subroot is the root
        known = tops.select(F.col("of").alias("place"), F.col("node").alias("subroot"), F.array().cast(PATH).alias("path"))
    else:
        known = known.select(F.col("child.of").alias("place"), F.col("child.node").alias("subroot"), "path")
    known = saved(known, "subroots")

    alone = nodes.filter("n = 1").join(known, "place").select("doc_id", "node", "changed", "subroot", "path")
    below = descend(above, known, ["subroot"], fanout)
    if below is not None:
        alone = alone.unionByName(below.select("child.doc_id", "child.node", "child.changed", "subroot", "path"))
    siblings = F.transform("path", lambda x: F.concat(x["left"], x["right"]))
    return alone.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        digest(F.array_join(siblings, "")).alias("proof_sha256"),
        folded(F.coalesce("changed", "node"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_fold(folds: int = 5) -> Column:
    """True for rows whose crc32 of the id as text is divisible by ``folds``; false for null ids."""
    return F.coalesce(fold(folds) == 0, F.lit(False))
