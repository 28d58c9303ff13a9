"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own characters say so, each distinct chunk gets a
verified identifier, and two texts are equal when their ordered identifier
lists are. A chunk's text is moved once per map task that meets it, for the
verification; documents are compared by lists of eight-byte identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from harborlight.llm.common import SPACE, saved, whole

#: A chunk ends behind these three characters, after 96 characters at least and 4096 at most.
CUT = r"(?s).{96,4096}?(?<=[aeiost][dlmnrt][ aeimo])|.{1,4096}"


def normalised(text: str = "text") -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(whole(text), f"{SPACE}+", " ")


def chunks(text: Column) -> Column:
    """The pieces of a text, in order; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def exact_duplicates(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A chunk's identifier is its hash together with its rank among the distinct
    chunk texts of that hash, so two identifiers agree only if the texts do.
    Ranks other than the first exist only where hashes collide, which is
    looked for over all chunks; ``hash_bits`` makes them frequent in tests.

    Null texts are empty. Null ids count last: a group of null ids only has
    keep_id null, and its rows are kept. Rows that repeat the kept id and text
    are the kept document again and stay too. Other columns are not read.
    """
    texts = docs.select("doc_id", normalised().alias("t"))
    pieces = chunks(F.col("t"))
    recipes = saved(
        texts.select(
            "doc_id", F.sha2(F.col("t"), 256).alias("text_sha256"),
            F.transform(pieces, lambda c: _hash(c, hash_bits)).alias("recipe")),
        "recipes")
    each = texts.select(F.explode(pieces).alias("chunk")).select(
        _hash(F.col("chunk"), hash_bits).alias("h"), "chunk")
    known = each.groupBy("h", "chunk").agg(F.count("*").alias("n"))
    shared = saved(known.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"), "collided")
    # one number comes back; without collisions a hash is already a verified identifier
    if shared.count() == 0:
        recipes = recipes.withColumn("ranks", F.array().cast("array<struct<pos:int,k:int>>"))
    else:
        ranked = known.join(shared, "h").select(
            "h", "chunk", F.row_number().over(W.partitionBy("h").orderBy("chunk")).alias("k")).filter("k > 1")
        placed = texts.select(
            "doc_id", F.sha2(F.col("t"), 256).alias("text_sha256"), F.posexplode(pieces).alias("pos", "chunk"),
        ).withColumn("h", _hash(F.col("chunk"), hash_bits)).join(ranked, ["h", "chunk"])
        ranks = placed.groupBy(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_s")).agg(
            F.array_sort(F.collect_set(F.struct("pos", "k"))).alias("ranks"))
        recipes = recipes.join(
            ranks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_sha256") == F.col("_s")), "left",
        ).withColumn("ranks", F.coalesce("ranks", F.array().cast("array<struct<pos:int,k:int>>")))
    # written down, so that the join has a plain exchange on both sides and a group of many copies can be split
    groups = saved(recipes.groupBy("recipe", "ranks").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return recipes.join(groups, ["recipe", "ranks"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
