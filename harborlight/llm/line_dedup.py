"""Repeated runs of lines, by winnowing.

Lines are hashed; a gram is the shortest stretch of lines from a line on that
holds ``gram_words`` words. In each stretch of ``reach`` words the gram with the
smallest hash is the fingerprint. A run that two places share and that holds
``run_words = gram_words + reach - 1`` words or more contains one stretch and
its grams whole, so both places select the same fingerprint.

Fingerprints are joined on their hash. Around the shared ones the match is
extended to both sides, line by line: the shortest stretches of ``run_words``
words from a line on and up to a line, as far as they hold a shared
fingerprint, are compared with the first place where the same stretch stands.
Their union is the whole repeated run. A stretch is compared with one place, so
work grows with the lines and never with pairs of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborlight.llm.common import SPACE, saved

GRAM_WORDS, REACH = 25, 26

_DOC = ["no_id", "id", "body"]


def _identity() -> list[Column]:
    """Order of documents: by id, null ids last, then by text hash."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"),
            F.xxhash64("text").alias("body")]


def _both(column: Column) -> Column:
    """A 128-bit key."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit("other"), column).alias("b"))


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line with words: document, place, hash, words before it and up to its end."""
    rows = docs.filter(F.col("text").isNotNull()).select(
        *_identity(), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select(
        *_DOC, "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("other"), "line").alias("b"),
        F.regexp_count("line", F.lit(SPACE.replace("[", "[^") + "+")).cast("long").alias("words"),
    ).filter("words > 0")
    # a document given twice is one document; the same exchange serves the window below
    rows = rows.repartition(*_DOC).dropDuplicates([*_DOC, "pos"])
    end = F.sum("words").over(W.partitionBy(*_DOC).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("words"))


def _forward(words: int):
    return W.partitionBy(*_DOC).orderBy("start").rangeBetween(0, words - 1)


def _backward(words: int):
    return W.partitionBy(*_DOC).orderBy("end").rangeBetween(-(words - 1), 0)


def _stretch(frame, words: int) -> list[Column]:
    """Key and places of the shortest stretch with so many words; key null if the document has too few."""
    lines = F.collect_list(F.struct("a", "b")).over(frame)
    return [F.when(F.sum("words").over(frame) >= words, _both(lines)).alias("key"),
            F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last")]


def repeated_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, reach: int = REACH) -> DataFrame:
    """Runs of lines to delete: no_id, id, body (the document), from, to (line numbers, from 0).

    A line goes if it lies in a stretch of lines with ``gram_words + reach - 1``
    words that stands earlier too: in a document before (by id, then text hash) or
    higher up in the same one without overlap.
    """
    run_words = gram_words + reach - 1
    lines = saved(lines_of(docs), "lines")
    grams = lines.select(*_DOC, "pos", "start", *_stretch(_forward(gram_words), gram_words)).filter("key IS NOT NULL")
    least = F.min(F.struct("key", F.negative("pos").alias("p"), "last")).over(_forward(reach))
    chosen = grams.select(*_DOC, least.alias("m")).select(
        *_DOC, F.negative("m.p").alias("pos"), "m.key", F.col("m.last").alias("gram_last")).distinct()
    chosen = saved(chosen, "fingerprints")
    # keys are written down, so that the joins have plain exchanges on both sides and a frequent key can be split
    often = saved(chosen.groupBy("key").agg(F.count("*").alias("places")).filter("places > 1").select("key"), "shared")
    shared = chosen.join(often, "key").select(*_DOC, "pos", "gram_last")
    marked = lines.join(shared, [*_DOC, "pos"], "left")

    def near(frame) -> DataFrame:
        gram_end = F.min("gram_last").over(frame)
        return marked.select(*_DOC, *_stretch(frame, run_words), gram_end.alias("gram_end")).filter(
            "key IS NOT NULL AND gram_end <= last").drop("gram_end")

    spans = saved(near(_forward(run_words)).unionByName(near(_backward(run_words))), "stretches")
    here = F.struct(*_DOC, "first", "last")
    origin = spans.groupBy("key").agg(F.min(here).alias("o"), F.count("*").alias("places")).filter("places > 1")
    origin = saved(origin.select("key", "o"), "origins")
    doc, at = F.struct(*_DOC), F.struct("o.no_id", "o.id", "o.body")
    later = spans.join(origin, "key").filter(
        (doc > at) | ((doc == at) & (F.col("first") > F.col("o.last"))))
    # overlapping and adjoining stretches become one run
    ordered = W.partitionBy(*_DOC).orderBy("first", "last")
    reached = F.max("last").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("first") > reached + 1).cast("int"), F.lit(1))
    runs = later.select(*_DOC, "first", "last").withColumn("fresh", fresh).withColumn(
        "run", F.sum("fresh").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*_DOC, "run").agg(F.min("first").alias("from"), F.max("last").alias("to")).drop("run")


def without_repeats(docs: DataFrame, gram_words: int = GRAM_WORDS, reach: int = REACH) -> DataFrame:
    """The documents with later repeated runs of lines taken out of ``text``, and how many lines that were.

    All columns stay; ``lines_total`` and ``lines_removed`` come behind them (columns
    of these names are replaced). Blank lines inside a run go with it, other blank
    lines stay. A null text stays null with 0 lines, an empty one has one line. Null
    ids count after all others. A row given twice is one document: both copies get
    the same result.
    """
    runs = repeated_runs(docs, gram_words, reach).groupBy(*_DOC).agg(
        F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    runs = runs.select(*[F.col(c).alias(f"_{c}") for c in _DOC], F.col("runs").alias("_runs"))
    no_id, ident, body = _identity()
    keep = [c for c in docs.columns if c not in ("lines_total", "lines_removed")]
    joined = docs.select(*[F.col(f"`{c}`") for c in keep]).join(
        runs, (no_id == F.col("_no_id")) & (ident == F.col("_id")) & (body == F.col("_body")), "left")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda line, i: ~F.exists("_runs", lambda r: (i >= r["from"]) & (i <= r["to"])))
    total = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    cut = F.col("_runs").isNotNull()
    removed = F.when(cut, F.aggregate("_runs", F.lit(0), lambda n, r: n + r["to"] - r["from"] + 1)).otherwise(0)
    text = F.when(cut, F.array_join(left, "\n")).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in keep]
    return joined.select(
        *columns, F.when(F.col("text").isNull(), 0).otherwise(total).cast("long").alias("lines_total"),
        removed.cast("long").alias("lines_removed"))
