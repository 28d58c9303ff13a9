"""URL filter: rules first, then path templates judged by the purity of their labelled pages.

Each host has a tree of path segments. Level by level, from the root: branches whose share of bad labels differs from
their node's stay by themselves; of the others, those of a node whose
children look like values become a wildcard, and those of any other node are merged. What looks like values is decided by shape
and by pages for each value, not by number. What comes out is
a template for each page, such as ``/~/*``. Below a depth only nodes with labels of both kinds go on. A template is rejected when the share of
good ones among its labelled pages, smoothed towards the same template on all
hosts and that towards all labelled pages, is under one half.

Rules are settings and few; they are one expression, longest rule first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import saved

DEPTH = 8           # below this depth a node without labels of both kinds ends in one tail
FEW = 5             # a node with fewer children is a wildcard only if they hold digits; a branch of a wildcard needs so many labels to stay
Z2 = 4.0            # squared normal deviation up to which branches are alike
SMOOTH = 2.0        # labelled pages that a prior counts for
WILD, MERGED, TAIL = "*", "~", "**"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    """What stands between the first :// and the next slash, question mark or hash, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    """What follows the host up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null if none fits.

    A rule is (verdict, host/path). It fits its host and all subdomains if the path
    starts with the rule's. Of two with the same length the longer host wins, then the smaller text.
    """
    rule = verdict = F.lit(None).cast("string")
    split = [(v, text, text[:text.index("/")], text[text.index("/"):]) for v, text in rules]
    for v, text, h, p in sorted(split, key=lambda r: (-len(r[1]), -len(r[2]), r[1]), reverse=True):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame) -> DataFrame:
    """Distinct paths (host, path, bad: 1, 0 or null without a label, n: pages) with their ``template``."""
    rows = saved(paths.withColumn("segs", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn(
        "t", F.lit("")).withColumn("done", F.lit(False)), "urls")
    depth = 0
    while rows.filter((~F.col("done")) & (F.size("segs") > depth)).limit(1).count():
        here = rows.withColumn("seg", F.when(~F.col("done"), F.get("segs", F.lit(depth))))
        # partial sums first, so a host with most pages is spread out
        kids = saved(here.filter("seg IS NOT NULL").groupBy("host", "t", "seg").agg(
            F.sum("n").alias("pages"), F.sum(F.when(F.col("bad").isNotNull(), F.col("n")).otherwise(0)).alias("l"),
            F.sum(F.coalesce("bad", F.lit(0)) * F.col("n")).alias("b")), "kids")
        nodes = kids.groupBy("host", "t").agg(
            F.count("*").alias("kids"), F.sum("pages").alias("all_pages"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"),
            F.sum(F.when(F.rlike("seg", F.lit("[0-9]")), F.col("pages")).otherwise(0)).alias("digits"),
        ).withColumn("wild", F.expr(f"digits * 2 > all_pages OR (kids >= {FEW} AND kids * 2 > all_pages)"))
        gap = F.col("b") * F.col("all_l").cast("double") - F.col("l") * F.col("all_b").cast("double")
        differs = gap * gap > F.lit(Z2) * F.col("l") * F.col("all_b").cast("double") * (F.col("all_l") - F.col("all_b"))
        own = F.concat(F.lit("/"), "seg")
        step = F.when(F.col("wild"), F.when(differs & (F.col("l") >= FEW), own).otherwise(f"/{WILD}")).otherwise(
            F.when(differs | (F.col("all_l") == 0), own).otherwise(f"/{MERGED}"))
        ends = (F.col("all_b") == 0) | (F.col("all_b") == F.col("all_l")) if depth >= DEPTH else F.lit(False)
        # written down, so that the join below has plain exchanges and a host with most pages can be split
        plan = saved(kids.join(nodes, ["host", "t"]).select(
            "host", "t", "seg", F.when(ends, f"/{TAIL}").otherwise(step).alias("step"), ends.alias("ends")), "nodes")
        rows = saved(here.join(plan, ["host", "t", "seg"], "left").withColumn(
            "t", F.concat("t", F.coalesce("step", F.lit("")))).withColumn(
            "done", F.col("done") | F.coalesce("ends", F.lit(False))).select(rows.columns), "urls")
        depth += 1
    return rows.select("host", "path", "bad", "n", F.col("t").alias("template"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    Pages that a rule judges are the labelled ones; the verdict of all others is
    their template's: block if the smoothed purity is under one half, else
    allow. Without any label purity is one half and everything is allowed. A null
    url, or one without ://, has an empty host, path and template. Rows given twice count twice
    and come twice; columns other than page_id and url are not read.
    """
    rows = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn(
        "bad", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    rows = saved(rows, "pages")
    # equal urls have equal rules: the tree is that of the distinct ones
    paths = saved(templates(rows.groupBy("host", "path", "bad").agg(F.count("*").alias("n"))), "paths")
    labelled = F.col("bad").isNotNull().cast("long") * F.col("n")
    own = paths.groupBy("host", "template").agg(
        F.sum(labelled).alias("l"), F.sum(labelled - F.coalesce("bad", F.lit(0)) * F.col("n")).alias("good"))
    own = saved(own, "templates")
    shape = own.groupBy("template").agg(F.sum("l").alias("shape_l"), F.sum("good").alias("shape_good"))
    every = own.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("l"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")).first()
    base = (every.g + 1.0) / (every.l + 2.0)
    prior = (F.col("shape_good") + F.lit(SMOOTH * base)) / (F.col("shape_l") + F.lit(SMOOTH))
    purity = (F.col("good") + F.lit(SMOOTH) * prior) / (F.col("l") + F.lit(SMOOTH))
    judged_templates = own.join(shape, "template").select("host", "template", purity.alias("purity"))
    known = saved(paths.join(judged_templates, ["host", "template"]).select("host", "path", "template", "purity"), "judged")
    return rows.join(known, ["host", "path"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("purity") < 0.5, "block").otherwise("allow")).alias("verdict"),
        "template", "purity")
