"""The plant-port network: graph tables, degrees, betweenness, cascade risk."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.functions.numeric import round_to
from harborlight.operators.latest import top_per_key
from harborlight.session import checkpoint_root


def edges(plant_ports: DataFrame) -> DataFrame:
    complete = plant_ports.filter((F.col("plant_code") != "") & (F.col("port") != ""))
    return complete.select(
        F.concat(F.lit("plant:"), "plant_code").alias("source"),
        F.concat(F.lit("port:"), "port").alias("target"),
    ).distinct()


def nodes(edge_list: DataFrame) -> DataFrame:
    """The ends of all edges; the text before the colon is the node's type."""
    ids = edge_list.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ids.select(
        "id",
        F.substring_index("id", ":", 1).alias("type"),
        F.regexp_replace("id", "^[^:]*:", "").alias("label"),
    )


def plant_products(node_list: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """Plant nodes with their first k products by name."""
    first = top_per_key(products.distinct(), ["plant_code"], [F.col("product_id").asc()], k)
    lists = first.groupBy("plant_code").agg(
        F.array_join(F.array_sort(F.collect_list("product_id")), ",").alias("products"),
        F.count("*").alias("listed"))
    return node_list.filter(F.col("type") == "plant").join(
        lists, F.col("label") == F.col("plant_code"), "left"
    ).select("id", "label", F.coalesce("products", F.lit("")).alias("products"),
             F.coalesce("listed", F.lit(0)).alias("listed"))


def degrees(edge_list: DataFrame) -> DataFrame:
    """In- and out-degree of every node, from one pass over the edges."""
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("target").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )
    return edge_list.select(F.inline(ends)).groupBy("id").agg(
        F.sum("in").alias("in_degree"), F.sum("out").alias("out_degree"))


def degree_risk(edge_list: DataFrame) -> DataFrame:
    """Degree centrality, and the in-degree as risk where paths are not looked at."""
    checkpoint_root(edge_list.sparkSession)
    deg = degrees(edge_list).checkpoint()
    n, m = deg.agg(F.count("*")).scalar(), deg.agg(F.sum("in_degree")).scalar()
    return deg.select(
        "id", "in_degree", "out_degree",
        round_to((F.col("in_degree") + F.col("out_degree")).cast("double") / F.greatest(n - 1, F.lit(1)), 4)
        .alias("degree"),
        F.col("in_degree").cast("double").alias("cascade_fallback"),
        round_to(F.try_divide(m.cast("double"), (n * (n - 1)).cast("double")), 6).alias("density"),
    )


EXACT_NODES = 2000   # larger graphs are walked from pivots
ERROR, RISK = 0.05, 0.01


def pivot_count(nodes: int, error: float = ERROR, risk: float = RISK) -> int:
    """Sources after which every node's betweenness is within ``error`` with probability 1 - ``risk``.

    A source adds a number between 0 and n / (n - 1) to each node's mean; Hoeffding's bound for one node, times n nodes.
    """
    if nodes < 3:
        return nodes
    return min(nodes, math.ceil(math.log(2 * nodes / risk) / (2 * error * error) * (nodes / (nodes - 1)) ** 2))


def pivots(edge_list: DataFrame, k: int) -> DataFrame:
    """The k nodes with the smallest hash of their id."""
    ids = edge_list.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ids.orderBy(F.md5("id"), "id").limit(k)


def sampled_betweenness(edge_list: DataFrame, error: float = ERROR, risk: float = RISK) -> DataFrame:
    """Betweenness within ``error`` of the exact one, for all nodes at once with probability 1 - ``risk``.

    Paths are walked from as many sources as the bound asks for, which grows with the logarithm of the nodes only. Once the
    bound asks for all of them the result is exact.
    """
    checkpoint_root(edge_list.sparkSession)
    nodes_in = edge_list.select(F.explode(F.array("source", "target")).alias("id")).distinct().count()
    k = pivot_count(nodes_in, error, risk)
    if k >= nodes_in:
        return betweenness(edge_list)
    return betweenness(edge_list, pivots(edge_list, k).checkpoint(), nodes_in / k)


def betweenness(edge_list: DataFrame, sources: DataFrame | None = None, scale_by: float = 1.0) -> DataFrame:
    """Share of shortest paths through each node, normalised, directed.

    ``sources`` (id) are the nodes to walk from, all without it; their sums count ``scale_by`` times. All sources advance one step per round: a round is one join of the frontier
    (source, node, path count) with the edges and one aggregate, so its size is
    what counts, not the number of rounds. Going back, each node hands its share
    to the nodes before it. Rounds are checkpointed; the walk ends when no node
    is new, after as many rounds as the longest shortest path has steps.
    """
    spark = edge_list.sparkSession
    checkpoint_root(spark)
    links = edge_list.select(F.col("source").alias("u"), F.col("target").alias("v")).distinct()
    links = links.filter(F.col("u") != F.col("v")).checkpoint()
    ids = links.select(F.explode(F.array("u", "v")).alias("id")).distinct()

    first = links if sources is None else links.join(sources.select(F.col("id").alias("u")), "u", "left_semi")
    frontier = first.select(F.col("u").alias("s"), F.col("v").alias("node")).withColumn(
        "paths", F.lit(1.0))
    seen = frontier.select("s", "node").unionByName(
        first.select(F.col("u").alias("s"), F.col("u").alias("node")).distinct())
    levels = [frontier.checkpoint()]
    while True:
        ahead = (
            levels[-1].join(links, F.col("node") == F.col("u"))
            .groupBy("s", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
            .join(seen, ["s", "node"], "left_anti")
            .checkpoint()
        )
        if ahead.isEmpty():
            break
        levels.append(ahead)
        seen = seen.unionByName(ahead.select("s", "node")).checkpoint()

    # from the farthest level back: share(node) = sum over next of paths/paths_next * (1 + share_next)
    total = None
    share = levels[-1].withColumn("share", F.lit(0.0))
    for level in reversed(levels[:-1]):
        handed = (
            share.select("s", F.col("node").alias("v"), (F.lit(1.0) + F.col("share")).alias("_give"),
                         F.col("paths").alias("_paths"))
            .join(links, "v")
            .join(level.select("s", F.col("node").alias("u"), "paths"), ["s", "u"])
            .groupBy("s", F.col("u").alias("node"))
            .agg(F.sum(F.col("paths") / F.col("_paths") * F.col("_give")).alias("share"))
        )
        share = level.join(handed, ["s", "node"], "left").fillna(0.0, ["share"]).checkpoint()
        part = share.groupBy("node").agg(F.sum("share").alias("share"))
        total = part if total is None else total.unionByName(part)

    n = ids.agg(F.count("*")).scalar().cast("double")
    scale = (n - 1) * (n - 2)
    if total is None:
        return ids.withColumn("betweenness", F.lit(0.0))
    sums = total.groupBy(F.col("node").alias("id")).agg(F.sum("share").alias("share"))
    return ids.join(sums, "id", "left").select(
        "id", F.coalesce(F.try_divide(F.coalesce("share", F.lit(0.0)) * F.lit(scale_by), scale), F.lit(0.0)).alias("betweenness"))


def cascade_risk(edge_list: DataFrame, exact_nodes: int = EXACT_NODES) -> DataFrame:
    """Betweenness times in-degree per node; from pivots where there are more than ``exact_nodes`` nodes."""
    checkpoint_root(edge_list.sparkSession)
    deg = degree_risk(edge_list).select("id", "in_degree", "degree").checkpoint()
    between = betweenness(edge_list) if deg.count() <= exact_nodes else sampled_betweenness(edge_list)
    return between.join(deg, "id").select(
        "id",
        round_to("betweenness", 4).alias("betweenness"),
        "degree",
        round_to(F.col("betweenness") * F.col("in_degree"), 4).alias("cascade_risk"),
    )
