"""Connected components, their numbering, and density clustering."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import hover_text
from kinweave.operators.numbering import dense_number
from kinweave.operators.skew import counted_join
from kinweave.session import cut, cut_counting, release

MAX_ROUNDS = 100


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge, root being the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014). Neighbour minima are aggregated map-side
    and joined back with hub nodes salted, so no neighbourhood is ever gathered. Self-loops add their node.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    state = {"n": F.count("*"), "sum": F.bit_xor(F.xxhash64("u", "v"))}
    e, now = cut_counting(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), **state)
    seen = None
    for _ in range(MAX_ROUNDS):
        if now == seen or not now["n"]:
            break
        seen = now
        large = cut(_large_star(e, now["n"]))
        before, (e, now) = e, cut_counting(_small_star(large, seen["n"]), **state)
        release(before, large)
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    alone = loops.join(stars.unionByName(roots), "node", "left_anti").select("node", F.col("node").alias("root"))
    return stars.unionByName(roots).unionByName(alone)


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
    return counted_join(both.where("v > u"), low, ["u"], "_n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    others = counted_join(e, low, ["u"], "_n", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def number_components(components: DataFrame) -> DataFrame:
    """(node, cluster_label): components numbered 0.. by their smallest node."""
    sizes, seen = cut_counting(components.groupBy("root").agg(F.count("*").alias("_n")), n=F.sum("_n"))
    labels = dense_number(sizes, ["root"], "cluster_label")
    total = seen["n"] or 0
    return counted_join(components, labels, ["root"], "_n", total).select("node", "cluster_label")


def label_rows(rows: DataFrame, row_id: str, labels: DataFrame, singletons: bool = True) -> DataFrame:
    """rows with cluster_label; rows without a link get max + 1, max + 2, ... in row order, or null."""
    if "cluster_label" in rows.columns:
        rows = rows.drop("cluster_label")
    named = labels.select(F.col("node").alias(row_id), "cluster_label")
    if not singletons:
        return rows.join(named, row_id, "left")
    top = labels.agg(F.max("cluster_label")).first()[0]
    alone = dense_number(rows.select(row_id).join(named, row_id, "left_anti"), [row_id], "cluster_label", -1 if top is None else top)
    alone = alone.withColumn("cluster_label", F.col("cluster_label") + 1)
    return rows.join(named.unionByName(alone.select(row_id, "cluster_label")), row_id)


def cluster_subgraph(rows: DataFrame, row_id: str, edges: DataFrame, label: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one cluster of labelled rows, for drawing elsewhere."""
    nodes = rows.where(F.col("cluster_label") == label)
    ids = nodes.select(F.col(row_id).alias("src"))
    return nodes, edges.join(ids, "src", "left_semi")


def cluster_layout(rows: DataFrame, row_id: str, edges: DataFrame, label: int, hover: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes (row id, x, y, text) and edges (src, dst, x0, y0, x1, y1) of one cluster, laid out on a circle in row order, for any plotter."""
    nodes, links = cluster_subgraph(rows, row_id, edges, label)
    placed_nodes = cut(dense_number(nodes, [row_id], "_i"))
    turn = F.col("_i") * F.lit(2 * math.pi / max(1, placed_nodes.count()))
    drawn = placed_nodes.select(row_id, F.cos(turn).alias("x"), F.sin(turn).alias("y"), hover_text(row_id, hover).alias("text"))
    at = lambda end, k: drawn.select(F.col(row_id).alias(end), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    return drawn, links.join(at("src", 0), "src").join(at("dst", 1), "dst").select("src", "dst", "x0", "y0", "x1", "y1")


def dbscan(rows: DataFrame, row_id: str, pairs: DataFrame, eps: float, min_samples: int, weight: str | None = None) -> DataFrame:
    """(row_id, cluster_id) by density over distances max(1 - similarity, 0); noise is -1.

    pairs must hold every pair with similarity above 0; other pairs are at distance 1, so eps must be below 1. A row
    is a core if it and its neighbours number min_samples or more; clusters are the components of cores, and a
    border row joins the neighbouring cluster with the smallest number. Where rows are classes of equal rows, the
    column weight holds their sizes, which count in the core test.
    """
    if eps >= 1:
        raise ValueError("eps must be below 1: unlisted pairs are at distance 1")
    near = pairs.where(F.greatest(1 - F.col("similarity"), F.lit(0.0)) <= eps + 1e-9).select(F.col("idx1").alias("src"), F.col("idx2").alias("dst"))
    both = cut(near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    ids = cut(rows.select(F.col(row_id).alias("src"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")))
    degrees, seen = cut_counting(both.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("_d")), n=F.sum("_d"))
    sized = ids.withColumnRenamed("src", "dst").join(degrees, "dst")
    beside = counted_join(both, sized, ["dst"], "_d", seen["n"] or 0).groupBy("src").agg(F.sum("_w").alias("_near"))
    degree = ids.join(beside, "src", "left").select("src", (F.col("_w") + F.coalesce("_near", F.lit(0))).alias("_n"))
    cores = cut(degree.where(F.col("_n") >= min_samples).select("src"))
    dense = cut(degrees.join(cores.withColumnRenamed("src", "dst"), "dst"))  # cores with a neighbour
    inner = counted_join(both, dense, ["dst"], "_d", seen["n"] or 0).select("dst", "src")
    core_edges = counted_join(inner.where("src < dst"), dense.select(F.col("dst").alias("src"), "_d"), ["src"], "_d", seen["n"] or 0).select("src", "dst")
    alone = cores.select("src", F.col("src").alias("dst"))
    labels = cut(number_components(connected_components(core_edges.select("src", "dst").unionByName(alone))))
    sized_labels = labels.withColumnRenamed("node", "dst").join(degrees, "dst")
    border = counted_join(both, sized_labels, ["dst"], "_d", seen["n"] or 0).join(cores, "src", "left_anti").groupBy("src").agg(F.min("cluster_label").alias("cluster_label"))
    found = labels.select(F.col("node").alias(row_id), "cluster_label").unionByName(border.select(F.col("src").alias(row_id), "cluster_label"))
    return rows.join(found, row_id, "left").withColumn("cluster_id", F.coalesce("cluster_label", F.lit(-1)).cast("long")).drop("cluster_label")
