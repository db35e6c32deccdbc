"""Groups of directly or indirectly matching records: deterministic Borůvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.skew import LEAST_HEAVY, counted_join, heavy_sketch, sketched_join, sketched_keys
from kinweave.session import cut, cut_counting, release

MAX_ROUNDS = 64


def _hook(edges: DataFrame) -> DataFrame:
    """(node, parent, _n): each node's partner on its smallest edge, edges being ordered by (smaller end, larger end); _n counts its edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    best = both.groupBy("u").agg(F.min(F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).alias("_e"), F.count("*").alias("_n"))
    return best.select(F.col("u").alias("node"), F.when(F.col("_e.a") == F.col("u"), F.col("_e.b")).otherwise(F.col("_e.a")).alias("parent"), "_n")


def _collapse(hooked: DataFrame, n_edges: int) -> tuple[DataFrame, list, int]:
    """(node, parent, _n, open) with every node's root as its parent, by pointer doubling; the heavy roots; the largest _n.

    Of two nodes hooked on each other the smaller is the root. open marks pointers that may not have come to a root yet.
    No more nodes hook on a parent than it has edges, which bounds the first join; for the next ones the heavy parents
    are observed while the tree is written.
    """
    above = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("up"), F.col("_n").alias("_most"))
    step = counted_join(hooked, above, ["parent"], "_most", 2 * n_edges)
    mutual = F.col("up") == F.col("node")
    measures = {"heavy": heavy_sketch("parent"), "open": F.count_if("open"), "most": F.max("_n")}
    tree, seen = cut_counting(step.select("node", F.when(mutual, F.least("node", "parent")).otherwise(F.col("parent")).alias("parent"), "_n", (~mutual).alias("open")), **measures)
    for _ in range(MAX_ROUNDS):
        heavy = sketched_keys(seen["heavy"])
        if not seen["open"]:
            return tree, heavy, seen["most"] or 0
        step = sketched_join(tree.drop("open"), tree.select(F.col("node").alias("parent"), F.col("parent").alias("up"), "open"), "parent", heavy)
        before, (tree, seen) = tree, cut_counting(step.select("node", F.col("up").alias("parent"), "_n", "open"), **measures)
        release(before)
    raise RuntimeError("trees did not collapse")


def link_groups(pairs: DataFrame, idx1: str = "idx1", idx2: str = "idx2") -> DataFrame:
    """(node, group_id) of every record that stands in a pair; group_id is the smallest record of the group.

    In each round every component hooks on its smallest outgoing edge, the trees collapse by pointer doubling, and
    edges are relabelled and deduplicated, until none remain: at least half the components vanish a round. Counts and
    minima are combined map-side and hub records meet their root by broadcast, so no neighbourhood or group is gathered. Rounds are cut
    in the shared checkpoint folder. Pairs may come in either order and repeatedly; a record paired with itself only
    is a group of its own; pairs with a null end are ignored. No pairs give no rows.
    """
    ends = pairs.select(F.col(idx1).alias("a"), F.col(idx2).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    loops = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    edges, seen = cut_counting(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), n=F.count("*"))
    levels: list[tuple[DataFrame, list]] = []
    for _ in range(MAX_ROUNDS):
        n_edges = seen["n"]
        if not n_edges:
            break
        roots, heavy, most = _collapse(_hook(edges), n_edges)
        levels.append((roots.select("node", F.col("parent").alias("root")), heavy))
        hubs = 2 * n_edges if most > LEAST_HEAVY else 0
        left = counted_join(edges, roots.select(F.col("node").alias("u"), F.col("parent").alias("_ru"), "_n"), ["u"], "_n", hubs).select("v", "_ru")
        both = counted_join(cut(left) if hubs else left, roots.select(F.col("node").alias("v"), F.col("parent").alias("_rv"), "_n"), ["v"], "_n", hubs)
        apart = both.where("_ru <> _rv").select(F.least("_ru", "_rv").alias("u"), F.greatest("_ru", "_rv").alias("v"))
        before, (edges, seen) = edges, cut_counting(apart.distinct(), n=F.count("*"))
        release(before)
    else:
        raise RuntimeError("edges remain")
    if not levels:
        return loops.select("node", F.col("node").alias("group_id"))
    # The tops of the upper levels are handed down; a root that is not in the level above is a top itself.
    found, heavy = levels[-1]
    for lower, heavy in reversed(levels[:-1]):
        tops = found.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        found, seen = cut_counting(sketched_join(lower, tops, "root", heavy, "left").select("node", F.coalesce("_top", "root").alias("root")), heavy=heavy_sketch("root"))
        heavy = sketched_keys(seen["heavy"])
    heads = found.groupBy("root").agg(F.min("node").alias("group_id"))
    linked = sketched_join(found, cut(heads) if heavy else heads, "root", heavy).select("node", "group_id")
    alone = loops.join(linked, "node", "left_anti").select("node", F.col("node").alias("group_id"))
    return linked.unionByName(alone)
