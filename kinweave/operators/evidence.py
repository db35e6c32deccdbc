"""Pair evidence from several columns, edge rules, and links that must or must not be."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_evidence(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Full outer merge of (idx1, idx2, similarity) frames into idx1, idx2, <name>_similarity ..., missing ones 0.

    One shuffle whatever the number of frames. A pair given twice keeps its best score; idx1 and idx2 are put in order.
    """
    if not frames:
        raise ValueError("no column is configured")
    parts = [f.select(F.least("idx1", "idx2").alias("idx1"), F.greatest("idx1", "idx2").alias("idx2"), F.lit(k).alias("_k"), F.col("similarity").cast("double").alias("_s")) for k, f in frames.items()]
    scores = [F.coalesce(F.max(F.when(F.col("_k") == k, F.col("_s"))), F.lit(0.0)).alias(f"{k}_similarity") for k in frames]
    return reduce(DataFrame.unionByName, parts).groupBy("idx1", "idx2").agg(*scores)


def edge_rule(thresholds: Mapping[str, float], conditional: str = "OR", strict: bool = False) -> Column:
    """True where all (AND) or any (OR) of the columns' scores reach their thresholds; a null score counts as 0."""
    if conditional not in ("AND", "OR"):
        raise ValueError(f"conditional must be AND or OR, not {conditional}")
    tests = []
    for name, t in thresholds.items():
        score = F.coalesce(F.nanvl(F.col(f"{name}_similarity").cast("double"), F.lit(0.0)), F.lit(0.0))
        tests.append(score > t if strict else score >= t)
    return reduce((lambda a, b: a & b) if conditional == "AND" else (lambda a, b: a | b), tests)


def edges_of(evidence: DataFrame, rule: Column) -> DataFrame:
    """Distinct (src, dst), src < dst, of the evidence rows that pass the rule; pairs of a row with itself are left out."""
    ordered = evidence.where(rule & (F.col("idx1") != F.col("idx2")))
    return ordered.select(F.least("idx1", "idx2").alias("src"), F.greatest("idx1", "idx2").alias("dst")).distinct()


def resolve_ids(rows: DataFrame, row_id: str, business_id: str, constraints: DataFrame) -> DataFrame:
    """(src, dst, match, id1, id2) of constraints (id1, id2, match) in row ids: ids are compared as text, the first row of an id counts.

    A constraint with an unknown id keeps null src or dst, which `unknown_ids` reports.
    """
    first = rows.groupBy(F.col(business_id).cast("string").alias("_key")).agg(F.min(row_id).alias("_row"))
    a = first.select(F.col("_key").alias("_k1"), F.col("_row").alias("_r1"))
    b = first.select(F.col("_key").alias("_k2"), F.col("_row").alias("_r2"))
    c = constraints.select(F.col("id1").cast("string").alias("_k1"), F.col("id2").cast("string").alias("_k2"), "match", "id1", "id2")
    joined = c.join(a, "_k1", "left").join(b, "_k2", "left")
    return joined.select(F.least("_r1", "_r2").alias("src"), F.greatest("_r1", "_r2").alias("dst"), "match", "id1", "id2", F.col("_r1").isNull().alias("_no1"), F.col("_r2").isNull().alias("_no2"))


def unknown_ids(resolved: DataFrame) -> DataFrame:
    no1 = resolved.where("_no1").select(F.col("id1").cast("string").alias("id"))
    return no1.unionByName(resolved.where("_no2").select(F.col("id2").cast("string").alias("id"))).distinct()


def constrain(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Take out the direct edges that must not be, then add those that must; the latter win."""
    known = resolved.where(~F.col("_no1") & ~F.col("_no2") & (F.col("src") != F.col("dst")))
    kept = edges.join(known.where(~F.col("match")).select("src", "dst"), ["src", "dst"], "left_anti")
    return kept.unionByName(known.where("match").select("src", "dst")).distinct()
