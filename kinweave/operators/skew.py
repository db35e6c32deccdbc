"""Joins and per-key results where a few keys hold most rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.numbering import placed

HEAVY_SHARE = 0.001
LEAST_HEAVY = 1_000  # rows of one key that a task takes in its stride
TRACKED = 10_000  # keys of the sketch that finds heavy ones: its error is below a quarter of HEAVY_SHARE


def heavy_sketch(key: str) -> Column:
    """For cut_counting: the keys that can hold HEAVY_SHARE of the rows, at most 1 / HEAVY_SHARE of them, found without a pass of their own."""
    return F.expr(f"approx_top_k(`{key}`, {int(1 / HEAVY_SHARE)}, {TRACKED})")


def sketched_keys(sketch: list, least: int = LEAST_HEAVY) -> list:
    return [r["item"] for r in sketch or [] if r["item"] is not None and r["count"] > least]


def sketched_join(left: DataFrame, right: DataFrame, key: str, heavy: list, how: str = "inner") -> DataFrame:
    """Inner or left join with right, one narrow row per key; left's rows of the heavy keys meet theirs by broadcast and
    are not shuffled, whatever share they hold. heavy comes from a heavy_sketch of left. left is read twice."""
    if not heavy:
        return left.join(right, key, how)
    few = F.col(key).isin(heavy)
    return left.where(few).join(F.broadcast(right.where(few)), key, how).unionByName(left.where(~few | F.col(key).isNull()).join(right.where(~few), key, how))


def counted_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, total: int, share: float = HEAVY_SHARE, least: int = LEAST_HEAVY) -> DataFrame:
    """Inner join with right, one narrow row per key, whose `weight` bounds the number of left's rows per key.

    The weights add up to total, so that at most 1 / share keys are heavy; these are broadcast, and left's rows of them
    are not shuffled at all, whatever share they hold. left is read twice.
    """
    limit = max(least, int(total * share), 1)
    if total <= limit:
        return left.join(right, list(on))
    heavy = F.col(weight) > limit
    few = F.broadcast(right.where(heavy))
    rest = left.join(F.broadcast(right.where(heavy).select(*on)), list(on), "left_anti").join(right.where(~heavy), list(on))
    return left.join(few, list(on)).unionByName(rest)


def heavy_counts(df: DataFrame, on: Sequence[str], total: int, share: float = HEAVY_SHARE, least: int = LEAST_HEAVY) -> list:
    """The keys of df with more than max(least, share of total) rows, each with its count: at most 1 / share of them."""
    limit = max(least, int(total * share), 1)
    if total <= limit:
        return []
    return df.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).collect()


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], heavy: list, total: int, how: str = "inner", share: float = HEAVY_SHARE, least: int = LEAST_HEAVY) -> DataFrame:
    """Join left with right, which has one row per key; keys in heavy (rows of key and count) are salted.

    A heavy key is spread over as many salts as it holds shares of left's rows, and its right row is repeated for
    each. The list is bounded (see heavy_counts) and broadcast. Null keys never match; a left join spreads them.
    """
    limit = max(least, int(total * share), 1)
    if how == "inner" and not heavy:
        return left.join(right, list(on))
    no_key = reduce(lambda a, b: a | b, [left[c].isNull() for c in on])
    spread = F.xxhash64(*[left[c] for c in left.columns])
    if not heavy:
        salted = left.withColumn("_salt", F.when(no_key, F.pmod(spread, F.lit(1 << 16))).otherwise(0).cast("int"))
        return salted.join(right.withColumn("_salt", F.lit(0)), [*on, "_salt"], how).drop("_salt")
    types = ", ".join(f"`{c}` {right.schema[c].dataType.simpleString()}" for c in on)
    salts = F.broadcast(left.sparkSession.createDataFrame([(*r[:-1], math.ceil(r[-1] / limit)) for r in heavy], f"{types}, _salts int"))
    here = F.when(no_key, F.lit(1 << 16)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = left.join(salts, list(on), "left").withColumn("_salt", F.pmod(spread, here).cast("int")).drop("_salts")
    copies = right.join(salts, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, total: int, how: str = "inner", share: float = HEAVY_SHARE, least: int = LEAST_HEAVY) -> DataFrame:
    """spread_join where right's `weight` column holds the number of left's rows per key, which add up to total.

    The heavy keys are read off right, so that should be cut. Where no key can be heavy, nothing is looked up.
    """
    limit = max(least, int(total * share), 1)
    heavy = right.where(F.col(weight) > limit).select(*on, weight).collect() if total > limit else []
    return spread_join(left, right, on, heavy, total, how, share, least)


def key_chunks(df: DataFrame, key: str, order_by: Sequence[str] = (), chunk_rows: int = 100_000) -> DataFrame:
    """Exact offset chunking: each row's position within its key and the equal-sized chunk it falls into.

    The rows of each key are counted per input partition; prefix sums of these counts over the partitions give the
    offset at which a partition continues a key, and the place within (partition, key) completes the row number. With
    order_by the rows are first range-partitioned by (key, order_by), so that positions follow that order; end it
    with a unique column, else tied rows may be numbered either way. Without, they follow the input's own order.
    Adds _pos (from 0) and _chunk. No group is larger than an input partition. Rows with a null key are left out.
    """
    present = df.where(F.col(key).isNotNull())
    if order_by:
        order = [key, *order_by]
        present = present.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = placed(present)
    counts = rows.groupBy("_pid", key).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_pid", key).orderBy("_place")) - 1
    numbered = rows.withColumn("_in_part", place).join(offsets, ["_pid", key])
    pos = (F.col("_before") + F.col("_in_part")).cast("long")
    return numbered.withColumn("_pos", pos).withColumn("_chunk", F.floor(pos / F.lit(chunk_rows))).drop("_pid", "_place", "_in_part", "_before")


def key_summary(df: DataFrame, key: str, order_by: Sequence[str] = (), value: str | None = None, chunk_rows: int = 100_000) -> DataFrame:
    """Per key: n_rows, n_chunks, and of an ordered `value` the first, the last and the number of changes.

    Every chunk of at most chunk_rows rows is reduced to a state (rows, first, last, changes inside); the states of a
    key are merged in chunk order, a change being added where one chunk's last value differs from the next one's
    first. Nulls are compared as values. A table without rows gives no keys.
    """
    columns = [key, *order_by, *([value] if value and value not in (key, *order_by) else [])]
    chunks = key_chunks(df.select(*dict.fromkeys(columns)), key, order_by, chunk_rows)
    if value is None:
        states = chunks.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
        return states.groupBy(key).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_chunks"))
    within = Window.partitionBy(key, "_chunk").orderBy("_pos")
    stepped = chunks.withColumn("_step", (F.col("_pos") % F.lit(chunk_rows) != 0) & ~F.lag(value).over(within).eqNullSafe(F.col(value)))
    states = stepped.groupBy(key, "_chunk").agg(
        F.count("*").alias("_n"), F.min_by(F.struct(value), "_pos").alias("_first"), F.max_by(F.struct(value), "_pos").alias("_last"), F.count_if("_step").alias("_changes")
    )
    border = F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk"))
    joined = states.withColumn("_border", ((F.col("_chunk") > 0) & ~border.eqNullSafe(F.col("_first"))).cast("long"))
    return joined.groupBy(key).agg(
        F.sum("_n").alias("n_rows"),
        F.count("*").alias("n_chunks"),
        F.min_by("_first", "_chunk")[value].alias("first_value"),
        F.max_by("_last", "_chunk")[value].alias("last_value"),
        (F.sum("_changes") + F.sum("_border")).alias("n_changes"),
    )


def heavy_keys(df: DataFrame, key: str, order_by: Sequence[str] = (), share: float = 0.02, chunk_rows: int = 100_000) -> DataFrame:
    """(key_value, n_rows, share) of the non-null keys that hold at least `share` of all rows of df, null keys counted."""
    total = df.count()
    counted = key_summary(df, key, order_by, chunk_rows=chunk_rows)
    return counted.where(F.col("n_rows") >= F.lit(share * total)).select(F.col(key).cast("string").alias("key_value"), "n_rows", (F.col("n_rows") / F.lit(total)).alias("share"))
