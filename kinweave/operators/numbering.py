"""Dense row numbers without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.session import cut

_SHIFT = 1 << 33  # monotonically_increasing_id holds the partition above this bit


def place_in_partition() -> Column:
    return F.monotonically_increasing_id() % F.lit(_SHIFT)


def placed(df: DataFrame) -> DataFrame:
    """df, cut, with its partition number _pid and each row's place in its partition _place."""
    return cut(df.withColumn("_pid", F.spark_partition_id()).withColumn("_place", place_in_partition()))


def partition_offsets(fixed: DataFrame) -> DataFrame:
    """(_pid, _offset): rows in the partitions before each one, of a placed table."""
    counts = fixed.groupBy("_pid").count().collect()  # one row per partition
    rows, total = [], 0
    for pid, n in sorted(counts):
        rows.append((pid, total))
        total += n
    return fixed.sparkSession.createDataFrame(rows, "_pid int, _offset long")


def dense_number(df: DataFrame, order_by: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Number rows start, start + 1, ... in the given order; without one, in the order of the input's partitions and rows.

    Rows are range-partitioned, so a third of them sharing one order key would share a task; end order_by with a
    unique column. Equal keys are numbered in arbitrary order. An empty table stays empty.
    """
    fixed = placed(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df)
    joined = fixed.join(F.broadcast(partition_offsets(fixed)), "_pid")
    return joined.withColumn(name, F.col("_offset") + F.col("_place") + F.lit(start)).drop("_pid", "_place", "_offset")
