"""Where rows come from and go to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators.numbering import dense_number


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header line; give the schema at scale, as inferring it reads the file twice."""
    reader = spark.read.option("header", True).option("multiLine", False)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def corpus(spark: SparkSession, texts: Sequence[str | None]) -> DataFrame:
    """A literal list of texts as (row_idx, text)."""
    return spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string")


def with_row_index(df: DataFrame, order_by: Sequence[Column | str], name: str = "row_idx", start: int = 0) -> DataFrame:
    """Number the rows from start in the given order, or without one in the order of the input, without gathering them in one partition."""
    return dense_number(df, order_by, name, start)


def distinct_rows(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """The row of the smallest row_id for each combination of the columns; nulls are equal."""
    others = [c for c in df.columns if c not in columns]
    first = df.groupBy(*columns).agg(F.min_by(F.struct(*others), row_id).alias("_first"))
    return first.select(*[F.col(c) if c in columns else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def sampled(df: DataFrame, row_id: str, share: float, seed: int = 42) -> DataFrame:
    """About that share of the rows, always the same ones whatever the partitions."""
    return df.where(F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1_000_000)) < round(share * 1_000_000))
