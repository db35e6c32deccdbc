"""Records that are the same but for formatting, over dictionary-encoded columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import normal_form, words
from kinweave.operators.numbering import dense_number
from kinweave.operators.skew import counted_join, salted_join
from kinweave.session import cut


def encode_values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(value, n, codes): each distinct non-null value of the fields, its cells, and its words as a sorted array of integers.

    A value is canonicalised once, however many records hold it. Words get dense integers in alphabetical order.
    """
    cells = df.select(F.explode(F.array(*[F.col(f).cast("string") for f in fields])).alias("value")).where("value IS NOT NULL")
    values = cut(cells.groupBy("value").agg(F.count("*").alias("n")).withColumn("_v", F.monotonically_increasing_id()))
    tokens = cut(values.select("_v", F.explode(words(normal_form("value"))).alias("word")))
    counts = tokens.groupBy("word").agg(F.count("*").alias("_n"))
    dictionary = cut(dense_number(counts, ["word"], "code"))
    total = dictionary.agg(F.sum("_n")).first()[0] or 0
    coded = counted_join(tokens, dictionary, ["word"], "_n", total).groupBy("_v").agg(F.array_sort(F.collect_list("code")).alias("codes"))  # one value's words
    return values.join(coded, "_v", "left").select("value", "n", F.coalesce("codes", F.array().cast("array<bigint>")).alias("codes"))


def record_tuples(df: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    """(row_id, codes): every record rewritten as the sorted integers of all its fields' words; null fields hold none."""
    values = cut(encode_values(df, fields))
    total = values.agg(F.sum("n")).first()[0] or 0
    rows = df.select(row_id, *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)])
    for i in range(len(fields)):
        rows = salted_join(rows, values.select(F.col("value").alias(f"_f{i}"), "n", F.col("codes").alias(f"_c{i}")), [f"_f{i}"], "n", total, "left").drop("n")
    none = F.array().cast("array<bigint>")
    codes = F.array_sort(F.concat(*[F.coalesce(F.col(f"_c{i}"), none) for i in range(len(fields))]))
    return rows.select(row_id, codes.alias("codes"))


def formatting_copies(df: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    """(row_id, first_id, copies): the smallest record with the same words equally often in all fields together, and how many have them.

    White space, case, punctuation, and the order within and across fields do not matter. Records without a word are
    copies of each other. Groups are counted map-side and joined back with large ones salted. row_id must be unique.
    """
    tuples = cut(record_tuples(df, row_id, fields))
    groups = cut(tuples.groupBy("codes").agg(F.min(row_id).alias("first_id"), F.count("*").alias("copies")))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    return salted_join(tuples, groups, ["codes"], "copies", total).select(row_id, "first_id", "copies")
