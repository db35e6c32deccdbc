"""Occurrences and records of every value and term, by a range-partitioned sort and a run-length scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import counted, is_present, normal_form, words
from kinweave.session import cut

RARE = 1
COMMON = 0.05


def _changed(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one in front of it; two nulls are equal."""
    if not len(column):
        return np.zeros(0, bool)
    previous = pa.concat_arrays([pa.array([before.as_py() if before is not None else None], column.type), column.slice(0, len(column) - 1)])
    unequal = pc.not_equal(column, previous)
    nulls = pc.not_equal(pc.is_null(column), pc.is_null(previous))
    out = np.array(pc.if_else(pc.is_null(unequal), nulls, unequal).to_numpy(zero_copy_only=False), dtype=bool)
    if before is None:
        out[0] = True
    return out


def run_lengths(pairs: DataFrame, term: str, record: str, times: str) -> DataFrame:
    """(term, occurrences, records) of (term, record, times) rows.

    Rows are range-partitioned and sorted by (term, record), spilling as needed: a term held by a third of all
    records spans many partitions, while equal (term, record) rows stay together. Each partition is scanned once; the
    runs of a term that crosses partitions or batches are added up afterwards.
    """
    ordered = cut(pairs.select(term, record, F.col(times).cast("long").alias(times))).repartitionByRange(term, record).sortWithinPartitions(term, record)

    def scan(batches):
        last_term = last_record = None
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, records = batch.column(0), batch.column(1)
            new_term = _changed(terms, last_term)
            new_record = new_term | _changed(records, last_record)
            starts = np.flatnonzero(new_term)
            if not len(starts) or starts[0]:
                starts = np.concatenate([[0], starts])
            count = np.add.reduceat(batch.column(2).to_numpy(), starts)
            held = np.add.reduceat(new_record.astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(starts)), pa.array(count), pa.array(held)], ["term", "occurrences", "records"])
            last_term, last_record = terms[-1], records[-1]

    runs = ordered.mapInArrow(scan, "term string, occurrences long, records long")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def frequencies(df: DataFrame, record: str, text: str, by: str = "word", rare: int = RARE, common: float = COMMON) -> DataFrame:
    """(term, occurrences, records, mark) of every word of the normal form (by = "word") or every value as written ("value").

    Records are the distinct ids whose text is not missing; a row delivered twice counts once. mark is `rare` for a
    term in at most `rare` records, `common` for one in more than that share of the records, else null; if both hold,
    as in tiny tables, `rare`. A text's equal words are combined inside its row; one sort by (term, record) does the rest.
    """
    rows = cut(df.where(is_present(F.col(text).cast("string"))).select(F.col(record).alias("_record"), F.col(text).cast("string").alias("_text")).distinct())
    n_records = rows.agg(F.count_distinct("_record") + F.max(F.col("_record").isNull().cast("int"))).first()[0] or 0
    if by == "value":
        pairs = rows.select(F.col("_text").alias("term"), "_record", F.lit(1).alias("times"))
    elif by == "word":
        pairs = rows.select("_record", F.inline(counted(words(normal_form("_text"))))).select("term", "_record", F.col("tf").alias("times"))
    else:
        raise ValueError("by must be word or value")
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common * n_records), "common")
    return run_lengths(pairs, "term", "_record", "times").withColumn("mark", mark)
