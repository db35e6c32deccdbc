"""Streams of new records weighed with a frozen model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.vectorize import TOKENIZERS, term_frequencies


def score_stream(stream: DataFrame, row_id: str, column: str, idf: DataFrame, method: str = "tfidf") -> DataFrame:
    """(row_id, term, w) of a stream's records under a fitted (term, idf) table: a stream-static join without state.

    Terms outside the model are dropped; weights are not normalised, as that would need state.
    """
    tf = term_frequencies(stream, row_id, column, TOKENIZERS[method])
    return tf.join(idf.select("term", "idf"), "term").select(row_id, "term", (F.col("tf") * F.col("idf")).alias("w"))
