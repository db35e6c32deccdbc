"""TF-IDF as long tables (id, term, w); fit and transform are separate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.functions.stopwords import ENGLISH
from kinweave.operators.skew import counted_join

Tokenizer = Callable[[Column], Column]
TOKENIZERS: dict[str, Tokenizer] = {
    "tfidf": lambda c: X.word_ngrams(c, 2, 3, ENGLISH),
    "numeric": X.digit_runs,
    "char_ngram": lambda c: X.char_ngrams(c, 2),
    "char": lambda c: X.char_ngrams(c, 1),
}


def term_frequencies(df: DataFrame, row_id: str, column: str, tokenizer: Tokenizer, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, *keep, term, tf), combined map-side. Null and token-less texts give no rows; keep columns must depend on row_id."""
    tokens = df.select(row_id, *keep, F.explode(tokenizer(F.col(column))).alias("term"))
    return tokens.groupBy(row_id, "term").agg(*[F.first(c).alias(c) for c in keep], F.count("*").cast("double").alias("tf")).select(row_id, *keep, "term", "tf")


def fit_idf(tf: DataFrame, n_rows: int, weight: str | None = None) -> DataFrame:
    """(term, n_ids, df, idf) with idf = ln((N + 1) / (df + 1)) + 1, where a row may stand for `weight` equal ones."""
    counted = tf.groupBy("term").agg(F.count("*").alias("n_ids"), (F.sum(weight) if weight else F.count("*")).alias("df"))
    return counted.withColumn("idf", F.log((F.lit(n_rows) + 1) / (F.col("df") + 1)) + 1)


def weigh(tf: DataFrame, idf: DataFrame, row_id: str, norm: bool = True) -> DataFrame:
    """TF-IDF weights w of the terms in idf; others are dropped. With norm every row has length 1.

    Rows of terms that stand in a large share of all rows meet their weights by broadcast (see counted_join).
    """
    total = idf.agg(F.sum("n_ids")).first()[0] or 0
    weighed = counted_join(tf, idf.select("term", "n_ids", "df", "idf"), ["term"], "n_ids", total).withColumn("w", F.col("tf") * F.col("idf"))
    if norm:
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(row_id)))  # one row's terms
        weighed = weighed.withColumn("w", F.col("w") / length)
    return weighed.drop("tf", "idf", "n_ids")


def cross_similarity(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Cosine of all (left, right) pairs that share a term; both are unnormalised (id, term, w) of one fitted model.

    Pairs without a shared term have cosine 0 and no row.
    """

    def unit(v: DataFrame, key: str, name: str) -> DataFrame:
        length = v.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_len"))
        return v.join(length, key).where("_len > 0").select(F.col(key).alias(name), "term", (F.col("w") / F.col("_len")).alias(f"_w_{name}"))

    joined = unit(left, left_id, "idx1").join(unit(right, right_id, "idx2"), "term")
    return joined.groupBy("idx1", "idx2").agg(F.sum(F.col("_w_idx1") * F.col("_w_idx2")).alias("similarity"))
