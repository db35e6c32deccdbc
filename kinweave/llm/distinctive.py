"""How characteristic each term of a record is: log-odds with an informative Dirichlet prior (Monroe, Colaresi & Quinn 2008)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import counted, is_present, normal_form, words
from kinweave.operators.skew import counted_join
from kinweave.session import cut

PRIOR_WORDS = 1_000.0


def _z(tf: Column, length: Column, count: Column, total: Column, prior: Column) -> Column:
    """z-score of a record's log-odds against the rest; 0 where a side holds nothing but this term."""
    alpha = prior * count / total
    rest_tf, rest_length = count - tf, total - length
    odds = (tf + alpha) / F.nullif(length + prior - tf - alpha, F.lit(0.0))
    rest = (rest_tf + alpha) / F.nullif(rest_length + prior - rest_tf - alpha, F.lit(0.0))
    return F.coalesce((F.log(odds) - F.log(rest)) / F.sqrt(1 / (tf + alpha) + 1 / (rest_tf + alpha)), F.lit(0.0))


def term_scores(df: DataFrame, row_id: str, fields: Sequence[str], prior: float | None = PRIOR_WORDS, by_record: bool = False) -> DataFrame:
    """(row_id, field, term, tf, df, n_terms, z) of every different word of every record and field.

    z compares the record with the rest of its column: log-odds with a Dirichlet prior of `prior` words spread like the
    collection's counts, or, with None, of the collection's counts themselves. by_record counts a word once per record,
    however often it stands there (tf is then 1). `df` counts the records that hold the term, n_terms the record's
    different terms. Missing values and values without a word give no rows; ties keep all their terms. row_id must be
    unique.

    Words are counted inside their row. The only row-wise shuffle is the join with the statistics; terms that a
    thousandth of all rows hold meet theirs by broadcast, so that no word makes a hot task.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f).cast("string").alias("_value")) for i, f in enumerate(fields)])
    values = df.select(F.col(row_id).alias("_row"), F.explode(cells).alias("_c")).where(is_present("_c._value"))
    texts = cut(values.select("_row", "_c._f", counted(words(normal_form("_c._value"))).alias("_terms")))
    length = F.size("_terms") if by_record else F.aggregate("_terms", F.lit(0).cast("long"), lambda n, x: n + x["tf"])
    terms = texts.select("_row", "_f", F.size("_terms").alias("n_terms"), length.cast("double").alias("_length"), F.inline("_terms"))
    if by_record:
        terms = terms.withColumn("tf", F.lit(1).cast("long"))
    stats = cut(terms.groupBy("_f", "term").agg(F.sum("tf").cast("double").alias("_count"), F.count("*").alias("df")))
    totals = {r[0]: (float(r[1]), r[2]) for r in stats.groupBy("_f").agg(F.sum("_count"), F.sum("df")).collect()}  # one row a field
    total = F.get(F.array(*[F.lit(totals.get(i, (1.0, 0))[0]) for i in range(len(fields))]), F.col("_f"))
    scored = counted_join(terms, stats, ["_f", "term"], "df", sum(n for _, n in totals.values()))
    z = _z(F.col("tf").cast("double"), F.col("_length"), F.col("_count"), total, total if prior is None else F.lit(float(prior)))
    field = F.get(F.array(*map(F.lit, fields)), F.col("_f"))
    return scored.select(F.col("_row").alias(row_id), field.alias("field"), "term", "tf", "df", "n_terms", z.alias("z"))


def most_distinctive(scores: DataFrame, row_id: str) -> DataFrame:
    """(row_id, field, term, df, n_terms, z): each record and field's term of the highest z, where no other term ties with it.

    The first and the last of the terms with the highest z are aggregated, and are the same where it stands alone.
    """
    last, first = F.max(F.struct("z", "term", "df", "n_terms")), F.min(F.struct((-F.col("z")).alias("z"), "term"))
    ends = scores.repartition(row_id, "field").groupBy(row_id, "field").agg(last.alias("_last"), first.alias("_first"))
    return ends.where("_last.term = _first.term").select(row_id, "field", "_last.term", "_last.df", "_last.n_terms", "_last.z")
