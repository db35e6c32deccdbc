"""Mining and stripping the endings that many names share."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators.skew import counted_join, salted_join
from kinweave.session import cut, cut_counting


@dataclass(frozen=True)
class SuffixConfig:
    words: int = 3
    least_count: int = 20
    least_residual: int = 10
    second_pass: bool = False  # True: the result column also loses the ending of the second one-word pass


def common_endings(names: DataFrame, column: str, k: int, least_count: int, weight: str | None = None) -> DataFrame:
    """(ending, n) of last-k-word endings that stand in at least least_count rows; shorter names count whole."""
    counted = names.where(F.col(column).isNotNull()).groupBy(X.last_words(column, k).alias("ending")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return counted.where(F.col("n") >= least_count)


def common_affixes(df: DataFrame, column: str, least_count: int = 5, least_length: int = 2) -> DataFrame:
    """(word, n) of words that occur often enough and are long enough."""
    w = df.select(F.explode(X.words(X.squeeze(column))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def exempt(column: str, k: int, least_residual: int):
    after = F.coalesce(X.words_after_preposition(column) <= k, F.lit(False))
    return after | (X.residual_length(column, k) < least_residual)


def strip_pass(values: DataFrame, old: str, new: str, removed: str, k: int, config: SuffixConfig, statistics: list[DataFrame] | None = None) -> DataFrame:
    """One pass over distinct names (_vid, n, old): adds the stripped name and the removed text.

    Each name's endings of 1 to k words are matched to the mined ones by an equi-join whose common endings are
    met by broadcast; the longest match wins. statistics takes one row on the pass: see pass_statistics.
    """
    w = X.words(old)
    longest = F.least(F.size(w), F.lit(k))
    lengths = F.when(longest >= 1, F.sequence(F.lit(1), F.greatest(longest, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    ends = values.select("_vid", "n", F.col(old).alias("_old"), F.explode(lengths).alias("_j"), longest.alias("_top"))
    ow = X.words("_old")
    reasons = [F.coalesce(X.words_after_preposition("_old") <= k, F.lit(False)).alias("_near"), (X.residual_length("_old", k) < config.least_residual).alias("_short")]
    ending = F.array_join(F.slice(ow, F.size(ow) - F.col("_j") + 1, F.col("_j")), " ").alias("ending")
    ends, seen = cut_counting(ends.select("_vid", "n", "_j", "_top", ending, *reasons).withColumn("_exempt", F.col("_near") | F.col("_short")), total=F.count("*"))
    mined = ends.groupBy("ending").agg(F.sum(F.when(F.col("_j") == F.col("_top"), F.col("n")).otherwise(0)).alias("_count"), F.count("*").alias("_weight"))
    mined = cut(mined.where(F.col("_count") >= config.least_count))
    if statistics is not None:
        rows = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
        near, short = F.coalesce(X.words_after_preposition(old) <= k, F.lit(False)), X.residual_length(old, k) < config.least_residual
        whole = values.agg(rows(near).alias("near_preposition"), rows(short).alias("short_rest"))
        statistics.append(whole.crossJoin(mined.agg(F.count("*").alias("endings"))).select(F.lit(len(statistics) + 1).alias("pass"), F.lit(k).alias("words"), "endings", "near_preposition", "short_rest"))
    total = seen["total"]
    hits = counted_join(ends.where(~F.col("_exempt")).select("_vid", "_j", "ending"), mined.select("ending", "_weight"), ["ending"], "_weight", total)
    cuts = hits.groupBy("_vid").agg(F.max("_j").alias("_cut"))
    done = values.join(cuts, "_vid", "left")
    ow = X.words(old)
    stripped = F.trim(F.array_join(F.slice(ow, F.lit(1), F.greatest(F.size(ow) - F.col("_cut"), F.lit(0))), " "))
    done = done.withColumn(new, F.when(F.col("_cut").isNotNull(), stripped).otherwise(F.col(old)))
    return cut(done.withColumn(removed, F.when(F.col("_cut").isNotNull(), X.removed_text(old, new))).drop("_cut"))


def clean_entity_names(df: DataFrame, column: str, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """df with <column>_CLN and 0-ending, 1-ending, ... (the removed words from the right).

    Names are normalised, then endings of 3, 2 and 1 words that at least 20 rows share are mined and stripped in turn,
    each pass counting on what the last one left; a second one-word pass feeds the ending columns only. A name keeps
    its ending where no more than k words follow its last preposition or fewer than 10 characters would remain. All
    passes run over the distinct names, weighted by their rows. Null names give nulls. User columns are kept.
    """
    source = cut(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_name")).agg(F.count("*").alias("n")).withColumn("_vid", F.monotonically_increasing_id()))
    values = source.withColumn("_c", X.clean_name("_name"))
    old, removed = "_c", []
    for k in [*range(config.words, 0, -1), 0]:
        values = strip_pass(values, old, f"_c{k}", f"_r{k}", max(k, 1), config)
        old = f"_c{k}"
        removed.insert(0, f"_r{k}")
    joined = F.concat_ws(" ", *removed)
    result = values.select(
        F.col("_name"), "n", F.col("_c0" if config.second_pass else "_c1").alias("_cln"), *[X.nth_word_from_right(joined, i + 1).alias(f"_e{i}") for i in range(config.words + 1)]
    )
    total = values.agg(F.sum("n")).first()[0] or 0
    out = salted_join(df.withColumn("_name", F.col(column)), result, ["_name"], "n", total, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_cln").alias(f"{column}_CLN"), *[F.col(f"_e{i}").alias(f"{i}-ending") for i in range(config.words + 1)])


def pass_statistics(df: DataFrame, column: str, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """(pass, words, endings, near_preposition, short_rest): of each pass, the second one-word pass being the last, how many endings
    are common and how many rows keep theirs for either reason, counted on what the pass before has left."""
    source = cut(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_name")).agg(F.count("*").alias("n")).withColumn("_vid", F.monotonically_increasing_id()))
    values, statistics = source.withColumn("_c", X.clean_name("_name")), []
    old = "_c"
    for k in [*range(config.words, 0, -1), 0]:
        values = strip_pass(values, old, f"_c{k}", f"_r{k}", max(k, 1), config, statistics)
        old = f"_c{k}"
    return reduce(DataFrame.unionByName, statistics)
