"""Classes of equal values, and the cosine-threshold self-join between them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import text as X
from kinweave.operators.skew import salted_join
from kinweave.operators.vectorize import TOKENIZERS, Tokenizer, fit_idf, term_frequencies, weigh
from kinweave.session import cut, cut_parts, release

MOST_LIST = 2_000  # vectors with one term that a task compares with as many
WAVE = 20_000_000  # pairs of vectors with one term that are made at a time
MOST_TERMS, CELLS = 4_096, 1_000_000  # different terms of a batch up to which vectors are laid out to be scored, and the numbers that may take
SLACK = 1e-9  # sums of products differ in the last digits with the order of summation


def block_columns(column: str, criteria: Sequence[str], blocking_column: str | Sequence[str] | None) -> list[Column]:
    """The composite block key: the first character of the value and / or other columns. No criteria mean one block."""
    keys: list[Column] = []
    for c in criteria or ():
        if c == "first_letter":
            keys.append(X.first_character(F.col(column).cast("string")))
        elif c == "blocking_column":
            names = [blocking_column] if isinstance(blocking_column, str) else list(blocking_column or ())
            if not names:
                raise ValueError("blocking_column is not named")
            keys += [F.col(n).cast("string") for n in names]
        else:
            raise ValueError(f"unknown blocking criterion: {c}")
    return keys


def value_classes(df: DataFrame, row_id: str, column: str, blocks: Sequence[Column] = ()) -> DataFrame:
    """(class_id, value, n, _b0, ...): one row per distinct value and block; class_id is its smallest row id.

    Null values and null block keys form classes too; n counts the rows.
    """
    keyed = df.select(F.col(row_id).alias("_row"), F.col(column).cast("string").alias("value"), *[b.alias(f"_b{i}") for i, b in enumerate(blocks)])
    names = ["value", *[f"_b{i}" for i in range(len(blocks))]]
    return keyed.groupBy(*names).agg(F.min("_row").alias("class_id"), F.count("*").alias("n"))


def membership(df: DataFrame, row_id: str, column: str, classes: DataFrame, blocks: Sequence[Column] = ()) -> DataFrame:
    """(row id, class_id) of every row with a value and full block key; heavy values are salted."""
    names = ["value", *[f"_b{i}" for i in range(len(blocks))]]
    keyed = df.select(F.col(row_id), F.col(column).cast("string").alias("value"), *[b.alias(f"_b{i}") for i, b in enumerate(blocks)]).na.drop(subset=names)
    total = classes.agg(F.sum("n")).first()[0] or 0
    return salted_join(keyed, classes.na.drop(subset=names).select(*names, "class_id", "n"), names, "n", total).select(row_id, "class_id")


def class_vectors(classes: DataFrame, tokenizer: Tokenizer | str = "tfidf") -> DataFrame:
    """Unit TF-IDF vectors of the classes. The statistics count every row, missing values and all blocks included;
    classes that are missing, have a null block key or no term get no vector, so that they match nothing."""
    tokenizer = TOKENIZERS[tokenizer] if isinstance(tokenizer, str) else tokenizer
    blocks = tuple(c for c in classes.columns if c.startswith("_b"))
    n_rows = classes.agg(F.sum("n")).first()[0] or 0
    # Blocks split a value into several classes; df counts rows, so their weights add up.
    usable = X.is_present("value")
    for b in blocks:
        usable = usable & F.col(b).isNotNull()
    marked = classes.withColumn("_ok", usable)
    tf = cut(term_frequencies(marked, "class_id", "value", tokenizer, ("_ok", "n", *blocks)))
    vectors = weigh(tf.where("_ok"), cut(fit_idf(tf, n_rows, "n")), "class_id")
    return vectors.select("class_id", *blocks, "term", "df", "w")


def cosine_pairs(vectors: DataFrame, threshold: float, row_id: str = "class_id", float32_scores: bool = False) -> DataFrame:
    """(idx1, idx2, similarity) of all pairs idx1 < idx2 within a block whose unit vectors have cosine >= threshold.

    Lossless prefix filter (Bayardo, Ma & Srikant, WWW 2007): with each vector's terms ordered from rare to common,
    only terms before the point where the rest of the vector is shorter than the threshold are indexed; a pair
    at or above the threshold shares one of them. Long lists are split. Only candidates are scored in full, terms
    being compared by 64-bit hashes. Cosines of 0 are never
    pairs, whatever the threshold. The pairs are made in waves of about WAVE list pairs and written one wave after the other. float32_scores re-tests the score after rounding it to single precision.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    blocks = [c for c in vectors.columns if c.startswith("_b")]
    spark = vectors.sparkSession
    v = vectors.select(F.col(row_id).alias("_id"), *blocks, F.xxhash64("term").alias("term"), "df", "w")
    v = v if hasattr(vectors, "_cut_at") else cut(v)
    order = Window.partitionBy("_id").orderBy("df", "term")
    square = F.col("w") * F.col("w")
    left = F.sqrt(F.sum(square).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    after = F.sqrt(F.coalesce(F.sum(square).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    bound = threshold - SLACK
    index = cut(v.select("_id", *blocks, "term", "df", "w", left.alias("_left"), after.alias("_after")).where((F.col("_left") >= bound) & (F.col("df") > 1)))
    # The pairs of all lists can be far more than the disk holds at one time: each wave makes those of its share of idx1.
    n = index.groupBy(*blocks, "term").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    waves = int(n // WAVE) + 1
    # The list of a common term is dealt to parts, and every part of it meets every other in a task of its own.
    n_parts = lambda most: F.floor((F.col("df") - 1) / F.lit(most)).cast("int") + 1
    n1, n2 = n_parts(MOST_LIST * waves), n_parts(MOST_LIST)
    mine = lambda k: F.pmod(F.xxhash64("_id"), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    side = lambda i, *parts: index.select(*blocks, "term", F.col("_id").alias(f"idx{i}"), F.col("w").alias(f"_w{i}"), F.col("_left").alias(f"_left{i}"), F.col("_after").alias(f"_after{i}"), *parts)
    a, b = side(1, mine(n1).alias("_p1"), every(n2).alias("_p2")), side(2, every(n1).alias("_p1"), mine(n2).alias("_p2"))

    def arrays(ids: DataFrame) -> DataFrame:
        terms = v.join(ids, "_id", "left_semi").select("_id", F.struct(F.col("term").alias("t"), "w").alias("e"))
        return cut(terms.groupBy("_id").agg(F.sort_array(F.collect_list("e")).alias("_v")).select("_id", F.col("_v.t").alias("_t"), F.col("_v.w").alias("_w")))  # one row's terms

    known = arrays(index.select("_id").distinct()) if waves > 1 else None

    def scored() -> Iterator[DataFrame]:
        for w in range(waves):
            # At a pair's first shared term the lengths from there on bound the cosine; later terms' rows may go, as the bound below covers them.
            met = a.where(F.pmod(F.xxhash64(F.lit(1), "idx1"), F.lit(waves)) == w).join(b, [*blocks, "term", "_p1", "_p2"])
            shared = met.where((F.col("idx1") < F.col("idx2")) & (F.col("_left1") * F.col("_left2") >= bound)).groupBy("idx1", "idx2")
            # Beyond the last shared indexed term, the product of the two remaining lengths bounds what can still be added.
            reachable = shared.agg((F.sum(F.col("_w1") * F.col("_w2")) + F.min(F.col("_after1") * F.col("_after2"))).alias("_most"))
            candidates = cut(reachable.where(F.col("_most") >= bound).select("idx1", "idx2"))
            full = known if known is not None else arrays(candidates.select(F.explode(F.array("idx1", "idx2")).alias("_id")).distinct())
            end = lambda i, full=full: full.select(F.col("_id").alias(f"idx{i}"), F.col("_t").alias(f"_t{i}"), F.col("_w").alias(f"_w{i}"))
            both = candidates.join(end(1), "idx1").join(end(2), "idx2").select("idx1", "idx2", "_t1", "_w1", "_t2", "_w2")
            kind = v.schema["_id"].dataType.simpleString()
            pairs = both.mapInArrow(_dots, f"idx1 {kind}, idx2 {kind}, similarity double").where(F.col("similarity") >= bound)
            if float32_scores:
                pairs = pairs.withColumn("similarity", F.col("similarity").cast("float").cast("double")).where(F.col("similarity") >= threshold)
            yield pairs
            release(candidates, *([] if known is not None else [full]))

    found = cut_parts(spark, scored())
    release(index, *([known] if known is not None else []))
    return found


def _dots(batches):
    """Dot products of sparse vectors given as sorted term hashes and weights."""
    for batch in batches:
        t1, w1, t2, w2 = (batch.column(i) for i in range(2, 6))
        flat = [(c.flatten().to_numpy(), np.asarray(c.offsets) - c.offsets[0].as_py()) for c in (t1, w1, t2, w2)]
        out = np.zeros(batch.num_rows)
        coded = pa.concat_arrays([t1.flatten(), t2.flatten()]).dictionary_encode()
        few = len(coded.dictionary) <= MOST_TERMS
        if few:  # each row's first vector laid out over all terms
            codes = coded.indices.to_numpy()
            codes, at1, at2 = np.split(codes, [len(flat[0][0])]), flat[0][1], flat[2][1]
            rows = max(CELLS // max(len(coded.dictionary), 1), 1)
            laid = np.zeros((min(rows, batch.num_rows), len(coded.dictionary)))
            for i in range(0, batch.num_rows, rows):
                k = min(i + rows, batch.num_rows)
                x, y = (np.repeat(np.arange(k - i), np.diff(at[i : k + 1])) for at in (at1, at2))
                first, second = slice(at1[i], at1[k]), slice(at2[i], at2[k])
                laid[x, codes[0][first]] = flat[1][0][first]
                out[i:k] = np.bincount(y, laid[y, codes[1][second]] * flat[3][0][second], k - i)
                laid[x, codes[0][first]] = 0
        for i in range(0 if few else batch.num_rows):
            x1, x2 = (flat[k][0][flat[k][1][i] : flat[k][1][i + 1]] for k in (0, 2))
            at = np.minimum(np.searchsorted(x2, x1), max(len(x2) - 1, 0))
            hit = x2[at] == x1
            out[i] = flat[1][0][flat[1][1][i] : flat[1][1][i + 1]][hit] @ flat[3][0][flat[3][1][i] : flat[3][1][i + 1]][at[hit]]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["idx1", "idx2", "similarity"])


def top_neighbours(pairs: DataFrame, n: int, score: str = "similarity") -> DataFrame:
    """The n best partners of every id, by score and then by id."""
    both = pairs.select("idx1", "idx2", score).unionByName(pairs.select(F.col("idx2").alias("idx1"), F.col("idx1").alias("idx2"), score))
    rank = F.row_number().over(Window.partitionBy("idx1").orderBy(F.desc(score), "idx2"))
    return both.withColumn("rank", rank).where(F.col("rank") <= n)


def max_similarity(*frames: DataFrame) -> DataFrame:
    """Element-wise maximum of several (idx1, idx2, similarity) frames."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f)
    return merged.groupBy("idx1", "idx2").agg(F.max("similarity").alias("similarity"))
