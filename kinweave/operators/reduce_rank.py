"""Projection of sparse row vectors to a few dimensions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import cut, cut_counting

MOST_ENTRIES = 8_000_000  # of the basis that is broadcast, 64 MB
MOST_QUERY_ENTRIES = 8_000_000  # of the query vectors that are broadcast at once


def _rows_times(terms: list, weights: list, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(product of the sparse rows with basis, flat term numbers, flat weights, row of each entry)."""
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    t, w = np.concatenate(terms).astype(np.int64), np.concatenate(weights)
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(w[:, None] * basis[t], starts, axis=0), t, w, np.repeat(np.arange(len(sizes)), sizes)


def truncated_svd(vectors: DataFrame, row_id: str, rank: int = 100, oversample: int = 10, iterations: int = 4, seed: int = 7) -> DataFrame:
    """(row_id, unit ARRAY<DOUBLE>): unit rows of the projection on the leading right singular vectors.

    Seeded subspace iteration: the term-by-(rank + oversample) basis lives on the driver and is broadcast, its size
    being checked against MOST_ENTRIES; each round multiplies by the matrix and its transpose on the executors.
    Cosines do not depend on the basis' rotation. Rows whose projection is zero are left out.
    """
    spark = vectors.sparkSession
    terms = vectors.select("term").distinct()
    n_terms = terms.count()
    width = min(rank + oversample, max(1, n_terms))
    if n_terms * width > MOST_ENTRIES:
        raise ValueError(f"{n_terms} terms at rank {rank} exceed the driver's bound; hash the terms first")
    index = {r[0]: i for i, r in enumerate(terms.orderBy("term").collect())}
    ids = spark.createDataFrame(list(index.items()), "term string, _t int")
    rows = vectors.join(ids, "term").groupBy(row_id).agg(F.collect_list(F.struct("_t", "w")).alias("_v")).select(row_id, F.col("_v._t").alias("_t"), F.col("_v.w").alias("_w"))
    rows = cut(rows)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]

    def gram(b: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(b)

        def part(batches):
            total = np.zeros_like(shared.value)
            for pdf in batches:
                if len(pdf):
                    done, t, w, row = _rows_times(pdf["_t"].tolist(), pdf["_w"].tolist(), shared.value)
                    for j in range(total.shape[1]):
                        total[:, j] += np.bincount(t, w * done[row, j], len(total))
            import pandas as pd

            yield pd.DataFrame({"m": [total.tobytes()]})

        sums = rows.select("_t", "_w").mapInPandas(part, "m binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(b.shape)).treeReduce(np.add)
        return sums

    for _ in range(iterations):
        basis = np.linalg.qr(gram(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ gram(basis))
    basis = basis @ turn[:, np.argsort(-values)[:rank]]
    final = spark.sparkContext.broadcast(basis)
    schema = f"`{row_id}` {vectors.schema[row_id].dataType.simpleString()}, unit array<double>"

    def project(batches):
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                out = _rows_times(pdf["_t"].tolist(), pdf["_w"].tolist(), final.value)[0]
                sizes = np.linalg.norm(out, axis=1)
                keep = sizes > 1e-12
                yield pd.DataFrame({row_id: pdf[row_id].to_numpy()[keep], "unit": list(out[keep] / sizes[keep, None])})

    return rows.mapInPandas(project, schema)


def dense_cosine(queries: DataFrame, rows: DataFrame, row_id: str, threshold: float) -> DataFrame:
    """(idx1, idx2, similarity) of queries against all rows, in blocks of rows and blocks of queries.

    Queries are broadcast in blocks of at most MOST_QUERY_ENTRIES numbers; a larger set takes several passes over rows.
    """
    spark = rows.sparkSession
    numbered, seen = cut_counting(queries.select(row_id, "unit").withColumn("_q", F.monotonically_increasing_id()), n=F.count("*"), width=F.max(F.size("unit")))
    blocks = max(1, -(-seen["n"] * (seen["width"] or 1) // (MOST_QUERY_ENTRIES // 2)))  # blocks by hash differ in size
    found = None
    for k in range(blocks):
        q = numbered.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == k).select(row_id, "unit").collect()
        shared = spark.sparkContext.broadcast((np.array([r[row_id] for r in q], dtype="int64"), np.array([r["unit"] for r in q], dtype="float64")))

        def part(batches, shared=shared):
            import pandas as pd

            qid, qm = shared.value
            for pdf in batches:
                if not len(pdf) or not len(qid):
                    continue
                s = qm @ np.stack(pdf["unit"].to_numpy()).T
                i, j = np.nonzero(s >= threshold)
                ids = pdf[row_id].to_numpy()
                out = pd.DataFrame({"idx1": qid[i], "idx2": ids[j], "similarity": s[i, j]})
                yield out[out.idx1 != out.idx2]

        one = rows.mapInPandas(part, "idx1 long, idx2 long, similarity double")
        found = one if found is None else found.unionByName(one)
    return found
