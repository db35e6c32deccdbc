"""Passages of held-out test items inside a corpus, by winnowing (Schleimer, Wilkerson & Aiken, SIGMOD 2003)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import mail
from kinweave.llm.worker import kept
from kinweave.operators.skew import LEAST_HEAVY, counted_join
from kinweave.session import cut, cut_counting

SPAN = 10  # words of the shortest passage that counts
GRAM = 5  # words of a fingerprinted k-gram
MOST_TEST_HASHES = 250_000  # fingerprints of about 200 bytes each with their contexts, 50 MB; beyond, corpus fingerprints are joined by a shuffle
WORDS_KEPT = 500_000
ROWS = 512
_WORDS = re.compile(r"[^\W_]+").findall


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value


def word_list(text: str) -> list[str]:
    """Words of the normal form."""
    return _WORDS(text.lower().replace(".", "").replace(",", ""))


def plain_texts(text: str | None) -> list[str]:
    return [text] if text else []


def mail_texts(text: str | None) -> list[str]:
    return list(dict.fromkeys(t for _, _, t in mail.parts(text)))


def winnow(sequences: list[list[str]], gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Selected fingerprints of word sequences: (sequence number, k-gram hash, position in words, all word hashes).

    In every window of span - gram + 1 neighbouring k-grams the smallest hash is kept, of equal ones the last, so
    two sequences that share span words keep a common k-gram inside them.
    """
    hashes = kept("word_hashes", _Hashes)
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    n, window = int(lengths.sum()), span - gram + 1
    word = np.fromiter((hashes[w] for s in sequences for w in s), dtype=np.uint64, count=n)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), word
    owner = np.repeat(np.arange(len(sequences)), lengths)
    m = n - gram + 1
    mixed = np.zeros(m, np.uint64)
    for j in range(gram):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word[j : j + m]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    starts = np.flatnonzero(owner[: n - span + 1] == owner[span - 1 :])  # windows inside one sequence
    view = np.lib.stride_tricks.sliding_window_view(mixed, window)[starts]
    last = window - 1 - np.argmin(view[:, ::-1], axis=1)
    at = np.unique(starts + last)
    return owner[at], mixed[at].view(np.int64), at, word


def spans(sequences: list[list[str]], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the span words from each place on, whether they lie in one sequence), for the words of all sequences together."""
    hashes = kept("word_hashes", _Hashes)
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    n = int(lengths.sum())
    m = max(0, n - span + 1)
    word = np.fromiter((hashes[w] for s in sequences for w in s), dtype=np.uint64, count=n)
    owner = np.repeat(np.arange(len(sequences)), lengths)
    mixed = np.zeros(m, np.uint64)
    for j in range(span if m else 0):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word[j : j + m]
    return mixed, owner[:m] == owner[n - m :] if m else np.zeros(0, bool)


def known_spans(items: DataFrame, text: str, span: int = SPAN, most: int = 16 * MOST_TEST_HASHES) -> np.ndarray:
    """The sorted hashes of all runs of span words of the items, for workers to look up; at most `most` (32 MB), else this raises."""

    def run(batches):
        for batch in batches:
            mixed, inside = spans([word_list(t) for t in batch.column(0).to_pylist() if t], span)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(mixed[inside]).view(np.int64))], ["hash"])

    found = items.select(text).mapInArrow(run, "hash long").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"the items have more than {most} runs of {span} words")
    return np.sort(np.array([r[0] for r in found], dtype=np.int64).view(np.uint64))


def copied_shares(sequences: list[list[str]], known: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Of each word sequence, the share of its words that lie in a run of span words of the items."""
    mixed, inside = spans(sequences, span)
    lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    n = int(lengths.sum())
    covered = np.zeros(n + 1, np.int64)
    if len(mixed) and len(known):
        at = np.minimum(np.searchsorted(known, mixed), len(known) - 1)
        hits = np.flatnonzero((known[at] == mixed) & inside)
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + span, -1)
    inside_run = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    ends = np.cumsum(lengths)
    return (inside_run[ends] - inside_run[ends - lengths]) / np.maximum(lengths, 1)


def fingerprints(df: DataFrame, row_id: str, text: str, texts_of, gram: int = GRAM, span: int = SPAN, only: np.ndarray | None = None) -> DataFrame:
    """(row_id, hash, context): a text's selected k-grams with the hashes of the words around each.

    context holds span - gram words on either side, so that it decides whether span words are shared around a hit.
    Places outside the text are null. `only`, a sorted array, keeps the hashes that can meet a partner.
    """
    side = span - gram
    width = 2 * side + gram

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                sequences, rows = [], []
                for i, t in enumerate(piece.column(1).to_pylist()):
                    for s in texts_of(t):
                        sequences.append(word_list(s))
                        rows.append(i)
                owner, value, at, word = winnow(sequences, gram, span)
                if only is not None and len(value):
                    near = np.minimum(np.searchsorted(only, value), max(len(only) - 1, 0))
                    hit = only[near] == value if len(only) else np.zeros(len(value), bool)
                    owner, value, at = owner[hit], value[hit], at[hit]
                if not len(at):
                    continue
                sizes = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
                first = np.cumsum(sizes) - sizes
                places = at[:, None] + np.arange(-side, gram + side)[None, :]
                outside = (places < first[owner][:, None]) | (places >= (first + sizes)[owner][:, None])
                context = pa.array(word[np.clip(places, 0, len(word) - 1)].view(np.int64).ravel(), mask=outside.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), context)
                ids = piece.column(0).take(pa.array(np.asarray(rows)[owner]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(value), lists], [row_id, "hash", "context"])

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(row_id, text).mapInArrow(run, f"`{row_id}` {kind}, hash long, context array<bigint>")


def leaked_items(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, texts_of=mail_texts, gram: int = GRAM, span: int = SPAN, most_test_hashes: int = MOST_TEST_HASHES) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that hold at least span consecutive words of an item.

    Both sides are winnowed and joined on their fingerprints; a hit counts if the words around it agree over span
    words, which is exact up to collisions of 64-bit word hashes. While the items have at most most_test_hashes
    fingerprints, these go to the workers, which send out matching fingerprints only; otherwise all corpus
    fingerprints are joined by a salted shuffle. Null, empty and shorter texts have no case.
    """
    side = span - gram
    tests = cut(fingerprints(items, item_id, item_text, plain_texts, gram, span).withColumnRenamed("context", "_item_context"))
    known = tests.select("hash").distinct()
    small = tests.count() <= most_test_hashes
    only = np.sort(np.array([r[0] for r in known.collect()], dtype=np.int64)) if small else None
    found = fingerprints(docs, doc_id, doc_text, texts_of, gram, span, only)
    if small:
        joined = found.join(F.broadcast(tests), "hash")
    else:
        found, seen = cut_counting(found, n=F.count("*"))
        counts = cut(found.groupBy("hash").agg(F.count("*").alias("_n")).join(known, "hash", "left_semi"))
        salts = lambda: F.floor((F.col("_n") - 1) / F.lit(LEAST_HEAVY))
        # A common phrase's fingerprints are dealt to salts, and the items' rows of it repeated for each.
        dealt = counted_join(found, counts, ["hash"], "_n", seen["n"]).withColumn("_salt", F.pmod(F.xxhash64(doc_id, "context"), salts() + 1)).drop("_n")
        repeated = tests.join(counts, "hash").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts()))).drop("_n")
        joined = dealt.join(repeated, ["hash", "_salt"])
    same = F.zip_with("context", "_item_context", lambda a, b: F.coalesce(a == b, F.lit(False)))
    agrees = F.exists(F.sequence(F.lit(1), F.lit(side + 1)), lambda s: F.forall(F.slice(F.col("_same"), s, F.lit(span)), lambda x: x))
    return joined.withColumn("_same", same).where(agrees).select(doc_id, item_id).distinct()
