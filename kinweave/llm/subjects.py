"""Subjects of documents: averaged word and subword embeddings with independent logistic outputs."""

from __future__ import annotations

import math
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm import contamination, mail
from kinweave.llm.worker import kept
from kinweave.session import cut

BUCKETS, DIM, SEED = 1 << 15, 12, 11
LABELLED_DOCS = 6_000  # bound of the labelled documents that are fitted, the first by hash
PARTS, STEPS, RATE, REFITS = 4, 12, 0.1, 2  # few steps: words of many paragraphs are learnt before those of a few
SURE, LEAD = 0.35, 1.5  # a paragraph is given its best subject if that is so probable and so far ahead of the second
NONE = 0.2  # and none if no subject is so probable
COPIED = 0.3  # share of a paragraph's words in passages of the held-out items from which on it does not count
GRAM = 4  # letters of a subword
SENTENCES = 3
ROWS = 256

_QUOTE = re.compile(r"^[ \t]*((?:[>|][ \t]?)*)(.*)$")
_SENTENCE = re.compile(r"[.!?]+[\"')\]»”]*(?:\s+(?=[\"'(\[«“¿¡]*[^\W\d_a-zäöüßàâçéèêëîïôûùñáíóú])|\s*$)")
_WORD = re.compile(r"[^\W\d_]{3,}").findall
# Lines with which an earlier mail begins: an attribution, a rule with or without words in it, a note in brackets, a sender's header.
_CHAIN = re.compile(r".*:$|[-_=*]{4,}|\[[^\]]*\]$|(?:from|von|de|da|van)[ \t]*:", re.I)


def paragraphs(text: str, sentences: int = SENTENCES) -> list[str]:
    """Paragraphs of that many sentences or more. Quote marks are taken off; a change of quoting ends a paragraph.

    A signature, from an unquoted `--` line to the next quoted line or the beginning of an earlier mail, is left out; the
    chain below it is read.
    """
    out, lines, depth, signed = [], [], -1, False
    for line in [*text.split("\n"), ""]:
        m = _QUOTE.match(line)
        marks, rest = m.group(1), m.group(2).strip()
        d = marks.count(">") + marks.count("|")
        if lines and (not rest or d != depth):
            joined = " ".join(lines)
            if joined.count(".") + joined.count("?") + joined.count("!") >= sentences and len(_SENTENCE.findall(joined)) >= sentences:
                out.append(joined)
            lines = []
        if not d and rest == "--":
            signed = True
        elif rest and (d or _CHAIN.match(rest)):
            signed = False
        if rest and not signed:
            lines.append(rest)
            depth = d
    return out


def mail_paragraphs(text: str | None) -> list[str]:
    """The distinct long paragraphs a reader sees; attachments are left out."""
    return list(dict.fromkeys(p for _, attached, t in mail.parts(text) if not attached for p in paragraphs(t)))


def own_paragraphs(texts: list[str | None], known: np.ndarray) -> tuple[list[int], list[list[str]]]:
    """(number of the text, words) of every long paragraph that is not mostly copied from the items whose runs are known."""
    rows, found = [], []
    for i, t in enumerate(texts):
        for p in mail_paragraphs(t):
            rows.append(i)
            found.append(p)
    if len(known) and found:
        copied = contamination.copied_shares([contamination.word_list(p) for p in found], known) >= COPIED
        rows, found = [i for i, c in zip(rows, copied) if not c], [p for p, c in zip(found, copied) if not c]
    return rows, [_WORD(p.lower()) for p in found]


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, its ends marked."""
    marked = f"<{word}>"
    parts = [word, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))] if len(word) > 3 else [word]
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in parts]


def start(n_subjects: int) -> np.ndarray:
    """Flat parameters: embeddings (zero), output weights (seeded), biases."""
    weights = np.random.default_rng(SEED).standard_normal((DIM, n_subjects)) / math.sqrt(DIM)
    return np.concatenate([np.zeros(BUCKETS * DIM), weights.ravel(), np.full(n_subjects, -2.0)]).astype(np.float32)


def unpack(theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e = BUCKETS * DIM
    return theta[:e].reshape(BUCKETS, DIM), theta[e : e + DIM * k].reshape(DIM, k), theta[e + DIM * k :]


class Fit:
    """One partition's paragraphs."""

    def __init__(self, texts: list[list[str]], targets: np.ndarray) -> None:
        vocabulary: dict[str, int] = {}
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.codes = np.array([vocabulary.setdefault(w, len(vocabulary)) for t in texts for w in t], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.lengths)
        lists = [features(w) for w in vocabulary]
        self.word_of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        self.bucket = np.array([b for x in lists for b in x], dtype=np.int64)
        self.per_word = np.bincount(self.word_of, minlength=len(lists)).astype(np.float32)
        self.targets, self.n_words = targets.astype(np.float32), len(lists)

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        """Of the logistic losses summed over the paragraphs."""
        k = self.targets.shape[1]
        emb, weights, bias = unpack(theta, k)
        n = len(self.lengths)
        table = np.stack([np.bincount(self.word_of, emb[self.bucket, d], self.n_words) for d in range(DIM)], 1) / self.per_word[:, None]
        mean = np.stack([np.bincount(self.owner, table[self.codes, d], n) for d in range(DIM)], 1) / np.maximum(self.lengths, 1)[:, None] * 10
        z = np.clip(mean @ weights + bias, -30, 30)
        delta = 1 / (1 + np.exp(-z)) - self.targets
        back = (delta @ weights.T) * (10 / np.maximum(self.lengths, 1)[:, None])
        to_word = np.stack([np.bincount(self.codes, back[self.owner, d], self.n_words) for d in range(DIM)], 1) / self.per_word[:, None]
        to_emb = np.stack([np.bincount(self.bucket, to_word[self.word_of, d], BUCKETS) for d in range(DIM)], 1)
        return np.concatenate([to_emb.ravel(), (mean.T @ delta).ravel(), delta.sum(0)])


def fit(examples: DataFrame, n_subjects: int, steps: int = STEPS) -> np.ndarray:
    """Parameters fitted on (words ARRAY<STRING>, target ARRAY<DOUBLE>, part INT) rows, which are bounded and dealt to fixed parts.

    In each step all partitions compute the gradient of their paragraphs from the shared parameters; the driver adds
    the gradients up, one vector of about 400,000 numbers per partition, and takes an Adam step.
    """
    theta = start(n_subjects).astype(np.float64)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    token = uuid.uuid4().hex
    for step in range(1, steps + 1):
        shared = examples.sparkSession.sparkContext.broadcast(theta.astype(np.float32))

        def run(batches, shared=shared):
            held, batches = kept("fits", dict), list(batches)
            key = (token, *sorted({(p, sum(b.num_rows for b in batches)) for b in batches for p in b.column(2).unique().to_pylist()}))
            if key not in held:
                texts, targets = [], []
                for batch in batches:
                    texts += batch.column(0).to_pylist()
                    targets += batch.column(1).to_pylist()
                for old in [k for k in held if k[0] != token]:
                    del held[old]
                held[key] = Fit(texts, np.array(targets, dtype=np.float64).reshape(-1, n_subjects)) if texts else None
            if held[key]:
                g = held[key].gradient(shared.value.astype(np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([len(held[key].lengths)]), pa.array([g.tobytes()])], ["n", "gradient"])

        parts = examples.select("words", "target", "part").mapInArrow(run, "n long, gradient binary").collect()  # one row a partition
        shared.destroy()
        if not parts:
            break
        parts.sort(key=lambda p: (p[0], bytes(p[1])))
        g = sum(np.frombuffer(p[1], np.float32).astype(np.float64) for p in parts) / sum(p[0] for p in parts)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return theta.astype(np.float32)


class Scorer:
    def __init__(self, theta: np.ndarray, k: int) -> None:
        emb, self.weights, self.bias = unpack(theta, k)
        self.emb, self.k = emb, k
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, self.k))

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.known) > 300_000:
            self.forget()
        for w in set().union(*texts).difference(self.known):
            n = len(self.known)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n] = self.emb[features(w)].mean(0) @ self.weights * 10
            self.known[w] = n
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.fromiter((self.known[w] for t in texts for w in t), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        sums = np.stack([np.bincount(owner, self.table[codes, j], len(texts)) for j in range(self.k)], 1) if len(codes) else np.zeros((len(texts), self.k))
        z = np.clip(sums / np.maximum(lengths, 1)[:, None] + self.bias, -30, 30)
        return 1 / (1 + np.exp(-z))


def _paragraph_rows(docs: DataFrame, text: str, target: str, known: np.ndarray) -> DataFrame:
    """(words, target) of the long paragraphs of the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            rows, words = own_paragraphs(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1).take(pa.array(rows, pa.int64()))], ["words", "target"])

    return docs.select(text, target).mapInArrow(run, "words array<string>, target array<double>")


def _fixed(rows: DataFrame) -> DataFrame:
    """rows in a few partitions that stay the same from step to step, each with its number."""
    dealt = rows.repartition(PARTS, "words").sortWithinPartitions(F.xxhash64("words"))
    return cut(dealt.withColumn("part", F.spark_partition_id()))


def held_out_spans(held_out: DataFrame | None, text: str = "text") -> np.ndarray:
    return np.zeros(0, np.uint64) if held_out is None else contamination.known_spans(held_out, text)


def train(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, subject: str, subjects: list[str], known: np.ndarray | None = None) -> np.ndarray:
    """Fit on the paragraphs of labelled documents, at first with their documents' labels, then with what the model makes of them.

    Labels name subjects of whole documents, incompletely and partly wrongly; a document's labels are at first given to
    all its long paragraphs. Each refit starts afresh on the same paragraphs, each with its best subject alone where the
    last model is sure of it, or with none where nothing is probable; the others are left out. Paragraphs copied from the items whose runs
    are known (held_out_spans) are never fitted. The labelled documents are bounded by LABELLED_DOCS and their paragraphs
    spread over fixed partitions. Without any label every score stays low.
    """
    k, spark = len(subjects), docs.sparkSession
    known = np.zeros(0, np.uint64) if known is None else known
    targets = [F.max((F.col(subject) == s).cast("double")) for s in subjects]
    labelled = labels.where(F.col(subject).isin(*subjects)).groupBy(doc_id).agg(F.array(*targets).alias("target"))
    chosen = labelled.orderBy(F.xxhash64(doc_id), doc_id).limit(LABELLED_DOCS)
    first = _fixed(_paragraph_rows(docs.select(doc_id, text).join(F.broadcast(chosen), doc_id), text, "target", known))  # at most LABELLED_DOCS rows
    theta = fit(first, k)
    for _ in range(REFITS):
        shared = spark.sparkContext.broadcast(theta)

        def judge(batches, shared=shared):
            scorer = Scorer(shared.value, k)
            for batch in batches:
                words = batch.column(0).to_pylist()
                if not words:
                    continue
                p = scorer.probabilities(words)
                ranked = np.sort(p, 1)
                sure = (ranked[:, -1] >= SURE) & (ranked[:, -1] > LEAD * (ranked[:, -2] if k > 1 else 0))
                target = np.zeros_like(p)
                target[np.flatnonzero(sure), p.argmax(1)[sure]] = 1
                use = sure | (ranked[:, -1] < NONE)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(target.tolist(), pa.list_(pa.float64())), batch.column(1)], ["words", "target", "part"]).filter(pa.array(use))

        theta = fit(cut(first.select("words", "part").mapInArrow(judge, "words array<string>, target array<double>, part int")), k)
    return theta


def document_subjects(docs: DataFrame, doc_id: str, text: str, theta: np.ndarray, subjects: list[str], threshold: float = 0.5, known: np.ndarray | None = None) -> DataFrame:
    """Distinct (doc_id, subject) of every document that treats a subject in a paragraph of three or more sentences.

    Each paragraph the reader sees, quoted ones included, is scored on its own; nothing is shuffled. Paragraphs mostly
    copied from the items whose runs are known do not count. Documents without such a paragraph, and null and empty texts,
    have no row.
    """
    known = np.zeros(0, np.uint64) if known is None else known
    shared = docs.sparkSession.sparkContext.broadcast((theta, known))
    k = len(subjects)

    def run(batches):
        scorer = kept(f"subject_scorer_{zlib.crc32(shared.value[0].tobytes())}", lambda: Scorer(shared.value[0], k))
        names = np.array(subjects)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                rows, words = own_paragraphs(piece.column(1).to_pylist(), shared.value[1])
                if not words:
                    continue
                i, j = np.nonzero(scorer.probabilities(words) >= threshold)
                pairs = np.unique(np.stack([np.asarray(rows)[i], j], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(pairs[:, 0])), pa.array(names[pairs[:, 1]].tolist(), pa.string())], [doc_id, "subject"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, subject string")
