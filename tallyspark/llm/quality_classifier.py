"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text is a vector of term weights in two blocks: the most frequent words of the labelled sample, and
marks of form (kinds of words, punctuation, repeated words and lines), which weigh more. A
truncated SVD of the sample's matrix projects both into a latent space. The labelled vectors are
broadcast, a size bounded by SAMPLE * RANK numbers; every text meets all of them in exact blocked
cosine products, and the labels of its NEIGHBOURS nearest vote, weighted by similarity.

Null and empty texts have no direction; their score is the sample's share of label 1. Without any
labelled row scores are 0.5. Rows are independent, so repeated rows repeat; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, mix, repeated, scans, sums_between
from .common import cut, labelled_sample, prepare, with_arrow_columns

#: Labelled rows that the vectors are made of, at most.
SAMPLE = 4000
WORDS, RANK, NEIGHBOURS, BLOCK = 2048, 64, 25, 1024
#: Length of the words' block; the block of form has length 1.
CONTENT = 0.3
#: A text is accepted from this score on.
ACCEPT = 0.7
#: Marks of form: words in upper case, capitalised, lower case, with digits, with symbols inside or at the
#: end, of one letter, long; words equal to the last; repeated lines; lines; then one for each ASCII mark.
_MARKS = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
FORMS = 11 + len(_MARKS)
_UPPER, _LOWER, _DIGIT, _SIGN = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_LOWER[128:] = True
_SIGN[_MARKS] = True
_MARK = np.full(256, -1, np.int64)
_MARK[_MARKS] = np.arange(len(_MARKS))


def term_counts(scan, vocabulary: np.ndarray) -> np.ndarray:
    """Rows of counts: the words of the ascending vocabulary, then the marks of form."""
    n, words = scan.rows, scan.words()
    owner = scan.owner(scan.bounds)
    out = np.zeros((n, len(vocabulary) + FORMS), np.float32)
    if len(vocabulary) and len(words):
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        hit = vocabulary[at] == words
        out[:, : len(vocabulary)] = np.bincount(owner[hit] * len(vocabulary) + at[hit], minlength=n * len(vocabulary)).reshape(n, -1)
    form = out[:, len(vocabulary) :]
    if not len(words):
        return out
    spans = np.stack([scan.starts, scan.ends], axis=1)
    inside = lambda flags: sums_between_pairs(flags[scan.raw], spans)
    size, upper, lower, digit, sign = scan.ends - scan.starts, inside(_UPPER), inside(_LOWER), inside(_DIGIT), inside(_SIGN)
    head = _UPPER[scan.raw[scan.starts]]
    tail = _SIGN[scan.raw[scan.ends - 1]]
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    kinds = [
        (upper >= 2) & (lower == 0), head & (lower > 0), ~head & (upper == 0) & (lower > 0), digit > 0, sign - tail > 0,
        tail & (sign >= 2), size == 1, size > 20, same,
    ]
    for k, flags in enumerate(kinds):
        form[:, k] = sums_between(flags, scan.bounds)
    starts, ends, lines = scan.lines()
    full = np.flatnonzero(np.searchsorted(scan.starts, ends) > np.searchsorted(scan.starts, starts))
    of = np.repeat(np.arange(n), np.diff(lines))[full]
    _, later = repeated(scan.hashes(starts[full], ends[full]) ^ mix(of.astype(U64) + U64(1)))
    form[:, 9], form[:, 10] = np.bincount(of, later, n), np.bincount(of, minlength=n)
    at = np.flatnonzero(_SIGN[scan.raw])
    text = np.searchsorted(scan.offsets, at, "right") - 1
    form[:, 11:] = np.bincount(text * len(_MARKS) + _MARK[scan.raw[at]], minlength=n * len(_MARKS)).reshape(n, -1)
    return out


def sums_between_pairs(flags: np.ndarray, spans: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:])
    return total[spans[:, 1]] - total[spans[:, 0]]


@dataclass
class Model:
    vocabulary: np.ndarray
    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weights(counts, self.weight, len(self.vocabulary)) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by cosine."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        own = self.project(counts)
        best = np.full((len(own), 0), -2, np.float32)
        label = np.zeros((len(own), 0), np.float32)
        for k in range(0, len(self.labels), BLOCK):
            cosine = own @ self.vectors[k : k + BLOCK].T
            best = np.concatenate([best, cosine], axis=1)
            label = np.concatenate([label, np.broadcast_to(self.labels[k : k + BLOCK], cosine.shape)], axis=1)
            if best.shape[1] > NEIGHBOURS:
                keep = np.argpartition(-best, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
                best, label = np.take_along_axis(best, keep, 1), np.take_along_axis(label, keep, 1)
        vote = np.maximum(best, 0).astype(float) ** 4
        total = vote.sum(axis=1)
        empty = ~own.any(axis=1) | (total <= 0)
        return np.where(empty, self.labels.mean(), (vote * label).sum(axis=1) / np.where(total > 0, total, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _weights(counts: np.ndarray, weight: np.ndarray, words: int) -> np.ndarray:
    """Logarithms of the words' rates, and square roots of the marks' rates, so that a few marks in a long text count little."""
    total = np.maximum(counts[:, words : words + 3].sum(axis=1, keepdims=True), 1)
    content = np.log1p(counts[:, :words] * (1000 / total)) * weight[:words]
    form = counts[:, words:] / total
    form[:, 9] = counts[:, words + 9] / np.maximum(counts[:, words + 10], 1)
    form[:, 10] = 0
    form = np.sqrt(form) * weight[words:]
    return np.concatenate([_unit(content) * CONTENT, _unit(form)], axis=1).astype(np.float32)


def train(counts: np.ndarray, labels: np.ndarray, vocabulary: np.ndarray, seed: int = 5) -> Model:
    """Inverse document frequencies, the latent basis by subspace iteration, and the labelled vectors."""
    n, width = counts.shape
    weight = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.2)
    # in parts, for the driver's memory
    parts = [_weights(counts[k : k + 256], weight, len(vocabulary)) for k in range(0, n, 256)]
    x = np.concatenate(parts) if parts else np.zeros((0, width), np.float32)
    del parts
    rank = min(RANK, n, width)
    basis = np.random.default_rng(seed).standard_normal((width, rank)).astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0] if n else basis
    model = Model(vocabulary, weight, basis, np.zeros((0, rank), np.float32), labels.astype(np.float32))
    model.vectors = _unit(x @ basis)
    return model


def _counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    def compute(batch):
        rows = [r.tobytes() for s in scans(batch.column(batch.schema.get_field_index("text"))) for r in term_counts(s, vocabulary)]
        return [pa.array(rows, pa.binary())]

    return with_arrow_columns(docs, "counts binary", compute).select("quality", "counts")


def fit(docs: DataFrame, labels: DataFrame, *conditions: Column, limit: int = SAMPLE) -> Model:
    """The model of at most `limit` labelled rows of docs; the conditions choose among the labels."""
    prepare(docs.sparkSession)
    some = labelled_sample(labels, limit, *conditions)
    known = cut(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "labelled")

    def distinct(batches):
        for batch in batches:
            for s in scans(batch.column(0)):
                keys = s.words()
                of = s.owner(s.bounds).astype(U64)
                _, later = repeated(keys ^ mix(of + U64(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[~later].view(np.int64))], names=["word"])

    words = known.select("text").mapInArrow(distinct, "word long").groupBy("word").count().orderBy(F.desc("count"), "word").limit(WORDS)
    vocabulary = np.sort(words.toArrow()["word"].to_numpy().view(U64))
    rows = _counts(known, vocabulary).toArrow()
    quality = rows["quality"].to_numpy()
    counts = np.empty((rows.num_rows, len(vocabulary) + FORMS), np.float32)
    at = 0
    for chunk in rows["counts"].chunks:
        for row in chunk:
            counts[at] = np.frombuffer(row.as_buffer(), np.float32)
            at += 1
    del rows
    order = np.lexsort((*counts.T[-4:], counts.sum(axis=1), quality))  # the same whatever the tasks' order
    return train(counts[order], quality[order], vocabulary)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with score and predicted."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def compute(batch):
        known = shared.value
        parts = [known.score(term_counts(s, known.vocabulary)) for s in scans(batch.column(batch.schema.get_field_index("text")))]
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0))]

    scored = with_arrow_columns(docs, "score double", compute)
    return scored.drop(*[c for c in scored.columns if c.lower() == "predicted"]).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def held_out(column: str = "doc_id") -> Column:
    """The rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted; labels of held-out rows are never read."""
    model = fit(docs, labels, ~held_out(), limit=limit)
    scored = score(docs, model)
    return scored.drop(*[c for c in scored.columns if c.lower() == "held_out"]).withColumn("held_out", held_out())
