"""Toxicity: a factorization machine over hashed terms.

Terms are words and word beginnings (so that inflected forms of a stem count as one), hashed. Every term of a bounded
balanced sample that LEAST documents hold enters the model; besides a weight each has
a short vector, and the dot products of the vectors of all terms in a document give the pairwise interactions
that additive weights miss (two mild words that are harmful together, or a harmful one in harmless company).
Weights and vectors are fitted together, under a penalty that leaves a parameter at zero unless it helps the whole
machine; no term is judged by itself, so one that tells something only beside another stays. Terms whose parameters
are all zero go out of the fitted model, which therefore stays small.
Scoring reads every whole text in place.

Defined results: null, empty and wordless texts hold no term and get the model's base score; repeated rows score
alike; a null doc_id is never held out; if the sample lacks a class, every score is the share of the other (0 without
any label); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

#: Documents of each label that the fit sees at most.
PER_CLASS = 3000
#: Hash buckets of terms (as a power of two), factors, documents of the sample that must hold a term.
BITS, FACTORS, LEAST = 22, 4, 3
#: Bytes of the word beginnings that are terms of their own.
BEGINNINGS = (5, 6, 7, 8)
EPOCHS, RATE, SEED = 200, 0.05, 9
#: Penalties of weights and of vector components, their first size, and the steps after which zero terms may go.
WEIGHT_COST, VECTOR_COST, SPREAD, SETTLED = 3e-3, 1e-3, 0.05, 30
_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
SEPARATORS = ~common.byte_mask(_LETTERS)


def terms(column: pa.Array, hasher: common.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash bucket of every term occurrence."""
    data, offsets = common.utf8(column)
    starts, ends, first = common.words(data, offsets, SEPARATORS)
    row = common.per_row(np.diff(first))
    hashes = hasher.several(data, starts, [ends, *(np.minimum(ends, starts + n) for n in BEGINNINGS)])
    rows, found = [row], [common.mix(hashes[0], 1)]
    for n, beginning in zip(BEGINNINGS, hashes[1:], strict=True):
        longer = ends - starts > n
        rows.append(row[longer])
        found.append(common.mix(beginning[longer], 2))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _present(row: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * width + term)
    return key // width, key % width


class Factorization:
    """w0 + sum w_i + sum of v_i v_j over the terms present: bias, weights and vectors by bucket, or a constant score."""

    def __init__(self, buckets: np.ndarray, constant: float | None = None):
        self.buckets, self.base, self.constant = buckets, 0.0, constant
        self.w, self.v = np.zeros(len(buckets), np.float32), np.zeros((FACTORS, len(buckets)), np.float32)

    def score(self, column: pa.Array, hasher: common.Hasher) -> np.ndarray:
        n = len(column)
        if self.constant is not None:
            return np.full(n, self.constant)
        row, bucket = terms(column, hasher)
        if not hasattr(self, "slot"):
            self.slot = np.full(1 << BITS, -1, np.int32)
            self.slot[self.buckets] = np.arange(len(self.buckets))
        slot = self.slot[bucket]
        known = slot >= 0
        row, term = _present(row[known], slot[known].astype(np.int64), len(self.w) or 1)
        out = self.base + np.bincount(row, self.w[term], n)
        for v in self.v.astype(np.float64):
            out += 0.5 * (np.bincount(row, v[term], n) ** 2 - np.bincount(row, v[term] ** 2, n))
        return 0.5 * (np.tanh(0.5 * out) + 1)


class _Matrix:
    """Which of the documents hold which terms, summed along either side."""

    def __init__(self, row: np.ndarray, term: np.ndarray, rows: int, terms_: int):
        order = np.argsort(term, kind="stable")
        self.row, self.term, self.rows, self.by_term = row, term, rows, row[order]
        self.begin = np.searchsorted(term[order], np.arange(terms_))
        self.first, self.full = np.searchsorted(row, np.arange(rows)), np.bincount(row, minlength=rows) > 0

    def per_row(self, x: np.ndarray) -> np.ndarray:
        """Sums over the terms of each document of a number for each term."""
        out = np.zeros(self.rows, np.float32)
        out[self.full] = np.add.reduceat(x[self.term], self.first[self.full])
        return out

    def per_term(self, x: np.ndarray) -> np.ndarray:
        """Sums over the documents of each term of a number for each document."""
        return np.add.reduceat(x[self.by_term], self.begin)


def learn(row: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> Factorization:
    """The machine for documents 0 to len(y) - 1; row ascends, and (row, bucket) are the buckets present, each once."""
    n = len(y)
    buckets, term, held = np.unique(bucket, return_inverse=True, return_counts=True)
    live = held >= LEAST
    rng = np.random.default_rng(SEED)
    # parameters by term: row 0 holds the weights, the others the components of the vectors
    p = np.concatenate([np.zeros((1, len(buckets))), rng.normal(0, SPREAD, (FACTORS, len(buckets)))]).astype(np.float32)
    m, s = np.zeros_like(p), np.zeros_like(p)
    cost = np.array([WEIGHT_COST] + [VECTOR_COST] * FACTORS, np.float32)[:, None]
    base, base_m, base_s, x = 0.0, 0.0, 0.0, None
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    for step in range(1, EPOCHS + 1):
        if step >= SETTLED and step % 10 == 0:
            live = p.any(0)
        if x is None or live.sum() < 0.8 * len(live):
            slot = np.cumsum(live) - 1
            kept = live[term]
            row, term = row[kept].astype(np.int32), slot[term[kept]].astype(np.int32)
            buckets, p, m, s = buckets[live], p[:, live], m[:, live], s[:, live]
            live = np.ones(len(buckets), bool)
            if not len(buckets):
                break
            x = _Matrix(row, term, n, len(buckets))
        sums = [x.per_row(v) for v in p[1:]]
        out = base + x.per_row(p[0]) + 0.5 * sum(q * q - x.per_row(v * v) for q, v in zip(sums, p[1:], strict=True))
        d = (each * (0.5 * (np.tanh(0.5 * out) + 1) - y)).astype(np.float32)
        alone = x.per_term(d)
        gradient = np.stack([alone, *(x.per_term(d * q) - alone * v for q, v in zip(sums, p[1:], strict=True))])
        m = 0.9 * m + 0.1 * gradient
        s = 0.999 * s + 0.001 * gradient * gradient
        base_m, base_s = 0.9 * base_m + 0.1 * float(d.sum()), 0.999 * base_s + 0.001 * float(d.sum()) ** 2
        base -= RATE * (base_m / (1 - 0.9**step)) / (np.sqrt(base_s / (1 - 0.999**step)) + 1e-8)
        rate = RATE / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        p = p - rate * (m / (1 - 0.9**step))
        # the step of the penalty, in the measure of the step of the gradient
        p = np.sign(p) * np.maximum(np.abs(p) - np.minimum(rate * cost, 1e3), 0)
    used = p.any(0)
    model = Factorization(buckets[used])
    model.base, model.w, model.v = float(base), p[0, used], p[1:, used]
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, modulus: int = 5, fold: int = 0) -> Factorization:
    common.configure(docs.sparkSession)
    sample = labelled.training_rows(docs, labels, "toxic", per_class, labelled.held_out(F.col("doc_id"), modulus, fold))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.Hasher()
        for block in common.blocks(batches, "text"):
            row, term = _present(*terms(block.column("text"), hasher), 1 << BITS)
            ends = np.searchsorted(row, np.arange(block.num_rows + 1)).tolist()
            own = [term[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("label"), pa.array(own, pa.binary())], names=["label", "terms"])

    rows = sorted((r.label, bytes(r.terms)) for r in sample.mapInArrow(encode, "label int, terms binary").collect())
    found = {label for label, _ in rows}
    if len(found) < 2:
        return Factorization(np.zeros(0, np.int64), float(next(iter(found), 0)))
    bucket = np.frombuffer(b"".join(own for _, own in rows), "<u4").astype(np.int32)
    return learn(common.per_row(np.array([len(own) // 4 for _, own in rows])), bucket, np.array([label for label, _ in rows], np.float32))


def score(docs: DataFrame, model: Factorization) -> DataFrame:
    """doc_id, score of every row."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.Hasher()
        for block in common.blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(model.score(block.column("text"), hasher), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Factorization, most: float) -> DataFrame:
    """The documents that score under most, unchanged: each is dropped or kept where it lies."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.Hasher()
        for block in common.blocks(batches, "text"):
            yield block.filter(pa.array(model.score(block.column("text"), hasher) < most))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", labelled.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
