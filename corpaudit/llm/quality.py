"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by how its bytes and words are made up
(never by id, language or source); a small network embeds it, gated attention (Ilse et al., 2018) weighs the
passages, and the weighted mean of the embeddings is scored. Attention and score are learned together
from document labels alone, on a bounded balanced sample; scoring reads every passage of every document in place.

Defined results: null, empty and wordless texts are one empty passage and get that passage's score; repeated
rows score alike; a null doc_id is never held out; if the sample lacks a class, every score is the share of the
other (0.5 without any label); extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

PASSAGE = 64
#: Documents of each label that the fit sees at most, and passages of one document (larger ones are left to scoring).
PER_CLASS, MOST_PASSAGES = 1500, 2000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 16, 120, 0.02, 1e-3, 5
SEPARATORS = common.byte_mask(common.SPACES)

#: Byte classes of the encoding.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\t\r\x0b\x0c", ".,;:'\"-()", "!?", "|", "#$%&*+/<=>@[\\]^_`{}~"]
_OF_BYTE = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES):
    _OF_BYTE[list(_members.encode())] = _i
_N = len(_CLASSES) + 1


def encode(column: pa.Array, hasher: common.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each row (one at least)."""
    data, offsets = common.utf8(column)
    starts, ends, first = common.words(data, offsets, SEPARATORS)
    count = np.diff(first)
    # the last words join the passage before them if they are too few for their own
    bags = np.maximum(1, (count + PASSAGE // 2) // PASSAGE)
    row = common.per_row(bags)
    place = np.arange(len(row)) - (np.cumsum(bags) - bags)[row]
    low = first[:-1][row] + place * PASSAGE
    high = np.where(place == bags[row] - 1, first[1:][row], low + PASSAGE)
    size = high - low
    of_word = common.per_row(size)
    p = len(row)
    words = np.maximum(size, 1).astype(np.float64)
    # bytes of words and the gaps after them, by class
    gap = np.append(starts[1:], len(data)) if len(starts) else starts
    last = np.zeros(len(starts), bool)
    last[high[size > 0] - 1] = True
    gap = np.where(last, ends, gap)
    span = gap - starts
    if len(starts):
        at = np.arange(int(span.sum())) + np.repeat(starts - (np.cumsum(span) - span), span)
        made = np.bincount(np.repeat(of_word, span) * _N + _OF_BYTE[data[at]], minlength=p * _N).reshape(p, _N)
    else:
        made = np.zeros((p, _N))
    share = made / np.maximum(made.sum(1, keepdims=True), 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(of_word, length, p) / words
    spread = np.sqrt(np.maximum(np.bincount(of_word, length * length, p) / words - mean * mean, 0))
    hashes = hasher.spans(data, starts, ends)
    key = np.sort(of_word.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=p) / words
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    short = np.bincount(of_word, length <= 3, p) / words
    final = data[ends - 1] if len(ends) else data
    odd = np.bincount(of_word, (_OF_BYTE[final] >= 6) & (_OF_BYTE[final] < _N - 1), p) / words
    stop = np.bincount(of_word, _OF_BYTE[final] == 5, p) / words
    out = np.column_stack([np.sqrt(share), np.minimum(mean, 30) / 10, np.minimum(spread, 30) / 10, distinct, np.bincount(of_word, again, p) / words, short, odd, stop, np.minimum(size, PASSAGE) / PASSAGE, size == 0])
    return out.astype(np.float32), bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Attention:
    """The network; its parameters are a few hundred numbers."""

    def __init__(self, features: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        w = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.shift, self.scale = np.zeros(features), np.ones(features)
        self.p = {"W": w(features, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": w(HIDDEN, HIDDEN), "U": w(HIDDEN, HIDDEN), "a": w(HIDDEN), "c": w(HIDDEN), "d": np.zeros(1, np.float32)}
        self.constant = None

    def _forward(self, x: np.ndarray, begin: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        weight = e / np.add.reduceat(e, begin)[bag]
        z = np.add.reduceat(weight[:, None] * h, begin, axis=0)
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(bags):
            return np.full(len(bags), self.constant if self.constant is not None else 0.5)
        return self._forward(((x - self.shift) / self.scale).astype(np.float32), np.cumsum(bags) - bags, common.per_row(bags))["score"]

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> Attention:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-3
        x, begin, bag = ((x - self.shift) / self.scale).astype(np.float32), np.cumsum(bags) - bags, common.per_row(bags)
        each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
        p, m, v = self.p, {}, {}
        for step in range(1, EPOCHS + 1):
            f = self._forward(x, begin, bag)
            h, t, g, weight = f["h"], f["t"], f["g"], f["weight"]
            ds = each * (f["score"] - y.astype(np.float32))
            dz = ds[:, None] * p["c"]
            da = (h * dz[bag]).sum(1)
            de = weight * (da - np.add.reduceat(weight * da, begin)[bag])
            dtg = de[:, None] * p["a"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = (weight[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grads = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}
            for k, grad in grads.items():
                grad = grad + DECAY * p[k] / len(bags) * 100
                m[k] = 0.9 * m.get(k, 0) + 0.1 * grad
                v[k] = 0.999 * v.get(k, 0) + 0.001 * grad * grad
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = common.Hasher()
    for block in common.blocks(batches, "text"):
        x, bags = encode(block.column("text"), hasher)
        ends = np.cumsum(bags)
        rows = [x[e - n : e].tobytes() for e, n in zip(ends.tolist(), bags.tolist(), strict=True)]
        keep = pa.array(bags <= MOST_PASSAGES)
        yield pa.RecordBatch.from_arrays([block.column("label"), pa.array(bags), pa.array(rows, pa.binary())], names=["label", "bags", "x"]).filter(keep)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, modulus: int = 4, fold: int = 2) -> Attention:
    common.configure(docs.sparkSession)
    sample = labelled.training_rows(docs, labels, "quality", per_class, labelled.held_out(F.col("doc_id"), modulus, fold))
    rows = sorted(sample.mapInArrow(_bags, "label int, bags long, x binary").collect(), key=lambda r: (r.label, bytes(r.x)))
    features = len(encode(pa.array([""]), common.Hasher())[0][0])
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, features).astype(np.float64)
    return Attention(features).fit(x, np.array([r.bags for r in rows], np.int64), np.array([r.label for r in rows], np.float64))


def _scores(model: Attention, column: pa.Array, hasher: common.Hasher) -> np.ndarray:
    return model.score(*encode(column, hasher)) if len(column) else np.zeros(0)


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """doc_id, score of every row."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.Hasher()
        for block in common.blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(_scores(model, block.column("text"), hasher), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Attention, least: float) -> DataFrame:
    """The documents that score least or more, unchanged: each is dropped or kept where it lies."""
    common.configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.Hasher()
        for block in common.blocks(batches, "text"):
            yield block.filter(pa.array(_scores(model, block.column("text"), hasher) >= least))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", labelled.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
