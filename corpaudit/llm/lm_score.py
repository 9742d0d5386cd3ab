"""Cross-entropy difference: documents scored by how much better a target model predicts them than a background one.

Both models are word bigram models with back-off to unigrams, over one vocabulary and one set of bigrams
(Moore and Lewis, 2010), counted over all documents. Every word and every bigram of LEAST occurrences is in the models,
whatever the size of the corpus; other words are one unknown word, other bigrams back off.

The models are never held in one place. Documents are put into blocks by a hash. A block sends its distinct words, in
ascending order and cut into shards of the hash range; a shard adds up the counts of all blocks and answers each
block with the totals of the block's own words, in their order. Bigrams of the words then known take the same way.
So a task holds one block or one shard, both bounded in size, of which a larger corpus has more; a block and a shard
exchange a row only where they share keys, so there are never more rows than keys. Sums over all words are one broadcast row.
The difference of the two losses per token, averaged, is the document's score: above zero it reads like the target.

Defined results: null, empty and wordless texts have no tokens and null losses and score; repeated rows count and score
each; null ids are scored, and are not in the target; an empty target gives a uniform target model; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least count of words and bigrams in the models, at any size of the corpus.
LEAST = 2
#: Weight of the bigram estimate, and what is added to each unigram count.
LAMBDA, ALPHA = 0.6, 0.5
#: So many target ids are broadcast at most; more are joined by a shuffle.
IDS = 2_000_000
#: Bytes of text in a block, on average; there are as many shards as blocks.
SCORED_BYTES = 8_000_000
#: Stand for the start of a text and for the unknown word among the hashes of words.
START, UNKNOWN = 1, 2
SEPARATORS = common.byte_mask(common.SPACES)
_PARTS = "shard long, block long, keys binary, counts binary"
_TOTALS = "block long, shard long, kind long, totals binary"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("loss_background", pa.float64()), ("loss_target", pa.float64()), ("score", pa.float64())])
#: Words have counts as a word and as a predecessor, bigrams one, in background and target each.
_WORDS, _PAIRS, KINDS = 0, 1, (4, 2)
_SUMS = [f"s{i}" for i in range(1 + 2 * KINDS[_WORDS])]


def _pack(x: np.ndarray) -> bytes:
    """The bytes of the numbers, all first ones before all second ones: the leading zeros compress."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(x.size, x.itemsize).T).tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _parts(block: int, shards: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
    """A row for each shard that has keys: ascending keys as differences, and their counts (a row for each kind of count)."""
    cuts = np.searchsorted(keys, np.array([-(-(i << 64) // shards) for i in range(1, shards)], np.uint64))
    ends = [0, *cuts.tolist(), len(keys)]
    own = [i for i in range(shards) if ends[i] < ends[i + 1]]
    spans = [slice(ends[i], ends[i + 1]) for i in own]
    columns = [own, [block] * len(own), [_pack(np.diff(keys[x], prepend=np.uint64(0))) for x in spans], [_pack(counts[:, x].astype(np.uint32)) for x in spans]]
    return pa.table(dict(zip(("shard", "block", "keys", "counts"), map(pa.array, columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary())), strict=True)))


def _summed(table: pa.Table, kind: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of a shard: how many keys each block has, where each is among the distinct keys, and the totals of these."""
    columns = table.to_pydict()
    keys = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in columns["keys"]]
    counts = [_unpack(x, np.uint32).reshape(KINDS[kind], -1) for x in columns["counts"]]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    return [len(k) for k in keys], at, np.array([np.bincount(at, c) for c in np.concatenate(counts, axis=1)]).astype(np.int64)


def _add(kind: int):
    """Totals of a shard's keys, to each block those of its own keys."""

    def run(table: pa.Table) -> pa.Table:
        sizes, at, totals = _summed(table, kind)
        ends = np.cumsum([0, *sizes])
        own = [_pack(totals[:, at[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        del at, totals
        common.release()
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "kind": [kind] * len(own), "totals": pa.array(own, pa.binary())})

    return run


def _sums(table: pa.Table) -> pa.Table:
    """Of a shard's words: how many are known, and the counts of all and of the others."""
    totals = _summed(table, _WORDS)[2]
    known, rest = totals[0] >= LEAST, (totals[0] > 0) & (totals[0] < LEAST)
    return pa.table([pa.array([int(x)]) for x in (known.sum(), *totals.sum(1), *totals[:, rest].sum(1))], names=_SUMS)


def _keys(past: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One hash of each bigram."""
    return common.mix(common.mix(past, 5) + word, 6)


class Block:
    """The tokens of a block's documents in one row of hashes, and each token's predecessor; a text's first follows START."""

    def __init__(self, docs: pa.Table):
        hasher, words, firsts, self.number = common.Hasher(), [], [], docs.column("block")[0].as_py()
        for part in common.blocks(docs.combine_chunks().to_batches(), "text"):
            data, offsets = common.utf8(part.column("text"))
            starts, ends, first = common.words(data, offsets, SEPARATORS)
            words.append(hasher.spans(data, starts, ends))
            firsts.append(np.diff(first))
        self.tokens = np.concatenate(firsts)
        self.word = np.concatenate(words)
        self.first = np.append(0, np.cumsum(self.tokens))
        self.past = np.empty_like(self.word)
        self.past[1:] = self.word[:-1]
        self.past[self.first[:-1][self.tokens > 0]] = START
        row = common.per_row(self.tokens)
        self.weights = [np.asarray(docs.column(c))[row] for c in ("background", "target")]
        self.words, at = np.unique(np.concatenate([self.word, self.past]), return_inverse=True)
        at = at.astype(np.int32)
        self.at_word, self.at_past = at[: len(self.word)], at[len(self.word) :]
        self.word = self.past = None

    def word_counts(self) -> np.ndarray:
        """Counts in background and target as a word, and as a predecessor."""
        return np.array([np.bincount(at, w, len(self.words)) for at in (self.at_word, self.at_past) for w in self.weights])

    def learn(self, totals: pa.Table) -> None:
        """Take the totals of the words; unknown ones get those of all unknown words."""
        self.totals = _received(totals, _WORDS, len(self.words))
        sums = next((np.array(r["sums"], np.int64) for r in totals.select(["kind", "sums"]).to_pylist() if r["kind"] == _WORDS), np.zeros(len(_SUMS), np.int64))
        known = (self.totals[0] >= LEAST) | (self.words == START)
        self.size, self.all = sums[0], sums[1:5]
        self.totals = np.where(known, self.totals, sums[5:, None])
        named = np.where(known, self.words, np.uint64(UNKNOWN))
        self.pairs, self.at_pair = np.unique(_keys(named[self.at_past], named[self.at_word]), return_inverse=True)
        self.at_pair = self.at_pair.astype(np.int32)
        common.release()

    def losses(self, totals: pa.Table) -> np.ndarray:
        """Summed losses of each document under background and target."""
        pairs = _received(totals, _PAIRS, len(self.pairs))
        kept, out = pairs[0] >= LEAST, []
        for k in (0, 1):
            single = (self.totals[k] + ALPHA) / (self.all[k] + ALPHA * (self.size + 1))
            pair = np.where(kept, pairs[k], 0)[self.at_pair] / np.maximum(self.totals[2 + k], 1)[self.at_past]
            total = np.append(0, np.cumsum(-np.log(LAMBDA * pair + (1 - LAMBDA) * single[self.at_word])))
            out.append(total[self.first[1:]] - total[self.first[:-1]])
        return np.column_stack(out)


def _received(table: pa.Table, kind: int, size: int) -> np.ndarray:
    """The totals of a block's keys in their order."""
    rows = sorted((r for r in table.select(["kind", "shard", "totals"]).to_pylist() if r["kind"] == kind), key=lambda r: r["shard"])
    totals = np.concatenate([np.zeros((KINDS[kind], 0), np.int64), *(_unpack(r["totals"], np.int64).reshape(KINDS[kind], -1) for r in rows)], axis=1)
    if totals.shape[1] != size:
        raise ValueError("the documents changed between two reads")
    return totals


class Model:
    """What the models learn from: all documents, and the ids of the target. They are counted when documents are scored."""

    def __init__(self, docs: DataFrame, ids: DataFrame):
        self.docs, self.ids = docs, ids

    def rows(self) -> DataFrame:
        out = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(1).cast("long").alias("background"))
        return out.join(self.ids, "doc_id", "left").select("doc_id", "text", "background", F.coalesce("target", F.lit(0)).cast("long").alias("target"))


def fit(docs: DataFrame, target: DataFrame) -> Model:
    """docs: all documents; target: the ids (doc_id) of those that the target model learns from."""
    common.configure(docs.sparkSession)
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return Model(docs, common.bounded(ids.withColumn("target", F.lit(1)), IDS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, loss_background, loss_target, score (background less target) per token, for every row."""
    common.configure(docs.sparkSession)
    rows = model.rows().withColumn("scored", F.lit(True))
    if not docs.sameSemantics(model.docs):
        none = F.lit(0).cast("long")
        new = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", none.alias("background"), none.alias("target"), F.lit(True).alias("scored"))
        rows = rows.withColumn("scored", F.lit(False)).union(new)
    size = sum(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for d in (docs, model.docs)[: 1 + (not docs.sameSemantics(model.docs))])
    n = math.ceil(size / SCORED_BYTES) or 1
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long").alias("block"), "doc_id", "text", "background", "target", "scored")

    def word_parts(docs: pa.Table) -> pa.Table:
        block = Block(docs)
        return _parts(block.number, n, block.words, block.word_counts())

    def pair_parts(docs: pa.Table, totals: pa.Table) -> pa.Table:
        block = Block(docs)
        block.learn(totals)
        return _parts(block.number, n, block.pairs, np.array([np.bincount(block.at_pair, w, len(block.pairs)) for w in block.weights]))

    def scores(docs: pa.Table, totals: pa.Table) -> pa.Table:
        block = Block(docs)
        block.learn(totals)
        loss, none = block.losses(totals), block.tokens == 0
        mean = np.round(loss / np.maximum(block.tokens, 1)[:, None], 9)
        columns = [pa.array(x, mask=none) for x in (mean[:, 0], mean[:, 1], mean[:, 0] - mean[:, 1])]
        out = pa.Table.from_arrays([docs.column("doc_id"), pa.array(block.tokens), *columns], schema=_SCORES)
        return out.filter(docs.column("scored"))

    parts = rows.groupBy("block").applyInArrow(word_parts, _PARTS).groupBy("shard")
    sums = parts.applyInArrow(_sums, ", ".join(f"{c} long" for c in _SUMS)).agg(F.array(*(F.coalesce(F.sum(c), F.lit(0)) for c in _SUMS)).alias("sums"))
    words = parts.applyInArrow(_add(_WORDS), _TOTALS).crossJoin(F.broadcast(sums))
    pairs = rows.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(pair_parts, _PARTS).groupBy("shard").applyInArrow(_add(_PAIRS), _TOTALS)
    known = words.union(pairs.withColumn("sums", F.lit(None).cast("array<bigint>")))
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scores, "doc_id long, n_tokens long, loss_background double, loss_target double, score double")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of good quality."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels").where("quality = 1")))
