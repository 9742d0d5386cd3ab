"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Spark counts in how many documents each distinct word of the corpus (match of the pattern) is, and the words of HOT documents or more are
replayed once for the whole corpus: in each partition of the word table, the words are laid out as one array of
symbols, and an inverted index from merge rank to symbol positions replays every merge in rank order over all of them
at once, looking only at the neighbours of merged positions again. Their ids are broadcast; of more words than a bound
allows, those of most documents. The words beyond it, most of which occur in one place only, are replayed the same way with
the block of text that holds them: a word's ids do not depend on where it is replayed, so no text is ever shuffled.

The count splits words with the JVM's pattern engine, whose idea of white space is narrower; what it finds only decides what
is replayed once. Each text is split by the tokenizer's own pattern.

Defined results: null or empty text has no tokens (and decodes to empty bytes); repeated rows give repeated
rows; any further columns of the input pass through unless they clash with an output name, in which case the
output wins; an empty table gives an empty table. Texts are never cut.
"""

from __future__ import annotations

import base64
import collections
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of text whose words share one replay.
BLOCK_BYTES = 2_000_000
#: Further words whose ids a task keeps from block to block before it starts anew.
KNOWN_WORDS = 100_000
#: Documents that make a word one of the corpus; the words and bytes of words that are broadcast at most; the parts of
#: their table.
HOT, HOT_WORDS, HOT_BYTES, PARTS = 20, 100_000, 2_000_000, 6
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from a rank file (base64 token, blank, rank). The vocabulary has a fixed size."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Replay:
    """Merges of one vocabulary, applied to many words at once."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {token: i for i, token in enumerate(tokens) if token}
        self.byte = np.array([self.ids.get(bytes([b]), 0) for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ids.items():
            for at in range(1, len(token)):
                left, right = self.ids.get(token[:at]), self.ids.get(token[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64(2**62))
        self.ranks = np.append(np.array([pairs[k] for k in keys.tolist()], np.int32), _NONE)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two adjacent symbols form, or _NONE."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        whole = np.array([self.ids.get(w, -1) for w in words], np.int32)
        open_ = np.flatnonzero(whole < 0)
        size = np.array([len(words[i]) for i in open_.tolist()], np.int64)
        symbols, owner = self._merge(b"".join([words[i] for i in open_.tolist()]), size)
        counts = np.ones(len(words), np.int64)
        counts[open_] = np.bincount(owner, minlength=len(open_))
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        closed = np.flatnonzero(whole >= 0)
        out[first[closed]] = whole[closed]
        rank_in_word = np.arange(len(owner)) - np.searchsorted(owner, owner)
        out[first[open_][owner] + rank_in_word] = symbols
        return out, counts

    def _merge(self, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        owner = np.repeat(np.arange(len(size)), size)
        if not n:
            return np.zeros(0, np.int32), owner
        # one more slot at the end: writes to "no neighbour" land there
        symbol = np.append(self.byte[np.frombuffer(data, np.uint8)], np.int32(0))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(size)
        after[ends[size > 0] - 1] = n
        before[(ends - size)[size > 0]] = n
        pair = np.full(n + 1, _NONE, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        pair[inner] = self.rank(symbol[inner], symbol[after[inner]])

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(positions: np.ndarray) -> None:
            ranks = pair[positions]
            found = ranks != _NONE
            positions, ranks = positions[found], ranks[found]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, group in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                if rank in index:
                    index[rank].append(group)
                else:
                    index[rank] = [group]
                    heapq.heappush(heap, rank)

        post(inner)
        while heap:
            rank = heapq.heappop(heap)
            at = index.pop(rank)
            at = at[0] if len(at) == 1 else np.concatenate(at)
            at = np.sort(at[pair[at] == rank])
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            np.not_equal(at[1:], at[:-1], out=new[1:])
            at = at[new]
            word = owner[at]
            several = np.zeros(len(at), bool)
            several[1:] = word[1:] == word[:-1]
            if several.any():
                # in a word where a merge makes a pair of lower rank, that pair comes before further merges
                ahead, beyond = before[at], after[after[at]]
                low = (self.rank(symbol[ahead], np.full(len(at), rank)) < rank) & (ahead < n)
                low |= (self.rank(np.full(len(at), rank), symbol[beyond]) < rank) & (beyond < n)
                if self.rank(np.array([rank]), np.array([rank]))[0] < rank:
                    low[:] = True
                wait = np.isin(word, word[low]) & several
                # of overlapping hits in a run, every second one from the left
                joined = np.zeros(len(at), bool)
                joined[1:] = after[at[:-1]] == at[1:]
                place = np.arange(len(at))
                odd = (place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 1
                if wait.any():
                    index[rank] = [at[wait]]
                    heapq.heappush(heap, rank)
                at = at[~(odd | wait)]
            gone = after[at]
            beyond = after[gone]
            symbol[at] = rank
            pair[gone] = _NONE
            after[at] = beyond
            before[beyond] = at
            symbol[gone] = -1
            right = np.where(beyond < n, self.rank(symbol[at], symbol[beyond]), _NONE)
            pair[at] = right
            ahead = before[at]
            has = ahead < n
            ahead = ahead[has]
            pair[ahead] = self.rank(symbol[ahead], symbol[at[has]])
            pair[n] = _NONE
            post(np.concatenate([at, ahead]))
        kept = np.flatnonzero(symbol[:n] >= 0)
        return symbol[kept], owner[kept]


class Known:
    """Numbers of words as they come, their ids one after the other, and the count of ids of each."""

    def __init__(self, hot: tuple[list[str], bytes, bytes]):
        words, ids, counts = hot
        self.number = collections.defaultdict(itertools.count(len(words)).__next__, zip(words, itertools.count()))
        self.ids, self.counts = np.frombuffer(ids, "<u4"), np.frombuffer(counts, np.int64)


def corpus_words(docs: DataFrame, tokens: list[bytes], pattern: str, text_col: str = "text") -> tuple[list[str], bytes, bytes]:
    """The hot words of the corpus, their ids and counts of ids, replayed in the partitions of the word table."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)))
    words = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= HOT) & (F.length("word") > 1))
    made = common.cut(words)
    # the least power of two such that the words of so many documents keep within the bounds
    power = F.floor(F.log2("n")).cast("int")
    sizes = made.groupBy(power.alias("power")).agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes")).orderBy(F.desc("power")).collect()
    least, words_, bytes_ = 64, 0, 0
    for r in sizes:
        words_, bytes_ = words_ + r.words, bytes_ + r.bytes
        if words_ > HOT_WORDS or bytes_ > HOT_BYTES:
            break
        least = r.power

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = None
        for batch in batches:
            replay = replay or Replay(tokens)
            ids, counts = replay.words([w.encode() for w in batch.column("word").to_pylist()])
            ends = np.cumsum(counts)
            packed = [ids[e - c : e].astype("<u4").tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(packed, pa.binary())], names=["word", "ids"])

    hot = made.where(power >= least).select("word").repartition(PARTS, "word").mapInArrow(replayed, "word string, ids binary")
    rows = sorted(hot.collect())
    common.drop(made)
    return [r.word for r in rows], b"".join(bytes(r.ids) for r in rows), np.array([len(r.ids) // 4 for r in rows], np.int64).tobytes()


def _encoder(tokens: list[bytes], pattern: str, text_col: str, schema: pa.Schema, sent):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, replay = regex.compile(pattern).findall, Replay(tokens)
        words = Known(sent.value)
        for block in common.blocks(batches, text_col, BLOCK_BYTES):
            if len(words.number) > KNOWN_WORDS + HOT_WORDS:
                words = Known(sent.value)
            known = len(words.counts)
            look = words.number.__getitem__
            rows = [np.fromiter(map(look, split(t or "")), np.int32) for t in block.column(text_col).to_pylist()]
            new, size = replay.words([w.encode() for w in itertools.islice(words.number, known, None)])
            words.ids, words.counts = np.append(words.ids, new.astype("<u4")), np.append(words.counts, size)
            flat, counts = words.ids, words.counts
            first = np.cumsum(counts) - counts
            packed, totals = [], []
            for row in rows:
                n = counts[row]
                total = int(n.sum())
                # position of each id: the start of its word, and its place in the word
                place = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                packed.append(flat[np.repeat(first[row], n) + place].tobytes())
                totals.append(total)
            made = {"n_tokens": pa.array(totals, pa.int64()), "ids": pa.array(packed, pa.binary())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else block.column(f.name) for f in schema], schema=schema)

    return encode


def _decoder(tokens: list[bytes], ids_col: str, schema: pa.Schema):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = tokens.__getitem__
        for batch in batches:
            out = [b"".join(map(get, np.frombuffer(ids or b"", "<u4").tolist())) for ids in batch.column(ids_col).to_pylist()]
            made = {"decoded": pa.array(out, pa.binary())}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in schema], schema=schema)
        common.release()

    return decode


def _extended(df: DataFrame, extra: list[T.StructField]) -> T.StructType:
    names = {f.name for f in extra}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + extra)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, text_col: str = "text") -> DataFrame:
    """The input with ``n_tokens`` (long) and ``ids`` (binary: little-endian unsigned 32-bit ids). Counts the words of all docs first."""
    common.configure(docs.sparkSession)
    schema = _extended(docs, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    sent = docs.sparkSession.sparkContext.broadcast(corpus_words(docs, tokens, pattern, text_col))
    return docs.mapInArrow(_encoder(tokens, pattern, text_col, _arrow(schema), sent), schema)


def decode(encoded: DataFrame, tokens: list[bytes], ids_col: str = "ids") -> DataFrame:
    """The input with ``decoded`` (binary): the bytes that the ids stand for. Null ids decode to empty bytes."""
    common.configure(encoded.sparkSession)
    schema = _extended(encoded, [T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(_decoder(tokens, ids_col, _arrow(schema)), schema)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, by a full encode and decode."""
    import public_tokenizers

    tokens = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    common.configure(docs.sparkSession)
    # both steps in one worker: the decoder reads nothing but the encoder's ids
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    whole = T.StructType([*schema.fields, T.StructField("decoded", T.BinaryType())])
    pattern = pattern or public_tokenizers.PATTERN
    sent = docs.sparkSession.sparkContext.broadcast(corpus_words(docs, tokens, pattern))
    encode_, decode_ = _encoder(tokens, pattern, "text", _arrow(schema), sent), _decoder(tokens, "ids", _arrow(whole))
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: decode_(encode_(batches)), whole)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
