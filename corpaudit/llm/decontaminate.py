"""Benchmark decontamination by pigeonhole edit matching.

A test item of w words may differ from a passage by k = floor(rate * w) word edits. Split into k + 1 pieces,
at least one piece then occurs in the passage unchanged. All windows of a text are hashed and looked up among
the hashed pieces; each hit is verified by Myers' bit-parallel edit distance of the item against the text
around it. Words are runs of letters and digits in lower case, so case, punctuation and spacing do not count.

Documents are read once in place: no shuffle, memory bounded by a block of text. The benchmark goes out in blocks
of bounded size, one pass over the documents for each (one block for usual benchmarks).

Defined results: null, empty or wordless texts and items match nothing; items under five words have a budget of no edits, so they are
found as exact runs of words; where ``min_words`` is set (off by default), items of fewer words match only a text that has the same
words and no others;
repeated documents and items each give their rows; extra columns are ignored by find_leaks and kept by decontaminate;
empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE = 0.2
#: Items of fewer words match whole texts only; 0: no such limit.
MIN_WORDS = 0
#: Words of benchmark items that one pass over the documents looks for.
BLOCK_WORDS = 2_000_000
#: A piece is looked up by its first words, so many at most; the verification sees all of it.
KEY_WORDS = 6
_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
SEPARATORS = ~common.byte_mask(_LETTERS)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def myers(item: list[int], text: list[int]) -> tuple[int, int]:
    """Smallest edit distance of item to any run of text, and the end of the first such run."""
    size = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, word in enumerate(item):
        peq[word] |= 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best, end = full, 0, size, size, 0
    for place, word in enumerate(text, 1):
        eq = peq.get(word, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(cross | up) & full
        minus = up & cross
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        diagonal = eq | down
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if score < best:
            best, end = score, place
    return best, end


def _lower(texts: pa.Array) -> pa.Array:
    """Letter by letter, so that a word is the same wherever it stands: the final sigma is a sigma."""
    return pc.replace_substring(pc.utf8_lower(texts), "ς", "σ")


class Items:
    """One block of benchmark items: their words and the index of their pieces."""

    def __init__(self, rows: list[tuple[int, str]], rate: float, min_words: int):
        hasher = common.Hasher()
        self.min_words = min_words
        texts = _lower(pa.array([text for _, text in rows], pa.string()))
        data, offsets = common.utf8(texts)
        starts, ends, first = common.words(data, offsets, SEPARATORS)
        hashes = hasher.spans(data, starts, ends).tolist()
        self.items, keys = [], defaultdict(list)
        for (item_id, _), a, b in zip(rows, first[:-1].tolist(), first[1:].tolist(), strict=True):
            size = b - a
            if not size:
                continue
            budget = int(rate * size) if size >= min_words else 0
            number = len(self.items)
            self.items.append((item_id, hashes[a:b], budget))
            cuts = [size * i // (budget + 1) for i in range(budget + 2)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                take = min(end - begin, KEY_WORDS)
                key = 0
                for word in hashes[a + begin : a + begin + take]:
                    key = (key * int(_STEP) + word) % 2**64
                keys[take].append((key, number, begin))
        self.keys = {}
        for take, found in keys.items():
            found.sort()
            key = np.array([f[0] for f in found], np.uint64)
            mask = np.zeros(1 << 20, bool)
            mask[(common.mix(key) >> np.uint64(44)).astype(np.int64)] = True
            self.keys[take] = (key, [f[1:] for f in found], mask)

    def find(self, column: pa.Array, hasher: common.Hasher) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, distance, first word, end word) of each item that a text holds, best place only."""
        data, offsets = common.utf8(_lower(pc.fill_null(column, "")))
        starts, ends, first = common.words(data, offsets, SEPARATORS)
        hashes = hasher.spans(data, starts, ends)
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        rolled = np.zeros(len(hashes), np.uint64)
        for take in range(1, max(self.keys, default=0) + 1):
            n = len(hashes) - take + 1
            if n <= 0:
                break
            rolled = rolled[:n] * _STEP + hashes[take - 1 :]
            if take not in self.keys:
                continue
            key, owners, mask = self.keys[take]
            hit = np.flatnonzero(mask[(common.mix(rolled) >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(key, rolled[hit]), np.searchsorted(key, rolled[hit], "right")
            row = np.searchsorted(first, hit, "right") - 1
            inside = (high > low) & (hit + take <= first[row + 1])
            for at, a, b, r in zip(hit[inside].tolist(), low[inside].tolist(), high[inside].tolist(), row[inside].tolist(), strict=True):
                for number, begin in owners[a:b]:
                    places[r, number].add(at - begin)
        out = []
        for (row, number), begins in places.items():
            item_id, item, budget = self.items[number]
            begin_row, end_row = int(first[row]), int(first[row + 1])
            if len(item) < self.min_words and end_row - begin_row != len(item):
                continue
            best, seen = None, begin_row
            for begin in sorted(begins):
                low, high = max(begin - budget, begin_row), min(begin + len(item) + budget, end_row)
                if high <= seen and best is not None:
                    continue
                distance, end = myers(item, hashes[low:high].tolist())
                seen = high
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, low - begin_row, low + end - begin_row)
                    if not distance:
                        break
            if best:
                out.append((row, item_id, *best))
        return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size, each sent to all tasks of one pass."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = items.agg(F.sum(F.length("text") / 4)).first()[0] or 0
    blocks = max(1, int(words // block_words) + 1)
    for block in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, first_word, end_word for each test item that a document holds."""
    spark = docs.sparkSession
    common.configure(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    out = None
    for rows in item_blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hasher, items = common.Hasher(), Items(sent.value, rate, min_words)
            for block in common.blocks(batches, "text"):
                found = items.find(block.column("text"), hasher)
                if found:
                    rows_, *rest = zip(*found, strict=True)
                    ids = block.column("doc_id").take(pa.array(rows_))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, f.type) for v, f in zip(rest, list(schema)[1:], strict=True))], schema=schema)

        part = own.mapInArrow(run, "doc_id long, item_id long, distance int, first_word long, end_word long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """The documents that hold no test item, unchanged: each is dropped or kept where it lies."""
    spark = docs.sparkSession
    common.configure(spark)
    for rows in item_blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hasher, items = common.Hasher(), Items(sent.value, rate, min_words)
            for block in common.blocks(batches, text_col):
                keep = np.ones(block.num_rows, bool)
                keep[[f[0] for f in items.find(block.column(text_col), hasher)]] = False
                yield block.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
