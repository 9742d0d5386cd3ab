"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows fall into blocks by hash. The driver draws how many rows of each block go to each shard (a random
matrix with the block sizes and the exact shard sizes as margins; it holds one small number per block and
shard, no rows). Every block permutes its rows locally and deals them out by those numbers, and every
shard permutes what it received. The result is a uniform permutation whose shard sizes differ by one at most.

Only DataFrame and SQL functions touch rows. All keys are hashes of the row and a seed, so a recomputed task
deals the same. A block or slice holds about ``block_rows`` rows whatever the data (more from MOST_BLOCKS blocks on), since rows are placed by a
hash of id and text: neither a hot text nor a hot or null id piles up (only rows equal in both do).

Defined results: a null text counts no bytes (size 1) and has the CRC of the empty text; null ids and repeated
rows are placed like any others; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS = 50_000
#: Blocks of a small table, so that it still spreads over a cluster; and of a large one, which bounds the matrix on the
#: driver: blocks then hold more rows (1.5 million of 10^11), which a task sorts with spilling.
LEAST_BLOCKS, MOST_BLOCKS = 64, 65_536


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of draws items, taken without return, are good: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    top = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - top
    down = up = mode
    p_down = p_up = top
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Random counts with row sums blocks and column sums shards, as a uniform permutation would give."""
    rng, room = random.Random(seed), list(shards)
    out = []
    for rows in blocks:
        total, dealt = sum(room), []
        for k, free in enumerate(room):
            got = hypergeometric(rng, free, total - free, rows) if rows else 0
            total, rows = total - free, rows - got
            room[k] -= got
            dealt.append(got)
        out.append(dealt)
    return out


def shuffle_to_shards(docs: DataFrame, shards: int = 8, seed: int = 17, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    text = F.col(text_col)
    light = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col), text).alias("key"),
    )
    light = common.cut(light)
    rows = light.count()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, math.ceil(rows / block_rows)))
    order = ["doc_id", "size", "text_crc32"]
    light = light.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "key"), F.lit(blocks)).cast("int"))
    sizes = dict(light.groupBy("block").count().collect())
    sizes = [sizes.get(b, 0) for b in range(blocks)]
    drawn = matrix(sizes, [rows // shards + (s < rows % shards) for s in range(shards)], seed)
    # one number per block and shard, as text: a row of the matrix is the running sum of what each shard gets
    ends = ";".join(",".join(str(sum(row[: s + 1])) for s in range(shards)) for row in drawn)
    deal = spark.range(1).select(F.posexplode(F.split(F.lit(ends), ";")).alias("block", "ends"))
    deal = deal.select("block", F.split("ends", ",").cast("array<bigint>").alias("ends"))
    # local permutation, then the drawn number of rows to each shard
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit("local"), "key"), *order)
    dealt = light.withColumn("place", F.row_number().over(local)).join(deal, "block")
    dealt = dealt.select(
        *order, "key", F.size(F.filter("ends", lambda end: end < F.col("place"))).alias("shard"),
        F.pmod(F.shiftright(F.xxhash64(F.lit("slot"), "key"), 40), F.lit(blocks)).cast("int").alias("slice"),
    )
    dealt = common.cut(dealt)
    # permutation within the shard: random slices in order, rows of a slice in random order
    starts = dealt.groupBy("shard", "slice").count()
    starts = starts.withColumn("start", F.sum("count").over(Window.partitionBy("shard").orderBy("slice")) - F.col("count"))
    inner = Window.partitionBy("shard", "slice").orderBy(F.xxhash64(F.lit("slot"), "key"), *order)
    out = dealt.withColumn("place", F.row_number().over(inner)).join(starts.drop("count"), ["shard", "slice"])
    return out.select(
        *order, F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_to_shards(common.table(spark, sf_dir, "documents"))
