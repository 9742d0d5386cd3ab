"""Shared helpers: scratch tables, Arrow text blocks, vectorised word hashing, connected components.

Text is read straight from Arrow's UTF-8 buffers, so a task never builds a Python string per word.
Blocks are bounded in bytes (one row at least), which bounds a task's memory.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: long texts make a batch of Spark's default of 10,000 rows too large.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000
#: Bytes of text that a task works on at once.
BLOCK_BYTES = 1_000_000
#: Bytes that separate words: space and the controls 9 to 13.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def configure(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes; nothing else in the session changes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system, for workers that wait for their next task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: The stand-in folder of this process, once made. A plain value: the module travels to executors by value.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        found = _LOCAL[0]
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing lazy reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, rows: int, bytes_: int = 64_000_000) -> DataFrame:
    """Mark a small written table for broadcast after counting its rows and bytes; a larger one is left to a shuffle join."""
    sizes = [F.octet_length(f.name) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    total = df.agg(F.count("*").alias("n"), *(F.sum(s).alias(f"s{i}") for i, s in enumerate(sizes))).first()
    return F.broadcast(df) if total[0] <= rows and sum(x or 0 for x in total[1:]) <= bytes_ else df


# ---------------------------------------------------------------- text blocks


def blocks(batches: Iterable[pa.RecordBatch], column: str, budget: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold budget bytes at most, or one row."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        first = total = 0
        for row, bytes_ in enumerate(size.tolist()):
            if row > first and total + bytes_ > budget:
                yield batch.slice(first, row - first)
                first, total = row, 0
            total += bytes_
        if batch.num_rows > first:
            yield batch.slice(first)
    release()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_mask(members: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(members)] = True
    return mask


#: A-Z to a-z, all other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; seeds give independent orders of the same values."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """64-bit hashes of byte spans, many at a time, eight bytes a step.

    Equal bytes give equal hashes. Of spans up to eight bytes no two of one length collide; of others any two do with a
    chance of about 2^-64, whatever their bytes: every step mixes all bits, and long spans take a cryptographic hash.
    """

    def __init__(self, fold: np.ndarray = FOLD):
        self.fold = fold

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]."""
        return self.several(data, starts, [ends])[0]

    def several(self, data: np.ndarray, starts: np.ndarray, each: list[np.ndarray]) -> list[np.ndarray]:
        """Hashes of data[start:end] for several ends of each start."""
        folded = np.zeros(len(data) + 8, np.uint8)
        folded[: len(data)] = self.fold[data]
        eight = np.ndarray((len(data) + 1,), "<u8", folded, strides=(1,))
        return [self._hash(folded, eight, starts, ends) for ends in each]

    @staticmethod
    def _hash(folded: np.ndarray, eight: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = mix(size.astype(np.uint64), 77)
        long = np.flatnonzero(size > _LONG)
        for i in long.tolist():
            digest = hashlib.blake2b(folded[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        todo = np.flatnonzero((size > 0) & (size <= _LONG))
        at, left = starts[todo], size[todo]
        while len(todo):
            # of the last bytes, those past the end are shifted out
            over = (8 * np.maximum(8 - left, 0)).astype(np.uint64)
            out[todo] = mix(out[todo] ^ (eight[at] << over), 78)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the first word of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    after[edge] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_row(counts: np.ndarray) -> np.ndarray:
    """Row numbers repeated by count."""
    return np.repeat(np.arange(len(counts)), counts)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


# ------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): the smallest node reachable from each.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until nothing changes: each is a minimum
    per node and a join back to its edges, so no neighbourhood is ever gathered in one place. Nodes without an edge
    are absent from the result. Null ends and loops are ignored.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # large star: neighbours above a node are tied to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and the node, are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, edges = edges, cut(small.where("u <> v").distinct())
        drop(before)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
