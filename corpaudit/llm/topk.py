"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block. A pass does not keep the scores: each task counts those of a
query in bins of a range that holds its k-th best score, the counts are summed over all tasks, and the bin
where the k-th score lies becomes the range of the next pass. A query is settled when its bin is one score wide, or when few
enough scores reach it. A last pass keeps only the scores from that bin on; ties go to the smaller id.

Scores are inner products of integers, exact in whatever type holds them. Rows stay where they are, in packed blocks;
what travels to them are the blocks of queries, in rounds of a bounded size, and back come counts. No pass
keeps more than k rows of a block for a query, however many tie, and those it drops have k better ones in their own block.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; a shorter vector counts as
filled up with zeros; rows that repeat an id are candidates of their own, but never for that id, and as a query the least of
its vectors counts; scores beyond 2^61 count as 2^61; an empty table or query set gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bins of a pass, and how many scores settle a query as soon as no more reach its bin.
BINS, ENOUGH = 256, 64
#: Rows of a block of candidates and of queries, and bytes of either.
ROWS, QUERY_ROWS, BYTES = 4096, 1024, 2_000_000
#: Bytes of query blocks that are broadcast in one round.
ROUND_BYTES = 32_000_000
#: Largest absolute score.
MOST = 2**61

_PACKED = "ids binary, n int, dims int, kind string, data binary, top double, norm double"


def scaled(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as a whole double; null if the vector takes no part."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # from 2^52 on a double is whole
    whole = lambda y: F.when(F.abs(y) < 2**52, F.floor(y).cast("double")).otherwise(F.greatest(F.lit(-1e300), F.least(F.lit(1e300), y)))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(wide, lambda x: whole(x * scale)))


def _pack(ids: list[np.ndarray], values: list[np.ndarray], sizes: list[np.ndarray]) -> list:
    """One block: ids, and the vectors filled up to one length, in the smallest type that holds them."""
    ids, values, sizes = (np.concatenate(x) for x in (ids, values, sizes))
    dims = int(sizes.max(initial=0))
    table = np.zeros((len(ids), dims))
    starts = np.cumsum(sizes) - sizes
    rows = common.per_row(sizes)
    table[rows, np.arange(len(values)) - starts[rows]] = values
    top = float(np.abs(table).max(initial=0))
    kind = "i2" if top < 2**15 else "i4" if top < 2**31 else "f8"
    with np.errstate(over="ignore"):
        norm = float(np.sqrt((table * table).sum(1)).max(initial=0))
    return [ids.astype("<i8").tobytes(), len(ids), dims, kind, table.astype(kind).tobytes(), top, norm]


def packed(rows: DataFrame, most: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of rows (vec_id, v, and further long columns, which become binary), never across tasks."""
    names = [f.split()[0] for f in _PACKED.split(", ")] + list(extra)
    schema = _PACKED + "".join(f", {c} binary" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size = [], 0, 0

        def out() -> pa.RecordBatch:
            block = _pack([h[0] for h in held], [h[1] for h in held], [h[2] for h in held]) + [np.concatenate([h[3][c] for h in held]).tobytes() for c in extra]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in block[:1]] + [pa.array([block[1]], pa.int32()), pa.array([block[2]], pa.int32())] + [pa.array([x]) for x in block[3:]], names=names)

        for batch in batches:
            wide = batch.column("v")
            lengths = np.diff(np.asarray(wide.offsets, np.int64))
            for at in range(0, batch.num_rows, 256):
                part = slice(at, at + 256)
                piece = batch.slice(at, 256)
                values = np.asarray(piece.column("v").flatten(), np.float64)
                if held and (count + piece.num_rows > most or size + 2 * len(values) > BYTES):
                    yield out()
                    held, count, size = [], 0, 0
                held.append((np.asarray(piece.column("vec_id"), np.int64), values, lengths[part], {c: np.asarray(piece.column(c), np.int64) for c in extra}))
                count, size = count + piece.num_rows, size + 2 * len(values)
        if held:
            yield out()
        common.release()

    return rows.select("vec_id", "v", *extra).mapInArrow(run, schema)


def _table(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    n, dims = row[f"{side}n"], row[f"{side}dims"]
    return np.frombuffer(row[f"{side}ids"], "<i8"), np.frombuffer(row[f"{side}data"], row[f"{side}kind"]).reshape(n, dims)


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers, exact; beyond MOST they count as MOST."""
    dims = min(left.shape[1], right.shape[1])
    left, right = left[:, :dims], right[:, :dims]
    bound = float(np.abs(left.astype(np.float64)).max(initial=0)) * float(np.abs(right.astype(np.float64)).max(initial=0)) * dims
    if bound < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    if bound < MOST:
        return left.astype(np.int64) @ right.astype(np.int64).T
    return np.array([[max(-MOST, min(MOST, v)) for v in row] for row in (whole(left) @ whole(right).T).tolist()], np.int64).reshape(len(left), len(right))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of every block of candidates with every block of queries: the row, both ids, scores, and which are scored."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            (qids, left), (ids, right) = _table(row, "q_"), _table(row, "")
            yield row, qids, ids, scores(left, right), qids[:, None] != ids[None, :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id of a query, bin, n: how many scores of this task fall into each bin of the query's range."""
    sums: dict[bytes, np.ndarray] = {}
    for row, qids, _, found, open_ in _met(batches):
        low, width = (np.frombuffer(row[f"q_{c}"], "<i8")[:, None] for c in ("low", "width"))
        at = (found - low) // width
        inside = open_ & (at >= 0) & (at < BINS)
        place = at + np.arange(len(qids))[:, None] * BINS
        counted = np.bincount(place[inside], minlength=len(qids) * BINS)
        key = row["q_ids"]
        sums[key] = sums[key] + counted if key in sums else counted
    for key, counted in sums.items():
        some = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, "<i8")[some // BINS]), pa.array((some % BINS).astype(np.int32)), pa.array(counted[some])], names=["vec_id", "bin", "n"])
    common.release()


def _keep(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, qids, ids, found, open_ in _met(batches):
            left, right = np.nonzero(open_ & (found >= np.frombuffer(row["q_low"], "<i8")[:, None]))
            score = found[left, right]
            order = np.lexsort((ids[right], -score, left))
            left, right, score = left[order], right[order], score[order]
            # of one query's, the best k of this block
            first = np.searchsorted(left, left)
            best = np.arange(len(left)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(qids[left[best]]), pa.array(ids[right[best]]), pa.array(score[best])], names=["query_id", "vec_id", "score"])
        common.release()

    return run


def _scan(candidates: DataFrame, queries: DataFrame, f, schema: str) -> DataFrame:
    """f over every block of candidates with every block of queries (vec_id, v, low, width), written; queries go round in bounded broadcasts."""
    extra = ("low", "width")
    blocks = common.cut(packed(queries, QUERY_ROWS, extra).withColumn("at", F.monotonically_increasing_id()))
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    rounds = -(-size // ROUND_BYTES) or 1
    out = None
    for r in range(rounds):
        some = blocks.where(F.pmod(F.xxhash64("at"), F.lit(rounds)) == r).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "n", "dims", "kind", "data", *extra)])
        met = candidates.select("ids", "n", "dims", "kind", "data").crossJoin(F.broadcast(some))
        part = common.cut(met.mapInArrow(f, schema))
        out = part if out is None else out.unionByName(part)
    return out


def _narrowed(state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """state (vec_id, low, width, above) with the range of the bin that holds each k-th score; reach: scores from that bin on."""
    summed = counts.groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("vec_id").orderBy(F.col("bin").desc())
    reached = summed.join(state, "vec_id").withColumn("reach", F.col("above") + F.sum("n").over(down)).where(F.col("reach") >= k)
    found = reached.groupBy("vec_id").agg(F.max_by(F.struct("bin", "reach", "n"), "bin").alias("x"))
    wide = F.col("width")
    # fewer than k scores in all: every one is among the best
    low = F.when(F.col("x").isNull(), F.col("low")).otherwise(F.col("low") + F.col("x.bin") * wide)
    settled = F.col("x").isNull() | (wide == 1) | (F.col("x.reach") <= max(ENOUGH, k))
    next_ = F.ceil(wide / BINS)
    return state.join(found, "vec_id", "left").select("vec_id", low.alias("low"), F.greatest(F.lit(1), next_).cast("long").alias("width"), F.coalesce(F.col("x.reach") - F.col("x.n"), F.lit(0)).alias("above"), settled.alias("settled"))


def top_k(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest scores of every query (a condition on vec_id) among all rows but its own.

    vectors: vec_id, v (whole numbers as doubles, see ``scaled``; null takes no part).
    """
    spark = vectors.sparkSession
    common.configure(spark)
    rows = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    candidates = common.cut(packed(rows, ROWS))
    norm = candidates.agg(F.max("norm")).first()[0] or 0.0
    asked = common.cut(rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")))
    # no score is beyond the product of the lengths
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    most = F.least(F.ceil(length * norm * (1 + 1e-9)).cast("double") + 1, F.lit(float(MOST))).cast("long")
    state = common.cut(asked.select("vec_id", (-most).alias("low"), F.ceil((2 * most + 1) / BINS).cast("long").alias("width"), F.lit(0).cast("long").alias("above"), F.lit(False).alias("settled")))
    while True:
        left = state.where("not settled")
        if left.isEmpty():
            break
        counts = _scan(candidates, asked.join(left, "vec_id"), _count, "vec_id long, bin int, n long")
        before, state = state, common.cut(_narrowed(left.drop("settled"), counts, k).unionByName(state.where("settled")))
        common.drop(before)
    best = _scan(candidates, asked.join(state, "vec_id"), _keep(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# -------------------------------------------------------------------- query


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every query (ids divisible by 100) among all vectors."""
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)


ORACLE_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= 10"""
