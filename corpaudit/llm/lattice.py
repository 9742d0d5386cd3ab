"""Embedding near-duplicates by E8 lattice hashing.

Equal vectors are one vector with a count from the start. Unit vectors are projected to eight dimensions by several
random matrices (one per table) and decoded to the nearest point of the E8 lattice, the densest packing there. A vector
enters the cell of that point and of the next nearest ones (probes); pairs that share a cell of any table are
compared by cosine in double precision. Vectors of one length meet; those of different lengths have no cosine.

Only numbers of cells and rows travel at first; vectors follow to the cells that hold two or more. A cell's members
are compared in blocks of bounded size, as matrix products inside tasks: a crowded cell is split over many tasks, and
no pair is ever emitted. A task adds up its links per vector (each pair counts in the first cell that it shares, known
from the codes both carry) and passes on one edge per vector to the smallest member it reaches, so output grows with
the vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing (0 links,
their own class, kept); equal vectors link; rows that repeat an id are vectors of their own, whose classes that id joins;
null ids link with nothing; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TABLES, PROBES, SCALE, SEED = 7, 3, 2.0, 3
#: Members of a block of a cell.
BLOCK = 1024
_CELL = ["dims", "tab", "cell"]


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: integers of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def e8_points(x: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes, 8): the nearest E8 points in order of distance. E8 is D8 and D8 moved by one half.

    The candidates are the nearest point of either coset, and their neighbours across the two coordinates
    (by pairs) that lie closest to a boundary.
    """
    found = []
    for shift in (0.0, 0.5):
        near = nearest_d8(x - shift) + shift
        found.append(near)
        off = x - near
        order = np.argsort(-np.abs(off), axis=1)
        rows = np.arange(len(x))
        for a, b in ((0, 1), (0, 2), (1, 2)):
            other = near.copy()
            for k in (a, b):
                at = order[:, k]
                other[rows, at] += np.where(off[rows, at] >= 0, 1, -1)
            found.append(other)
    points = np.stack(found, 1)
    distance = ((points - x[:, None, :]) ** 2).sum(2)
    best = np.argsort(distance, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(points, best[:, :, None], 1)


def projections(dims: int) -> np.ndarray:
    """(tables, dims, 8) random projections that keep lengths on average."""
    return np.random.default_rng(SEED).normal(0, SCALE / np.sqrt(8), (TABLES, dims, 8))


def codes(unit: np.ndarray) -> np.ndarray:
    """(rows, tables, probes) 32-bit codes of the cells that a vector enters; distinct within a table."""
    out = np.empty((len(unit), TABLES, PROBES), np.int32)
    step = np.random.default_rng(SEED + 1).integers(1, 2**62, 8).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for t, projection in enumerate(projections(unit.shape[1])):
        points = np.rint(2 * e8_points(unit @ projection, PROBES)).astype(np.int64).view(np.uint64)
        mixed = common.mix((points * step).sum(2, dtype=np.uint64), t)
        out[:, t] = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def units(flat: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one."""
    x = flat.reshape(-1, dims).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        most = np.abs(x).max(1) if dims else np.zeros(len(x))
        good = np.isfinite(most) & (most > 0)
        x = np.where(good[:, None], x, 0) / np.where(good, most, 1)[:, None]
        x /= np.where(good, np.sqrt((x * x).sum(1)), 1)[:, None]
    return x, good


def _by_length(part: pa.RecordBatch, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each vector length, and their vectors."""
    size = np.asarray(pc.list_value_length(part.column("vector")))
    for dims in np.unique(size).tolist():
        rows = np.flatnonzero(size == dims)
        yield rows, np.asarray(pc.list_flatten(part.column("vector").take(pa.array(rows))), dtype=kind).reshape(-1, dims)


def _light(kind: type):
    """The number of a vector and of a cell, for every entry of a vector into a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for rows, vectors in _by_length(part, kind):
                    code = codes(units(vectors, vectors.shape[1])[0]).reshape(len(rows), -1)
                    row = np.repeat(np.arange(len(rows)), TABLES * PROBES)
                    table = np.tile(np.repeat(np.arange(TABLES), PROBES), len(rows))
                    key = np.unique(np.column_stack([row, table, code.ravel()]), axis=0)
                    rid = part.column("rid").take(pa.array(rows[key[:, 0]]))
                    dims = np.full(len(key), vectors.shape[1], np.int32)
                    yield pa.RecordBatch.from_arrays([rid, pa.array(dims), pa.array(key[:, 1].astype(np.int32)), pa.array(key[:, 2].astype(np.int32))], names=["rid", *_CELL])

    return run


def _coded(kind: type):
    """Every vector in binary form, with all its codes."""
    schema = pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for rows, vectors in _by_length(part, kind):
                    code = codes(units(vectors, vectors.shape[1])[0])
                    own = [part.column(c).take(pa.array(rows)) for c in ("rid", "id", "copies")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary())], schema=schema)

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys; a run holds two blocks at most."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        begin = np.append(np.append(0, np.flatnonzero(change)), batch.num_rows)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _compare(kind: type, least: float, schema: pa.Schema):
    """Links and edges of each run: the members of one block of a cell, or of two blocks against each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, [*_CELL, "b1", "b2"]):
            n = rows.num_rows
            if n < 2:
                continue
            dims, tab, cell, b1, b2 = (rows.column(k)[0].as_py() for k in (*_CELL, "b1", "b2"))
            block, ids, copies = (np.asarray(rows.column(k).combine_chunks()) for k in ("block", "id", "copies"))
            rid = rows.column("rid").combine_chunks()
            x, _ = units(np.frombuffer(b"".join(rows.column("vector").to_pylist()), kind), dims)
            code = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int32).reshape(n, TABLES, PROBES)
            linked = x @ x.T >= least
            np.fill_diagonal(linked, False)
            if b1 != b2:
                linked &= block[:, None] != block[None, :]
            if not linked.any():
                continue
            # a pair counts in the first table, and there in the smallest cell, that it shares
            i, j = np.nonzero(np.triu(linked))
            counts = np.zeros(n, np.int64)
            for at in range(0, len(i), 200_000):
                a, b = i[at : at + 200_000], j[at : at + 200_000]
                first = np.ones(len(a), bool)
                for t in range(tab + 1):
                    for p in range(PROBES):
                        for q in range(PROBES):
                            same = code[a, t, p] == code[b, t, q]
                            first &= ~same if t < tab else ~(same & (code[a, t, p] < cell))
                a, b = a[first], b[first]
                counts += (np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)).astype(np.int64)
            # the smallest member that each can reach within the run
            label = ids.copy()
            while True:
                reach = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
                if (reach == label).all():
                    break
                label = reach
            keep = pa.array(linked.any(1))
            yield pa.RecordBatch.from_arrays([rid, pa.array(ids), pa.array(label), pa.array(counts)], schema=schema).filter(keep)

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    spark = vectors.sparkSession
    common.configure(spark)
    double = "float" not in vectors.schema[vector_col].dataType.simpleString()
    kind = np.float64 if double else np.float32
    vector = F.col(vector_col).cast("array<double>" if double else "array<float>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), vector.alias("vector"))
    rows = common.cut(rows.select("*", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = rows.where(F.col("id").isNotNull() & ~odd & F.exists("vector", lambda v: v != 0))
    # equal vectors are one, by 128 bits of hash
    classes = common.cut(whole.groupBy("k1", "k2").agg(F.min("rid").alias("rid"), F.min("id").alias("id"), F.count("*").alias("copies"), F.min_by("vector", "rid").alias("vector")))
    light = common.cut(classes.select("rid", "vector").mapInArrow(_light(kind), "rid long, dims int, tab int, cell int"))
    shared = light.groupBy(*_CELL).agg(F.count("*").alias("members")).where("members > 1").select(*_CELL, F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    coded = classes.select("rid", "id", "copies", "vector").mapInArrow(_coded(kind), "rid long, id long, copies long, vector binary, codes binary")
    dealt = light.join(shared, _CELL).join(coded, "rid")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dealt = dealt.select("*", F.least("block", "with").alias("b1"), F.greatest("block", "with").alias("b2")).drop("with")
    keys = [*_CELL, "b1", "b2"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "rid")
    schema = pa.schema([("rid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    found = common.cut(dealt.mapInArrow(_compare(kind, least, schema), "rid long, a long, b long, n long"))
    edges = found.select("a", "b")
    # an id of several vectors joins their classes
    repeated = whole.groupBy("id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("id")
    if not repeated.isEmpty():
        own = whole.join(repeated, "id").select("k1", "k2", F.col("id").alias("a")).distinct()
        edges = edges.union(own.join(classes.select("k1", "k2", F.col("id").alias("b")), ["k1", "k2"]).select("a", "b"))
    reached = common.components(edges)
    links = found.groupBy("rid").agg(F.sum("n").alias("n"))
    told = classes.select("k1", "k2", "rid", "id", "copies").join(links, "rid", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
    told = told.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(told, ["k1", "k2"], "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT a AS vec_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.vec_id = e.a WHERE r.root < e.b),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""
