"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct n-word shingles (64-bit hashes). Two sets with Jaccard t share a token
among the first |s| - ceil(t |s|) + 1 tokens of either set, under any one order of all tokens; so candidates must
do so under each of several orders. The first order puts frequent tokens last (a count sketch over all
documents gives frequencies; any estimate gives a valid order), so shared passages seldom meet; the others are
independent random orders, whose prefixes (32 bits a token) are intersected for every candidate pair; only the sets of
pairs that pass all orders travel to be verified. A bucket's pair must also fit by size and
by position: of two sets that are similar, the first token they share leaves enough tokens after it in both.

Groups of near copies are linked without listing their pairs: in each bucket of a shared prefix token, all members
are verified against one pivot; then only members outside a bucket's main component are verified against the
others. A pair left out this way joins documents that are already in one component, so classes are exact.
Documents with equal sets are one document from the start.

Defined results: null, empty or wordless texts have an empty set, link with nothing and form a class of their
own; texts with fewer than n words are one shingle; null ids are kept as rows of their own and link with nothing;
repeated rows stay as rows of one class, and an id with several texts has the links of each. Extra columns are
ignored. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Counters of the frequency sketch: a fixed size, whatever the corpus. It travels in compressed chunks.
BITS, CHUNKS = 24, 256
_SHIFT = np.uint64(64 - BITS)
#: Seeds of the random orders; the first also breaks ties of the frequency order.
ORDERS = (11, 23, 37)
#: So many ids of candidates are broadcast at most; more are joined by a shuffle.
IDS = 1_000_000
SEPARATORS = common.byte_mask(common.SPACES)


def shingles(column: pa.Array, n: int, hasher: common.Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, ascending within each row, and the number of each row."""
    data, offsets = common.utf8(column)
    starts, ends, first = common.words(data, offsets, SEPARATORS)
    hashes = hasher.spans(data, starts, ends)
    count = np.diff(first)
    many = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    row = common.per_row(many)
    place = first[:-1][row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
    value = np.zeros(len(row), np.uint64)
    for k in range(n):
        # a short text is one shingle of all its words: places beyond its end add nothing
        there = place + k
        inside = there < first[1:][row]
        word = hashes[np.minimum(there, len(hashes) - 1)] if len(hashes) else value
        value = np.where(inside, common.mix(value * np.uint64(0x9E3779B97F4A7C15) + word, k), value)
    # distinct within each row
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.bincount(row, minlength=len(column)).astype(np.int64)


def _profile(n: int, schema: pa.Schema):
    """Per row: set size and a 128-bit hash of the set. Per task: its counts of the sketch, in chunks (id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketch = common.Hasher(), np.zeros(1 << BITS, np.uint8)
        for block in common.blocks(batches, "text"):
            value, count = shingles(block.column("text"), n, hasher)
            counter, seen = np.unique(value >> _SHIFT, return_counts=True)
            counter = counter.astype(np.int64)
            sketch[counter] = np.minimum(sketch[counter] + seen, 255)
            ends = np.append(0, np.cumsum(count))
            sums = []
            for seed in (101, 202):
                total = np.append(np.uint64(0), np.cumsum(common.mix(value, seed)))
                sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
            nothing = pa.nulls(block.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(count), pa.array(sums[0]), pa.array(sums[1]), pa.nulls(block.num_rows, pa.int32()), nothing], schema=schema)
        if sketch.any():
            parts = [pa.compress(part.tobytes(), "zstd", asbytes=True) for part in np.split(sketch, CHUNKS)]
            none = pa.nulls(CHUNKS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks that a task received, up to 65,535."""
    size = (1 << BITS) // CHUNKS
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            new = np.frombuffer(pa.decompress(counts, size, "zstd", asbytes=True), np.uint8)
            sums[chunk] = np.minimum(sums.get(chunk, 0) + new.astype(np.int64), 65_535)
    if sums:
        parts = [pa.compress(v.astype(np.uint16).tobytes(), "zstd", asbytes=True) for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])


def _classes(parts: DataFrame) -> np.ndarray:
    """Frequency class of each counter of the sketch: 0 for what chance fills, then by the power of two."""
    parts = parts.where("chunk is not null").select("chunk", "counts")
    size = (1 << BITS) // CHUNKS
    total = np.zeros(1 << BITS, np.uint16)
    for chunk, counts in parts.repartition("chunk").mapInArrow(_add_chunks, "chunk int, counts binary").toLocalIterator():
        total[chunk * size : (chunk + 1) * size] = np.frombuffer(pa.decompress(bytes(counts), 2 * size, "zstd", asbytes=True), np.uint16)
    usual = 2 * float(total.mean()) + 4
    bounds = usual * 2.0 ** np.arange(24)
    return np.searchsorted(bounds, total).astype(np.uint8)


def prefix_size(count: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(count > 0, count - -(-count * num // den) + 1, 0)


def _prefixes(n: int, num: int, den: int, classes, schema: pa.Schema):
    """Per row of the input, a row for each token of its prefix under the first order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, by_counter = common.Hasher(), classes.value
        for block in common.blocks(batches, "text"):
            value, count = shingles(block.column("text"), n, hasher)
            row = common.per_row(count)
            order = np.lexsort((common.mix(value, ORDERS[0]), by_counter[value >> _SHIFT], row))
            place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            take = place < prefix_size(count, num, den)[row]
            token, row = value[order[take]].view(np.int64), row[take]
            ids = block.column("id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(token), ids, pa.array(count[row].astype(np.int32)), pa.array(place[take].astype(np.int32))], schema=schema)

    return run


def _sets(n: int, num: int, den: int, schema: pa.Schema):
    """Per row: its set, and its prefix under each random order but the first, in 32 bits a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.Hasher()
        for block in common.blocks(batches, "text"):
            value, count = shingles(block.column("text"), n, hasher)
            row = common.per_row(count)
            size = prefix_size(count, num, den)
            place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            take = place < size[row]
            prefixes = []
            for seed in ORDERS[1:]:
                key = common.mix(value, seed)
                key = key[np.lexsort((key, row))][take]
                prefixes.append(common.list_array((key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), size, pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(count), common.list_array(value.view(np.int64), count, pa.int64()), *prefixes], schema=schema)

    return run


def _verify(num: int, den: int, schema: pa.Schema):
    """Keeps the pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("sa", "sb"):
                column = batch.column(name)
                sides.append((np.asarray(column.values).view(np.uint64), np.asarray(column.offsets).tolist()))
            (flat_a, ends_a), (flat_b, ends_b) = sides
            kept = []
            for i in range(batch.num_rows):
                left, right = flat_a[ends_a[i] : ends_a[i + 1]], flat_b[ends_b[i] : ends_b[i + 1]]
                # both ascend and hold no value twice
                at = np.searchsorted(left, right)
                common_ = int((left[np.minimum(at, len(left) - 1)] == right).sum())
                kept.append(den * common_ >= num * (len(left) + len(right) - common_))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(kept, pa.bool_()))
        common.release()

    return run


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int, repeated: bool) -> DataFrame:
    """The pairs (a, b) that share a prefix token under every order and verify. What belongs to b travels to a, so a hot pivot is sent once."""

    def beside(pairs: DataFrame, side: str, *columns: str) -> DataFrame:
        return pairs.join(sets.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}{side}") for c in columns)), side)

    orders = [f"p{i}" for i in range(len(ORDERS) - 1)]
    # without an aggregate behind it, Spark may split the join of a hot pivot
    passed = beside(beside(pairs, "b", *orders), "a", *orders)
    for c in orders:
        passed = passed.where(F.arrays_overlap(f"{c}a", f"{c}b"))
    passed = passed.select("a", "b")
    # an id may have several sets: a pair passes if any two of them do
    passed = common.cut(passed.distinct() if repeated else passed)
    both = beside(beside(passed, "b", "s"), "a", "s").select("a", "b", "sa", "sb")
    found = common.cut(both.mapInArrow(_verify(num, den, pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a long, b long"))
    common.drop(passed)
    return found


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs: exact classes of the graph of links num/den or more."""
    spark = docs.sparkSession
    common.configure(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = common.cut(docs.mapInArrow(
        _profile(n, pa.schema([("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])),
        "id long, n long, h1 long, h2 long, chunk int, counts binary",
    ))
    classes = spark.sparkContext.broadcast(_classes(profile))
    profile = profile.where("chunk is null").select("id", "n", "h1", "h2")
    # equal sets are one document
    first = common.cut(profile.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    known = docs.where("id is not null")
    tokens = known.mapInArrow(_prefixes(n, num, den, classes, pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])), "token long, id long, n int, pos int")
    every = tokens = common.cut(tokens)
    repeated = not profile.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    # rows of copies go: all but the smallest id of each set; an id with other sets too stays, as it has the links of each
    copies = profile.where("n > 0").join(first.where("copies > 1").select("h1", "h2", F.col("id").alias("least")), ["h1", "h2"]).where("id <> least").select("id")
    if repeated:
        several = profile.where("n > 0").groupBy("id").agg(F.count_distinct("h1", "h2").alias("sets")).where("sets > 1")
        copies = copies.join(several, "id", "left_anti")
    tokens = tokens.join(common.bounded(copies, IDS), "id", "left_anti")
    if repeated:
        tokens = tokens.distinct()
    # buckets of two members or more; the pivot is the smallest id, with the size of its set
    buckets = tokens.groupBy("token").agg(F.count("*").alias("members"), F.min(F.struct("id", "n", "pos")).alias("pivot")).where("members > 1")
    tokens = common.cut(tokens.join(buckets, "token").select("token", "id", "n", "pos", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("m"), F.col("pivot.pos").alias("at")))
    common.drop(every)
    # sizes fit; and if this is the first token that two sets share, what follows it in either is enough
    fits = F.expr(f"{num} * greatest(n, m) <= {den} * least(n, m) AND {num + den}L * least(n - pos, m - at) >= {num}L * (n + m)")

    def verified(pairs: DataFrame) -> DataFrame:
        members = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = known.join(common.bounded(common.cut(members), IDS), "id", "left_semi")
        if repeated:
            sets = sets.dropDuplicates(["id", "text"])
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64())), *((f"p{i}", pa.list_(pa.int32())) for i in range(len(ORDERS) - 1))])
        sets = common.cut(sets.mapInArrow(_sets(n, num, den, schema), "id long, n long, s array<long>, p0 array<int>, p1 array<int>"))
        found = _links(pairs, sets, num, den, repeated)
        common.drop(sets)
        return found

    # every member of a bucket against its pivot
    stars = common.cut(tokens.where("id <> pivot").where(fits).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    reached = common.components(verified(stars))
    # what a bucket holds outside its main component, against all of it
    held = tokens.join(reached.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", "pos", F.coalesce("component", "id").alias("component"))
    shares = held.groupBy("token", "component").agg(F.count("*").alias("share"))
    mains = shares.groupBy("token").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("share", "component")).alias("main")).where("parts > 1")
    mixed = common.cut(held.join(mains.select("token", "main"), "token"))
    outside = mixed.where("component <> main").select("token", F.col("id").alias("a"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("component").alias("other"))
    rest = mixed.join(outside, "token").where(F.col("component") != F.col("other")).where(fits)
    rest = rest.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    rest = common.cut(rest.join(stars, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = reached.select(F.col("node").alias("a"), F.col("component").alias("b")).union(verified(rest))
        reached = common.components(more)
    # from set to class, and from each row to its set
    classed = first.join(reached.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component_id"))
    out = profile.join(classed, ["h1", "h2"], "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents whose id is the smallest of their class. Of rows that repeat an id, each different text stays once."""
    classes = jaccard_classes(docs, n, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(common.bounded(common.cut(classes), IDS), "doc_id", "left_anti")
    repeated = common.cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    repeated = common.bounded(repeated, IDS)
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(again)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(common.table(spark, sf_dir, "documents"), n=4, num=85, den=100)


ORACLE_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM t),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT doc_id, n AS n_shingles, min(root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""
