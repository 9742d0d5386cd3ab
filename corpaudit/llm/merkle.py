"""Merkle manifest of a dataset, with proofs by checkpoint and recomputation.

Rows are leaves, in order of their key within groups; every ``arity`` consecutive nodes become one, until a group has one
node, its subroot. The subroots, in order of the groups, form a tree of the same kind, whose top is the root.

Only every few levels are stored (``EVERY``; leaves, level 2, level 4 and so on). A proof needs all levels, so
extraction goes down from the root: for each aligned subtree the interior nodes between two stored levels
are computed anew from the stored nodes below, their digests go out as siblings, and the nodes are forgotten. No subtree is
larger than arity ** every nodes, and all shuffles carry (group, subtree) keys, so a group of a third of all rows is as
spread as any. Places within a group come from a range sort by group and key: each part counts its
rows, and the counts before it are added.

Defined results: a null field is marked in its leaf and differs from an empty one; null keys come first, null groups are a group
of their own and come first; rows of one group and key are ordered by their leaf, and equal rows are leaves of their own; an
empty table has no rows and no root; very long fields are hashed whole; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node, and the fields of a leaf in order.
ARITY, FIELDS = 16, ("doc_id", "source", "lang", "n_chars", "text")
#: Stored levels: one in so many.
EVERY = 2
#: Groups and parts of them that a broadcast may hold.
SPANS = 200_000


def leaf(fields: list[Column]) -> Column:
    """Hex digest of fields, each with its length in bytes, or a mark for null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def _hex(h: Column) -> Column:
    return F.lower(F.hex(h))


def _parents(digests: Column, arity: int) -> Column:
    """Digests of the parents of consecutive nodes: each is the hash of up to arity digests as text."""
    at = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / arity).cast("int"))
    return F.transform(at, lambda i: F.sha2(F.array_join(F.slice(digests, i * arity + 1, F.lit(arity)), ""), 256))


def _counts(n: Column, arity: int, levels: int) -> list[Column]:
    """Nodes of a group at a stored level and the levels above it."""
    out = [n]
    for _ in range(levels):
        out.append(F.ceil(out[-1] / arity))
    return out


@dataclass
class Manifest:
    """levels: stored nodes (grp, pos, n nodes of the group, h digest), the last one of one node a group; level 0 has the leaves'
    further columns too. groups: the tree above, of the subroots (None for that tree itself)."""

    levels: list[DataFrame]
    arity: int
    every: int
    groups: Manifest | None = None

    @property
    def root(self) -> str | None:
        top = (self.groups or self).levels[-1].select(_hex(F.col("h"))).first()
        return top and top[0]


def _subtrees(nodes: DataFrame, arity: int, every: int) -> DataFrame:
    """grp, sub, n, members (in order) of the aligned subtrees of arity ** every nodes."""
    others = [c for c in nodes.columns if c not in ("grp", "n")]
    members = F.array_sort(F.collect_list(F.struct("pos", *[c for c in others if c != "pos"])))
    return nodes.groupBy("grp", F.floor(F.col("pos") / arity**every).alias("sub")).agg(F.max("n").alias("n"), members.alias("members"))


def _climbed(nodes: DataFrame, arity: int, every: int) -> DataFrame:
    """The next stored level."""
    digests = F.transform("members", lambda x: _hex(x["h"]))
    counts = _counts(F.col("n"), arity, every)
    for count in counts[:-1]:
        digests = F.when(count > 1, _parents(digests, arity)).otherwise(digests)
    rows = _subtrees(nodes.select("grp", "pos", "n", "h"), arity, every)
    # the new count has another name first: a column beside it must not take it for the old one
    return rows.select("grp", F.col("sub").alias("pos"), counts[-1].alias("left"), F.unhex(F.get(digests, F.lit(0))).alias("h")).select("grp", "pos", F.col("left").alias("n"), "h")


def _levels(nodes: DataFrame, arity: int, every: int) -> list[DataFrame]:
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(common.cut(_climbed(out[-1], arity, every)))
    return out


def _in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows written in order of keys, with at: ascending over the whole table, gapless within a part (at >> 33)."""
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    keys = [*keys, "place"]
    return common.cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place").withColumn("at", F.monotonically_increasing_id()))


def build(rows: DataFrame, arity: int = ARITY, every: int = EVERY) -> Manifest:
    """The manifest of rows (grp of any type, key, h binary digest, and further columns, which level 0 keeps)."""
    if arity < 2 or every < 1:
        raise ValueError("a node has two children at least, and a stored level is one above the last at least")
    ordered = _in_order(rows, ["grp", "key", "h"])
    part = F.shiftright("at", 33)
    spans = common.cut(ordered.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows")))
    groups = _in_order(spans.groupBy("grp").agg(F.sum("rows").alias("n")), ["grp"])
    # groups are numbered like rows: by the counts of the parts before
    sizes = groups.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    sizes = sizes.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows"))
    numbered = groups.withColumn("part", part).join(sizes, "part").select("grp", "n", (F.col("at") - F.col("first") + F.col("before")).alias("number"))
    known = spans.withColumn("before", F.sum("rows").over(Window.partitionBy("grp").orderBy("part")) - F.col("rows"))
    known = known.alias("s").join(numbered.alias("g"), F.col("s.grp").eqNullSafe(F.col("g.grp"))).select(F.col("s.grp").alias("own"), "part", "first", "before", "n", "number")
    known = common.bounded(common.cut(known), SPANS)
    placed = ordered.withColumn("in_part", part).join(known, F.col("grp").eqNullSafe(F.col("own")) & (F.col("in_part") == F.col("part")))
    others = [c for c in rows.columns if c not in ("grp", "key", "h")]
    leaves = common.cut(placed.select(F.col("number").alias("grp"), (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n", "h", *others))
    common.drop(ordered)
    levels = _levels(leaves, arity, every)
    # levels all end at one node a group: that is the tree of subroots' own level 0
    total = known.agg(F.countDistinct("number")).first()[0]
    subroots = levels[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(total).cast("long").alias("n"), "h")
    return Manifest(levels, arity, every, Manifest(_levels(common.cut(subroots), arity, every), arity, every))


_PATH = "array<struct<left: string, right: string>>"


def _child(digests: Column, width: int, arity: int):
    """The j-th child of a subtree: its members below, and its siblings on both sides."""
    side = lambda first, size: F.array_join(F.slice(digests, first, size), "")
    return lambda j: F.struct(F.slice("members", j * width + 1, F.lit(width)).alias("members"), side(F.lit(1), j).alias("left"), side(j + 2, F.lit(arity)).alias("right"))


def _down(nodes: DataFrame, above: DataFrame, arity: int, every: int) -> DataFrame:
    """nodes with path: siblings left and right, level by level upwards. above: grp, pos, path of the next stored level, and what every row keeps."""
    kept = [c for c in above.columns if c not in ("grp", "pos", "path")]
    rows = _subtrees(nodes, arity, every).join(above.withColumnRenamed("pos", "sub"), ["grp", "sub"])
    counts = _counts(F.col("n"), arity, every)
    for level in range(every - 1, -1, -1):
        width = arity**level
        digests = F.transform("members", lambda x: _hex(x["h"]))
        for _ in range(level):
            digests = _parents(digests, arity)
        at = F.sequence(F.lit(0), F.floor((F.size("members") - 1) / width).cast("int"))
        rows = rows.select("grp", "n", "path", *kept, F.explode(F.transform(at, _child(digests, width, arity))).alias("c"))
        own = F.array(F.struct("c.left", "c.right"))
        path = F.when(counts[level] > 1, F.concat(own, F.col("path"))).otherwise(F.col("path"))
        rows = rows.select("grp", "n", *kept, F.col("c.members").alias("members"), path.alias("path"))
    one = F.get("members", F.lit(0))
    return rows.select("grp", *[one[c].alias(c) for c in nodes.columns if c not in ("grp", "n")], *kept, "path")


def _paths(m: Manifest, top: DataFrame) -> DataFrame:
    """Paths of level 0, stored level by stored level from those of the last one (grp, pos, path and what rows keep)."""
    above = top
    for nodes in reversed(m.levels[:-1]):
        found = _down(nodes, above, m.arity, m.every)
        kept = [c for c in top.columns if c not in ("grp", "pos", "path")]
        above = found if nodes is m.levels[0] else common.cut(found.select("grp", "pos", *kept, "path"))
    return above


def proofs(m: Manifest) -> DataFrame:
    """Level 0's further columns with h, path (siblings to the root), and subroot, root as hex."""
    top = m.groups.levels[-1].select("grp", "pos", F.array().cast(_PATH).alias("path"))
    subroots = _paths(m.groups, top)
    if len(m.groups.levels) == 1:
        subroots = subroots.join(m.groups.levels[0].select("grp", "pos", "h"), ["grp", "pos"])
    top = common.cut(subroots.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), _hex(F.col("h")).alias("subroot"), "path"))
    if len(m.levels) == 1:
        found = m.levels[0].join(top, ["grp", "pos"])
    else:
        found = _paths(m, top)
    others = [c for c in m.levels[0].columns if c not in ("grp", "pos", "n", "h")]
    return found.select(*others, "h", "subroot", "path", F.lit(m.root).cast("string").alias("root"))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings, level by level upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) gives with its siblings."""
    return F.aggregate(path, digest, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


# -------------------------------------------------------------------- query


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root, proof and the root recomputed from its tampered form."""
    docs = common.table(spark, sf_dir, "documents").select(*FIELDS)
    fields = [F.col(c) for c in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fake = F.when(tampered & (lowered != F.col("text")), F.unhex(leaf([*fields[:-1], lowered])))
    rows = common.cut(docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), F.unhex(leaf(fields)).alias("h"), "doc_id", fake.alias("fake")))
    found = proofs(build(rows))
    out = found.select("doc_id", _hex(F.col("h")).alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(_hex(F.coalesce("fake", "h")), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS[:-1])
_TEXT = "coalesce(strlen({0}) || ':' || {0}, '-')"
#: CRC-32 of a text of ASCII characters, by its table (``tab``), which a rule makes.
CRC_TABLE = "tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i))"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"
_FAKE = f"CASE WHEN {CRC.format('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
_STEP = "SELECT {0} lev + 1 AS lev, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {1} WHERE n > 1 GROUP BY {0} lev, pos // 16"
ORACLE_SQL = f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, source, sha256({_LEAF} || {_TEXT.format("text")}) AS leaf, sha256({_LEAF} || {_TEXT.format("told")}) AS fake FROM (SELECT *, {_FAKE} AS told FROM documents, tab)),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
tree AS (SELECT source, 0 AS lev, pos, n, leaf AS h FROM l UNION ALL {_STEP.format("source,", "tree")}),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS gid, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lev, gid AS pos, n, subroot AS h FROM sub UNION ALL {_STEP.format("", "top")}),
runs AS (SELECT source, lev, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY ALL),
tops AS (SELECT lev, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT rid, lev, (pos // (16 ** lev)::BIGINT)::BIGINT % 16 AS i, hs FROM l JOIN runs ON l.source IS NOT DISTINCT FROM runs.source AND run = pos // (16 ** (lev + 1))::BIGINT
  UNION ALL SELECT rid, 100 + lev, (gid // (16 ** lev)::BIGINT)::BIGINT % 16, hs FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source JOIN tops ON run = gid // (16 ** (lev + 1))::BIGINT),
sides AS (SELECT rid, lev, array_to_string(hs[1:i], '') AS lft, array_to_string(hs[i + 2:], '') AS rgt FROM steps),
path AS (SELECT rid, string_agg(lft || rgt, '' ORDER BY lev) AS proof, list(lft || '|' || rgt ORDER BY lev) AS sides FROM sides GROUP BY rid)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM (SELECT l.*, subroot, proof, list_reduce(list_prepend(fake, coalesce(sides, [])), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root
  FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source LEFT JOIN path USING (rid))"""
