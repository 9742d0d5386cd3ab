"""Structure repair of conversations by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state of the pattern ``(s?(ua)+)?`` of role initials); keeping, reroling or deleting a
row leads to the next row, inserting a turn stays at it. One heap grows from the start and one from the accepting
ends; each label is the least cost of its node and the least audit of that cost. When the two tops together exceed the
best crossing, all crossings of that cost are finished, and the least concatenated audit wins.
(Two audits of one cost between the same nodes are never prefixes of each other, so least parts make least wholes.)

Ordinary conversations are dealt by id and solved as they stream by; equal lattices of a task are solved once. Conversations of
more than ``LONG_ROWS`` rows or ``LONG_BYTES`` are never gathered: a range sort gives their rows a global order, first
occurrences come from an aggregate, each segment of rows becomes a 4 x 4 table of (cost, audit) from state to state, by the same search,
and tables are composed in rounds of bounded groups. Their repaired text runs once through one task row by row, as a SHA-256 must.

Defined results: null role or text counts as one space, null ids are one conversation, null turns come first and
count for no gap; rows of one turn are ordered by the MD5 of role and text, equal rows are duplicates of the first; roles of other initials must be changed or deleted; a conversation
without rows has zeros and an empty audit; an empty table gives an empty one; texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .merkle import CRC, CRC_TABLE

#: Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. The role that a state takes next, and where it leads.
STATES, ACCEPTING = (0, 1, 2, 3), (0, 3)
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Rows and bytes from which a conversation is solved in segments, rows of a segment, and tables composed at once.
LONG_ROWS, LONG_BYTES, SEGMENT, FAN = 1000, 4_000_000, 4096, 16
#: Lattices that a task remembers, of so many rows at most.
REMEMBERED, REMEMBERED_ROWS = 50_000, 40
_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


# ------------------------------------------------------------------ lattice


def _moves() -> tuple[dict, dict]:
    """Of each row mark, the moves (to, cost, letter) of a state, and the moves (from, cost, letter) into one.

    Marks: the role's initial (x: another), capital if truncated; d: must be deleted.
    """
    forward, back = {}, {}
    for mark in "suaxSUAXd":
        moves = [(s, s, DELETE, "D") for s in STATES]
        if mark != "d":
            more = TRUNCATED * mark.isupper()
            role = mark.lower()
            moves += [(0, 1, KEEP + more, "K")] if role == "s" else [(s, to, KEEP + more, "K") for s, (takes, to) in NEXT.items() if takes[0] == role]
            moves += [(s, to, REROLE + more, "R") for s, (_, to) in NEXT.items()]
        forward[mark] = {s: [(to, c, x) for at, to, c, x in moves if at == s] for s in STATES}
        back[mark] = {s: [(at, c, x) for at, to, c, x in moves if to == s] for s in STATES}
    return forward, back


_FORWARD, _BACK = _moves()
_INTO = {s: [at for at, (_, to) in NEXT.items() if to == s] for s in STATES}


def cheapest(marks: str, start: int = 0, ends: tuple[int, ...] = ACCEPTING) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from a state before the rows to one of the ends, the least audit of these; None if there are none."""
    n = len(marks)
    ahead, behind = {start: (0, "")}, {4 * n + e: (0, "") for e in ends}
    heap_f, heap_b = [(0, 0, start)], [(0, -n, e) for e in ends]
    heapq.heapify(heap_b)
    done_f, done_b = set(), set()
    best = math.inf

    def relax(labels: dict, heap: list, node: int, cost: int, audit: str, order: int) -> None:
        old = labels.get(node)
        if old is None or (cost, audit) < old:
            labels[node] = (cost, audit)
            if old is None or cost < old[0]:
                heapq.heappush(heap, (cost, order, node % 4))

    def forward() -> float:
        cost, i, s = heapq.heappop(heap_f)
        node = 4 * i + s
        if node in done_f:
            return math.inf
        done_f.add(node)
        audit = ahead[node][1]
        if i < n:
            for to, more, letter in _FORWARD[marks[i]][s]:
                relax(ahead, heap_f, node + 4 - s + to, cost + more, audit + letter, i + 1)
        relax(ahead, heap_f, 4 * i + NEXT[s][1], cost + INSERT, audit + "I", i)
        return cost + behind[node][0] if node in behind else math.inf

    def reverse() -> float:
        cost, i, s = heapq.heappop(heap_b)
        i = -i
        node = 4 * i + s
        if node in done_b:
            return math.inf
        done_b.add(node)
        audit = behind[node][1]
        if i:
            for at, more, letter in _BACK[marks[i - 1]][s]:
                relax(behind, heap_b, node - 4 - s + at, cost + more, letter + audit, 1 - i)
        for at in _INTO[s]:
            relax(behind, heap_b, 4 * i + at, cost + INSERT, "I" + audit, -i)
        return cost + ahead[node][0] if node in ahead else math.inf

    # both ends are settled first; free moves lead to later rows only, so a node's label is whole when it is popped
    best = min(forward(), *(reverse() for _ in ends))
    while heap_f and heap_b and heap_f[0][0] + heap_b[0][0] <= best:
        best = min(best, forward() if heap_f[0][0] <= heap_b[0][0] else reverse())
    found = None
    for node in done_f:
        i, s = divmod(node, 4)
        cost, audit = ahead[node]
        steps = [(node, 0, "")] + [(4 * i + NEXT[s][1], INSERT, "I")] + ([(4 * (i + 1) + to, more, letter) for to, more, letter in _FORWARD[marks[i]][s]] if i < n else [])
        for to, more, letter in steps:
            if to in done_b:
                rest = behind[to]
                total = cost + more + rest[0]
                if found is None or total <= found[0]:
                    whole = (total, audit + letter + rest[1])
                    found = whole if found is None else min(found, whole)
    return found


def walk(state: int, role: str, text: str, letters: str) -> tuple[int, list[str]]:
    """The state after a row's letters (inserts before or after it, and its own), and the lines that they leave."""
    lines = []
    for letter in letters:
        if letter == "D":
            continue
        if letter == "K":
            lines.append(f"{role}:{text}")
            state = 1 if role[:1] == "s" else 2 if role[:1] == "u" else 3
        else:
            lines.append(f"{NEXT[state][0]}:{text if letter == 'R' else ''}")
            state = NEXT[state][1]
    return state, lines


def row_letters(audit: str, rows: int) -> list[str]:
    """The audit cut by rows: inserts go with the row after them, the last ones with the last row."""
    out, at = [], 0
    for _ in range(rows):
        start = at
        while audit[at] == "I":
            at += 1
        at += 1
        out.append(audit[start:at])
    if out:
        out[-1] += audit[at:]
    return out


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


# --------------------------------------------------------------------- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage; copies: how often a row stands (0: dropped)."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(named.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


_blank = lambda: ~F.col("text").rlike(_BLANK)
_truncated = lambda: ~F.col("text").rlike(_ENDED)
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [f.split()[0] for f in _RESULT.split(", ")]


def _gaps(turns: set) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def _solve_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations of a task, whose rows come in order."""
    known: dict[str, tuple[int, str]] = {}
    now, rows, out = None, None, []

    def solve(conv_id: int | None, rows: list[tuple]) -> tuple:
        seen, marks, lines = set(), [], []
        counts = {"b": 0, "d": 0, "t": 0}
        for _, role, text, initial, blank, truncated, _, digest in rows:
            mark = "b" if blank else "d" if digest in seen else "t" if truncated else ""
            seen.add(digest)
            if mark:
                counts[mark] += 1
            marks.append("d" if mark in ("b", "d") else initial.upper() if mark else initial)
        lattice = "".join(marks)
        found = known.get(lattice)
        if found is None:
            found = cheapest(lattice)
            if len(lattice) <= REMEMBERED_ROWS and len(known) < REMEMBERED:
                known[lattice] = found
        state = 0
        for row, letters in zip(rows, row_letters(found[1], len(rows)), strict=True):
            state, more = walk(state, row[1], row[2], letters)
            lines += more
        turns = {r[0] for r in rows if r[0] is not None}
        return (conv_id, _gaps(turns), counts["b"], counts["d"], counts["t"], illegal_pairs("".join(r[3] for r in rows)), *found, hashlib.sha256("\n".join(lines).encode()).hexdigest())

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i > 6 else pa.int64()) for i, c in enumerate(columns)], names=_NAMES)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "initial", "blank", "truncated", "copies", "digest")]
        for conv_id, *row in zip(*columns, strict=True):
            if rows is None or conv_id != now:
                if rows is not None:
                    out.append(solve(now, rows))
                now, rows = conv_id, []
            rows += [row] * row[6]
        if len(out) > 500:
            yield batch_of(out)
            out = []
    if rows is not None:
        out.append(solve(now, rows))
    if out:
        yield batch_of(out)
    common.release()


# ------------------------------------------------------- long conversations


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every segment the cheapest edits from each state to each."""
    for batch in batches:
        cells = [[cheapest(m, s, (e,)) for s in STATES for e in STATES] for m in batch.column("marks").to_pylist()]
        yield _with_cells(batch.drop_columns(["marks"]), cells)


def _with_cells(batch: pa.RecordBatch, cells: list[list[tuple[int, str] | None]]) -> pa.RecordBatch:
    costs = pa.array([[c and c[0] for c in row] for row in cells], pa.list_(pa.int64()))
    audits = pa.array([[c and c[1] for c in row] for row in cells], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([*batch.columns, costs, audits], names=[*batch.schema.names, "costs", "audits"])


def composed(left: list, right: list) -> list:
    """The table of two segments in a row, from theirs."""
    out = []
    for s in STATES:
        for e in STATES:
            ways = [(left[4 * s + m][0] + right[4 * m + e][0], left[4 * s + m][1] + right[4 * m + e][1]) for m in STATES if left[4 * s + m] and right[4 * m + e]]
            out.append(min(ways, default=None))
    return out


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = []
        for parts in batch.column("parts").to_pylist():
            whole = None
            for p in parts:
                one = [None if c is None else (c, a) for c, a in zip(p["costs"], p["audits"], strict=True)]
                whole = one if whole is None else composed(whole, one)
            cells.append(whole)
        yield _with_cells(batch.drop_columns(["parts"]), cells)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every segment its first place and its rows' letters."""
    for batch in batches:
        for audit, segments in zip(batch.column("audit").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            letters, at = row_letters(audit, sum(s["rows"] for s in segments)), 0
            for s in segments:
                yield pa.RecordBatch.from_arrays([pa.array([s["first"]]), pa.array([letters[at : at + s["rows"]]], pa.list_(pa.string()))], names=["first", "letters"])
                at += s["rows"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the repaired lines of every conversation, whose rows come in order; nothing but its state is kept."""
    key = digest = None
    state, lines = 0, 0
    ended = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([digest.hexdigest()])], names=["conv_key", "repaired_sha256"])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_key", "role", "text", "letters")]
        for conv, role, text, letters in zip(*columns, strict=True):
            if digest is None or conv != key:
                if digest is not None:
                    yield ended()
                key, digest, state, lines = conv, hashlib.sha256(), 0, 0
            state, more = walk(state, role, text, letters)
            for line in more:
                digest.update(("\n" if lines else "").encode() + line.encode())
                lines += 1
    if digest is not None:
        yield ended()
    common.release()


def _solve_long(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Results of conversations that no task should hold. rows: as ``damaged``; convs: conv_id and conv_key, a number of its own."""
    rows = rows.withColumn("place", F.monotonically_increasing_id()).where("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    rows = rows.join(convs.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own"))).select("conv_key", "turn", "role", "text", _digest().alias("digest"), "place", "copy")
    keys = ["conv_key", "turn", "digest", "place", "copy"]
    ordered = common.cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_key", "turn", "role", "text", "digest", _initial(F.col("role")).alias("initial"), _blank().alias("blank"), _truncated().alias("truncated"), F.monotonically_increasing_id().alias("at")))
    light = ordered.select("conv_key", "turn", "digest", "initial", "blank", "truncated", "at")
    firsts = light.groupBy("conv_key", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    light = light.join(firsts, "at", "left").withColumn("duplicate", F.col("first").isNull() & ~F.col("blank")).withColumn("cut_off", F.col("truncated") & ~F.col("blank") & ~F.col("duplicate"))
    mark = F.when(F.col("blank") | F.col("duplicate"), "d").when(F.col("cut_off"), F.upper("initial")).otherwise(F.col("initial"))
    sorted_ = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", c.alias("x")))), lambda r: r["x"]), "")
    segments = light.groupBy("conv_key", F.floor(F.col("at") / SEGMENT).alias("segment")).agg(
        sorted_(mark).alias("marks"), sorted_(F.col("initial")).alias("initials"), F.min("at").alias("first"), F.count("*").alias("rows"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate")], F.count_if("cut_off").alias("truncated"))
    order = Window.partitionBy("conv_key").orderBy("first")
    # pairs of neighbours: those within a segment, and of its first row with the last one before
    pairs = F.concat(F.coalesce(F.lag(F.substring("initials", -1, 1)).over(order), F.lit("")), F.col("initials"))
    illegal = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.length("pairs") - 1), lambda i: F.substring("pairs", i, F.lit(2))), lambda p: ~p.isin("su", "ua", "au")))
    segments = segments.withColumn("seq", F.row_number().over(order) - 1).withColumn("pairs", pairs).withColumn("illegal", F.when(F.length("pairs") > 1, illegal).otherwise(0)).drop("pairs", "initials")
    segments = common.cut(segments)
    cells = "costs array<long>, audits array<string>"
    level = common.cut(segments.select("conv_key", "seq", "marks").mapInArrow(_tables, f"conv_key long, seq int, {cells}"))
    while level.agg(F.max("seq")).first()[0]:
        grouped = level.groupBy("conv_key", F.floor(F.col("seq") / FAN).cast("int").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("seq", "costs", "audits"))).alias("parts"))
        before, level = level, common.cut(grouped.mapInArrow(_compose, f"conv_key long, seq int, {cells}"))
        common.drop(before)
    ends = F.array(*[F.when(F.get("costs", F.lit(e)).isNotNull(), F.struct(F.get("costs", F.lit(e)).alias("cost"), F.get("audits", F.lit(e)).alias("audit"))) for e in ACCEPTING])
    best = level.select("conv_key", F.array_min(F.array_compact(ends)).alias("x")).select("conv_key", "x.*")
    counted = segments.groupBy("conv_key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.array_sort(F.collect_list(F.struct("first", "rows"))).alias("segments"))
    solved = common.cut(best.join(counted, "conv_key"))
    pieces = solved.select("audit", "segments").mapInArrow(_letters, "first long, letters array<string>")
    pieces = pieces.select("first", F.posexplode("letters").alias("i", "letters")).select((F.col("first") + F.col("i")).alias("at"), "letters")
    edited = ordered.select("conv_key", "at", "role", "text").join(pieces, "at").repartition("conv_key").sortWithinPartitions("conv_key", "at")
    digests = edited.select("conv_key", "role", "text", "letters").mapInArrow(_digests, "conv_key long, repaired_sha256 string")
    turns = ordered.where("turn is not null").groupBy("conv_key", "turn").agg(F.lit(1).alias("one")).groupBy("conv_key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = convs.join(solved.drop("segments"), "conv_key", "left").join(digests, "conv_key", "left").join(turns, "conv_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repaired(rows: DataFrame) -> DataFrame:
    """One row of faults, edits and the digest of the repaired lines for every conversation of rows (as ``damaged`` gives them)."""
    common.configure(rows.sparkSession)
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    long = sizes.where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("conv_id")
    long = common.cut(long.withColumn("conv_key", F.monotonically_increasing_id()))
    some = not long.isEmpty()
    short = rows.join(long.select(F.col("conv_id").alias("own")), F.col("conv_id").eqNullSafe(F.col("own")), "left_anti") if some else rows
    short = short.select("conv_id", "turn", "role", "text", _initial(F.col("role")).alias("initial"), _blank().alias("blank"), _truncated().alias("truncated"), "copies", _digest().alias("digest"))
    out = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest").mapInArrow(_solve_stream, _RESULT)
    return out.unionByName(_solve_long(rows, long)) if some else out


# -------------------------------------------------------------------- query


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired digest of every damaged conversation."""
    return repaired(damaged(common.table(spark, sf_dir, "conversations")))


_NL = "chr(10)"
_ORDER = "turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text), copy"
#: The same lattice as a recursive query over its rows: inserts (two at most lead anywhere), then one move per row.
ORACLE_SQL = f"""WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {_ORDER}) AS i, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial,
  NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY {_ORDER}) > 1 AS seen, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open FROM d),
f AS (SELECT *, CASE WHEN blank THEN 'b' WHEN seen THEN 'd' WHEN open THEN 't' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM r),
ins AS (SELECT * FROM (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', {_NL} || 'user:'), (1, 2, 'I', {_NL} || 'user:'), (3, 2, 'I', {_NL} || 'user:'), (2, 3, 'I', {_NL} || 'assistant:'),
  (0, 3, 'II', {_NL} || 'user:' || {_NL} || 'assistant:'), (1, 3, 'II', {_NL} || 'user:' || {_NL} || 'assistant:')) t(a, z, let, txt)),
act AS (SELECT * FROM (VALUES (0, 0, 'D', 3, NULL), (1, 1, 'D', 3, NULL), (2, 2, 'D', 3, NULL), (3, 3, 'D', 3, NULL), (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'),
  (0, 2, 'R', 2, NULL), (1, 2, 'R', 2, NULL), (3, 2, 'R', 2, NULL), (2, 3, 'R', 2, NULL)) t(a, z, let, price, initial)),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS st, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS b FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT p.conv_id, p.i + 1, act.z, min({{'cost': (p.b.cost + 2 * length(ins.let) + price + CASE WHEN fault = 't' AND act.let <> 'D' THEN 1 ELSE 0 END)::BIGINT, 'audit': p.b.audit || ins.let || act.let,
    'said': p.b.said || ins.txt || CASE act.let WHEN 'K' THEN {_NL} || role || ':' || text WHEN 'R' THEN {_NL} || CASE WHEN act.z = 2 THEN 'user' ELSE 'assistant' END || ':' || text ELSE '' END}})
  FROM dp p JOIN ins ON ins.a = p.st JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN act ON act.a = ins.z AND (act.initial IS NULL OR act.initial = f.initial) AND (act.let = 'D' OR fault NOT IN ('b', 'd'))
  GROUP BY p.conv_id, p.i, act.z),
counted AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
  count(*) FILTER (WHERE previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
done AS (SELECT dp.conv_id, min({{'cost': b.cost + 2 * length(let), 'audit': b.audit || let, 'said': b.said || txt}}) AS b FROM dp JOIN counted ON dp.conv_id IS NOT DISTINCT FROM counted.conv_id AND dp.i = n JOIN ins ON ins.a = st AND z IN (0, 3) GROUP BY dp.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted ON o.conv_id IS NOT DISTINCT FROM counted.conv_id LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id"""
