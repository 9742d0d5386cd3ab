"""Top-k search, Merkle manifests and conversation repair against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from corpaudit.llm import merkle, repair, topk

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


# -------------------------------------------------------------------- op 13


def plain_leaf(fields):
    return SHA("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(nodes, arity):
    """Levels of digests, and for each leaf its siblings (left, right) upwards."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([SHA("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    paths = []
    for at in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = level[at // arity * arity :][:arity]
            path.append(("".join(run[: at % arity]), "".join(run[at % arity + 1 :])))
            at //= arity
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows, arity):
    """(key, digest, subroot, root, path) of every row (group, key, digest)."""
    groups = sorted({g for g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: sorted(((k, h) for group, k, h in rows if group == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in groups}
    below = {g: plain_tree([h for _, h in leaves[g]], arity) for g in groups}
    root, above = plain_tree([below[g][0] for g in groups], arity)
    return sorted([(k, h, below[g][0], root, tuple(p + above[i])) for i, g in enumerate(groups) for (k, h), p in zip(leaves[g], below[g][1], strict=True)], key=str)


def test_merkle_equals_a_plain_tree(spark):
    rng = random.Random(5)
    sizes = {None: 3, "": 1, "a": 2, "é": 4, "Z": 27, "big": 260, "c": 16, "d": 17}
    rows = [(g, i if i % 11 else None, SHA(f"{g} {i % 200}")) for g, n in sizes.items() for i in range(n)] + [("a", 5, SHA("twin")), ("a", 5, SHA("twin"))]
    rng.shuffle(rows)
    for arity, every in ((16, 2), (3, 1), (3, 3), (2, 2)):
        df = spark.createDataFrame(rows, "grp string, key long, digest string").select("grp", "key", F.unhex("digest").alias("h"), F.col("key").alias("kept")).repartition(5)
        built = merkle.build(df, arity, every)
        found = merkle.proofs(built).withColumn("fold", merkle.folded(F.lower(F.hex("h")), F.col("path"))).withColumn("digest", merkle.proof_digest(F.col("path"))).collect()
        wanted = plain_manifest(rows, arity)
        assert sorted(((r.kept, r.h.hex(), r.subroot, r.root, tuple((x.left, x.right) for x in r.path)) for r in found), key=str) == [tuple(w) for w in wanted]
        assert built.root == wanted[0][3] and all(r.fold == r.root for r in found)
        assert all(r.digest == SHA("".join(x.left + x.right for x in r.path)) for r in found)
        # every stored level but the leaves is `every` levels above the one below
        assert [level.where("grp = 0").count() for level in built.levels][-1] == 1


def test_merkle_of_few_rows_and_the_query(spark, tmp_path):
    empty = spark.createDataFrame([], "grp string, key long, h binary")
    assert merkle.build(empty).root is None and merkle.proofs(merkle.build(empty)).isEmpty()
    one = spark.createDataFrame([("a", 1, b"\x01" * 32)], "grp string, key long, h binary")
    r = merkle.proofs(merkle.build(one)).first()
    assert r.subroot == r.root == "01" * 32 and r.path == []
    texts = [None, "", "UPPER", "lower", "ÄÖ same", "X" * 100_000, "tie", "tie"]
    rows = [(None if i == 2 else i // 2 if i > 5 else i, t, None if i % 3 else "en", None if i == 1 else f"s{i % 2}", i) for i, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit(1)).withColumn("grp", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    leaf = lambda r, text: plain_leaf((r[0], r[3], r[2], r[4], text))
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    fake = lambda r: leaf(r, low(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1])
    faked = {leaf(r, r[1]): fake(r) for r in rows}
    wanted = []
    for key, digest, subroot, root, path in plain_manifest([(r[3], r[0], leaf(r, r[1])) for r in rows], 16):
        fold = faked[digest]
        for left, right in path:
            fold = SHA(left + fold + right)
        wanted.append((key, digest, subroot, root, SHA("".join(a + b for a, b in path)), fold, fold == root))
    found = merkle.op13_merkle(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert not all(w[-1] for w in wanted)


# -------------------------------------------------------------------- op 12


def plain_top_k(rows, k, asked):
    """(query, rank, id, score) from all scores."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    most = topk.MOST
    out = []
    for q in sorted({i for i, _ in good if asked(i)}):
        mine = min(v for i, v in good if i == q)
        scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(mine, v, strict=False)))), i) for i, v in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def found_top_k(spark, rows, k, asked):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)).repartition(3)
    return [tuple(r) for r in topk.top_k(df.select("vec_id", topk.scaled(F.col("embedding")).alias("v")), asked, k).orderBy("query_id", "rank").collect()]


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, vector()) for i in range(300)]
    # a third of all rows are one vector, others tie by chance or are opposite
    same = vector()
    rows += [(i, same) for i in range(300, 450)] + [(i, [rng.choice([0.0, 1.0]) for _ in range(6)]) for i in range(450, 520)] + [(i, [-x for x in same]) for i in range(520, 525)]
    rows += [(None, vector()), (1000, None), (1010, [1.0, None]), (1020, [math.nan]), (1030, [math.inf, 1.0]), (1040, []), (1050, [2.0]), (1060, vector() + [0.5]), (310, vector()), (10, same), (-20, vector()), (7, same), (7, same)]
    asked = lambda i: i % 10 == 0
    wanted = plain_top_k(rows, 10, asked)
    assert found_top_k(spark, rows, 10, F.col("vec_id") % 10 == 0) == wanted
    # many rounds, small blocks, few bins and no early end give the same
    for name, value in (("ROUND_BYTES", 300), ("ROWS", 50), ("QUERY_ROWS", 7), ("BINS", 5), ("ENOUGH", 0)):
        monkeypatch.setattr(topk, name, value)
    assert found_top_k(spark, rows, 10, F.col("vec_id") % 10 == 0) == wanted


def test_top_k_of_few_and_huge(spark):
    huge = [(0, [1e300, 1.0]), (1, [1e300, -1e300]), (2, [-1e17, 3.0]), (3, [2.0**40, 2.0**20]), (4, [2.0**21, -(2.0**30)]), (5, [1e-300, 0.0]), (6, [-1e-300, 0.1])]
    assert found_top_k(spark, huge, 3, F.col("vec_id") < 10) == plain_top_k(huge, 3, lambda i: True)
    few = [(0, [1.0, 2.0]), (1, [0.0, -1.0])]
    assert found_top_k(spark, few, 10, F.col("vec_id") == 0) == [(0, 1, 1, -2 * 1024 * 1024)]
    assert found_top_k(spark, few, 10, F.col("vec_id") > 5) == []
    assert found_top_k(spark, [(0, [1.0])], 10, F.col("vec_id") == 0) == []
    assert found_top_k(spark, [(None, None)], 10, F.col("vec_id") == 0) == []


# -------------------------------------------------------------------- op 11


def every_repair(marks):
    """The least (cost, audit) of all edits with two inserts at most in a place, one by one."""
    inserts = ("", "I", "II")
    best = None
    for gaps in itertools.product(inserts, repeat=len(marks) + 1):
        for moves in itertools.product("DKR", repeat=len(marks)):
            audit, state, cost, legal = "", "", 0, True
            for gap, move, mark in itertools.zip_longest(gaps, moves, marks):
                for _ in gap:
                    state += "a" if state.endswith("u") else "u"
                    cost += 2
                audit += gap + (move or "")
                if move == "D":
                    cost += 3
                elif move:
                    legal &= mark != "d"
                    state += mark.lower() if move == "K" else "a" if state.endswith("u") else "u"
                    cost += (2 if move == "R" else 0) + mark.isupper()
            if legal and re.fullmatch("(s?(ua)+)?", state):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_cheapest_edits_equal_all_edits():
    rng = random.Random(2)
    for marks in ["", *"suaxSUAXd", *("".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(2, 4))) for _ in range(60))]:
        assert repair.cheapest(marks) == every_repair(marks), marks
    # tables of parts compose to the whole
    for _ in range(60):
        marks = "".join(rng.choice("suaaauuxSUAXd") for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.randint(0, len(marks)) for _ in range(3))
        parts = [marks[a:b] for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True)]
        table = None
        for part in parts:
            one = [repair.cheapest(part, s, (e,)) for s in repair.STATES for e in repair.STATES]
            table = one if table is None else repair.composed(table, one)
        assert min(x for x in (table[0], table[3]) if x) == repair.cheapest(marks)


def plain_repair(rows):
    """Results of all conversations from (conv_id, turn, role, text), without Spark."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        faults, marks = collections.Counter(), ""
        for i, (_, role, text) in enumerate(kept):
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in [k[1:] for k in kept[:i]] else "" if bare[-1] in ".!?" else "truncated"
            faults[fault] += 1
            initial = role[:1] if role[:1] in tuple("sua") else "x"
            marks += "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        # dynamic programming over rows and states
        best, nexts = {"": (0, "", "")}, {"": "u", "s": "u", "u": "a", "a": "u"}

        def inserted(best):
            for _ in range(3):
                for state, (cost, audit, said) in list(best.items()):
                    to = nexts[state]
                    way = (cost + 2, audit + "I", said + ("\nuser:" if to == "u" else "\nassistant:"))
                    best[to] = min(best.get(to, way), way)
            return best

        for mark, (_, role, text) in zip(marks, kept, strict=True):
            after = {}
            for state, (cost, audit, said) in inserted(best).items():
                ways = [(state, cost + 3, audit + "D", said)]
                if mark != "d":
                    to, more = nexts[state], mark.isupper()
                    ways.append((to, cost + 2 + more, audit + "R", said + ("\nuser:" if to == "u" else "\nassistant:") + text))
                    if mark.lower() == to or (mark.lower() == "s" and state == ""):
                        ways.append((mark.lower(), cost + more, audit + "K", said + f"\n{role}:{text}"))
                for to, *way in ways:
                    after[to] = min(after.get(to, tuple(way)), tuple(way))
            best = after
        cost, audit, said = min(w for s, w in inserted(best).items() if s in ("", "a"))
        turns = {k[0] for k in kept} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(kept)]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, SHA(said[1:])))
    return sorted(out, key=str)


def test_repairs_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["One. ", "two", "Three!\n", "", " \t", None, "is it?", "é. \x0b", "x" * 3000 + ".", "a\u2003", "one."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "ulf", "User"]
    rows = [(c if c else None, t if rng.random() > 0.1 else None, rng.choice(roles[: 4 if c % 2 else 10]), rng.choice(texts)) for c in range(25) for t in range(rng.randint(1, 14))]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(300)] + [(51, 3, "user", "same.")] * 40 + [(52, 2**40, "user", "far."), (52, 7, "assistant", "near.")]
    rows += [(c, t, "user", "gone.") for c, t in itertools.product(range(100, 400), range(3)) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit(1)).withColumn("kind", F.lit(9)).repartition(4)
    wanted = plain_repair(rows)
    found = repair.repaired(repair.damaged(conv))
    assert sorted(map(tuple, found.collect()), key=str) == wanted
    # the same in segments: none of it is gathered by conversation
    for name, value in (("LONG_ROWS", 2), ("SEGMENT", 3), ("FAN", 2)):
        monkeypatch.setattr(repair, name, value)
    assert sorted(map(tuple, repair.repaired(repair.damaged(conv)).collect()), key=str) == wanted
    assert repair.repaired(repair.damaged(conv.limit(0))).isEmpty()
