"""Edits of runs, heading styles and looks, the guard, style chains and scratch tables against plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpaudit import schemas, tables
from corpaudit.operators import audit, corrections, insertion, properties, report, requirements, structure, verify
from corpaudit.operators import runs as rn
from corpaudit.plans import layouts
from corpaudit.sources import corpus
from corpaudit.streaming import audit_stream
from corpaudit.tables import cut
from tests.test_formats import P, R, paragraphs


def run(text, **more):
    held = {"has_page_break": False, "has_drawing": False}
    return {"text": text, "props": R | {k: v for k, v in more.items() if k not in held}} | held | {k: v for k, v in more.items() if k in held}


def looks(runs):
    """Each character with its run's italics, and what stands between characters."""
    out = []
    for r in runs:
        out += [(c, r["props"]["italic"]) for c in r["text"] or ""]
        if r["has_drawing"]:
            out.append(("drawing", None))
    return out


def test_runs_are_spliced_cut_and_merged(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        runs = [run("".join(rng.choice("abc ") for _ in range(rng.randint(0, 6))), italic=rng.choice([True, False, None]), has_drawing=rng.random() < 0.1) for _ in range(rng.randint(0, 5))]
        size = sum(len(r["text"]) for r in runs)
        a, b = sorted((rng.randint(0, size), rng.randint(0, size)))
        rows.append((i, runs, a, b, rng.choice(["", "NEW"])))
    df = spark.createDataFrame(rows, f"id long, runs {schemas.RUNS}, a int, b int, after string")
    kind = df.schema["runs"].dataType
    ranges = F.array(F.struct(F.col("a").alias("start"), F.col("b").alias("end")))
    found = df.select("id", rn.spliced(F.col("runs"), kind, F.col("a"), F.col("b"), F.col("after")).alias("s"), rn.in_ranges(F.col("runs"), kind, ranges, "italic").alias("i"), rn.merged(F.col("runs"), kind).alias("m"))
    for r in found.collect():
        _, runs, a, b, after = rows[r.id]
        as_dicts = lambda x: [y.asDict(True) for y in x]
        # of each character its place, so that pictures may stand between
        at, cut, slanted, done = 0, [], [], a == b
        for one in runs:
            italic = one["props"]["italic"]
            if not done and at + len(one["text"]) > a and at < b:
                cut += [(c, italic) for c in one["text"][: max(0, a - at)]] + [(c, italic) for c in after] + [(c, italic) for c in one["text"][max(0, b - at) :]]
                done = True
            else:
                cut += [(c, italic) for k, c in enumerate(one["text"], at) if a == b or not a <= k < b]
            slanted += [(c, a <= k < b) for k, c in enumerate(one["text"], at)]
            at += len(one["text"])
            if one["has_drawing"]:
                cut.append(("drawing", None))
        assert looks(as_dicts(r.s)) == cut
        assert [x for x in looks(as_dicts(r.i)) if x[0] != "drawing"] == slanted
        assert looks(as_dicts(r.m)) == looks(runs) and all(x["text"] or x["has_drawing"] for x in as_dicts(r.m))
        assert not any(x["props"] == y["props"] and not x["has_drawing"] and not y["has_drawing"] for x, y in zip(as_dicts(r.m), as_dicts(r.m)[1:], strict=False))


def test_text_changes_reach_the_runs_and_typed_indents_keep_looks(spark):
    rows = [("See (Rowan and Pike, 2020) there.", {"runs": [run("See (Ro", italic=True), run("wan and", italic=False), run(" Pike, 2020) there.", italic=None)]}), ("  Typed blanks.", {"runs": [run(" "), run(" Typed ", italic=True), run("blanks.")]}), ("No runs known.", {})]
    paras = paragraphs(spark, rows)
    changes = spark.createDataFrame([(1, 0, 0, "(Rowan and Pike, 2020)", "(Rowan & Pike, 2020)"), (1, 0, 1, "there", "here"), (1, 2, 0, "known", "given"), (1, 2, 1, "absent", "x")], "doc_id long, p_idx int, step int, before string, after string")
    done = {r.p_idx: r for r in corrections.apply_text_changes(paras, changes).collect()}
    assert done[0].text == "See (Rowan & Pike, 2020) here." and [(r.text, r.props.italic) for r in done[0].runs] == [("See (Rowan & Pike, 2020)", True), (" here.", None)]
    assert done[2].text == "No runs given." and done[2].runs is None
    set_ = spark.createDataFrame([(1, 1, "text", "Typed blanks.", 0), (1, 1, "first_line_indent", "720", 0), (1, 2, "style_id", "Heading1", 0)], "doc_id long, p_idx int, field string, value string, step int")
    done = {r.p_idx: r for r in corrections.apply_prop_changes(paras, set_).collect()}
    assert done[1].text == "Typed blanks." and [(r.text, r.props.italic) for r in done[1].runs] == [("Typed ", True), ("blanks.", None)] and done[1].props.first_line_indent == 720
    assert done[2].style_id == "Heading1"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_runs_join_to_the_text_after_all_corrections(spark):
    t = layouts.tables(spark, "/root/testdata/sf0.001")
    from corpaudit.operators import requirements

    done = audit.correct_tables(t["paragraphs"], requirements.effective_requirements(t["settings"]), styles=t["styles"], forced=t["forced"])
    assert rn.mismatched(done["paragraphs"]).isEmpty() and done["paragraphs"].where("runs is not null").count() > 1000
    assert not corrections.ref.ranges_are_italic(done["paragraphs"].where("text like 'Harlow%' or text like 'Rowan, A.%'")).where("not italic").count()
    changes = done["changes"]
    assert {r.rule_id for r in changes.select("rule_id").distinct().collect()} >= {"APA-HEAD-001", "APA-HEAD-002", "APA-REFERENCE-008", "APA-CITATION-001", "APA-PARA-003"}
    assert not changes.where("reason is null or confidence is null or document_wide is null or field is null").count()
    marked = {r.after for r in changes.where("rule_id = 'APA-HEAD-002' and field = 'text'").collect()}
    assert marked == {"The Later Work on APA", "A Smaller Part"}
    kept = corrections.assert_preserved(t["paragraphs"], done["paragraphs"], changes.where("field = 'text'"))
    assert kept.isEmpty()


def test_heading_styles_take_their_levels_look(spark):
    styles = spark.createDataFrame([(1, "Heading2", "heading 2", "paragraph", "Base", False, P | {"line": 240, "left_indent": 3}, R | {"italic": True}), (1, "Base", "Base", "paragraph", None, True, P, R), (1, "Own", "Own", "paragraph", "Heading2", False, P, R)], schemas.STYLES)
    used = spark.createDataFrame([(1, 2), (1, 2), (1, 4), (2, 1)], "doc_id long, level int")
    look = spark.createDataFrame([(1, "Arial", 11)], "doc_id long, font string, font_size int")
    done = {(r.doc_id, r.style_id): r for r in corrections.heading_styles(styles, used, look).collect()}
    assert set(done) == {(1, "Heading2"), (1, "Base"), (1, "Own"), (1, "Heading4"), (2, "Heading1")}
    h = done[1, "Heading2"]
    assert (h.p_pr.line, h.p_pr.left_indent, h.p_pr.alignment, h.r_pr.bold, h.r_pr.italic, h.r_pr.font_ascii, h.r_pr.size_half_points, h.based_on) == (480, 3, "left", True, False, "Arial", 22, "Base")
    assert (done[1, "Heading4"].p_pr.first_line_indent, done[1, "Heading4"].name, done[2, "Heading1"].p_pr.alignment) == (720, "heading 4", "center")
    chained = {r.style_id: r for r in properties.resolve_styles(corrections.heading_styles(styles, used, look)).where("doc_id = 1").collect()}
    assert chained["Own"].r_pr.bold and chained["Own"].p_pr.line == 480


def test_guard_replays_in_order_and_counts(spark):
    before = paragraphs(spark, [("One “two” three", {}), ("Two more", {}), ("Kept", {}), ("", {"flags": {"has_drawing": True}})])
    after = paragraphs(spark, [("One 2 three", {}), ("Second more", {}), ("Kept", {}), ("", {"flags": {"has_drawing": True}})])
    # a change goes to its own paragraph first, one of no known place to the first that holds it
    changes = [(1, None, 0, "two", "2"), (1, 1, 1, "Line “Two” is off", "Line “Second”"), (1, 1, 2, "nowhere", "x"), (1, 2, 3, None, None)]
    told = spark.createDataFrame(changes, "doc_id long, p_idx int, step int, before string, after string")
    assert corrections.assert_preserved(before, after, told).isEmpty()
    # in the other order, and of no known place, the quoted word goes to the first paragraph
    other = spark.createDataFrame([(1, None, 5 - s, b, a) for _, _, s, b, a in changes], told.schema)
    assert {(r.side, r.collapsed) for r in corrections.assert_preserved(before, after, other).collect()} >= {("lost", "onesecondthree")}
    assert {(r.side, r.collapsed) for r in corrections.assert_preserved(before, after.where("p_idx <> 2"), told).collect()} == {("lost", "kept")}
    assert {(r.side, r.collapsed) for r in corrections.assert_preserved(before, after.where("p_idx <> 3"), told).collect()} == {("lost", "counter has_drawing"), ("added", "counter has_drawing")}
    put_in = spark.createDataFrame([(1, "Kept")], "doc_id long, text string")
    assert {r.side for r in corrections.assert_preserved(before, after, told, inserted=put_in).collect()} == {"lost", "added"}
    inline = lambda *kinds: spark.createDataFrame([(1, 0, k) for k in kinds], "doc_id long, p_idx int, kind string")
    found = corrections.assert_preserved(before, after, told, inline=(inline("footnote", "equation"), inline("footnote")))
    assert [(r.side, r.collapsed, r.n) for r in found.collect()] == [("lost", "counter equation", 1)]
    shapes = lambda *s: spark.createDataFrame([(1, i, i, r, c, "") for i, (r, c) in enumerate(s)], schemas.DOC_TABLES)
    assert corrections.assert_preserved(before, after, told, tables=(shapes((2, 3)), shapes((2, 3)))).isEmpty()
    assert {r.collapsed for r in corrections.assert_preserved(before, after, told, tables=(shapes((2, 3)), shapes((3, 2)))).collect()} == {"shapes 2x3", "shapes 3x2"}
    print_ = corrections.fingerprint(before, shapes((1, 1)), inline("hyperlink", "hyperlink", "endnote")).first()
    assert (print_.hyperlinks, print_.endnotes, print_.equations, print_.shapes) == (2, 1, 0, ["1x1"])


def test_scratch_goes_with_its_batch_and_repeats_are_seen(spark, tmp_path):
    folder = tables.shared_dir(spark).removeprefix("file://")
    held = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    at_first = held()
    text = "Background\nIt was said (Marsh, 2018).\nReferences\nMarsh, E. (2018). On thaw. Harbour Press."
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(3):
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        audit_stream.audit_stream(audit_stream.read_documents(spark, f"{tmp_path}/in"), path, state).awaitTermination(300)
    assert sorted(os.listdir(tmp_path / "out" / "_whole")) and spark.read.parquet(f"{path}/report").count() == 3
    assert held() == at_first
    # the last batch comes again, as after a failure: once its mark stands nothing is written anew, without it all is
    last = tmp_path / "out" / "report" / "batch=2"
    before = sorted(os.listdir(last))
    for mark, same in ((True, True), (False, False)):
        (tmp_path / "state" / "commits" / "2").unlink()
        for f in (tmp_path / "state" / "commits").glob(".2.*"):
            f.unlink()
        if not mark:
            (tmp_path / "out" / "_whole" / "batch=2").unlink()
        audit_stream.audit_stream(audit_stream.read_documents(spark, f"{tmp_path}/in"), path, state).awaitTermination(300)
        assert (sorted(os.listdir(last)) == before) is same and spark.read.parquet(f"{path}/report").count() == 3
    assert held() == at_first


def test_scopes_nest(spark, tmp_path):
    df = spark.range(3)
    with tables.scope(spark):
        outer = tables.cut(df)
        with tables.scope(spark):
            inner = tables.cut(df)
            assert inner.count() == 3
        assert outer.count() == 3
        with pytest.raises(Exception, match="(?i)not.*exist"):
            inner.count()
    assert tables.cut(df).count() == 3


def test_providers(spark, tmp_path):
    works = [("10.5/A", "Late ice on northern rivers", [("Marsh", "E.")], "J", "2018", "7", "1", "1"), ("10.5/b", "Harbours of the north", [("Okoye", "T.")], "J", "2017", "1", "1", "1")]
    spark.createDataFrame(works, schemas.WORKS).write.parquet(f"{tmp_path}/works")
    kind = "doc_id long, ref_idx int, doi string, title string, year string, surnames array<string>, journal struct<volume:string>"
    refs = spark.createDataFrame([(1, 0, "10.5/a", "Late ice on northern rivers", "2018", ["Marsh"], ("7",)), (1, 1, None, "Harbours of the north", "2016", ["Okoye"], None), (1, 2, "10.5/zz", "Gone", "2000", ["Nobody"], None), (1, 3, None, "Harbours of the North", "2017", ["Okoye"], ("1",)), (2, 0, "10.5/A", "Late ice on northern rivers", "2018", ["Marsh"], ("7",))], kind)
    status = lambda df: {(r.doc_id, r.ref_idx): r.status for r in df.collect()}
    whole = {(1, 0): "verified", (1, 1): "probable", (1, 2): "mismatch", (1, 3): "verified", (2, 0): "verified"}
    provider = verify.parquet_provider(spark, f"{tmp_path}/works")
    assert status(verify.verify_references(refs, provider)) == whole == status(verify.verify_references(refs, provider.works))
    off = verify.verify_references(refs, verify.no_provider())
    assert set(status(off).values()) == {"unverified"} and off.first().differences == ["verification is off"]
    # a source that cannot answer for titles: the others are answered all the same
    down = verify.Provider("down", provider.works, lambda asked: asked.where("doi is null"))
    found = verify.verify_references(refs, down)
    assert status(found) == whole | {(1, 1): "provider_unavailable", (1, 3): "provider_unavailable"} and {r.confidence for r in found.where("status = 'provider_unavailable'").collect()} == {0.0}
    assert {r.doc_id: r.provider_unavailable for r in report.verification_summary(found).collect()} == {1: True, 2: False}
    # two lookups a document: the same title is one; what a cache knows costs none, what failed is asked again
    assert status(verify.verify_references(refs, provider, budget=2)) == whole | {(1, 2): "unverified"}
    asked = verify.lookups(refs, 9).where("served").groupBy("key").agg(F.min("doi").alias("doi"), F.min("title").alias("title"))
    cache = verify.answers(asked, down)
    assert status(verify.verify_references(refs, provider, budget=1, cache=cache)) == whole
    assert status(verify.verify_references(refs, provider, budget=0, cache=cache)) == whole | {(1, 1): "unverified", (1, 3): "unverified"}
    empty = verify.Provider("empty", provider.works.limit(0))
    assert status(verify.verify_references(refs, empty, budget=9)) == {k: "unverified" if k in ((1, 1), (1, 3)) else "mismatch" for k in whole}


def test_places_move_behind_what_is_put_in_removed_or_split(spark):
    rng = random.Random(3)
    rows = [(d, rng.choice([None, *range(12)]), f"r{i}") for i, d in enumerate(rng.choices([1, 2, 3], k=60))]
    marks = [(d, rng.randint(0, 11), rng.choice([1, -1, 2])) for d in (1, 1, 1, 2, 4)]
    df = spark.createDataFrame(rows, "doc_id long, block_idx int, _by string")
    found = insertion.moved(df, spark.createDataFrame(marks, "doc_id long, at int, by int"))
    assert found.columns == df.columns
    wanted = [(d, b if b is None else b + sum(by for m, at, by in marks if m == d and at <= b), r) for d, b, r in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)


def test_given_title_lines_are_put_in_once_and_the_guard_lets_them_pass(spark):
    lines = [("A Study of Rivers", {"alignment": "center"}), ("Sam Rivers", {}), ("March 3, 2024", {"flags": {"page_break_after": True}}), ("Background", {}), ("The river ran along the old town for many quiet hours.", {})]
    paras = cut(paragraphs(spark, lines).unionByName(paragraphs(spark, lines[3:]).withColumn("doc_id", F.lit(2).cast("long"))))
    given = "struct<title:string,author:string,institution:string,course_number:string,course_name:string,instructor:string,due_date:string,running_head:string>"
    rows = [(d, "student", ("Own Title", "Ann Lake", "University of Lakes", None, "Water", "Dr. Reed", " ", None)) for d in (1, 2)]
    asked = spark.createDataFrame(rows, f"doc_id long, paper_type string, metadata {given}")
    settings = asked.selectExpr("doc_id", "paper_type", "string(null) font", "int(null) font_size", "boolean(null) abstract_required", "boolean(null) running_head_required", "int(null) min_references", "metadata")
    settings = cut(requirements.effective_requirements(settings))
    done = audit.correct_tables(paras, settings)
    texts = {d: [r.text for r in done["paragraphs"].where(F.col("doc_id") == d).orderBy("p_idx").collect()] for d in (1, 2)}
    assert texts[1] == ["A Study of Rivers", "Sam Rivers", "University of Lakes", "Water", "Dr. Reed", "March 3, 2024", "Background", lines[4][0]]
    assert texts[2] == ["", "", "", "Own Title", "", "Ann Lake", "University of Lakes", "Water", "Dr. Reed", "", "Background", lines[4][0]]
    put = done["changes"].where("field = 'inserted'")
    assert {(r.doc_id, r.rule_id, r.after) for r in put.collect()} == {(1, "APA-TITLE-003", x) for x in texts[1][2:5]} | {(2, "APA-TITLE-001", x) for x in ("Own Title", "Ann Lake", "University of Lakes", "Water", "Dr. Reed")}
    kept = done["changes"].where("field = 'text'")
    assert not corrections.assert_preserved(paras, done["paragraphs"], kept, inserted=done["inserted"]).count()
    assert {r.side for r in corrections.assert_preserved(paras, done["paragraphs"], kept).collect()} == {"added"}
    # what a user gives counts as known; the title page that was made is one
    before = {(r.doc_id, r.rule_id, r.message) for r in audit.audit(paras, settings, ("format",))["issues"].where("rule_id in ('APA-TITLE-001', 'APA-TITLE-003')").collect()}
    assert before == {(2, "APA-TITLE-001", "No title page was found.")}
    after = audit.audit(done["paragraphs"], settings, ("format",))
    assert not after["issues"].where("rule_id = 'APA-TITLE-001'").count() and after["structure"].where("has_title_page").count() == 2
    blank = done["paragraphs"].where("doc_id = 2 and p_idx in (0, 3, 9)").orderBy("p_idx").collect()
    assert [(r.is_empty, r.page_break_after, r.props and r.props.alignment) for r in blank] == [(True, False, "center"), (False, False, "center"), (True, True, "center")] and blank[1].run_props.bold
    assert not rn.mismatched(done["paragraphs"]).count()


def test_paragraphs_are_annotated_once_and_split_papers_again(spark, monkeypatch):
    made, plain = [], structure.annotate
    monkeypatch.setattr(structure, "annotate", lambda df: made.append(1) or plain(df))
    whole = spark.createDataFrame([(1, "Rivers freeze (Marsh, 2018).\nReferences\nMarsh, E. (2018). On thaw. doi:10.5555/a")], "doc_id long, text string")
    audit.correct(corpus.to_paragraphs(whole))
    assert len(made) == 1
    fused = spark.createDataFrame([(2, "Rivers freeze (Marsh, 2018).\x0bReferences\nMarsh, E. (2018). On thaw. doi:10.5555/a")], "doc_id long, text string")
    done = audit.correct(corpus.to_paragraphs(whole.union(fused)))[0].select("doc_id", "p_idx", "text").collect()
    assert len(made) == 3
    assert sorted(map(tuple, done)) == [(d, i, t) for d in (1, 2) for i, t in enumerate(["Rivers freeze (Marsh, 2018).", "References", "Marsh, E. (2018). On thaw. https://doi.org/10.5555/a"])]
