"""Properties, headings, captions, title lookup, rules of one's own, streams, sinks: what the queries do not show."""

import datetime

from pyspark.sql import functions as F

from corpaudit import schemas
from corpaudit.functions import text as fx
from corpaudit.operators import assembly, audit, corrections, headings, properties, report, rules, structure, verify
from corpaudit.plans import layouts
from corpaudit.sources import corpus, sinks
from corpaudit.streaming import audit_stream

P = dict.fromkeys("alignment spacing_before spacing_after line line_rule first_line_indent hanging_indent left_indent contextual_spacing page_break_before".split())
R = dict.fromkeys("font_ascii font_hansi size_half_points bold italic underline all_caps".split())


def paragraphs(spark, lines, doc=1):
    """lines: (text, changes of the layout line)."""
    rows = []
    for i, (text, more) in enumerate(lines):
        x = layouts.line(text, **{k: v for k, v in more.items() if k not in ("run", "flags", "runs", "style")}, **{k: more[k] for k in ("run", "flags", "runs", "style") if k in more})
        flags = {k: x[k] for k in ("page_break_after", "has_drawing", "has_numbering", "has_sect_pr", "inside_table")}
        rows.append({"doc_id": doc, "p_idx": i, "block_idx": i, "text": text, "style_id": x["style"], "direct": x["props"], "props": x["props"], "run_props": x["run"], "runs": x["runs"], "is_empty": not text.strip() and not flags["has_drawing"], "text_before_break": None, "text_after_break": None} | flags)
    return spark.createDataFrame(rows, schemas.PARAGRAPHS)


def test_style_chains_resolve_to_their_end(spark):
    # forty styles, each based on the next; the last sets the line; a cycle ends
    chain = [(1, f"s{i}", f"S{i}", "paragraph", f"s{i + 1}" if i < 39 else None, i == 0, P | ({"line": 480} if i == 39 else {}) | ({"left_indent": i} if i in (3, 7) else {}), R | ({"bold": True} if i == 20 else {})) for i in range(40)]
    chain += [(2, "x", "X", "paragraph", "y", True, P | {"line": 240}, R), (2, "y", "Y", "paragraph", "x", False, P | {"left_indent": 5}, R)]
    styles = spark.createDataFrame(chain, schemas.STYLES)
    found = {(r.doc_id, r.style_id): r for r in properties.resolve_styles(styles).collect()}
    assert (found[1, "s0"].p_pr.line, found[1, "s0"].p_pr.left_indent, found[1, "s0"].r_pr.bold) == (480, 3, True)
    assert found[1, "s5"].p_pr.left_indent == 7 and found[1, "s30"].r_pr.bold is None
    assert (found[2, "x"].p_pr.line, found[2, "x"].p_pr.left_indent, found[2, "y"].p_pr.line) == (240, 5, 240)
    # direct, then the longest run, the style chain, the document's defaults
    run = lambda text, **more: {"text": text, "props": R | more, "has_page_break": False, "has_drawing": False}
    paras = spark.createDataFrame([(1, 0, 0, "aaabbb", None, P | {"spacing_after": 7}, P, R, [run("aa", italic=True), run("bbbb", italic=False, size_half_points=30)], False, False, False, False, False, False, None, None)], schemas.PARAGRAPHS)
    defaults = spark.createDataFrame([(1, P | {"line": 1, "spacing_before": 9}, R | {"font_ascii": "Arial"})], f"doc_id long, p_pr {schemas.PROPS}, r_pr {schemas.RUN_PROPS}")
    r = properties.effective_props(paras, styles, defaults).first()
    assert (r.props.spacing_after, r.props.line, r.props.spacing_before, r.run_props.italic, r.run_props.size_half_points, r.run_props.bold, r.run_props.font_ascii) == (7, 480, 9, False, 30, True, "Arial")


def test_run_flags_headers_and_fingerprint(spark):
    run = {"text": "", "props": R, "has_page_break": True, "has_drawing": False}
    paras = paragraphs(spark, [(" ", {"runs": [run]}), (" ", {"runs": [run | {"has_drawing": True}]}), ("word", {})])
    rows = properties.run_flags(paras).orderBy("p_idx").collect()
    assert [(r.page_break_after, r.has_drawing, r.is_empty) for r in rows] == [(True, False, True), (True, True, False), (False, False, False)]
    heads = spark.createDataFrame([(1, "h", "header", "default", "3", ["PAGE \\* X"]), (1, "f", "footer", "default", "Tail", ["PAGE"]), (2, "f", "footer", "default", "", ["PAGE"]), (3, "h", "header", "default", "RIVERS 2", None)], schemas.HEADERS_FOOTERS)
    assert {r.doc_id: (r.has_page_field, r.has_running_head) for r in properties.header_flags(heads).collect()} == {1: (True, False), 3: (False, True)}
    tables = spark.createDataFrame([(1, 1, 5, 2, 3, ""), (1, 0, 2, 1, 4, "")], schemas.DOC_TABLES)
    f = corrections.fingerprint(properties.run_flags(paras), tables).first()
    assert (f.texts, f.images, f.page_breaks, f.shapes) == (["", "word"], 1, 2, ["1x4", "2x3"])


def test_headings_of_every_kind(spark):
    prose = "This long line of plain prose holds many more words than any heading ever would and so it is read as the body of the paper here."
    lines = [
        ("[Heading 2] the use of apa in rivers", {}), ("Subheading 3: deep water", {}), ("Subheading: shallow water", {}), ("Sub-heading - still water", {}), ("Styled", {"style": "S3"}), ("Styled below", {"style": "S4"}),
        ("How The River Came To Be Named.", {}), (prose, {}), ("Table 4", {"run": {"bold": True}}), ("just a short lower line", {}), ("Discussion", {"run": {"bold": True}, "alignment": "center"}), (prose, {}),
    ]
    paras = structure.annotate(paragraphs(spark, lines))
    names = spark.createDataFrame([(1, "S3", "Heading 3"), (1, "S4", "heading 4")], "doc_id long, style_id string, name string")
    found = headings.headings_of(paras, structure.structure(paras), names)
    rows = {r.p_idx: r for r in found.collect()}
    # a marked level stays; plain subheadings count on from a numbered one; the styles move up as none of them is 1
    assert {i: r.level for i, r in rows.items()} == {0: 2, 1: 4, 2: 5, 3: 5, 4: 1, 5: 2, 6: 1, 10: 1}
    assert rows[4].from_style and rows[6].marker.kind == "rephrased_heading" and rows[6].text == "How The River Came To Be Named" and rows[10].confidence == "high"
    assert [(r.p_idx, r.level, r.previous_level) for r in headings.heading_skips(found).collect()] == [(1, 4, 2)]
    forced = spark.createDataFrame([(1, 4, 3), (1, 10, 0)], "doc_id long, p_idx int, level int")
    assert {r.p_idx: r.level for r in headings.apply_forced(found, forced).where("p_idx in (4, 10)").collect()} == {4: 3}
    issues = audit.audit(paragraphs(spark, lines), groups=("text",), forced=forced)
    assert {r.p_idx for r in issues["headings"].collect()} >= {4} and not issues["headings"].where("p_idx = 10").count()
    titles = spark.createDataFrame([("the use of apa in us rivers", 4), ("an (old) U.S. town by the sea", 2), ("of", 1)], "t string, level int")
    assert [r[0] for r in titles.select(headings.marker_text(F.col("t"), F.col("level"))).collect()] == ["The Use of APA in US Rivers.", "An (Old) U.S. Town by the Sea", "Of"]


def test_titles_are_not_headings(spark):
    lines = [("Rivers And Towns", {"run": {"bold": True}, "alignment": "center", "flags": {"page_break_after": True}}), ("Rivers And Towns", {"run": {"bold": True}, "alignment": "center"}), ("Findings", {"run": {"bold": True}, "alignment": "center"})]
    paras = structure.annotate(paragraphs(spark, lines))
    assert [r.text for r in headings.headings_of(paras, structure.structure(paras)).collect()] == ["Findings"]


def test_captions_and_callouts(spark):
    lines = [("Figure 2 and Table 1 say so.", {}), ("Table 1", {"run": {"bold": True}}), ("Counts", {"run": {"italic": True}}), ("Between", {}), ("", {"flags": {"has_drawing": True}}), ("Figure 2", {}), ("Shape", {})]
    paras = structure.annotate(paragraphs(spark, lines)).withColumn("block_idx", 2 * F.col("p_idx"))
    objects = lambda *rows: spark.createDataFrame(rows, "doc_id long, object_idx int, block_idx int")
    tables = rules.captions(objects((1, 0, 5), (1, 1, 7)), paras, "Table", after=False)
    assert {r.object_idx: (r.label, r.title, r.label_bold, r.title_italic) for r in tables.collect()} == {0: ("Table 1", "Counts", True, True), 1: (None, None, False, False)}
    figures = rules.captions(objects((1, 0, 8)), paras, "Figure", after=True)
    assert [(r.label, r.title) for r in figures.collect()] == [("Figure 2", "Shape")]
    assert [r.called_out for r in rules.callouts(figures, paras, "Figure", F.regexp_extract("label", r"(\d+)", 1), to_end=True).collect()] == [True]
    assert [r.called_out for r in rules.callouts(tables, paras, "Table", F.col("object_idx") + 1, to_end=False).orderBy("object_idx").collect()] == [True, False]


def test_title_lookup_and_budget(spark):
    titles = ["Late ice on northern rivers", "Late ice on southern lakes", "Harbours of the north and their keepers", "On ice"]
    works = spark.createDataFrame([(f"10.5/{i}", t, [("Marsh", "E.")], "J", "2018", "7", "1", "1") for i, t in enumerate(titles)] + [("10.5/0", "Another title", [("Marsh", "E.")], "J", "2018", "7", "1", "1")], schemas.WORKS)
    asked = [("late ice on the northern rivers", None), ("harbours of the north", None), ("on ice", None), ("nothing like any of these words", None), ("x", "10.5/0"), ("late ice on northern rivers", None)]
    refs = spark.createDataFrame([(1, i, doi, title, "2018", ["marsh"], ("J", "7", "1", "1")) for i, (title, doi) in enumerate(asked)], "doc_id long, ref_idx int, doi string, title string, year string, surnames array<string>, journal struct<name:string,volume:string,issue:string,pages:string>")
    found = {r.ref_idx: r for r in verify.verify_references(refs, works).collect()}
    assert found[0].status == "verified" and abs(found[0].confidence - min(0.6 + 0.4 * 4 / 5, 0.95)) < 1e-9
    assert found[1].status == "mismatch" and found[2].status == "unverified" and found[3].status == "unverified"
    # of two works with one DOI the first by title counts
    assert found[4].status == "mismatch" and found[5].status == "verified" and abs(found[5].confidence - 0.95) < 1e-9
    few = {r.ref_idx: r.status for r in verify.verify_references(refs, works, budget=1).collect()}
    assert few[0] == "verified" and few[5] == "unverified"
    told = report.verification_issues(verify.verify_references(refs, works)).collect()
    assert {(r.ref_idx, r.status) for r in told} == {(1, "user_review"), (4, "user_review")}
    summary = report.verification_summary(verify.verify_references(refs, works)).first()
    assert (summary.attempted, summary.verified, summary.mismatch, summary.unverified) == (6, 2, 2, 2)


def test_a_rule_that_fails_takes_no_other_along(spark):
    own = [rules.Rule("OWN-1", "own", "error", "paragraphs", F.lit(True), F.col("text").contains("river"), F.lit("Says river.")), rules.Rule("OWN-2", "own", "error", "paragraphs", F.lit(True), F.col("no_such_column") > 1, F.lit("Never."))]
    disabled = spark.createDataFrame([(1, "APA-HEAD-004")], "doc_id long, rule_id string")
    out = audit.audit(paragraphs(spark, [("A river ran.", {}), ("Nothing.", {})]), own_rules=own, disabled=disabled)
    status = {r.rule_id: (r.status, r.checked, r.passed) for r in out["rule_results"].collect()}
    assert status["OWN-1"] == ("fail", 2, 1) and status["OWN-2"] == ("unverified", 0, 0) and "APA-HEAD-004" not in status
    assert [r.rule_id for r in report.filter_issues(out["issues"], "errors").collect()] == ["OWN-1"]
    assert report.filter_issues(out["issues"], "warnings").where("rule_id = 'OWN-2'").count() == 1
    assert not report.filter_issues(out["issues"], "fixed").count() and not report.filter_issues(out["issues"], "needs_review").where("rule_id like 'OWN%'").count()


def test_progress(spark):
    runs = spark.createDataFrame([(1, "ready"), (2, "error"), (3, "processing"), (4, "processing"), (5, "processing")], "run_id int, status string")
    stages = spark.createDataFrame([(3, "read", "done", 1), (3, "audit", "running", 2), (4, "read", "done", 1), (1, "read", "done", 1)], "run_id int, stage string, status string, stage_no int")
    r = report.batch_progress(runs, stages).first()
    assert (r.ready, r.error, r.in_progress, r.stages) == (1, 1, 3, {"audit": 1, "read": 1, "queued": 1})


def test_small_functions(spark):
    row = spark.createDataFrame([("C:\\papers\\my draft*1.docx", "high", 2160)], "name string, word string, twips int")
    r = row.select(fx.safe_name(F.col("name")), fx.confidence_score(F.col("word")), fx.twips_to_inches(F.col("twips")), fx.twips_to_points(F.col("twips")), fx.suggested_name(F.lit("late-ice_notes.docx")), fx.author_names(F.array(F.struct(F.lit("Marsh").alias("family"), F.lit("Ella").alias("given")))), fx.excerpt(F.lit("a  b " + "c" * 100), 10)).first()
    assert tuple(r) == ("my draft_1.docx", 0.95, '1.50"', "108.0 pt", "late ice notes", "Marsh, E.", "a b ccccc…")


def test_sources_sinks_and_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Background\nIt was said (Marsh, 2018).\nReferences\nMarsh, E. (2018). On thaw. Harbour Press."), (2, None), (3, "We waited. 12 people came.")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = corpus.read_corpus(spark, f"{tmp_path}/in", "doc_id")
    assert read.count() == 3
    (tmp_path / "a.txt").write_text("one\ntwo")
    whole = corpus.read_corpus(spark, str(tmp_path / "a.txt")).first()
    assert whole.text == "one\ntwo" and whole.doc_id.endswith("a.txt")
    out = audit.audit(corpus.to_paragraphs(read))
    sinks.write_audit({"issues": out["issues"], "report": out["report"]}, f"{tmp_path}/out", partition="rule_id")
    assert spark.read.parquet(f"{tmp_path}/out/issues").count() == out["issues"].count()
    pairs = spark.createDataFrame([(1, 2, 0.5, 0.25, 0.325, "Moderate")], "a long, b long, phrase double, content double, overall double, band string")
    sinks.write_similarity_csv(pairs, f"{tmp_path}/csv")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/csv", header=True).collect()] == [("1", "2", "32.5%", "25.0%", "50.0%", "Moderate")]
    audit_stream.audit_stream(audit_stream.read_documents(spark, f"{tmp_path}/in"), f"{tmp_path}/streamed", f"{tmp_path}/state").awaitTermination(300)
    streamed = spark.read.parquet(f"{tmp_path}/streamed/issues").drop("batch")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, out["issues"].select(streamed.columns).collect()))


def test_retention_on_a_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=m)
    batches = [[("a", "ready", at(0)), ("b", "processing", at(0)), ("a", "old", at(-5))], [("c", "ready", at(90))], [("d", "ready", at(200)), ("b", "ready", at(195))], [("e", "ready", at(400))]]
    out, state = str(tmp_path / "rows"), str(tmp_path / "state")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "run_id string, status string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("run_id string, status string, ts timestamp").parquet(f"{tmp_path}/in")
        write = lambda df, n, i=i: df.write.mode("append").parquet(f"{out}/{i}-{n}")
        audit_stream.expire_stream(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(300)
    rows = spark.read.parquet(*[str(p) for p in (tmp_path / "rows").iterdir()]).collect()
    kept = {(r.run_id, r.status) for r in rows if not r.expired}
    assert kept == {("a", "ready"), ("b", "processing"), ("b", "ready"), ("c", "ready"), ("d", "ready"), ("e", "ready")}
    # a run still processing is not forgotten; the last one is too young
    assert {(r.run_id, r.status) for r in rows if r.expired} >= {("a", "ready"), ("c", "ready")} and not any(r.expired and (r.run_id == "e" or r.status == "processing") for r in rows)


def test_structure_without_title_page_and_past_contents(spark):
    prose = "This line of plain prose goes on for quite some time and has far more than twenty words in it, so that it must be read as text of the body."
    bare = structure.annotate(paragraphs(spark, [("Rivers In Winter", {}), ("Ella Marsh", {}), ("Northern University", {}), (prose, {}), ("March 3, 2024", {})]))
    r = structure.structure(bare).first()
    assert (r.has_title_page, r.title_end, r.body_start, r.metadata.title, r.metadata.author, r.metadata.institution, r.metadata.due_date) == (False, 0, 0, "Rivers In Winter", "Ella Marsh", "Northern University", None)
    brk = {"flags": {"page_break_after": True}}
    lines = [("Rivers In Winter", {}), ("Ella Marsh", brk), ("Table of Contents", {}), ("Abstract ... 2", {}), ("Findings ... 3", brk), ("Abstract", {}), (prose, {}), ("Keywords: rivers", {}), (prose, {}), ("References", {}), ("Marsh, E. (2018). On thaw.", {}), ("Appendix A", {}), (prose, {})]
    marked = structure.annotate(paragraphs(spark, lines))
    r = structure.structure(marked).first()
    assert (r.has_title_page, r.title_end, r.abstract_heading, r.keywords, r.body_start, r.reference_heading, r.reference_entries) == (True, 2, 5, 7, 8, 9, 1)


def test_projected_words(spark):
    counts = spark.createDataFrame([(1, 10), (2, 5)], "doc_id long, words long")
    order = spark.createDataFrame([(1, 0, "Late ice notes"), (2, 1, "Two words")], "doc_id long, ord int, heading string")
    assert assembly.projected_words(counts, order, 7).first().projected == 10 + 5 + 3 + 2 + 7
