"""Queries on rules, reports, corrections, verification, requirements, intake, assembly and stages."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpaudit import schemas
from corpaudit.functions import text as fx
from corpaudit.operators import assembly, audit, corrections, report, requirements, runs, verify
from corpaudit.plans import layouts, seeds
from corpaudit.plans.common import spread, table
from corpaudit.plans.paper_queries import _LISTED, N, O
from corpaudit.sources import corpus
from corpaudit.streaming import audit_stream as stream
from corpaudit.tables import cut

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _audit(spark, sf_dir):
    return audit.audit(seeds.papers(spark, sf_dir), groups=("text", "format"), extra={"headers_footers": seeds.headers(spark, sf_dir)})


_PER_ORDER = "SELECT doc_id, '{0}' AS rule_id, '{1}' AS status, count(*) AS issues FROM o WHERE {2} GROUP BY doc_id"
_PER_PAPER = "SELECT doc_id, '{0}' AS rule_id, '{1}' AS status, 1 AS issues FROM n WHERE {2}"
_ISSUES = " UNION ALL ".join(
    [_PER_ORDER.format(*x) for x in [("APA-CITATION-001", "warning", "v >= 2"), ("APA-CITATION-008", "user_review", "key % 7 = 0"), ("APA-REFERENCE-004", "warning", "key % 5 = 0 AND key % 7 <> 0"), ("APA-STAT-001", "warning", "key % 11 = 0"), ("APA-NUM-001", "warning", "key % 13 = 0")]]
    + [_PER_PAPER.format(*x) for x in [("APA-REFERENCE-005", "user_review", "doc_id % 4 = 0"), ("APA-HEAD-002", "fail", "true"), ("APA-HEAD-004", "warning", "true"), ("APA-LAYOUT-002", "fail", "doc_id % 6 = 0"), ("APA-LAYOUT-003", "fail", "doc_id % 5 = 0"), ("APA-LAYOUT-004", "fail", "doc_id % 10 = 0"), ("APA-LAYOUT-005", "fail", "doc_id % 7 = 3"), ("APA-ABS-004", "warning", "true")]]
    + ["SELECT doc_id, 'APA-REFERENCE-003', 'fail', 1 FROM c WHERE entries > 1 AND doc_id % 9 = 0", "SELECT doc_id, 'APA-REFERENCE-002', 'fail', 1 FROM c WHERE doc_id % 8 = 0"]
)
_WITH = f"WITH {O}, {N}, {_LISTED}, c AS (SELECT doc_id, count(*) AS entries FROM listed GROUP BY doc_id)"


@query(f"{_WITH} {_ISSUES}")
def audit_issues(spark, sf_dir):
    return _audit(spark, sf_dir)["issues"].groupBy("doc_id", "rule_id", "status").agg(F.count("*").alias("issues"))


@query(f"""{_WITH}, m AS (SELECT doc_id, count(*) FILTER (WHERE key % 7 = 0) AS missing FROM o GROUP BY doc_id), u AS (SELECT n.doc_id, coalesce(missing, 0) + (n.doc_id % 4 = 0)::INT AS unresolved FROM n LEFT JOIN m USING (doc_id))
SELECT doc_id, CASE WHEN unresolved = 0 THEN 'apa_validated' ELSE 'review_required' END AS state, unresolved FROM u""")
def audit_report(spark, sf_dir):
    return audit.audit(seeds.papers(spark, sf_dir))["report"].select("doc_id", "state", "unresolved")


@query()
def audit_rule_results(spark, sf_dir):
    return _audit(spark, sf_dir)["rule_results"]


#: What a rule without findings says of these papers: passed always, or where there are orders, entries, or two entries; all others have nothing to judge.
_PASSED = {
    "true": "ABS-001 ABS-002 HEAD-001 HEAD-003 LAYOUT-002 LAYOUT-003 LAYOUT-004 LAYOUT-005 PARA-001 PARA-002 REFERENCE-001 TITLE-001 TITLE-002 TITLE-003 TITLE-004",
    "n > 0": "CITATION-001 CITATION-008", "entries > 0": "REFERENCE-002 REFERENCE-004 REFERENCE-005 REFERENCE-007", "entries > 1": "REFERENCE-003",
    "false": "ABBR-001 ABS-003 ABS-004 CITATION-002 FIGURE-001 FIGURE-002 FIGURE-003 HEAD-002 HEAD-004 LAYOUT-001 LAYOUT-006 NUM-001 NUM-002 PARA-003 PARA-004 QUOTE-001 QUOTE-002 REFERENCE-006 REFERENCE-008 STAT-001 TABLE-001 TABLE-002 TABLE-003 TITLE-005 TITLE-006",
}
_SILENT = " UNION ALL ".join(f"SELECT doc_id, unnest({[f'APA-{r}' for r in rules.split()]}) AS rule_id, CASE WHEN {where} THEN 'pass' ELSE 'not_applicable' END AS silent FROM x" for where, rules in _PASSED.items())


@query(f"""{_WITH}, i AS ({_ISSUES}), x AS (SELECT n.doc_id, n.n, coalesce(entries, 0) AS entries FROM n LEFT JOIN c USING (doc_id)), s AS ({_SILENT})
SELECT s.doc_id, s.rule_id, coalesce(i.status, s.silent) AS status FROM s LEFT JOIN i USING (doc_id, rule_id)""")
def audit_rule_status(spark, sf_dir):
    """The outcome of every rule for every paper: what was found, passed, or not there to judge."""
    return _audit(spark, sf_dir)["rule_results"].select("doc_id", "rule_id", "status")


@query()
def audit_category_summary(spark, sf_dir):
    return _audit(spark, sf_dir)["category_summary"]


@query(f"{_WITH}, i AS ({_ISSUES}) SELECT doc_id, sum(issues)::BIGINT AS issues, sum(issues) FILTER (WHERE status = 'user_review')::BIGINT AS reviews FROM i GROUP BY doc_id")
def audit_issue_counts(spark, sf_dir):
    out = _audit(spark, sf_dir)["issues"].groupBy("doc_id").agg(F.count("*").alias("issues"), F.count_if("needs_resolution").alias("reviews"))
    return out.withColumn("reviews", F.when(F.col("reviews") > 0, F.col("reviews")))


@query(f"{_WITH}, m AS (SELECT doc_id, count(*) AS open FROM o WHERE key % 7 = 0 GROUP BY doc_id) SELECT n.doc_id, 'apa_validated' AS state, 0 AS unresolved FROM n")
def audit_resolved_report(spark, sf_dir):
    """Every review answered: the recomputed reports have nothing open."""
    t = audit.audit(seeds.papers(spark, sf_dir))
    answers = t["issues"].where("needs_resolution").select("doc_id", report.issue_key().alias("issue_key"), F.lit("will_add").alias("option_id")).distinct()
    return report.recompute_report(t["report"], report.attach_resolutions(t["issues"], answers)).select("doc_id", "state", "unresolved")


@query(f"""{_WITH} SELECT doc_id, 'title' AS kind, 1 AS entries FROM n UNION ALL SELECT doc_id, 'abstract', 1 FROM n UNION ALL SELECT doc_id, 'heading', 1 FROM n UNION ALL SELECT doc_id, 'references', 1 FROM n UNION ALL SELECT doc_id, 'reference', entries FROM c""")
def audit_outline(spark, sf_dir):
    t = audit.audit(seeds.papers(spark, sf_dir))
    return report.outline(t["paragraphs"], t["structure"], t["headings"], t["references"], t["issues"]).groupBy("doc_id", "kind").agg(F.count("*").alias("entries"))


#: Paragraphs of a paper: 11 before the first order's, its orders, the heading of the list and the entries.
_FILLED = "p AS (SELECT n.doc_id, 12 + n + coalesce(entries, 0) AS filled, n, coalesce(entries, 0) AS entries FROM n LEFT JOIN c USING (doc_id))"


@query(f"""{_WITH}, x AS (SELECT doc_id, count(*) FILTER (WHERE v IN (2, 3, 4)) AS c1, count(*) FILTER (WHERE key % 5 = 0 AND key % 7 <> 0) AS r4 FROM o GROUP BY doc_id), {_FILLED}
SELECT doc_id, 'APA-CITATION-001' AS rule_id, c1 AS changes FROM x WHERE c1 > 0 UNION ALL SELECT doc_id, 'APA-REFERENCE-004', r4 FROM x WHERE r4 > 0 UNION ALL SELECT doc_id, 'APA-HEAD-002', CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 1 END FROM n UNION ALL SELECT doc_id, 'APA-LAYOUT-002', 3 * filled FROM p WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id, 'APA-LAYOUT-003', 2 * filled FROM p WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'APA-LAYOUT-004', 2 * filled FROM p WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id, 'APA-REFERENCE-002', 2 * entries FROM p WHERE doc_id % 8 = 0 AND entries > 0 UNION ALL SELECT doc_id, 'APA-ABS-004', 1 FROM p""")
def correction_changes(spark, sf_dir):
    """Two properties make double spacing, two make none around, three make the font; a marked heading changes text, style and alignment, others the style."""
    return audit.correct(seeds.papers(spark, sf_dir))[1].groupBy("doc_id", "rule_id").agg(F.count("*").alias("changes"))


@query(f"""{_WITH}, s AS (SELECT doc_id, (rank + 11)::INT AS p_idx, CASE v WHEN 0 THEN 'Evidence was strong (' || first || ', ' || year || ').' WHEN 1 THEN first || ' (' || year || ') found an effect.' WHEN 2 THEN first || ' and ' || second || ' (' || year || ') reported it.'
  WHEN 3 THEN 'It was shown before (' || first || ' & ' || second || ', ' || year || ', p. 21).' WHEN 4 THEN 'Earlier work agrees (' || first || ' et al., ' || year || ').' ELSE 'This holds (' || first || ' ' || year || ').' END
  || CASE WHEN key % 11 = 0 THEN ' The test gave p < 0.05 here.' ELSE '' END || CASE WHEN key % 13 = 0 THEN ' 12 people took part.' ELSE '' END AS text FROM o),
e AS (SELECT doc_id, (11 + n + row_number() OVER (PARTITION BY doc_id ORDER BY name))::INT AS p_idx, 'https://doi.org/' || doi AS text FROM listed JOIN n USING (doc_id))
SELECT doc_id, p_idx, text, 480 AS line, 0 AS spacing_after, 'Times New Roman' AS font, 24 AS size, 720 AS indent, 0 AS hanging FROM s UNION ALL SELECT doc_id, p_idx, text, 480, 0, 'Times New Roman', 24, 0, 720 FROM e""")
def corrected_paragraphs(spark, sf_dir):
    """Texts (of entries the link), places and properties of the body and the references after the corrections."""
    fixed = audit.correct(seeds.papers(spark, sf_dir))[0]
    entry = F.col("props.hanging_indent") == 720
    text = F.when(entry, F.regexp_extract("text", r"(https?://\S+|doi:\S+)$", 1)).otherwise(F.col("text"))
    rows = fixed.join(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n")).hint("merge"), "doc_id", "left").where(entry | (F.col("p_idx") >= seeds.HEAD) & (F.col("p_idx") < seeds.HEAD + F.col("n")))
    return rows.select("doc_id", "p_idx", text.alias("text"), "props.line", "props.spacing_after", F.col("run_props.font_ascii").alias("font"), F.col("run_props.size_half_points").alias("size"), F.col("props.first_line_indent").alias("indent"), F.coalesce("props.hanging_indent", F.lit(0)).alias("hanging"))


@query("SELECT c_custkey AS doc_id, 0 AS changes_on_second_run, 0 AS lost FROM customer")
def correction_idempotent(spark, sf_dir):
    """Per paper: a second run finds nothing to change but looks of headings whose styles moved up, and no content is lost or added."""
    paras = cut(seeds.papers(spark, sf_dir))
    fixed, changes = audit.correct(paras)
    again = audit.correct(fixed)[1].where("rule_id <> 'APA-HEAD-001'").groupBy("doc_id").agg(F.count("*").alias("again"))
    texts = changes.where("field = 'text'")
    lost = corrections.assert_preserved(paras, fixed, texts).groupBy("doc_id").agg(F.count("*").alias("bad"))
    out = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")).join(again.hint("merge"), "doc_id", "left").join(lost.hint("merge"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("again", F.lit(0)).cast("int").alias("changes_on_second_run"), F.coalesce("bad", F.lit(0)).cast("int").alias("lost"))


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 IN (1, 2) THEN 1 ELSE 0 END AS lost, CASE WHEN c_custkey % 4 IN (2, 3) THEN 1 ELSE 0 END AS added FROM customer""")
def preservation_guard(spark, sf_dir):
    """Papers of three paragraphs, of which one was lost, altered without a record, put in, or altered as recorded."""
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.concat(F.lit("Name of "), "c_name").alias("a"), F.concat(F.lit("Part of "), "c_mktsegment").alias("b"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("c"))
    rows = lambda df: df.select("doc_id", F.posexplode("texts").alias("p_idx", "text")).select("*", F.lit(False).alias("is_empty"), *[F.lit(False).alias(c) for c in corrections.COUNTERS.values()])
    kind = F.col("doc_id") % 4
    before = own.select("doc_id", F.array("a", "b", "c").alias("texts"))
    other = F.concat("a", F.lit(" and more"))
    after = own.select("doc_id", F.when(kind == 1, F.array("a", "c")).when(kind == 3, F.array("a", "b", "c", F.lit("Put in"))).otherwise(F.array("b", other, "c")).alias("texts"))
    changes = own.where(kind == 0).select("doc_id", F.lit(0).alias("p_idx"), F.concat(F.lit("The line “"), "a", F.lit("” is short")).alias("before"), F.concat(F.lit("The line “"), other, F.lit("”")).alias("after"))
    found = corrections.assert_preserved(rows(before), rows(after), changes).groupBy("doc_id").agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("lost", "added")])
    return own.select("doc_id").join(found.hint("merge"), "doc_id", "left").select("doc_id", *[F.coalesce(s, F.lit(0)).cast("int").alias(s) for s in ("lost", "added")])


@query(f"""{_WITH}, t AS (SELECT key, 'It was shown before (' || first || ' and ' || second || ', ' || year || ').' AS t, '(' || first || ' and ' || second || ', ' || year || ')' AS b, '(' || first || ' & ' || second || ', ' || year || ')' AS a FROM o),
x AS (SELECT *, 1 + key % (length(t) - 1) AS c, 20 AS s, 20 + length(b) AS e FROM t)
SELECT key, replace(t, b, a) AS text, CASE WHEN c <= s THEN t[1:c] WHEN c >= e THEN t[1:s] || a || t[e + 1:c] ELSE t[1:s] || a END AS plain, CASE WHEN c <= s THEN t[c + 1:s] || a || t[e + 1:] WHEN c >= e THEN t[c + 1:] ELSE t[e + 1:] END AS slanted FROM x""")
def corrected_runs(spark, sf_dir):
    """A citation mended in a paragraph of two runs, cut anywhere: both keep their looks, and together they are the text."""
    o = seeds.orders_of(spark, sf_dir)
    cited = lambda sign: F.concat(F.lit("("), "first", F.lit(f" {sign} "), "second", F.lit(", "), "year", F.lit(")"))
    rows = o.select(F.col("key").alias("doc_id"), F.concat(F.lit("It was shown before "), cited("and"), F.lit(".")).alias("text"), cited("and").alias("before"), cited("&").alias("after"))
    cut_at = (1 + F.col("doc_id") % (F.length("text") - 1)).cast("int")
    run = lambda text, italic: F.struct(text.alias("text"), F.from_json(F.lit(f'{{"italic": {italic}}}'), schemas.RUN_PROPS.removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("props"), F.lit(False).alias("has_page_break"), F.lit(False).alias("has_drawing"))
    paras = cut(rows.withColumn("p_idx", F.lit(0)).withColumn("runs", F.array(run(F.substring("text", F.lit(1), cut_at), "false"), run(F.substring(F.col("text"), cut_at + 1, F.length("text")), "true"))))
    done = corrections.apply_text_changes(paras.select("doc_id", "p_idx", "text", "runs"), paras.select("doc_id", "p_idx", F.lit(0).alias("step"), "before", "after"))
    own = lambda italic: runs.joined(F.filter("runs", lambda r: r["props"]["italic"] == italic))
    return done.select(F.col("doc_id").alias("key"), "text", own(F.lit(False)).alias("plain"), own(F.lit(True)).alias("slanted"))


@query(f"""{_WITH} SELECT doc_id, name, CASE WHEN name = 'zulu' OR key % 17 = 0 THEN 'mismatch' WHEN key % 4 = 0 THEN 'probable' ELSE 'verified' END AS status FROM listed""")
def verified_references(spark, sf_dir):
    """Entries against a table of works that lacks some and has another year for others; lookups are not limited here."""
    o = seeds.orders_of(spark, sf_dir)
    works = o.where("key % 17 <> 0").select(F.concat(F.lit("10.1234/"), F.col("key").cast("string")).alias("doi"), F.concat(F.lit("Topics of "), "first").alias("title"), F.array(F.struct(F.col("first").alias("family"), F.lit("J.").alias("given"))).alias("authors"), F.lit("Journal of Things").alias("journal"), F.when(F.col("key") % 4 == 0, "1888").otherwise(F.col("year")).alias("year"), F.lit("12").alias("volume"), F.lit("3").alias("issue"), F.lit("10-20").alias("pages"))
    refs = audit.analyse(seeds.papers(spark, sf_dir))["references"]
    out = verify.verify_references(refs, works, budget=2**31 - 1)
    return out.join(refs.select("doc_id", "ref_idx", F.col("surnames")[0].alias("name")).hint("merge"), ["doc_id", "ref_idx"]).select("doc_id", "name", "status")


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'Arial' ELSE 'Times New Roman' END AS font, CASE WHEN c_custkey % 2 = 0 THEN 11 ELSE 12 END AS font_size, CASE WHEN c_custkey % 3 = 0 THEN false WHEN c_custkey % 3 = 1 THEN true END AS abstract_required,
 CASE WHEN c_custkey % 5 = 0 THEN 3 + c_custkey % 6 END AS min_references, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS uninterpreted FROM customer""")
def parsed_requirements(spark, sf_dir):
    k = F.col("c_custkey")
    words = F.element_at(F.array(*map(F.lit, ("three", "four", "five", "six", "seven", "eight"))), (k % 6 + 1).cast("int"))
    text = F.concat_ws("; ", F.when(k % 2 == 0, "Use Arial 11 pt font"), F.when(k % 3 == 0, "No abstract").when(k % 3 == 1, "An abstract is required"), F.when(k % 5 == 0, F.concat(F.lit("at least "), words, F.lit(" references"))), F.when(k % 7 == 0, "Be kind to readers"))
    texts = table(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("requirements_text"))
    parsed = requirements.parse_requirements(texts).withColumn("paper_type", F.lit("student"))
    out = requirements.effective_requirements(parsed).join(parsed.select("doc_id", F.coalesce(F.size("uninterpreted"), F.lit(0)).alias("uninterpreted")).hint("merge"), "doc_id")
    return out.select("doc_id", "font", "font_size", "abstract_required", "min_references", "uninterpreted")


_WORD = r"[\p{L}\p{N}]+(?:[''’.-][\p{L}\p{N}]+)*"


@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS words FROM documents WHERE text IS NOT NULL")
def assembly_words(spark, sf_dir):
    return assembly.content_words(corpus.to_paragraphs(spread(table(spark, sf_dir, "documents"))))


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS paragraphs FROM documents WHERE text IS NOT NULL")
def intake_paragraphs(spark, sf_dir):
    return corpus.to_paragraphs(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("paragraphs"))


@query("SELECT 5000 AS words, count(*) > 0 AS exact FROM customer")
def assembly_budget(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("line_no"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    out = assembly.fill_budget(lines, 5000)
    return out.agg(F.sum("words").cast("int").alias("words"), (F.sum(fx.count_words(F.col("text"))) == 5000).alias("exact"))


@query(f"""WITH {N} SELECT doc_id AS ord, 1 AS headings, (11 + n)::BIGINT AS content FROM n""")
def assembly_documents(spark, sf_dir):
    paras = seeds.papers(spark, sf_dir)
    order = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("ord"), fx.suggested_name(F.col("c_name")).alias("heading"))
    return assembly.assemble(paras, order).groupBy("ord").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "content").alias("content"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'UNSUPPORTED_FILE_TYPE' WHEN doc_id % 7 = 0 THEN 'FILE_TOO_LARGE' WHEN doc_id % 11 = 0 THEN 'PASSWORD_PROTECTED' WHEN doc_id % 3 <> 0 THEN 'CORRUPT' END AS reject_code FROM documents""")
def intake_triage(spark, sf_dir):
    k = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(k.cast("string"), F.when(k % 5 == 0, ".pdf").otherwise(".docx")).alias("path"), F.when(k % 7 == 0, 30 * 2**20).otherwise(F.octet_length("text")).cast("long").alias("length"), F.when(k % 11 == 0, F.unhex(F.lit("D0CF11E0"))).when(k % 3 == 0, F.unhex(F.lit("504B0304"))).otherwise(F.encode(F.concat(F.lit("x"), "text"), "UTF-8")).alias("content"))
    return corpus.triage(files).select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), "reject_code")


@query("""WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey % 97 = 0 AS bad FROM lineitem), d AS (SELECT doc_id, bool_or(bad) AS unsafe, bool_or(n = 1) AS a, bool_or(n = 2) AS b FROM e GROUP BY doc_id)
SELECT doc_id, CASE WHEN unsafe THEN 'UNSAFE_PATH' WHEN NOT (a AND b) THEN 'CORRUPT' END AS reject_code FROM d""")
def intake_manifest(spark, sf_dir):
    n = F.col("l_linenumber")
    name = F.when(F.col("l_partkey") % 97 == 0, "../evil").when(n == 1, corpus.REQUIRED_PARTS[0]).when(n == 2, corpus.REQUIRED_PARTS[1]).otherwise(F.concat(F.lit("word/part"), n.cast("string")))
    # unsafe names stand beside the required parts, so a package has both
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array_distinct(F.array(name, F.when(n == 1, corpus.REQUIRED_PARTS[0]).when(n == 2, corpus.REQUIRED_PARTS[1]).otherwise(name)))).alias("entry_name"), F.lit(1000).alias("uncompressed_size"))
    return corpus.scan_manifest(rows)


@query("""WITH r AS (SELECT source AS name, n_chars AS size, doc_id AS arrival, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS r FROM documents) SELECT name, size, arrival FROM r WHERE r = 1 ORDER BY arrival LIMIT 30""")
def intake_dedupe(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("n_chars").alias("size"), F.lit(0).alias("last_modified"), F.col("doc_id").alias("arrival"))
    return corpus.dedupe_intake(files).select("name", "size", "arrival")


@query("SELECT user_id AS run_id, event_type AS stage, max_by(event_id::VARCHAR, row(ts, event_id::VARCHAR)) AS status FROM events GROUP BY ALL")
def stage_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").cast("string").alias("status"), "ts")
    return stream.latest_stage(events).select("run_id", "stage", "status")


@query("SELECT event_id AS run_id FROM events WHERE event_type = 'purchase' OR ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 60 MINUTE")
def runs_kept(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "processing").otherwise("done").alias("status"), "ts")
    return stream.expire(runs, datetime.datetime(2024, 1, 15)).select("run_id")


@query(f"{_WITH} SELECT n.doc_id, (12 + n + coalesce(entries, 0))::BIGINT AS paragraphs, 1 AS headings, n AS citations, coalesce(entries, 0) AS references, true AS has_title_page, true AS has_abstract FROM n LEFT JOIN c USING (doc_id)")
def corpus_profile(spark, sf_dir):
    t = audit.analyse(seeds.papers(spark, sf_dir))
    return corpus.profile(t["paragraphs"], t["structure"], t["headings"], t["citations"], t["references"]).drop("metadata", "images", "tables", "footnotes")


def title_page_papers(spark, sf_dir):
    """Papers of which a fourth has no title page and others lack lines of it, the values that users give, and a table of two objects a paper."""
    k, segment = F.col("doc_id"), F.initcap("segment")
    lacks = {2: 5, 3: 7, 4: 3}
    paras = seeds.papers(spark, sf_dir)
    # the break before a short paper's references would make all before it a title page
    paras = paras.withColumn("page_break_after", F.col("page_break_after") & (k % 4 != 0))
    for place in ("direct", "props"):
        paras = paras.withColumn(place, F.when(k % 4 == 0, F.col(place).withField("page_break_before", F.lit(False))).otherwise(F.col(place)))
    off = F.when(k % 4 == 0, F.col("p_idx") < 6).otherwise(F.lit(False))
    for place, n in lacks.items():
        off = off | ((F.col("p_idx") == place) & (k % n == 0))
    paras = corrections.remove_paragraphs(paras, paras.where(off).select("doc_id", "p_idx", F.lit("removed").alias("field")))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("segment"))
    values = {
        "title": F.when(k % 8 != 4, F.concat(F.lit("Given Work of "), segment)), "author": F.concat(F.lit("Ann "), segment), "institution": F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("University of "), segment)),
        "course_number": F.when(k % 14 != 0, "XYZ200"), "course_name": F.when(k % 14 != 0, segment), "instructor": F.when(k % 9 != 0, F.concat(F.lit("Dr. "), segment)), "due_date": F.lit(None).cast("string"),
    }
    settings = own.select("doc_id", F.when(k % 11 == 0, "professional").otherwise("student").alias("paper_type"), *[F.lit(None).cast(c).alias(n) for n, c in [("font", "string"), ("font_size", "int"), ("abstract_required", "boolean"), ("running_head_required", "boolean"), ("min_references", "int")]], F.struct(*[v.alias(n) for n, v in values.items()]).alias("metadata"))
    objects = own.select("doc_id", F.explode(F.array(F.lit(0), F.lit(20))).alias("block_idx"), F.lit("own").alias("first_cell_text"))
    return paras, requirements.effective_requirements(settings), objects


_SEGMENT = "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"


@query(f"""WITH c AS (SELECT c_custkey AS doc_id, {_SEGMENT} AS s, c_custkey % 11 = 0 AS professional,
  CASE WHEN c_custkey % 10 <> 0 THEN 'University of ' || s END AS institution, CASE WHEN c_custkey % 14 <> 0 THEN 'XYZ200: ' || s END AS course, CASE WHEN c_custkey % 9 <> 0 THEN 'Dr. ' || s END AS instructor FROM customer),
l AS (SELECT doc_id, list_filter(CASE WHEN doc_id % 8 = 0 THEN ['', '', '', 'Given Work of ' || s, '', 'Ann ' || s, institution, course, instructor, ''] WHEN doc_id % 4 <> 0 THEN
  ['A Study of ' || s || ' Paper ' || doc_id, 'Sam R' || translate(doc_id::VARCHAR, '0123456789', 'abcdefghij'), CASE WHEN doc_id % 5 <> 0 THEN 'University of Somewhere' END, CASE WHEN doc_id % 7 <> 0 THEN 'ABC' || (100 + doc_id % 800) || ': Methods' END, CASE WHEN doc_id % 3 <> 0 THEN 'Dr. Lee Grey' END,
   CASE WHEN doc_id % 5 = 0 THEN institution END, CASE WHEN doc_id % 7 = 0 AND NOT professional THEN course END, CASE WHEN doc_id % 3 = 0 AND NOT professional THEN instructor END, 'March 3, 2024'] ELSE []::VARCHAR[] END, lambda x: x IS NOT NULL) AS lines FROM c),
p AS (SELECT doc_id, i::INT AS place, lines[i + 1] AS text FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM l)),
n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN len(lines) ELSE len(lines) - (3 + (doc_id % 5 <> 0)::INT + (doc_id % 7 <> 0)::INT + (doc_id % 3 <> 0)::INT) END AS added FROM l)
SELECT doc_id, place, text FROM p UNION ALL SELECT doc_id, (CASE WHEN doc_id % 8 = 0 THEN added ELSE 0 END)::INT, 'object' FROM n UNION ALL SELECT doc_id, (20 + added)::INT, 'object' FROM n""")
def title_pages_given(spark, sf_dir):
    """Title pages after given lines were put in, and the places of two objects, before and behind."""
    paras, settings, objects = title_page_papers(spark, sf_dir)
    done = audit.correct_tables(cut(paras), settings, children={"tables": objects})
    last = Window.partitionBy("doc_id")
    page = done["paragraphs"].withColumn("last", F.min(F.when(F.col("page_break_after"), F.col("p_idx"))).over(last)).where("p_idx <= last")
    return page.select("doc_id", F.col("p_idx").alias("place"), "text").unionByName(done["tables"].select("doc_id", F.col("block_idx").alias("place"), F.lit("object").alias("text")))


def _layouts(spark, sf_dir):
    t = {name: cut(df) if name in ("paragraphs", "styles") else df for name, df in layouts.tables(spark, sf_dir).items()}
    return t, requirements.effective_requirements(t["settings"])


_OWN = f"SELECT c_custkey AS doc_id, rule_id, status, issues FROM customer JOIN ({{}}) v(layout, rule_id, status, issues) ON c_custkey % {len(layouts.layouts())} = layout"


@query(_OWN.format(layouts.findings_sql()))
def layout_issues(spark, sf_dir):
    """Papers that each break one rule: text, format, tables, figures, sections, headers, styles and requirements."""
    t, settings = _layouts(spark, sf_dir)
    extra = {k: t[k] for k in ("sections", "headers_footers", "tables", "figures")}
    found = audit.audit(t["paragraphs"], settings, ("text", "format"), extra=extra, styles=t["styles"], forced=t["forced"])["issues"]
    return found.groupBy("doc_id", "rule_id", "status").agg(F.count("*").alias("issues"))


@query(_OWN.format(layouts.findings_sql(fixed=True)))
def layout_issues_corrected(spark, sf_dir):
    """An independent audit of those papers after their corrections: what is left is what no correction mends."""
    t, settings = _layouts(spark, sf_dir)
    done = audit.correct_tables(t["paragraphs"], settings, styles=t["styles"], forced=t["forced"])
    fixed = done["paragraphs"]
    extra = {"sections": corrections.apply_section_changes(t["sections"]), "headers_footers": corrections.add_page_headers(t["headers_footers"], t["paragraphs"]), "tables": t["tables"], "figures": t["figures"]}
    found = audit.audit(fixed, settings, ("text", "format"), extra=extra, styles=done["styles"])["issues"]
    return found.groupBy("doc_id", "rule_id", "status").agg(F.count("*").alias("issues"))


_CATEGORIES = "CITATION citations REFERENCE references QUOTE quotations HEAD headings STAT statistics NUM numbers ABBR abbreviations LAYOUT layout PARA paragraph TITLE title_page ABS abstract TABLE tables FIGURE figures".split()
_CATEGORIES = ", ".join(f"('{part}', '{category}')" for part, category in zip(_CATEGORIES[::2], _CATEGORIES[1::2], strict=True))


@query(f"""WITH f AS ({_OWN.format(layouts.findings_sql())}), r AS (SELECT * FROM (VALUES {_CATEGORIES}) r(part, category))
SELECT c_custkey AS doc_id, category, coalesce(sum(issues), 0)::BIGINT AS issue_count, count(DISTINCT f.rule_id) AS broken FROM customer CROSS JOIN r LEFT JOIN f ON f.doc_id = c_custkey AND split_part(f.rule_id, '-', 2) = part GROUP BY ALL""")
def layout_categories(spark, sf_dir):
    """The category rollup: issues, and how many rules that apply have not passed."""
    t, settings = _layouts(spark, sf_dir)
    extra = {k: t[k] for k in ("sections", "headers_footers", "tables", "figures")}
    out = audit.audit(t["paragraphs"], settings, ("text", "format"), extra=extra, styles=t["styles"], forced=t["forced"])
    nothing_answered = out["issues"].withColumn("option_id", F.lit(None).cast("string"))
    rows = report.category_summary(out["rule_results"], nothing_answered)
    return rows.select("doc_id", "category", "issue_count", (F.col("rules_checked") - F.col("rules_passed")).alias("broken"))
