"""Structure of a document from its ordered paragraphs: title page, abstract, reference list, body, metadata.

All windows share one partitioning by doc_id, so the whole detection is one shuffle. ``annotate`` puts the
boundaries on every paragraph; ``structure`` is one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpaudit.functions import text as fx

#: Shapes of the lines that mark a document's parts.
REFERENCE_HEADING = r"(?i)^(references|reference list|works cited|bibliography|reference)$"
REFERENCE_LIKE = r"\((?:1[6-9]|20)\d{2}[a-z]?\)|\(n\.d\.\)|https?://"
AFTER_REFERENCES = r"(?i)^(appendix|appendices|footnotes|tables|figures)\b"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE = rf"(?i)^(?:{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH},?\s+\d{{4}}|\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}})$"
COURSE = r"^[A-Z]{2,6}[- ]?\d{2,4}[A-Z]?\b"
INSTITUTION = r"(?i)(university|college|institute|school|academy|department of)"
INSTRUCTOR = r"(?i)^(dr\.|prof\.?|professor|instructor|mr\.|ms\.|mrs\.)\s"
AUTHOR = r"^[A-ZÀ-Þ][\w'’\-À-ÿ]+(?:\s[A-ZÀ-Þ][\w.'’\-À-ÿ]+){0,4}$"
YEAR_IN_PARENTHESES = r"\([^)]*(?:19|20)\d{2}"


def _all():
    return Window.partitionBy("doc_id")


def _so_far():
    return _all().orderBy("p_idx").rowsBetween(Window.unboundedPreceding, 0)


def _first(where: Column, value: Column | str = "p_idx") -> Column:
    """Least position of the document where the condition holds."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min(F.when(where, value)).over(_all())


def annotate(paras: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The paragraphs with the document's boundaries on each. columns: those of the paragraphs that are carried along, if not all.

    Windows carry a paragraph as one packed column beside the few marks that they read, and what follows a paragraph is told from the last
    place of its kind: a frame that ends with the document would be added up anew for every paragraph.
    """
    p, filled = F.col("p_idx"), F.col("filled")
    t, text = F.col("t"), F.col("text")
    breaks_before = F.coalesce(F.col("props.page_break_before"), F.lit(False))
    df = paras.withColumn("t", fx.strip(text)).withColumn("n_words", F.size(F.split("t", r"\s+"))).withColumn("breaks", F.col("page_break_after") | breaks_before)
    marks = {
        "filled": ~F.col("is_empty"), "breaks_before": breaks_before, "broken": F.col("page_break_after") | (breaks_before & (p > 0)), "is_prose": (F.col("n_words") > 20) | ((p < 8) & text.rlike(YEAR_IN_PARENTHESES)),
        "is_toc": t.rlike(r"(?i)^table\s+of\s+contents$"), "is_abstract": t.rlike("(?i)^abstract$"), "is_keyword": t.rlike(r"(?i)^keywords?\s*:"), "entry_like": text.rlike(REFERENCE_LIKE), "is_list": ~F.col("inside_table") & t.rlike(REFERENCE_HEADING),
        "ends_list": t.rlike(AFTER_REFERENCES) & (F.length(t) < 30), "is_fused": ~F.col("inside_table") & (F.col("text_before_break") != "") & F.col("text_after_break").rlike(REFERENCE_HEADING),
    }
    held = [*(paras.columns if columns is None else columns), "t", "n_words", "breaks"]
    df = df.select("doc_id", "p_idx", "n_words", "breaks", F.struct(*held).alias("row"), *[c.alias(name) for name, c in marks.items()])
    # title page
    df = df.withColumn("first_break", F.min(F.when(F.col("broken"), F.struct(p, F.when(F.col("breaks_before"), p).otherwise(p + 1).alias("at")))).over(_all())["at"])
    df = df.withColumn("prose_at", F.coalesce(_first((p < 8) & filled & F.col("is_prose")), F.lit(8)))
    # the last places of text and of what looks like an entry
    df = df.withColumn("last_text", F.max(F.when(filled, p)).over(_all())).withColumn("last_entry", F.max(F.when(filled & F.col("entry_like"), p)).over(_all()))
    before = filled & (p < F.col("first_break"))
    heads = F.coalesce(F.col("last_entry") > p, F.lit(False)) | ~F.coalesce(F.col("last_text") > p, F.lit(False))
    df = df.withColumn("title_lines", F.count_if(before).over(_all())).withColumn("title_prose", F.count_if(before & (F.col("n_words") > 30)).over(_all()))
    df = df.withColumn("opening_lines", F.max(F.when(filled & (p < F.least(F.col("prose_at"), F.lit(8))), p + 1)).over(_all()))
    # reference list: the last heading that entries, or nothing, follow
    df = df.withColumn("reference_heading", F.max(F.when(heads & F.col("is_list"), p)).over(_all())).withColumn("last_fused", F.max(F.when(heads & F.col("is_fused"), p)).over(_all()))
    has = (F.col("first_break") <= 30) & F.col("title_lines").between(1, 12) & (F.col("title_prose") == 0)
    df = df.withColumn("has_title_page", F.coalesce(has, F.lit(False))).withColumn("title_end", F.when(F.col("has_title_page"), F.col("first_break")).otherwise(0))
    # where metadata may stand without a title page
    df = df.withColumn("metadata_end", F.when(F.col("has_title_page"), F.col("title_end")).otherwise(F.coalesce("opening_lines", F.lit(0))))
    # abstract, past a table of contents
    df = df.withColumn("opening", F.min(F.when(filled & (p >= F.col("title_end")), F.struct(p, "is_toc"))).over(_all()))
    df = df.withColumn("reference_stop", F.coalesce(_first(filled & (p > F.col("reference_heading")) & F.col("ends_list")), F.lit(2**31 - 1)))
    df = df.withColumn("toc_break", _first(F.col("opening.is_toc") & F.col("breaks") & (p > F.col("opening.p_idx")) & (p < F.col("opening.p_idx") + 60)))
    df = df.withColumn("scan", F.coalesce(F.col("toc_break") + 1, F.col("title_end")))
    df = df.withColumn("candidate", F.min(F.when(filled & (p >= F.col("scan")) & (p < F.col("scan") + 8), F.struct(p, "is_abstract"))).over(_all()))
    df = df.withColumn("abstract_heading", F.when(F.col("candidate.is_abstract"), F.col("candidate.p_idx")))
    later = filled & (p > F.col("abstract_heading"))
    df = df.withColumn("stop", _first(later & (F.col("is_keyword") | F.col("breaks"))))
    # the next filled paragraph's words
    df = df.withColumn("words", F.when(filled, F.col("n_words"))).withColumn("rank", F.count_if(later).over(_so_far())).withColumn("next_words", F.expr("lead(words) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY p_idx)"))
    df = df.withColumn("in_abstract", F.coalesce(later & (p < F.coalesce(F.col("stop"), F.lit(2**31 - 1))) & (F.col("rank") <= 3), F.lit(False)))
    df = df.withColumn("keywords", _first(later & F.col("is_keyword") & (p == F.col("stop")) & (F.col("rank") <= 4)))
    df = df.withColumn("abstract_last", F.max(F.when(F.col("in_abstract"), p)).over(_all()))
    df = df.withColumn("is_reference", F.coalesce(filled & (p > F.col("reference_heading")) & (p < F.col("reference_stop")), F.lit(False)))
    df = df.withColumn("fused_heading", F.when(F.col("reference_heading").isNull(), F.col("last_fused")))
    df = df.withColumn("body_start", F.coalesce(F.col("keywords") + 1, F.col("abstract_last") + 1, F.col("abstract_heading") + 1, F.col("title_end")))
    past = F.coalesce(p >= F.col("reference_heading"), F.lit(False))
    df = df.withColumn("in_body", filled & (p >= F.col("body_start")) & ~past).withColumn("cites", filled & (p >= F.col("title_end")) & ~past & ~F.col("is_reference"))
    found = ["has_title_page", "title_end", "metadata_end", "abstract_heading", "in_abstract", "keywords", "abstract_last", "reference_heading", "is_reference", "fused_heading", "body_start", "in_body", "cites", "next_words"]
    return df.select(*[F.col("row")[c].alias(c) for c in held], *found)


BOUNDARIES = ["has_title_page", "title_end", "metadata_end", "abstract_heading", "keywords", "abstract_last", "reference_heading", "fused_heading", "body_start"]


def title_metadata(annotated: DataFrame) -> DataFrame:
    """doc_id, metadata: each title-page line fills the first free slot that it fits, in a fixed order of slots."""
    lines = annotated.where("not is_empty and p_idx < metadata_end").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("p_idx", "t"))).alias("lines"))
    slots = ["title", "due_date", "course_number", "institution", "instructor", "author", "course_name"]
    empty = F.struct(*[F.lit(None).cast("string").alias(s) for s in slots], F.lit(None).cast("int").alias("title_p_idx"))

    def fill(acc: Column, line: Column) -> Column:
        t = line["t"]
        free = lambda s: acc[s].isNull()
        is_title = free("title") & F.length(t).between(4, 200)
        tests = [("title", is_title), ("due_date", free("due_date") & t.rlike(DATE)), ("course_number", free("course_number") & t.rlike(COURSE)), ("institution", free("institution") & t.rlike(INSTITUTION) & (F.length(t) < 120)), ("instructor", free("instructor") & t.rlike(INSTRUCTOR)), ("author", free("author") & acc["title"].isNotNull() & t.rlike(AUTHOR) & (F.length(t) < 80))]
        chosen = F.lit(None).cast("string")
        for name, test in reversed(tests):
            chosen = F.when(test, name).otherwise(chosen)
        course = F.trim(F.regexp_extract(t, COURSE, 0))
        rest = F.trim(F.regexp_replace(F.regexp_replace(t, COURSE, ""), r"^[:\-–\s]+", ""))
        values = [F.when(chosen == s, course if s == "course_number" else t).otherwise(acc[s]).alias(s) for s in slots[:-1]]
        name = F.when((chosen == "course_number") & (rest != ""), rest).otherwise(acc["course_name"]).alias("course_name")
        return F.struct(*values, name, F.when(chosen == "title", line["p_idx"]).otherwise(acc["title_p_idx"]).alias("title_p_idx"))

    return lines.select("doc_id", F.aggregate("lines", empty, fill).alias("metadata"))


def structure(annotated: DataFrame) -> DataFrame:
    """One row per document: boundaries, numbers of abstract paragraphs and reference entries, metadata."""
    out = annotated.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in BOUNDARIES], F.count_if("in_abstract").alias("abstract_paragraphs"), F.count_if("is_reference").alias("reference_entries"))
    return out.join(title_metadata(annotated).hint("merge"), "doc_id", "left")


def split_fused(paras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The paragraphs with a fused reference heading put on a line of its own, renumbered; and the changes made."""
    return split_marked(annotate(paras), paras.columns)


def split_marked(marked: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """``split_fused`` of annotated paragraphs; columns: those of the paragraphs."""
    here = F.coalesce(F.col("p_idx") == F.col("fused_heading"), F.lit(False))
    kept = [c for c in columns if c not in ("text", "p_idx", "block_idx", "text_before_break", "text_after_break")]
    texts = F.when(here, F.array("text_before_break", "text_after_break")).otherwise(F.array("text"))
    rows = marked.select(*kept, "p_idx", "block_idx", F.when(here, None).otherwise(F.col("text_before_break")).alias("text_before_break"), F.when(here, None).otherwise(F.col("text_after_break")).alias("text_after_break"), F.posexplode(texts).alias("part", "text"), here.alias("here"), F.col("fused_heading").alias("at"))
    moved = F.coalesce(((F.col("p_idx") > F.col("at")) | F.col("here") & (F.col("part") == 1)).cast("int"), F.lit(0))
    out = rows.withColumn("p_idx", F.col("p_idx") + moved).withColumn("block_idx", F.col("block_idx") + moved).select(*columns)
    changes = marked.where(here).select("doc_id", F.lit("APA-REFERENCE-000").alias("rule_id"), "p_idx", F.col("text").alias("before"), F.col("text_after_break").alias("after"))
    return out, changes


def long_quotes(annotated: DataFrame) -> DataFrame:
    """doc_id, p_idx, words, indented: quotations of 40 words, in quotation marks or as an indented block."""
    quoted = F.regexp_extract("text", r"[“\"]([^”\"]{150,})[”\"]", 1)
    left = F.coalesce(F.col("props.left_indent"), F.lit(0))
    rows = annotated.where("not is_empty and not is_reference and p_idx >= body_start")
    words = F.when(quoted != "", F.size(F.split(quoted, r"\s+"))).when((left >= 700) & ~F.col("has_numbering"), F.col("n_words"))
    return rows.select("doc_id", "p_idx", words.alias("words"), (left >= 700).alias("indented")).where("words >= 40")
