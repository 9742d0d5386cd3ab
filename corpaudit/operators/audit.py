"""The audit of a corpus: structure, citations, references, matching, rules, report; check-only or with corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit.operators import citations, corrections, headings, insertion, matching, properties, references, report, requirements, rules, structure
from corpaudit.tables import cut

# Joins of rows per document are hinted to merge here and in the operators that an audit runs: such rows have few bytes once shuffled, from which Spark would decide to
# broadcast them, but many more in the memory of the driver and of each executor, and a table that grows with the corpus would be sent whole.


def default_settings(paras: DataFrame) -> DataFrame:
    """Requirements of all documents of a table (doc_id) that gives none; one row per document is enough."""
    none = lambda kind: F.lit(None).cast(kind)
    base = paras.select("doc_id").distinct().select("doc_id", F.lit("student").alias("paper_type"), none("string").alias("font"), none("int").alias("font_size"), none("boolean").alias("abstract_required"), none("boolean").alias("running_head_required"), none("int").alias("min_references"))
    return requirements.effective_requirements(base)


def analyse(paras: DataFrame, forced: DataFrame | None = None, style_names: DataFrame | None = None, marked: DataFrame | None = None) -> dict[str, DataFrame]:
    """All child tables, written once each: what reads them starts a plan of its own.

    forced: levels of headings that users set (doc_id, p_idx, level); style_names: (doc_id, style_id, name); marked: the annotated paragraphs, where they
    are written already.
    """
    marked = cut(structure.annotate(paras)) if marked is None else marked
    doc = cut(structure.structure(marked))
    found, refs = cut(citations.extract_citations(marked)), cut(references.references_of(marked))
    heads = headings.headings_of(marked, doc, style_names)
    heads = cut(heads if forced is None else headings.apply_forced(heads, forced, marked))
    matches = cut(matching.match_status(matching.match_citations(found, refs), found))
    return {"paragraphs": marked, "structure": doc, "headings": heads, "citations": found, "references": refs, "matches": matches, "usage": matching.reference_usage(matches, refs)}


def audit(
    paras: DataFrame, settings: DataFrame | None = None, groups: tuple[str, ...] = ("text",), disabled: DataFrame | None = None, extra: dict[str, DataFrame] | None = None, own_rules: list | None = None,
    styles: DataFrame | None = None, forced: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """issues, rule_results, category_summary, report, and the tables they come from.

    extra: sections, tables, figures, headers_footers, where known; styles: the style table, from which the properties
    of paragraphs are resolved first; forced: heading levels that users set; own_rules: further rules.
    """
    names = None
    if styles is not None:
        paras, names = cut(properties.effective_props(paras, styles)), styles.select("doc_id", "style_id", "name")
    t = analyse(paras, forced, names) | (extra or {})
    listed = (rules.text_rules() if "text" in groups else []) + (rules.format_rules() if "format" in groups else []) + (own_rules or [])
    inputs = rules.rule_tables(t, settings if settings is not None else default_settings(t["structure"]), {r.table for r in listed})
    issues, results = rules.evaluate_rules(inputs, listed, disabled)
    settled = issues.withColumn("option_id", F.lit(None).cast("string"))
    return t | {"inputs": inputs, "issues": issues, "rule_results": results, "category_summary": report.category_summary(results, settled), "report": report.report(results, settled)}


def correct(paras: DataFrame, settings: DataFrame | None = None, forced: DataFrame | None = None, styles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrected paragraphs, changes) of ``correct_tables``."""
    t = correct_tables(paras, settings, forced, styles)
    return t["paragraphs"], t["changes"]


def correct_tables(
    paras: DataFrame, settings: DataFrame | None = None, forced: DataFrame | None = None, styles: DataFrame | None = None, children: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """paragraphs, changes, inserted (doc_id, text), and styles where they are given. What changes is what the rules find: citation and reference texts, then the
    properties, typed indents and blank paragraphs of the format rules, then styles and looks of headings, italics of
    references, and their order. Texts change in their runs, whose looks stay. Last, title-page lines that a user gives are put in (``insertion``;
    settings with metadata).

    changes: doc_id, p_idx, rule_id, before, after, reason, confidence, document_wide, field (what changed: text, or a property); p_idx is the
    place before blank paragraphs went and lines came in. children: tables with a block_idx (tables, figures); they come back under their names, their blocks moved.
    """
    names, original = None, styles
    if styles is not None:
        paras, names = cut(properties.effective_props(paras, styles)), styles.select("doc_id", "style_id", "name")
    first = cut(structure.annotate(paras))
    fused, splits = structure.split_marked(first, paras.columns)
    marked = first
    if not splits.isEmpty():
        # only papers of which a paragraph was split are looked at anew
        fused, halved = cut(fused), splits.select("doc_id").distinct().hint("merge")
        marked = cut(first.join(halved, "doc_id", "left_anti").select(*first.columns).unionByName(structure.annotate(fused.join(halved, "doc_id", "left_semi").select(*fused.columns))))
    t = analyse(fused, forced, names, marked)
    settings = settings if settings is not None else default_settings(t["structure"])
    inputs = rules.rule_tables(t, settings, {"paragraphs", "citation_problems", "reference_problems"})
    texts = cut(corrections.text_changes(inputs["citation_problems"], inputs["reference_problems"]))
    props = rules.proposed_changes(inputs["paragraphs"], rules.format_rules())
    props = cut(props.unionByName(corrections.heading_changes(t["headings"], t["paragraphs"], forced)))
    out = cut(corrections.apply_prop_changes(corrections.apply_text_changes(fused, texts), props))
    entries = t["references"].select("doc_id", "p_idx")
    slanted = cut(corrections.apply_italics(out, entries))
    italics = slanted.alias("n").join(out.alias("o").hint("merge"), ["doc_id", "p_idx"]).where(~F.col("n.runs").eqNullSafe(F.col("o.runs")))
    italics = italics.select("doc_id", "p_idx", F.lit("APA-REFERENCE-008").alias("rule_id"), F.lit("not in italics").alias("before"), F.lit("in italics").alias("after"), F.lit("Journals with volumes, and titles of works, stand in italics.").alias("reason"), F.lit(0.9).alias("confidence"), F.lit(False).alias("document_wide"), F.lit("run.italic").alias("field"))
    out = cut(corrections.remove_paragraphs(corrections.reorder_references(slanted, t["references"]), props))
    old = inputs["paragraphs"].select("doc_id", "p_idx", "text")
    before = F.when(F.col("field") == "text", F.col("text")).otherwise(F.col("field"))
    noted = ["reason", "confidence", "document_wide", "field"]
    set_ = props.join(old.hint("merge"), ["doc_id", "p_idx"]).select("doc_id", "p_idx", "rule_id", before.alias("before"), F.col("value").alias("after"), *noted)
    texts = texts.withColumn("document_wide", F.lit(False)).withColumn("field", F.lit("text")).select("doc_id", "p_idx", "rule_id", "before", "after", *noted)
    splits = splits.select("*", F.lit("The heading of the list stood in another paragraph.").alias("reason"), F.lit(0.9).alias("confidence"), F.lit(False).alias("document_wide"), F.lit("split").alias("field"))
    gone = props.where("field = 'removed'").select("doc_id", "p_idx").distinct().join(fused.select("doc_id", "p_idx", "block_idx").hint("merge"), ["doc_id", "p_idx"])
    split = splits.select("doc_id", "p_idx").join(first.select("doc_id", "p_idx", "block_idx").hint("merge"), ["doc_id", "p_idx"])
    lines = None
    if "metadata" in settings.columns:
        lines = cut(insertion.located(insertion.title_page_lines(t["structure"], settings), out))
        out = cut(insertion.insert_paragraphs(out, lines, settings))
    changes = texts.unionByName(set_).unionByName(splits).unionByName(italics)
    if lines is not None:
        put = lines.where("element is not null")
        new = put.select("doc_id", F.col("at").alias("p_idx"), "rule_id", F.concat(F.lit("no "), F.replace("element", F.lit("_"), F.lit(" "))).alias("before"), F.col("text").alias("after"), F.lit("A title-page line that a user gave.").alias("reason"), F.when(F.col("rule_id") == "APA-TITLE-001", 0.9).otherwise(0.95).alias("confidence"), (F.col("rule_id") == "APA-TITLE-001").alias("document_wide"), F.lit("inserted").alias("field"))
        changes = changes.unionByName(new)
    found = {"paragraphs": out, "changes": cut(changes)}
    if lines is not None:
        found["inserted"] = put.select("doc_id", "text")
    for name, table in (children or {}).items():
        # each step's places are those that the one before left
        for moves in (insertion.moves_of(split=split), insertion.moves_of(removed=gone), lines if lines is None else insertion.moves_of(lines=lines)):
            table = table if moves is None else insertion.moved(table, moves)
        found[name] = cut(table)
    if original is not None:
        sure = t["headings"].where("from_style or confidence = 'high'").select("doc_id", "level")
        found["styles"] = cut(corrections.heading_styles(original, sure, settings))
    return found
