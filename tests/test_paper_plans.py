"""Annotated paragraphs that carry only the columns that their readers name."""

from pyspark.sql import functions as F

from corpaudit.operators import structure
from corpaudit.plans import paper_queries, seeds


def test_annotated_paragraphs_carry_what_is_named(spark):
    papers = seeds.papers(spark, "/root/testdata/sf0.001").where("doc_id < 40")
    few = structure.annotate(papers, ["doc_id", "p_idx", "text"])
    assert not {"props", "run_props", "direct", "runs"} & set(few.columns)
    full = structure.annotate(papers).select(few.columns)
    assert sorted(map(str, few.select(F.struct("*").cast("string")).collect())) == sorted(map(str, full.select(F.struct("*").cast("string")).collect()))


def test_only_paragraphs_that_are_parsed_are_written(spark):
    rows = paper_queries._cited_and_listed(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "p_idx", "text", "cites", "is_reference"] and rows.where("not cites and not is_reference").isEmpty() and not rows.isEmpty()
