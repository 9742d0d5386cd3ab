"""Papers rendered from customer and orders: known structure, citations and defects, for queries with exact answers.

One paper per customer; each order is one body paragraph that cites one reference entry. What an order's key is
divisible by decides on its defect, so that SQL can state the answer without parsing any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpaudit import schemas
from corpaudit.plans.common import table
from corpaudit.sources.corpus import typed_null

#: Lines before the first body paragraph of an order.
HEAD = 11


def letters(key: Column, capital: str) -> Column:
    return F.concat(F.lit(capital), F.translate(key.cast("string"), "0123456789", "abcdefghij"))


def _props(**values: Column) -> Column:
    kinds = {"alignment": "string", "line_rule": "string", "contextual_spacing": "boolean", "page_break_before": "boolean"}
    names = "alignment spacing_before spacing_after line line_rule first_line_indent hanging_indent left_indent contextual_spacing page_break_before".split()
    return F.struct(*[values.get(n, F.lit(None)).cast(kinds.get(n, "int")).alias(n) for n in names])


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("key"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) - 1
    return own.select("doc_id", "key", rank.alias("rank"), letters(F.col("key"), "K").alias("first"), letters(F.col("key"), "M").alias("second"), letters(F.col("key"), "N").alias("third"), (F.lit(1990) + F.col("key") % 30).cast("string").alias("year"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs table of all papers."""
    orders = orders_of(spark, sf_dir)
    papers_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("segment"))
    papers_ = papers_.join(orders.groupBy("doc_id").agg(F.count("*").alias("n")).hint("merge"), "doc_id", "left").fillna(0, "n")
    k = F.col("doc_id")
    line = lambda i, text, **extra: F.struct(F.lit(i).alias("p_idx"), text.alias("text"), F.lit(extra.get("brk", False)).alias("page_break_after"), F.lit(extra.get("bold", False)).alias("bold"), F.lit(extra.get("align", "left")).alias("alignment"))
    head = F.array(
        line(0, F.concat(F.lit("A Study of "), F.initcap("segment"), F.lit(" Paper "), k.cast("string")), bold=True, align="center"), line(1, F.concat(F.lit("Sam "), letters(k, "R")), align="center"), line(2, F.lit("University of Somewhere"), align="center"),
        line(3, F.concat(F.lit("ABC"), (F.lit(100) + k % 800).cast("string"), F.lit(": Methods")), align="center"), line(4, F.lit("Dr. Lee Grey"), align="center"), line(5, F.lit("March 3, 2024"), brk=True, align="center"),
        line(6, F.lit("Abstract"), bold=True, align="center"), line(7, F.lit("This paper looks at several things and reports what was found.")), line(8, F.lit("Keywords: things, reports")),
        line(9, F.when(k % 3 == 0, "[H2] Introduction").otherwise("Introduction"), bold=True, align="center"), line(10, F.lit("The sections below review the work that came before in some detail, and every one of them is about a single earlier study of things.")),
    )
    heads = papers_.select("doc_id", F.inline(head))
    o = F.col("key")
    body = F.concat(
        F.when(o % 6 == 0, F.concat(F.lit("Evidence was strong ("), "first", F.lit(", "), "year", F.lit(").")))
        .when(o % 6 == 1, F.concat("first", F.lit(" ("), "year", F.lit(") found an effect.")))
        .when(o % 6 == 2, F.concat("first", F.lit(" & "), "second", F.lit(" ("), "year", F.lit(") reported it.")))
        .when(o % 6 == 3, F.concat(F.lit("It was shown before ("), "first", F.lit(" and "), "second", F.lit(", "), "year", F.lit(", p. 21).")))
        .when(o % 6 == 4, F.concat(F.lit("Earlier work agrees ("), "first", F.lit(" et al, "), "year", F.lit(").")))
        .otherwise(F.concat(F.lit("This holds ("), "first", F.lit(" "), "year", F.lit(")."))),
        F.when(o % 11 == 0, " The test gave p < 0.05 here.").otherwise(""),
        F.when(o % 13 == 0, " 12 people took part.").otherwise(""),
    )
    plain = lambda text, p_idx: [text.alias("text"), F.lit(False).alias("page_break_after"), F.lit(False).alias("bold"), F.lit("left").alias("alignment"), p_idx.cast("int").alias("p_idx")]
    bodies = orders.select("doc_id", *plain(body, F.col("rank") + HEAD))
    title = papers_.select("doc_id", F.lit("References").alias("text"), F.lit(False).alias("page_break_after"), F.lit(True).alias("bold"), F.lit("center").alias("alignment"), (F.col("n") + HEAD).cast("int").alias("p_idx"))
    who = F.when((o % 6).isin(2, 3), F.concat("first", F.lit(", J., & "), "second", F.lit(", P."))).when(o % 6 == 4, F.concat("first", F.lit(", J., "), "second", F.lit(", P., & "), "third", F.lit(", Q."))).otherwise(F.concat("first", F.lit(", J.")))
    doi = F.concat(F.when(o % 5 == 0, "doi:").otherwise("https://doi.org/"), F.lit("10.1234/"), o.cast("string"))
    entry = F.concat(who, F.lit(" ("), "year", F.lit("). Topics of "), "first", F.lit(". Journal of Things, 12(3), 10–20. "), doi)
    listed = orders.where("key % 7 <> 0").select("doc_id", entry.alias("text"))
    extra = papers_.where("doc_id % 4 = 0").select("doc_id", F.lit("Zulu, Z. (2001). Never cited. Journal of Things, 1(1), 1–2. https://doi.org/10.1234/z").alias("text"))
    # customers of one in nine list their entries backwards
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(k % 9 == 0, F.lit("")).otherwise(F.col("text")), F.desc("text")))
    entries = listed.union(extra).withColumn("place", place).join(papers_.select("doc_id", "n").hint("merge"), "doc_id").select("doc_id", *plain(F.col("text"), F.col("place") + F.col("n") + HEAD))
    rows = heads.unionByName(bodies).unionByName(title).unionByName(entries)
    is_entry = F.col("text").rlike(r"^[A-Z][a-z]+, [A-Z]\., |^[A-Z][a-z]+, [A-Z]\. \(")
    props = _props(alignment=F.col("alignment"), spacing_before=F.lit(0), spacing_after=F.when(k % 10 == 0, 160).otherwise(0), line=F.when(k % 5 == 0, 276).otherwise(480), line_rule=F.lit("auto"), first_line_indent=F.when(F.col("alignment") == "left", F.when(is_entry | (F.col("p_idx") < 9), 0).otherwise(720)), hanging_indent=F.when(is_entry, F.when(k % 8 == 0, 0).otherwise(720)), page_break_before=(F.col("text") == "References"))
    font = F.when(k % 6 == 0, "Calibri").otherwise("Times New Roman")
    run = F.struct(font.alias("font_ascii"), font.alias("font_hansi"), F.when(k % 6 == 0, 22).otherwise(24).alias("size_half_points"), F.col("bold"), F.lit(False).alias("italic"), F.lit(False).alias("underline"), F.lit(False).alias("all_caps"))
    out = rows.select(
        "doc_id", "p_idx", F.col("p_idx").alias("block_idx"), "text", typed_null("string").alias("style_id"), props.alias("direct"), props.alias("props"), run.alias("run_props"), typed_null(schemas.RUNS).alias("runs"), F.lit(False).alias("is_empty"), F.lit(False).alias("has_drawing"),
        "page_break_after", F.lit(False).alias("has_numbering"), F.lit(False).alias("has_sect_pr"), F.lit(False).alias("inside_table"), typed_null("string").alias("text_before_break"), typed_null("string").alias("text_after_break"),
    )
    return out


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header with a page number for every paper, but for customers of one in seven."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    field = F.when(F.col("doc_id") % 7 == 3, "DATE").otherwise("PAGE")
    return own.select("doc_id", F.lit("header1").alias("part"), F.lit("header").alias("kind"), F.lit("default").alias("ref_type"), F.lit("").alias("text"), F.array(field).alias("field_codes"))
