"""Sources and intake: text corpora, paragraphs, file triage, manifest safety, dedupe, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpaudit import schemas
from corpaudit.functions import text as fx

#: Limits of the intake.
MAX_FILE, MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL = 25 * 2**20, 4096, 200 * 2**20, 400 * 2**20
REQUIRED_PARTS = ("[Content_Types].xml", "word/document.xml")


def read_corpus(spark: SparkSession, path: str, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, text from Parquet, or one document per text file with its path as the id."""
    if id_col is None:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def typed_null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def to_paragraphs(docs: DataFrame) -> DataFrame:
    """One row per line, with null properties; a vertical tab is a soft line break. Null texts have no lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("p_idx", "raw"))
    text = fx.plain_spaces(F.translate("raw", "\t\u000b", "  "))
    soft = F.instr("raw", "\u000b") > 0
    return lines.select(
        "doc_id", "p_idx", F.col("p_idx").alias("block_idx"), text.alias("text"), typed_null("string").alias("style_id"), typed_null(schemas.PROPS).alias("direct"),
        typed_null(schemas.PROPS).alias("props"), typed_null(schemas.RUN_PROPS).alias("run_props"), typed_null(schemas.RUNS).alias("runs"), (F.trim(text) == "").alias("is_empty"),
        *[F.lit(False).alias(c) for c in ("has_drawing", "page_break_after", "has_numbering", "has_sect_pr", "inside_table")],
        F.when(soft, fx.strip(fx.plain_spaces(F.regexp_replace("raw", r"(?s)^(.*)\x0b.*$", "$1")))).alias("text_before_break"),
        F.when(soft, fx.strip(fx.plain_spaces(F.regexp_replace("raw", r"(?s)^.*\x0b", "")))).alias("text_after_break"),
    )


def triage(files: DataFrame) -> DataFrame:
    """path, length, accepted, reject_code of (path, length, content): extension, size, then the first bytes."""
    head = F.hex(F.substring("content", 1, 4))
    code = (
        F.when(~F.lower("path").endswith(".docx"), "UNSUPPORTED_FILE_TYPE").when(F.col("length") > MAX_FILE, "FILE_TOO_LARGE").when(head == "D0CF11E0", "PASSWORD_PROTECTED").when(F.coalesce(F.substring(head, 1, 4), F.lit("")) != "504B", "CORRUPT")
    )
    return files.select("path", "length", code.isNull().alias("accepted"), code.alias("reject_code"))


def scan_manifest(entries: DataFrame) -> DataFrame:
    """doc_id, reject_code of (doc_id, entry_name, uncompressed_size): counts, sizes, unsafe names, missing parts."""
    name = F.col("entry_name")
    unsafe = name.rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:")
    agg = entries.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("uncompressed_size").alias("largest"), F.sum("uncompressed_size").alias("total"), F.bool_or(unsafe).alias("unsafe"),
        F.bool_or(F.lower(name).contains("vbaproject")).alias("macros"), *[F.bool_or(name == part).alias(f"part{i}") for i, part in enumerate(REQUIRED_PARTS)],
    )
    code = (
        F.when(F.col("n") > MAX_ENTRIES, "TOO_MANY_ENTRIES").when((F.col("largest") > MAX_ENTRY) | (F.col("total") > MAX_TOTAL), "PACKAGE_TOO_LARGE").when(F.col("unsafe"), "UNSAFE_PATH").when(F.col("macros"), "MACROS").when(~(F.col("part0") & F.col("part1")), "CORRUPT")
    )
    return agg.select("doc_id", code.alias("reject_code"))


def dedupe_intake(files: DataFrame, cap: int = 30) -> DataFrame:
    """First of each (name, size, last_modified) in arrival order, and the first cap of them (a feature of the intake)."""
    first = Window.partitionBy("name", "size", "last_modified").orderBy("arrival")
    return files.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r").orderBy("arrival").limit(cap)


def profile(paras: DataFrame, structure: DataFrame, headings: DataFrame, citations: DataFrame, references: DataFrame, tables: DataFrame | None = None, footnotes: DataFrame | None = None) -> DataFrame:
    """One row per document: counts of paragraphs, headings, citations, references, images, and (null where not known) tables
    and footnotes, and what was detected."""
    counts = paras.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if("has_drawing").alias("images"))
    for name, df in (("headings", headings), ("citations", citations), ("references", references), ("tables", tables), ("footnotes", footnotes)):
        if df is None:
            counts = counts.withColumn(name, F.lit(None).cast("long"))
            continue
        counts = counts.join(df.groupBy("doc_id").agg(F.count("*").alias(name)).hint("merge"), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return counts.join(structure.select("doc_id", "has_title_page", F.col("abstract_heading").isNotNull().alias("has_abstract"), "metadata").hint("merge"), "doc_id", "left")
