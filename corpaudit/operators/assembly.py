"""Assembly: word counts up to the references, ordered concatenation, appendix text to an exact word budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpaudit.functions import text as fx

#: A line that is only a reference heading.
REFERENCE_HEADING = r"(?i)^(references|bibliography|works\s+cited)\s*:?[\s.]*$"


def _cutoffs(paras: DataFrame) -> DataFrame:
    return paras.where(fx.strip(F.col("text")).rlike(REFERENCE_HEADING)).groupBy("doc_id").agg(F.min("block_idx").alias("cutoff"))


def _before(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return rows.join(cutoffs, "doc_id", "left").where(F.col("cutoff").isNull() | (F.col("block_idx") < F.col("cutoff"))).drop("cutoff")


def content_words(paras: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """doc_id, words before the first reference heading; cells (doc_id, block_idx, text) of tables count too."""
    rows = paras.select("doc_id", "block_idx", "text")
    if cells is not None:
        rows = rows.unionByName(cells.select("doc_id", "block_idx", "text"))
    counted = _before(rows, _cutoffs(paras)).groupBy("doc_id").agg(F.sum(fx.count_words(F.col("text"))).alias("words"))
    return paras.select("doc_id").distinct().join(counted, "doc_id", "left").withColumn("words", F.coalesce("words", F.lit(0)).cast("long"))


def assemble(paras: DataFrame, order: DataFrame, appendix: DataFrame | None = None) -> DataFrame:
    """ord, block_idx, kind, text: for each document of order (doc_id, ord, heading) its heading and content, the appendix last."""
    heads = order.select("ord", F.lit(-1).alias("block_idx"), F.lit("heading").alias("kind"), F.col("heading").alias("text"))
    body = _before(paras.select("doc_id", "block_idx", "text"), _cutoffs(paras)).join(order.select("doc_id", "ord"), "doc_id").select("ord", "block_idx", F.lit("content").alias("kind"), "text")
    out = heads.unionByName(body)
    if appendix is not None:
        out = out.unionByName(appendix.select(F.lit(2**31 - 1).alias("ord"), F.col("pos").alias("block_idx"), F.lit("appendix").alias("kind"), "text"))
    return out


def fill_budget(lines: DataFrame, words: int) -> DataFrame:
    """pos, text, words: the lines (line_no, text) over and over until the budget, the last one cut at its word.

    The lines of one appendix are few; their repeats are counted and ranged in Spark.
    """
    counted = lines.select("line_no", "text", fx.count_words(F.col("text")).alias("n"))
    size = counted.agg(F.sum("n").alias("total"), F.count("*").alias("lines"), F.max("line_no").alias("last")).first()
    if not size.total or words <= 0:
        return counted.where("false").select(F.lit(0).alias("pos"), "text", F.lit(0).alias("words"))
    cycles = -(-words // size.total)
    # words before each line: sums of whole stretches of lines, then within the stretch
    counted = counted.withColumn("stretch", F.floor(F.col("line_no") / 1000))
    sums = counted.groupBy("stretch").agg(F.sum("n").alias("sum"))
    sums = sums.select("stretch", F.coalesce(F.sum("sum").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.join(sums, "stretch").withColumn("before", F.col("ahead") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    rows = before.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1)))).withColumn("left", F.lit(words) - F.col("cycle") * size.total - F.col("before")).where("left > 0")
    # text up to the end of its left-th word: everything but what follows that many words
    cut = F.concat(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"([^\p{{L}}\p{{N}}]*{fx.COUNTED_WORD})"), F.lit(1)), F.lit(1), F.col("left").cast("int")), ""))
    return rows.select((F.col("cycle") * (size.last + 1) + F.col("line_no")).cast("int").alias("pos"), F.when(F.col("n") <= F.col("left"), F.col("text")).otherwise(cut).alias("text"), F.least("n", "left").cast("int").alias("words"))


def projected_words(counts: DataFrame, order: DataFrame, appendix_words: int) -> DataFrame:
    heads = order.select("doc_id", fx.count_words(F.col("heading")).alias("heading_words"))
    return counts.join(heads, "doc_id").agg((F.sum("words") + F.sum("heading_words") + appendix_words).cast("long").alias("projected"))
