"""The corpus pipeline: quality, toxicity, near duplicates, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents
(the last: digests of the encoding). run() applies them in order; each result is written to the shared folder
and read again, so a lost executor costs one stage's tasks at most. Null and empty texts pass through every filter
as their operators define; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpaudit.llm import bpe, common, decontaminate, jaccard, quality, toxicity

#: No SQL expresses the learned stages; tests plant rows for every stage, and hold each stage's operator against a plain version.
ORACLE_SQL = None
#: A document is rejected as poor below this score, and as toxic from this score on.
POOR, TOXIC = 0.5, 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go; null and empty texts are scored like any other."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")), POOR)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts get the model's base score."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")), TOXIC)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest id stays; documents without words stay, and of rows that repeat an id the different texts stay."""
    return jaccard.keep_one(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text that is left; null and empty texts have no tokens."""
    return bpe.digests(docs)


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("near_duplicates", one_of_each_group), ("decontamination", no_leaks), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
