"""Bounded, balanced samples of labelled documents, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def remainder(id_: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(modulus))


def held_out(id_: Column, modulus: int, fold: int) -> Column:
    return F.coalesce(remainder(id_, modulus) == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, fold: Column, parts: int = 12) -> DataFrame:
    """(text, label) of per_class documents of each label at most, without those of the held-out fold.

    The bound is a parameter of the fit alone: ids are taken in the order of a hash, so the sample spreads over
    the corpus. Null ids and labels, and ids with several labels, teach nothing. Of several texts of an id the
    smallest counts, null only if there is no other.
    """
    ids = docs.select("doc_id").where(~fold).distinct()
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = known.agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most")).where("label = most").drop("most")
    known = common.cut(known.join(ids, "doc_id").select("doc_id", "label"))
    order = F.xxhash64("doc_id")
    chosen = known.where("label = 0").orderBy(order, "doc_id").limit(per_class).union(known.where("label = 1").orderBy(order, "doc_id").limit(per_class))
    chosen = common.cut(chosen)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return common.cut(rows.select("text", "label").repartition(parts))
