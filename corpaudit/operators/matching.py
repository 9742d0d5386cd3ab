"""Citations against reference entries of the same document, both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit.functions import text as fx

#: Abbreviations of organisations; users may pass more.
ORGANISATIONS = {
    "apa": "american psychological association",
    "who": "world health organization",
    "cdc": "centers for disease control and prevention",
    "nih": "national institutes of health",
    "un": "united nations",
    "unesco": "united nations educational, scientific and cultural organization",
}


def names_match(cited: Column, listed: Column, organisations: dict[str, str]) -> Column:
    """Equal, an abbreviation, or one name within the other if the cited one is longer than eight characters."""
    a, b = fx.name_key(cited), fx.name_key(listed)
    full = F.create_map(*[F.lit(x) for pair in organisations.items() for x in pair])[a]
    return F.coalesce((a == b) | F.coalesce(b.contains(full), F.lit(False)) | ((F.length(a) > 8) & (b.contains(a) | a.contains(b))), F.lit(False))


def match_citations(citations: DataFrame, refs: DataFrame, organisations: dict[str, str] | None = None) -> DataFrame:
    """doc_id, citation_idx, ref_idx, grade (exact or probable): an equi-join on document and year, then the names."""
    orgs = ORGANISATIONS | (organisations or {})
    left = citations.select("doc_id", "citation_idx", "authors", "et_al", F.col("year").alias("cited_year"), fx.year_base(F.col("year")).alias("base"))
    right = refs.where(F.col("year").isNotNull() & (F.size("surnames") > 0)).select("doc_id", "ref_idx", "surnames", "is_org", F.col("year").alias("listed_year"), fx.year_base(F.col("year")).alias("base"))
    pairs = left.join(right.hint("merge"), ["doc_id", "base"]).where(names_match(F.col("authors")[0], F.col("surnames")[0], orgs))
    by_year = F.when(F.col("cited_year") == F.col("listed_year"), "exact").otherwise("probable")
    n, m = F.size("authors"), F.size("surnames")
    every = F.forall(F.zip_with("authors", F.slice("surnames", F.lit(1), n), lambda a, s: a.isNotNull() & s.isNotNull() & names_match(a, s, orgs)), lambda ok: ok)
    grade = (
        F.when(F.col("et_al"), F.when(m >= 3, by_year).otherwise("probable")).when(n == 1, F.when(F.col("is_org") | (m == 1), by_year).otherwise("probable")).when(every & (n == m), by_year).when(every, "probable")
    )
    return pairs.select("doc_id", "citation_idx", "ref_idx", grade.alias("grade")).where("grade is not null")


def match_status(pairs: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, citation_idx, status, ref_idxs: one exact entry wins, several are ambiguous; else the same of probable ones."""
    found = pairs.groupBy("doc_id", "citation_idx").agg(F.sort_array(F.collect_list(F.when(F.col("grade") == "exact", F.col("ref_idx")))).alias("exact"), F.sort_array(F.collect_list(F.when(F.col("grade") == "probable", F.col("ref_idx")))).alias("probable"))
    out = citations.select("doc_id", "citation_idx").join(found.hint("merge"), ["doc_id", "citation_idx"], "left")
    exact, probable = F.coalesce(F.size("exact"), F.lit(0)), F.coalesce(F.size("probable"), F.lit(0))
    status = F.when(exact == 1, "exact").when(exact > 1, "ambiguous").when(probable == 1, "probable").when(probable > 1, "ambiguous").otherwise("missing_reference")
    chosen = F.when(exact > 0, F.col("exact")).when(probable > 0, F.col("probable")).otherwise(F.array().cast("array<int>"))
    return out.select("doc_id", "citation_idx", status.alias("status"), chosen.alias("ref_idxs"))


def reference_usage(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, ref_idx, cited, citation_idxs: every chosen candidate counts as cited."""
    uses = matches.select("doc_id", "citation_idx", F.explode("ref_idxs").alias("ref_idx")).groupBy("doc_id", "ref_idx").agg(F.sort_array(F.collect_list("citation_idx")).alias("citation_idxs"))
    out = refs.select("doc_id", "ref_idx").join(uses.hint("merge"), ["doc_id", "ref_idx"], "left")
    return out.select("doc_id", "ref_idx", F.col("citation_idxs").isNotNull().alias("cited"), F.coalesce("citation_idxs", F.array().cast("array<int>")).alias("citation_idxs"))
