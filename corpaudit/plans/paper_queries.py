"""Queries on the audit operators, over papers rendered from customer and orders; SQL states what was rendered."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpaudit.operators import citations as cit
from corpaudit.operators import headings as hd
from corpaudit.operators import matching, references, structure
from corpaudit.plans import seeds
from corpaudit.tables import cut

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


O = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rank,
 'K' || translate(o_orderkey::VARCHAR, '0123456789', 'abcdefghij') AS first, 'M' || translate(o_orderkey::VARCHAR, '0123456789', 'abcdefghij') AS second, 'N' || translate(o_orderkey::VARCHAR, '0123456789', 'abcdefghij') AS third,
 (1990 + o_orderkey % 30)::VARCHAR AS year, o_orderkey % 6 AS v FROM orders)"""
N = "n AS (SELECT c_custkey AS doc_id, coalesce(c, 0) AS n, c_mktsegment AS segment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS c FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"


def _cited_and_listed(spark, sf_dir) -> DataFrame:
    """The paragraphs that citations and references are read from, written once: no other rows, and only what their parsers read."""
    marked = structure.annotate(seeds.papers(spark, sf_dir), ["doc_id", "p_idx", "text"])
    return cut(marked.where("cites or is_reference").select("doc_id", "p_idx", "text", "cites", "is_reference"))


def _citations(spark, sf_dir) -> DataFrame:
    return cit.extract_citations(_cited_and_listed(spark, sf_dir))


def _references(spark, sf_dir) -> DataFrame:
    return references.references_of(_cited_and_listed(spark, sf_dir))


def _matched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(matches, references); what both sides of the match read is parsed once."""
    rows = _cited_and_listed(spark, sf_dir)
    found = cut(cit.extract_citations(rows).select("doc_id", "citation_idx", "authors", "et_al", "year"))
    refs = cut(references.references_of(rows).select("doc_id", "ref_idx", "surnames", "is_org", "year"))
    return matching.match_status(matching.match_citations(found, refs), found), refs


@query(f"WITH {N} SELECT doc_id, true AS has_title_page, 6 AS title_end, 6 AS abstract_heading, 8 AS keywords, 9 AS body_start, (11 + n)::INT AS reference_heading, 1 AS abstract_paragraphs FROM n")
def paper_structure(spark, sf_dir):
    out = structure.structure(structure.annotate(seeds.papers(spark, sf_dir)))
    return out.select("doc_id", "has_title_page", "title_end", "abstract_heading", "keywords", "body_start", "reference_heading", F.col("abstract_paragraphs").cast("int").alias("abstract_paragraphs"))


@query(f"""WITH {N} SELECT doc_id, 'A Study of ' || upper(segment[1]) || lower(segment[2:]) || ' Paper ' || doc_id AS title, 'Sam R' || translate(doc_id::VARCHAR, '0123456789', 'abcdefghij') AS author, 'University of Somewhere' AS institution,
 'ABC' || (100 + doc_id % 800) AS course_number, 'Methods' AS course_name, 'Dr. Lee Grey' AS instructor, 'March 3, 2024' AS due_date FROM n""")
def paper_metadata(spark, sf_dir):
    out = structure.structure(structure.annotate(seeds.papers(spark, sf_dir)))
    return out.select("doc_id", *[F.col(f"metadata.{c}").alias(c) for c in ("title", "author", "institution", "course_number", "course_name", "instructor", "due_date")])


@query(f"WITH {N} SELECT doc_id, 9 AS p_idx, 'Introduction' AS text, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS level, 'high' AS confidence, CASE WHEN doc_id % 3 = 0 THEN 120 ELSE 115 END AS score FROM n")
def paper_headings(spark, sf_dir):
    own = ["doc_id", "p_idx", "is_empty", "inside_table", "has_numbering", "style_id", "props", "run_props"]
    read = ["in_body", "in_abstract", "is_reference", "next_words", *structure.BOUNDARIES]
    paras = cut(structure.annotate(seeds.papers(spark, sf_dir), own).select(*own, "t", "n_words", *read))
    return hd.headings_of(paras, structure.structure(paras)).select("doc_id", "p_idx", "text", "level", "confidence", "score")


_CITED = """SELECT doc_id, rank::INT AS citation_idx, (rank + 11)::INT AS p_idx, CASE WHEN v IN (1, 2) THEN 'narrative' ELSE 'parenthetical' END AS kind,
 CASE WHEN v IN (2, 3) THEN first || '|' || second ELSE first END AS authors, v = 4 AS et_al, year, CASE WHEN v = 3 THEN 'p. 21' END AS locator,
 CASE v WHEN 2 THEN 'AMPERSAND_IN_NARRATIVE' WHEN 3 THEN 'AND_IN_PARENTHETICAL' WHEN 4 THEN 'ET_AL_MISSING_PERIOD' WHEN 5 THEN 'MISSING_COMMA_BEFORE_YEAR' ELSE '' END AS problems FROM o"""


@query(f"WITH {O} {_CITED}")
def paper_citations(spark, sf_dir):
    out = _citations(spark, sf_dir)
    return out.select("doc_id", "citation_idx", "p_idx", "kind", F.array_join("authors", "|").alias("authors"), "et_al", "year", "locator", F.array_join("problems", "|").alias("problems"))


@query(f"""WITH {O} SELECT doc_id, rank::INT AS citation_idx, CASE v WHEN 2 THEN first || ' and ' || second || ' (' || year || ')' WHEN 3 THEN '(' || first || ' & ' || second || ', ' || year || ', p. 21)' WHEN 4 THEN '(' || first || ' et al., ' || year || ')' END AS fixed FROM o WHERE v IN (2, 3, 4, 5)""")
def paper_citation_fixes(spark, sf_dir):
    rows = _citations(spark, sf_dir).select("doc_id", "citation_idx", "raw", F.explode("problems").alias("code"))
    return rows.select("doc_id", "citation_idx", cit.citation_fix(F.col("raw"), F.col("code")).alias("fixed"))


_LISTED = """listed AS (SELECT doc_id, key, lower(first) AS name, CASE WHEN v IN (2, 3) THEN 2 WHEN v = 4 THEN 3 ELSE 1 END AS surnames, year, 'Topics of ' || first AS title, '10.1234/' || key AS doi, CASE WHEN key % 5 = 0 THEN 'DOI_OLD_FORMAT' ELSE '' END AS problems FROM o WHERE key % 7 <> 0
 UNION ALL SELECT c_custkey, 0, 'zulu', 1, '2001', 'Never cited', '10.1234/z', '' FROM customer WHERE c_custkey % 4 = 0)"""


@query(f"WITH {O}, {_LISTED} SELECT doc_id, name, surnames, year, title, doi, 'journal_article' AS type, 'Journal of Things' AS journal, problems FROM listed")
def paper_references(spark, sf_dir):
    out = _references(spark, sf_dir)
    return out.select("doc_id", F.col("surnames")[0].alias("name"), F.size("surnames").alias("surnames"), "year", "title", "doi", "type", F.col("journal.name").alias("journal"), F.array_join(F.transform("problems", lambda p: p["code"]), "|").alias("problems"))


@query(f"WITH {O} SELECT doc_id, rank::INT AS citation_idx, CASE WHEN key % 7 = 0 THEN 'missing_reference' ELSE 'exact' END AS status, CASE WHEN key % 7 = 0 THEN 0 ELSE 1 END AS candidates FROM o")
def paper_matches(spark, sf_dir):
    return _matched(spark, sf_dir)[0].select("doc_id", "citation_idx", "status", F.size("ref_idxs").alias("candidates"))


@query(f"WITH {O}, {_LISTED} SELECT doc_id, name, name <> 'zulu' AS cited FROM listed")
def paper_usage(spark, sf_dir):
    matches, refs = _matched(spark, sf_dir)
    used = matching.reference_usage(matches, refs)
    return used.join(refs.select("doc_id", "ref_idx", F.col("surnames")[0].alias("name")).hint("merge"), ["doc_id", "ref_idx"]).select("doc_id", "name", "cited")


@query(f"WITH {O}, {_LISTED}, c AS (SELECT doc_id, count(*) AS n FROM listed GROUP BY doc_id) SELECT doc_id, n AS entries, doc_id % 9 <> 0 OR n = 1 AS in_order FROM c")
def paper_reference_order(spark, sf_dir):
    return references.reference_order(_references(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("entries"), F.bool_and("in_order").alias("in_order"))
