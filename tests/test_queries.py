"""Queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpaudit.plans import registry

DATA = "/root/testdata/sf0.001"
#: Every query with SQL, but those whose work other queries or tests do with other columns.
SAME = {"sim_matrix", "sim_report_rows", "audit_issue_counts", "audit_resolved_report", "audit_report", "audit_outline", "layout_categories", "layout_issues_corrected", "correction_changes", "paper_citation_fixes", "paper_usage", "corpus_profile"}
ELSEWHERE = {"sim_query_pairs", "sim_query_metrics"}
CHOSEN = [name for name in registry.ORACLES if name not in SAME | ELSEWHERE]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(int(v) if isinstance(v, bool) else v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    done = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in done.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == wanted


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
