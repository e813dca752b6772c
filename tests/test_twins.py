"""Queries and their SQL twins on tables that hold what only larger copies of the supplied ones hold."""

import os
import sys

import duckdb
import pytest

from jobloom.plans import ORACLES, QUERIES
from jobloom.sources.inputs import TABLES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import rows_of  # noqa: E402


def compared(spark, small, folder, key, **changed):
    """Rows of a query and of its twin where some tables are replaced by the result of a DuckDB query."""
    con = duckdb.connect()
    for table in TABLES:
        path = f"{small}/{table}.parquet"
        if table in changed:
            con.execute(f"COPY ({changed[table].format(path=path)}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        else:
            os.symlink(path, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = QUERIES[key](spark, str(folder))
    result = con.execute(ORACLES[key])
    return rows_of(df.columns, df.collect()), rows_of([c[0] for c in result.description], result.fetchall())


def test_known_companies_with_large_keys_are_not_new(spark, small, tmp_path):
    wide = "SELECT * FROM '{path}' UNION ALL SELECT * REPLACE (c_custkey + 100000 AS c_custkey) FROM '{path}'"
    got, want = compared(spark, small, tmp_path, "agg_ingest_summary", customer=wide)
    assert got == want
    assert all(value == "0" for row in got[0] for (value, _), name in zip(row, got[1]) if name == "new_companies")


# references cut before their semicolon, inside a text and before a tag
CUT = "replace(replace(html, '</h1>', ' a&amp</h1>'), '</p>', ' b&quot;c &amp</p>')"


@pytest.mark.parametrize("key", ["pg_content", "pg_main", "pg_prune", "pg_clean"])
def test_references_without_a_semicolon(spark, small, tmp_path, key):
    got, want = compared(spark, small, tmp_path, key, pages=f"SELECT * REPLACE ({CUT} AS html) FROM '{{path}}'")
    assert got == want


# every reference that the pages hold, cut before its semicolon: alone in a heading, before other tags, and twice in a row
CUT_HEADS = (
    "replace(replace(html, '</title>', [' &quot', ' &amp', ' a&copy', '&amp&quot'][page_id % 4 + 1] || '</title>'), "
    "'</h1>', [' token = &quot', '&middot &amp', ' a&copyb', '&quot&ampquot;'][page_id % 4 + 1] || '</h1>')"
)
CUT_TEXTS = f"replace(replace({CUT_HEADS}, '<br>', ' &quot<br>;'), '</p>', ' b&middot c &copy</p>')"


@pytest.mark.parametrize("key", ["pg_title", "pg_sections", "pg_markdown", "pg_preprocess", "pg_pipeline"])
def test_headings_that_end_in_a_cut_reference(spark, small, tmp_path, key):
    got, want = compared(spark, small, tmp_path, key, pages=f"SELECT * REPLACE ({CUT_TEXTS} AS html) FROM '{{path}}'")
    assert got == want
