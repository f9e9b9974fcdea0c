"""Registered queries: every oracle has a query, and a sample agrees with DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["totals_check", "verify_readback", "merge_dups", "wide_summary", "append_new", "photo_lines", "align_exact", "interp_fill", "table_diff", "html_tables"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_duckdb(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in rel.description]
    want = sorted(str(r) for r in rel.fetchall())
    got = sorted(str(tuple(r)) for r in df.select(*[f"`{c}`" for c in order]).collect())
    assert got == want
