"""A sample of registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidepanel.plans.catalog import QUERIES, STATEMENTS

SF = "/root/testdata/sf0.001"
SAMPLE = ["flagship_ic", "align_calendar", "roll_std", "ema", "cs_rank_norm_unbounded", "asof_join", "pit_collapse", "brinson", "stream_tresample", "fix_unit_jump", "next_date_join", "calendar_align", "total_return_adjust", "write_panel", "hash_by_instrument", "scan_csv_parquet", "leakage_audit"]


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, map(tuple, df.select(*cols).collect())))
    rel = duck.execute(STATEMENTS[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)
    assert len(QUERIES) > 300


#: Queries without a statement, and why.
NO_STATEMENT = {
    "gbt_fit": "an iterative fit",
    "pca_cov": "an eigenvalue problem",
}


def test_every_query_has_a_statement_or_a_reason():
    assert set(QUERIES) - set(STATEMENTS) == set(NO_STATEMENT)
