"""The user aggregate makes states per batch, not a Python call per group."""

import pytest
import small_tables
from pyspark.sql import functions as F

from tidepanel.plans import catalog
from tidepanel.plans import fixtures as T


def test_no_python_call_per_group(spark, tmp_path):
    path = small_tables.write(spark, tmp_path)
    out = catalog.QUERIES["udaf_resample"](spark, path)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "AggregateInPandas" not in plan and "ArrowAggregatePython" not in plan
    want = T.bars(spark, path).groupBy("instrument", F.date_format(F.trunc("datetime", "month"), "yyyy-MM-dd").alias("m")).agg((F.max("close") - F.min("close")).alias("v"))
    want = {(r.instrument, r.m): r.v for r in want.collect()}
    assert {(r.instrument, r.month): r.value for r in out.collect()} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
