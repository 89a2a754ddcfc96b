"""Trailing drawdown against brute force, without a list per row."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window

from tidepanel.operators.factors import symbol_risk, trailing_drawdown


@pytest.mark.parametrize("rows", [1, 7, 60])
def test_drawdown_of_blocks(spark, rows):
    v = np.exp(np.random.default_rng(5).normal(0, 0.1, (2, 150)).cumsum(axis=1))
    df = spark.createDataFrame([(k, i, float(v[k, i])) for k in range(2) for i in range(150)], "k int, i int, v double")
    out = trailing_drawdown(df, Window.partitionBy("k").orderBy("i"), "v", rows, "d")
    assert out.columns == ["k", "i", "v", "d"]
    for r in out.collect():
        w = v[r.k, max(0, r.i - rows + 1) : r.i + 1]
        assert r.d == pytest.approx((w / np.maximum.accumulate(w) - 1).min())


def test_symbol_risk_makes_no_lists(spark):
    day = dt.date(2024, 1, 1)
    bars = spark.createDataFrame([("a", day, 1.0)], "instrument string, datetime date, close double")
    bench = spark.createDataFrame([(day, 0.1)], "datetime date, bench double")
    assert "collect_list" not in symbol_risk(bars, bench)._jdf.queryExecution().optimizedPlan().toString()
