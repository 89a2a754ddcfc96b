"""Cases that are easily answered wrong without a sign of it."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.expr import features
from tidepanel.operators import clean, joins, model, portfolio, process
from tidepanel.sources.panel import align_calendar, build_calendar, scan_panel, write_panel

DAY = dt.date(2020, 1, 1)


def bars(spark, closes, **more):
    rows = [("a", DAY + dt.timedelta(k), c, c, c, c, 1.0) for k, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "instrument string, datetime date, open double, high double, low double, close double, volume double")
    for name, values in more.items():
        extra = spark.createDataFrame([(DAY + dt.timedelta(k), v) for k, v in enumerate(values)], f"datetime date, {name} double")
        df = df.join(extra, "datetime")
    return df


def column(df, name):
    return [r[name] for r in df.orderBy("datetime").collect()]


def test_unit_jumps_are_repaired_to_the_end(spark):
    assert column(clean.fix_unit_jump(bars(spark, [100.0**k for k in range(14)])), "close") == [pytest.approx(1.0)] * 14
    assert column(clean.fix_unit_jump(bars(spark, [1.0, None, 100.0, 1e4, 50.0])), "close") == [1.0, None, 1.0, 1.0, 50.0]


def test_total_loss_and_missing_return(spark):
    d = clean.total_return_adjust(bars(spark, [10.0, 11.0, 22.0, 22.0, 30.0], ret=[None, 0.1, None, -1.0, 0.1]))
    assert column(d, "adj_close") == [pytest.approx(x) for x in (10.0, 11.0, 22.0, 0.0, 0.0)]


def test_capped_weights_keep_their_sum(spark):
    d = spark.createDataFrame([(DAY, "a", 0.6), (DAY, "b", 0.4)], "date date, instrument string, weight double")
    assert sorted(r.weight for r in portfolio.cap_weights(d, 0.3).collect()) == [0.5, 0.5]


def test_next_date_of_early_and_late_events(spark):
    cal = spark.createDataFrame([(DAY + dt.timedelta(10 + 3 * k), k) for k in range(3)], "datetime date, cal_ix long")
    ev = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(9),), (DAY + dt.timedelta(10),), (DAY + dt.timedelta(16),), (DAY + dt.timedelta(400),)], "date date")
    got = {r.date: r.visible_date for r in joins.next_date_join(ev, cal).collect()}
    first, second = DAY + dt.timedelta(10), DAY + dt.timedelta(13)
    assert list(got[d] for d in sorted(got)) == [first, first, second, None, None]


def test_filled_samples_are_not_cut(spark):
    n = 10_100
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.struct(x.cast("double").alias("v"))).alias("sample"))
    assert df.select(F.size(process._fill_block("sample", ["v"])).alias("n")).first().n == n


def test_outliers_and_infinity_stay_in_their_windows(spark):
    values = [100.0 + (k % 5) / 10 for k in range(60)]
    values[3], values[40] = 1e7, float("inf")
    panel = align_calendar(bars(spark, values), build_calendar(bars(spark, values)))
    got = column(features(panel, {"s": "Std($close,5)", "b": "Slope($close,5)", "m": "Sum($close,5)"}), "s")
    clean_window = [v for v in values[20:25]]
    mean = sum(clean_window) / 5
    assert got[24] == pytest.approx((sum((v - mean) ** 2 for v in clean_window) / 4) ** 0.5, rel=1e-12)
    assert all(v is None or v == v for v in got) and got[59] == pytest.approx(got[24], rel=1e-9)


def test_a_full_write_replaces_the_store(spark, tmp_path):
    a = bars(spark, [1.0, 2.0])
    old = a.withColumn("datetime", F.date_sub("datetime", 300))
    write_panel(a.unionByName(old), str(tmp_path))
    write_panel(a, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/values").count() == 2


def test_a_range_scan_prunes_years(spark, tmp_path):
    a = bars(spark, [1.0, 2.0, 3.0])
    write_panel(a.unionByName(a.withColumn("datetime", F.date_sub("datetime", 400))), str(tmp_path))
    d = scan_panel(spark, f"{tmp_path}/values", ["close"], start=DAY, end=DAY + dt.timedelta(1))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and column(d, "close") == [1.0, 2.0] and d.columns == ["instrument", "datetime", "close"]


def test_linear_fits_are_the_plain_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2)) * [1.0, 30.0]
    y = x @ [2.0, 0.1] + rng.normal(size=80) + 5
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, label double")
    for ridge in (0.0, 40.0):
        want = np.linalg.solve(x.T @ x + ridge * np.eye(2), x.T @ y)
        assert list(model.linear_fit(df, ["a", "b"], ridge=ridge).coefficients) == pytest.approx(list(want), rel=1e-6)
    m = model.linear_fit(df, ["a", "b"], lasso=0.3)
    grad = x.T @ (y - x @ m.coefficients) / 80
    assert m.intercept == 0 and all(abs(g - 0.3 * np.sign(c)) < 1e-3 if c else abs(g) <= 0.3 + 1e-3 for g, c in zip(grad, m.coefficients))
