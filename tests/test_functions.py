"""Null, infinity and tie rules on tiny frames; rolling functions against plain pandas on random panels."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import expr as X

INF = float("inf")


def panel(spark, values, **more):
    rows = []
    for name, xs in values.items():
        for i, x in enumerate(xs):
            rows.append((name, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), i, x, *[m[i] for m in more.values()]))
    cols = "instrument string, datetime timestamp, cal_ix int, x double" + "".join(f", {m} double" for m in more)
    return spark.createDataFrame(rows, cols)


def run(df, text, **kw):
    out = X.features(df, {"v": text}, **kw).orderBy("instrument", "cal_ix").collect()
    return [r.v for r in out]


def test_division_and_log_keep_infinity(spark):
    df = panel(spark, {"a": [1.0, -1.0, 0.0, None, 4.0]}, y=[0.0, 0.0, 0.0, 1.0, 2.0])
    assert run(df, "$x/$y") == [INF, -INF, None, None, 2.0]
    assert run(df, "Log($x)") == [0.0, None, -INF, None, pytest.approx(np.log(4))]
    assert run(df, "IsInf($x/$y)") == [True, True, False, False, False]


def test_comparisons_are_never_null(spark):
    df = panel(spark, {"a": [1.0, None]}, y=[1.0, 1.0])
    assert run(df, "$x>$y") == [False, False]
    assert run(df, "$x!=$y") == [False, True]
    assert run(df, "Greater($x,$y)") == [1.0, None]


def test_windows_leave_infinity_out(spark):
    df = panel(spark, {"a": [1.0, 2.0, 3.0]}, y=[1.0, 0.0, 1.0])
    assert run(df, "Mean($x/$y,3)") == [1.0, 1.0, 2.0]


def test_missing_row_takes_precedence_in_idx_max(spark):
    df = panel(spark, {"a": [1.0, 5.0, None, 2.0]})
    assert run(df, "IdxMax($x,3)") == [1.0, 2.0, 3.0, 2.0]


def test_flat_windows_have_no_correlation(spark):
    df = panel(spark, {"a": [7.1] * 5}, y=[1.0, 2.0, 3.0, 4.0, 5.0])
    assert run(df, "Corr($x,$y,5)") == [None] * 5
    assert run(df, "Rsquare($x,5)") == [None] * 5
    assert run(df, "Std($x,5)") == [None, 0.0, 0.0, 0.0, 0.0]


def test_text_and_functions_agree(spark):
    df = panel(spark, {"a": [1.0, 2.0, 4.0]})
    assert run(df, "Mean($x,2)/$x-1") == run(df, X.Mean(X.field("x"), 2) / X.field("x") - 1)
    with pytest.raises(ValueError):
        X.parse("__import__('os')")


def random_panel(spark, n=60):
    rng = np.random.default_rng(5)
    xs, ys = {}, []
    for name in ("a", "b", "c"):
        x = np.round(rng.normal(50, 10, n), 1)
        x[rng.random(n) < 0.2] = np.nan
        xs[name] = [None if np.isnan(v) else float(v) for v in x]
    y = rng.normal(5, 1, n)
    return panel(spark, xs, y=[float(v) for v in y]), xs, y


CASES = {
    "Mean($x,7)": lambda s: s.rolling(7, min_periods=1).mean(),
    "Std($x,7)": lambda s: s.rolling(7, min_periods=1).std(),
    "Skew($x,9)": lambda s: s.rolling(9, min_periods=1).skew(),
    "Kurt($x,9)": lambda s: s.rolling(9, min_periods=1).kurt(),
    "Quantile($x,7,0.3)": lambda s: s.rolling(7, min_periods=1).quantile(0.3),
    "Rank($x,7)": lambda s: s.rolling(7, min_periods=1).rank(pct=True),
    "Count($x,7)": lambda s: s.rolling(7, min_periods=0).count(),
    "Max($x,7)": lambda s: s.rolling(7, min_periods=1).max(),
    "EMA($x,5)": lambda s: s.ewm(span=5, min_periods=1).mean(),
    "EMA($x,0.4)": lambda s: s.ewm(alpha=0.4, min_periods=1).mean(),
    "Mad($x,7)": lambda s: s.rolling(7, min_periods=1).apply(lambda v: np.nanmean(np.abs(v - np.nanmean(v))), raw=True),
    "WMA($x,4)": lambda s: s.rolling(4, min_periods=1).apply(lambda v: np.nanmean(v * np.arange(1, len(v) + 1) / np.arange(1, len(v) + 1).sum()), raw=True),
}


@pytest.mark.parametrize("chunk_rows", [2048, 16])
def test_rolling_equals_pandas(spark, chunk_rows):
    """A chunk size of 16 forces windows across copied chunk edges."""
    df, xs, y = random_panel(spark)
    finite = [c for c in CASES if not c.startswith("EMA")]
    groups = [finite, [c for c in CASES if c.startswith("EMA")]]
    for names in groups:
        got = X.features(df, {f"v{i}": c for i, c in enumerate(names)}, chunk_rows=chunk_rows).toPandas().sort_values(["instrument", "cal_ix"])
        for i, c in enumerate(names):
            want = pd.concat([CASES[c](pd.Series(v, dtype=float)) for v in xs.values()])
            np.testing.assert_allclose(got[f"v{i}"].to_numpy(dtype=float), want.to_numpy(dtype=float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_time_range_sees_the_rows_before_it(spark):
    df, _, _ = random_panel(spark)
    start = dt.datetime(2020, 1, 20)
    full = X.features(df, {"v": "Mean(Ref($x,2),5)"}).where(F.col("datetime") >= F.lit(start))
    cut = X.features(df, {"v": "Mean(Ref($x,2),5)"}, start=start)
    assert sorted(full.collect()) == sorted(cut.collect())
