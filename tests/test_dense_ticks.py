"""Shares of a code over time windows: equal to brute force, and no window is read again for each of its rows."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators.intraday import intensity


def test_intensity_keeps_running_counts(spark):
    start = dt.datetime(2024, 1, 1, 9)
    rows = [(str(i % 2), start + dt.timedelta(seconds=37 * (i // 3)), [None, "click", "view", "click", "buy"][i * 7 % 5]) for i in range(900)]
    ticks = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, code string")
    df = intensity(ticks, "click", 600, 3600)
    assert "RangeFrame, -" not in df._jdf.queryExecution().optimizedPlan().toString()
    p = pd.DataFrame(rows, columns=["instrument", "ts", "code"])

    def share(r, s):
        w = p[(p.instrument == r.instrument) & (p.ts <= r.ts) & (p.ts >= r.ts - dt.timedelta(seconds=s))]
        return (w.code == "click").sum() / len(w) if w.code.notna().any() else None

    p["short"], p["long"] = ([share(r, s) for r in p.itertuples()] for s in (600, 3600))
    p["more"] = [None if pd.isna(a) else float(a > b) for a, b in zip(p.short, p.long)]
    want = p.groupby(["instrument", p.ts.dt.floor("h")]).agg(a=("short", "mean"), b=("more", "mean"))
    got = {(r.instrument, r.bin): (r.intensity, r.relative_intensity) for r in df.withColumn("bin", F.col("bin").cast("timestamp_ntz")).collect()}
    assert got == {k: pytest.approx((v.a, v.b)) for k, v in want.iterrows()}
