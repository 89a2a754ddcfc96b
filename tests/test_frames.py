"""Wide sets of moving windows from arrays against the window aggregates of Spark."""

import datetime as dt
import random

import pytest
import small_tables
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import factors as A
from tidepanel.plans import catalog


def _panel(spark, names=3, rows=90):
    rng = random.Random(11)
    gap = lambda v, share=0.1: None if rng.random() < share else v
    out = []
    for k in range(names):
        for i in range(rows if k else 4):
            # missing, equal and flat stretches, an infinite and a very large value
            close = 2.5 if 20 <= i < 45 else float("inf") if i == 50 else 1e9 if i == 60 else round(rng.uniform(1, 3), 1)
            volume = 0.0 if i % 13 == 5 else float(rng.randrange(1, 9))
            out.append((f"i{k}" if k < 2 else None, dt.date(2020, 1, 1) + dt.timedelta(days=i), i, gap(close + 1), gap(close - 0.5), gap(close), gap(volume)))
    return spark.createDataFrame(out, "instrument string, datetime date, cal_ix int, high double, low double, close double, volume double")


def _rows(df):
    return {(r.instrument, r.cal_ix): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("chunk_rows", [2048, 1])
def test_arrays_give_what_windows_give(spark, monkeypatch, chunk_rows):
    exprs = A.rolling_factors((1, 6)) | {"W": "WMA($close,5)", "C": "Count($close,4)", "S": "Std(Mean($close,3),4)", "R": "Ref(Rank($close,4),2)", "D": "Mean($close,3)-Mean(Ref(Std($close,3),1),2)"}
    panel = _panel(spark)
    made = X.features(panel, exprs, chunk_rows=chunk_rows)
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    got = _rows(made)
    monkeypatch.setattr(X, "WIDE", 10_000)
    want = _rows(X.features(panel, exprs, chunk_rows=chunk_rows))
    assert got.keys() == want.keys() and len(want) == 184
    for key, row in want.items():
        for name, v in row.items():
            g = got[key][name]
            assert (g is None) == (v is None) and (not isinstance(v, float) or g == pytest.approx(v, rel=1e-7, abs=1e-7)), (key, name, g, v)


def test_batches_carry_their_last_rows(spark):
    exprs = {f"m{n}": f"Sum($close,{n})+Quantile($close,{n},0.3)" for n in range(2, 12)}
    panel = spark.range(500).select(F.when(F.col("id") < 130, "a").otherwise("b").alias("instrument"), F.lit(None).cast("date").alias("datetime"), F.col("id").cast("int").alias("cal_ix"), (F.col("id") * 37 % 101).cast("double").alias("close"))
    want = _rows(X.features(panel, exprs))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")
        assert _rows(X.features(panel, exprs)) == want
    finally:
        spark.conf.set(size, old)


def test_wide_sets_read_no_frame_per_row(spark, tmp_path):
    path = small_tables.write(spark, tmp_path)
    for name in ("f158_rolling", "dataset_build"):
        plan = catalog.QUERIES[name](spark, path)._jdf.queryExecution().optimizedPlan().toString()
        assert all(f not in plan for f in ("collect_list", "regr_", "covar_samp", "var_samp", "avg(")), name
