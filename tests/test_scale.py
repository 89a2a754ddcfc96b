"""Distributed ranks and quantiles against brute force, with a hot value and a hot group."""

import numpy as np
import pandas as pd
import pytest

from tidepanel.operators import portfolio as Q
from tidepanel.operators.scale import Bounds, exact_quantiles, xs_order
from tidepanel.operators.joins import asof_join
from tidepanel.operators.intraday import row_halo
from pyspark.sql import Window
from pyspark.sql import functions as F


def skewed(spark, n=6000):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(0, 1, n), 3)
    v[: n // 3] = 0.25  # a third of all rows holds one value
    d = np.where(rng.random(n) < 0.7, 1, rng.integers(2, 6, n))
    pdf = pd.DataFrame({"d": d, "instrument": [f"i{k}" for k in range(n)], "v": v})
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, sdf


@pytest.mark.parametrize("bounds", [Bounds(), Bounds(6, 6000)])
def test_ranks_with_hot_value(spark, bounds):
    pdf, sdf = skewed(spark)
    got = xs_order(sdf, ["d"], "v", "instrument", "r", bounds).toPandas().set_index("instrument").loc[pdf["instrument"]]
    g = pdf.groupby("d")["v"]
    np.testing.assert_allclose(got["r_avg"].to_numpy(dtype=float), g.rank().to_numpy())
    assert (got["r_n"].to_numpy() == g.transform("count").to_numpy()).all()
    for _, part in got[got["v"].notna()].groupby("d"):
        assert sorted(part["r_rn"]) == list(range(1, len(part) + 1))
        assert part.sort_values("r_rn")["v"].is_monotonic_increasing


def test_both_rank_paths_agree(spark):
    _, sdf = skewed(spark)
    a = xs_order(sdf, ["d"], "v", "instrument", "r", Bounds())
    b = xs_order(sdf, ["d"], "v", "instrument", "r", Bounds(6, 6000))
    cols = ["instrument", "r_n", "r_avg", "r_rn"]
    assert sorted(map(tuple, a.select(cols).collect()), key=str) == sorted(map(tuple, b.select(cols).collect()), key=str)


def test_exact_quantiles(spark):
    pdf, sdf = skewed(spark)
    got = exact_quantiles(sdf, ["d"], "v", {"a": 0.31, "b": 0.5, "c": 1.0}).toPandas().set_index("d").sort_index()
    for name, q in (("a", 0.31), ("b", 0.5), ("c", 1.0)):
        np.testing.assert_allclose(got[name], pdf.groupby("d")["v"].quantile(q))
    assert exact_quantiles(sdf, [], "v", {"m": 0.5}).first().m == pytest.approx(pdf["v"].median())


def test_row_halo_reaches_over_empty_chunks(spark):
    rng = np.random.default_rng(1)
    sec = np.sort(rng.choice(40_000, 150, replace=False))
    pdf = pd.DataFrame({"instrument": "a", "ts": pd.to_datetime(sec, unit="s"), "event_id": range(150), "x": rng.normal(size=150)})
    h = row_halo(spark.createDataFrame(pdf), "instrument", ["ts", "event_id"], 6, chunk_seconds=500)
    w = Window.partitionBy("instrument", "chunk").orderBy("ts").rowsBetween(-6, 0)
    got = h.withColumn("m", F.avg("x").over(w)).where("own").orderBy("ts").toPandas()["m"]
    np.testing.assert_allclose(got, pdf["x"].rolling(7, min_periods=1).mean())


def test_asof_chunks_equal_plain(spark):
    rng = np.random.default_rng(2)
    days = pd.date_range("2020-01-01", periods=400)
    left = spark.createDataFrame(pd.DataFrame({"instrument": "a", "datetime": [d.date() for d in days], "k": range(400)}))
    some = sorted(rng.choice(400, 25, replace=False))
    right = spark.createDataFrame(pd.DataFrame({"instrument": "a", "datetime": [days[i].date() for i in some], "v": [float(i) for i in some]}))
    a, b = asof_join(left, right), asof_join(left, right, chunk_days=30)
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_covariance_equals_pandas(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 12))
    x[rng.random(x.shape) < 0.1] = np.nan
    wide = pd.DataFrame(x, columns=[f"s{k}" for k in range(12)])
    rows = [(int(t), c, float(v)) for c in wide for t, v in wide[c].items() if not np.isnan(v)]
    df = spark.createDataFrame(rows, "ix int, instrument string, ret double")
    got = Q.covariance(df, 12, block=5).toPandas().pivot(index="i", columns="j", values="cov").loc[wide.columns, wide.columns]
    np.testing.assert_allclose(got.to_numpy(), wide.cov().to_numpy(), rtol=1e-9)


def test_weight_cap(spark):
    df = spark.createDataFrame([("d", "a", 0.7), ("d", "b", 0.2), ("d", "c", 0.1)], "date string, instrument string, weight double")
    w = {r.instrument: r.weight for r in Q.cap_weights(df, 0.5).collect()}
    assert w["a"] == pytest.approx(0.5) and sum(w.values()) == pytest.approx(1.0)


def test_capped_choice(spark):
    rows = [("d", f"n{k}", "s1" if k < 4 else "s2", f"i{k % 2}", 10.0 - k) for k in range(8)]
    df = spark.createDataFrame(rows, "date string, instrument string, sector string, industry string, score double")
    got = [r.instrument for r in Q.capped_topn(df, 4, {"sector": 2, "industry": 2}).orderBy(F.desc("score")).collect()]
    assert got == ["n0", "n1", "n4", "n5"]
