"""Queries over their whole tables, against statements of the whole job that are written here once more."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import joins, portfolio
from tidepanel.plans import fixtures as T
from tidepanel.plans.catalog import QUERIES, STATEMENTS
from tidepanel.plans.q_resample import _R
from tidepanel.plans.registry import duck_output

SF = "/root/testdata/sf0.001"


def answer(sql):
    duck = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return sorted(duck.execute(sql).fetchall())


def test_minutes_are_filled_for_every_instrument_without_any(spark, tmp_path):
    spark.sql("SELECT CAST(id AS INT) AS user_id, TIMESTAMP'2024-01-01 12:00:00' AS ts, 1.0D AS value, id AS event_id, 'click' AS event_type, '' AS props FROM range(5, 40)").write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["fill_minutes"](spark, str(tmp_path)).collect()
    assert {r.instrument for r in rows} == {str(k) for k in range(10, 40)}
    assert len(rows) == 30 * 4 and rows[0].datetime.startswith("2024-01-01 09:")
    got = sorted(map(tuple, QUERIES["fill_minutes"](spark, SF).select("instrument", "datetime").collect()))
    whole = f"""WITH {T.TICKS}, d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS day FROM events)
        SELECT instrument, strftime(day + CAST(to_minutes(540 + 15 * k) AS INTERVAL), '%Y-%m-%d %H:%M:%S.%f') FROM d, range(4) r(k) WHERE instrument NOT IN (SELECT instrument FROM ticks)"""
    assert got == answer(whole)


def test_a_slice_holds_every_instrument(spark):
    got = sorted(map(tuple, QUERIES["quote_slice"](spark, SF).collect()))
    whole = f'WITH {T.PANEL} SELECT instrument, sum(volume) AS sum, avg(close) AS mean, bool_and(coalesce(volume, 0) > 5) AS "all" FROM panel WHERE {_R} GROUP BY 1'
    assert len(got) == 10 and got == answer(duck_output(whole, "instrument:s sum:f mean:f all:b"))


def test_every_instrument_goes_wide_and_back(spark):
    got = sorted(map(tuple, QUERIES["pivot_unpivot"](spark, SF).select("instrument", "datetime", "close").collect()))
    whole = f"WITH {T.BARS} SELECT instrument, datetime, close FROM bars"
    assert len({r[0] for r in got}) == 10 and got == answer(duck_output(whole, "instrument:s datetime:d close:f"))


def test_blocks_have_a_fixed_width_whatever_the_bucket(spark):
    df = spark.range(50).select(F.concat(F.lit("i"), "id").alias("instrument"), F.lit("2024-01-01").cast("date").alias("datetime"), F.col("id").cast("double").alias("close"))
    # one bucket for all, so one block is not enough
    places = joins.column_blocks(df, 1, width=8)
    wide = joins.pivot_blocks(df, places, "close", width=8)
    assert wide.count() == 7 and len(wide.columns) == 3 + 8
    assert sorted(joins.unpivot_blocks(wide, places, "close", width=8).collect()) == sorted(df.collect())


def test_weight_schemes_by_risk(spark):
    rows = QUERIES["weight_schemes"](spark, SF).select("date", "instrument", "scheme", "weight").collect()
    assert {r.scheme for r in rows} == {"equal", "score", "inverse_vol", "beta", "beta_neutral"}
    # the statement covers all five schemes
    assert sorted(tuple(r) for r in rows) == answer(STATEMENTS["weight_schemes"])
    d = spark.createDataFrame([(0.02, 2.0, 1.0), (0.1, 0.1, 2.0), (None, None, 3.0)], "vol double, beta double, score double").withColumn("date", F.lit(1))
    got = d.select(*[v.alias(k) for k, v in portfolio.scheme_values(d).items()]).collect()
    want = {"inverse_vol": [2.0, 10.0, 20.0], "beta": [0.5, 1.0, 1 / 0.3], "beta_neutral": [0.25, 1.0, 1 / 0.09]}
    for name, values in want.items():
        assert sorted(r[name] for r in got) == pytest.approx(values)


def test_trailing_risk(spark):
    price = np.exp(np.cumsum(np.random.default_rng(4).normal(0, 0.05, (3, 30)), axis=1))
    d = spark.createDataFrame([(t, f"i{k}", float(price[k, t])) for k in range(3) for t in range(30)], "date int, instrument string, price double")
    got = {(r.instrument, r.date): r for r in portfolio.trailing_risk(d).collect()}
    m = price[:, 1:] / price[:, :-1] - 1
    k = m.mean(axis=0)
    for i in range(3):
        assert got[f"i{i}", 29].vol == pytest.approx(m[i, -12:].std(ddof=1) * 52**0.5)
        assert got[f"i{i}", 29].beta == pytest.approx(np.cov(m[i, -24:], k[-24:])[0, 1] / k[-24:].var(ddof=1))


def dense_shrunk(x, target, alpha):
    """The estimators written with matrices."""
    t, p = x.shape
    s = x.T @ x / t
    v, k = np.diag(s), x.mean(axis=1)
    sd, c, vk = np.sqrt(v), x.T @ k / t, k @ k / t
    r = (np.sum(s / np.outer(sd, sd)) - p) / (p * (p - 1))
    f = {"const_var": np.eye(p) * v.mean(), "const_corr": r * np.outer(sd, sd), "single_factor": np.outer(c, c) / vk}[target]
    if target != "const_var":
        np.fill_diagonal(f, v)
    y, z = x**2, x * k[:, None]
    phi = y.T @ y / t - s**2
    rho = 0.0
    if target == "const_corr":
        theta = (x**3).T @ x / t - v[:, None] * s
        np.fill_diagonal(theta, 0)
        rho = np.trace(phi) + r * np.sum(np.outer(1 / sd, sd) * theta)
    if target == "single_factor":
        v1, v3 = (y.T @ z / t - c[:, None] * s) * c[None, :], (z.T @ z / t - vk * s) * np.outer(c, c)
        rho = np.trace(phi) + 2 * (v1.sum() - np.trace(v1)) / vk - (v3.sum() - np.trace(v3)) / vk**2
    if alpha == "lw":
        alpha = max(0, min(1, (phi.sum() - rho) / np.sum((s - f) ** 2) / t))
    elif alpha == "oas":
        s2, tr2 = np.sum(s**2), np.trace(s) ** 2
        alpha = (1 - 2 / p) * (s2 + tr2) / ((t + 1 - 2 / p) * (s2 + tr2 / p))
    return (1 - alpha) * s + alpha * f, alpha


@pytest.mark.parametrize("target", ["const_var", "const_corr", "single_factor"])
def test_shrinkage_intensities(spark, target):
    rng = np.random.default_rng(5)
    raw = rng.normal(0, 1, (40, 6)) * np.arange(1, 7) + rng.normal(0, 1, (40, 1)) * np.linspace(0.5, 2, 6)
    raw[3, 2] = raw[7, 5] = np.nan
    rows = [(t, t, f"i{k}", None if np.isnan(raw[t, k]) else float(raw[t, k])) for t in range(40) for k in range(6)]
    df = spark.createDataFrame(rows, "date int, ix int, instrument string, ret double")
    x = np.nan_to_num(raw - np.nanmean(raw, axis=0))
    for alpha in ("lw", "oas", 0.3):
        want, share = dense_shrunk(x, target, alpha)
        got = portfolio.shrink_returns(df, 6, target, alpha, block=4).collect()
        assert len(got) == 36 and got[0].alpha == pytest.approx(share) and share > 0
        for e in got:
            assert e.cov == pytest.approx(want[int(e.i[1]), int(e.j[1])])


def test_a_date_may_hold_any_number_of_names(spark, monkeypatch):
    monkeypatch.setitem(T._bounds, SF, T.bounds(spark, SF)._replace(names=200_001))
    df = QUERIES["udtf_date"](spark, SF)
    assert "InPandas" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.select("instrument", "datetime", "value").collect())) == answer(STATEMENTS["udtf_date"])
