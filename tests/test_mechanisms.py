"""Order statistics of growing windows, structured covariance, rolling fits and permutations against plain versions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.functions import growing
from tidepanel.operators import model as M
from tidepanel.operators import portfolio as Q


def series(spark, names, length, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(names):
        x = np.round(rng.standard_normal(length), 1 if i % 2 else 9)  # every other one has many ties
        rows += [(f"n{i}", t, None if rng.random() < 0.1 else float(v)) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "instrument string, cal_ix int, close double").withColumn("datetime", F.date_add(F.lit("2000-01-01"), F.col("cal_ix")))
    return rows, df


EXPRS = {"q": "Quantile($close,0,0.8)", "m": "Med($close,0)", "r": "Rank($close,0)", "d": "Mad($close,0)"}


@pytest.mark.parametrize("fan", [5, 32])
def test_growing_windows_against_the_history(spark, monkeypatch, fan):
    monkeypatch.setattr(growing, "FAN", fan)
    rows, df = series(spark, 3, 100, fan)
    got = {(r.instrument, r.cal_ix): r for r in X.features(df, EXPRS).collect()}
    assert len(got) == len(rows)
    history = {}
    for name, t, v in rows:
        h = history.setdefault(name, [])
        if v is not None:
            h.append(v)
        r, a = got[name, t], np.array(h)
        if not h:
            assert r.q is None and r.m is None and r.r is None and r.d is None
            continue
        want = [np.quantile(a, 0.8), np.median(a), np.abs(a - a.mean()).mean()]
        assert np.allclose([r.q, r.m, r.d], want, rtol=0, atol=1e-9)
        rank = None if v is None else ((a < v).sum() + ((a == v).sum() + 1) / 2) / len(a)
        assert (r.r is None) == (rank is None) and (rank is None or abs(r.r - rank) < 1e-12)


def test_growing_windows_grow_with_the_rows(spark):
    seconds = []
    for length in (700, 700, 2800):
        _, df = series(spark, 2, length, 1)
        df = df.repartition(4, "instrument").cache()
        df.count()
        start = time.time()
        out = X.features(df, EXPRS)
        assert "collect_list" not in out._jdf.queryExecution().toString()
        out.agg(*[F.sum(c) for c in EXPRS]).collect()
        seconds.append(time.time() - start)
    # four times the rows; a history per row would make it sixteen times the work
    assert seconds[2] < 8 * seconds[1]


def test_components_of_returns(spark):
    rng = np.random.default_rng(3)
    for names, dates, factors in ((40, 90, 4), (30, 12, 5), (3, 50, 5), (1, 20, 2)):
        hidden = rng.standard_normal((dates, 3)) @ rng.standard_normal((3, names)) + 0.3 * rng.standard_normal((dates, names))
        seen = rng.random((dates, names)) < 0.9
        rows = [(d, f"n{i:03}", float(hidden[d, i]) if seen[d, i] else None) for d in range(dates) for i in range(names)]
        df = spark.createDataFrame(rows, "date int, instrument string, ret double")
        x = np.where(seen, hidden, np.nan)
        x = np.nan_to_num(x - np.nanmean(x, axis=0))
        f = np.linalg.svd(x, full_matrices=False)[2][:factors].T
        b = x @ f
        want = f @ np.atleast_2d(np.cov(b.T)) @ f.T + np.diag((x - b @ f.T).var(axis=0))
        got = np.zeros_like(want)
        for r in Q.pca_covariance(df, factors).collect():
            got[int(r.i[1:]), int(r.j[1:])] = r.cov
        assert np.allclose(got, want, atol=1e-8)
        loads, _ = Q.principal_components(df.join(df.groupBy("instrument").agg(F.avg("ret").alias("m")), "instrument").selectExpr("date", "instrument", "ret - m AS x").where("x IS NOT NULL"), factors)
        v = np.array([r.f for r in loads.orderBy("instrument").collect()])
        assert np.allclose(v @ v.T, f @ f.T, atol=1e-6)


def test_rolling_fits_of_one_job(spark):
    rng = np.random.default_rng(5)
    rows = [(f"2001-{1 + d // 28:02}-{1 + d % 28:02}", f"n{i}", *map(float, rng.standard_normal(2)), float(rng.standard_normal())) for d in range(120) for i in range(5) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "datetime string, instrument string, a double, b double, label double").withColumn("datetime", F.to_date("datetime"))
    calendar = df.select("datetime").distinct().toPandas()["datetime"].sort_values().to_list()
    cal = spark.createDataFrame(list(enumerate(calendar)), "cal_ix int, datetime date")
    tasks = M.rolling_tasks(cal, 50, 20, train=40, gap=3)
    data = df.toPandas()
    for ridge in (0.0, 2.0):
        got = M.walk_forward(df, tasks, ["a", "b"], ridge=ridge).toPandas().sort_values(["task", "datetime", "instrument"])
        want = []
        spans = {(r.task, r.segment): (r.start, r.end) for r in tasks.collect()}
        for task in sorted({t for t, _ in spans}):
            cut = lambda s: data[(data["datetime"] >= spans[task, s][0]) & (data["datetime"] <= spans[task, s][1])]  # noqa: B023, E731
            x, y = cut("train")[["a", "b"]].to_numpy(), cut("train")["label"].to_numpy()
            beta = np.linalg.solve(x.T @ x + ridge * np.eye(2), x.T @ y)
            want += [(task, r.datetime, r.instrument, r.a * beta[0] + r.b * beta[1]) for r in cut("test").itertuples()]
        want.sort(key=lambda r: r[:3])
        assert [(r.task, r.datetime, r.instrument) for r in got.itertuples()] == [w[:3] for w in want]
        assert np.allclose(got["score"], [w[3] for w in want])


def test_random_order_holds_every_place_once(spark):
    df = spark.range(5000).selectExpr("CAST(id AS STRING) AS k")
    for rows in (5000, 100_000 * 16 + 1):  # with and without parts
        a = {r.k: r.at for r in M.random_index(df, ["k"], 1, rows, "at").collect()}
        b = {r.k: r.at for r in M.random_index(df.repartition(7), ["k"], 1, rows, "at").collect()}
        c = {r.k: r.at for r in M.random_index(df, ["k"], 2, rows, "at").collect()}
        assert a == b and sorted(a.values()) == sorted(c.values()) == list(range(5000))
        assert sum(a[k] == c[k] for k in a) < 20


def test_importance_of_a_used_and_an_unused_column(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 3))
    rows = [(i, *map(float, v), float(2 * v[0] + 0.5 * v[1] + 0.1 * rng.standard_normal())) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, label double")
    model = M.linear_fit(df, ["a", "b", "c"])
    got = {r.feature: r for r in M.permutation_importance(model, df, ["a", "b", "c"], key=("k",)).collect()}
    assert got["a"].bin == 4 and got["c"].bin == 0 and abs(got["c"].importance) < 0.1
    # the squared error changes by c^2 (p - x)^2 + 2 c e (p - x): with independent normal values mean 2 c^2, deviation about 8^0.5 c^2
    assert abs(got["a"].importance - 2 / 8**0.5) < 0.1
    assert got["a"].chosen
