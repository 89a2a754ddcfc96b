"""Covariances of many names: vectors are written once, and blocks of them are crossed."""

import math
import random

import pytest

from tidepanel.operators import portfolio as Q


@pytest.fixture(scope="module")
def returns(spark):
    rng = random.Random(11)
    rows = [(t, t, f"i{k}", None if rng.random() < 0.1 else math.nan if rng.random() < 0.02 else rng.gauss(0, 1 + k)) for t in range(30) for k in range(23)]
    rows += [(t, t, None, rng.gauss(0, 1)) for t in range(30)]
    return spark.createDataFrame(rows, "date int, ix int, instrument string, ret double").cache()


def rows(df):
    return {(r.i, r.j): r[2:] for r in df.collect()}


def same(a, b):
    return a.keys() == b.keys() and all(x == pytest.approx(y, rel=1e-9, abs=1e-12, nan_ok=True) for k in a for x, y in zip(a[k], b[k]))


def test_vectors_are_not_copied(spark, returns):
    plan = Q.covariance(returns, 90_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "collect_list" not in plan


def test_crossed_blocks_give_the_same_pairs(spark, returns, monkeypatch):
    whole = returns.where("instrument IS NOT NULL AND NOT isnan(ret)")
    make = [
        lambda: Q.covariance(returns, 24, block=4),
        lambda: Q.covariance(returns, 24, block=4, centre=False, variances=True),
        lambda: Q.shrink_returns(whole, 23, "single_factor", "lw", block=4),
        lambda: Q.shrink_returns(whole, 23, "const_corr", "oas", block=4),
    ]
    want, level = [rows(m()) for m in make], Q.mean_correlation(whole, 23, block=4).first().level
    monkeypatch.setattr(Q, "CROSSED", 3)
    monkeypatch.setattr(Q, "BLOCK_NAMES", 5)
    monkeypatch.setattr(Q, "LEAST_BLOCKS", 3)
    assert len(want[0]) == 24**2
    assert all(same(a, rows(m())) for a, m in zip(want, make))
    assert Q.mean_correlation(whole, 23, block=4).first().level == pytest.approx(level, rel=1e-9)


def test_components_of_few_dates_end_after_a_step_or_two(spark, returns, monkeypatch):
    """Returns without any structure, whose leading directions hardly differ: from any other start they take a step for every few dates."""
    x = returns.where("ret IS NOT NULL AND NOT isnan(ret) AND instrument IS NOT NULL").selectExpr("date", "instrument", "ret AS x")
    steps, plain = [], Q._times
    monkeypatch.setattr(Q, "_times", lambda *a: steps.append(1) or plain(*a))
    loads, top = Q.principal_components(x, 2, extra=0)
    assert len(steps) <= 4
    monkeypatch.setattr(Q, "GRAM_DATES", 3)
    steps.clear()
    want, best = Q.principal_components(x, 2, extra=0)
    assert len(steps) > 4 and top == pytest.approx(best, rel=1e-9)
    a, b = ({r.instrument: r.f for r in d.collect()} for d in (loads, want))
    assert a.keys() == b.keys()
    for i in a:
        for j in a:
            assert sum(p * q for p, q in zip(a[i], a[j])) == pytest.approx(sum(p * q for p, q in zip(b[i], b[j])), abs=1e-6)
