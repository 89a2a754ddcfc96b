"""Cases that showed only on larger tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import growing as G
from tidepanel.operators import clean as C
from tidepanel.operators import intraday as I
from tidepanel.operators import portfolio as Q
from tidepanel.plans import catalog


def test_order_diff_reads_every_current_position(spark, tmp_path):
    rows = [(i, s, 150.0, flag) for i, (s, flag) in enumerate((s, f) for s in range(6) for f in "AR")] + [(90, 1, 250.0, "A"), (91, 4, 40.0, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.instrument, r.direction, r.amount) for r in catalog.QUERIES["order_diff"](spark, str(tmp_path)).collect()}
    # suppliers 1 and 4 have current amounts too; 40 is less than a whole unit
    assert got == {("0", "sell", 150.0), ("3", "sell", 150.0), ("1", "buy", 200.0)}


def test_change_against_a_close_of_zero(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h), c, c, c, c, 5.0) for h, c in enumerate((2.0, 0.0, None, 3.0, 0.0, 0.0, 4.0))]
    panel = spark.createDataFrame(rows, "instrument string, datetime timestamp_ntz, open double, high double, low double, close double, volume double")
    got = [r.change for r in C.norm_bars(panel).orderBy("datetime").collect()]
    # as the statement divides: x/0 is infinity and 0/0 is no number; a missing close repeats the last one
    assert got[0] is None and got[1] == -1.0 and math.isnan(got[2]) and got[3] == math.inf and got[4] == -1.0
    assert math.isnan(got[5]) and got[6] == math.inf


def test_book_change_against_a_price_of_zero(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 10, 0, 20 * k), k, [p], [p], [1.0], [1.0]) for k, p in enumerate((0.0, 1.0, 2.0))]
    quotes = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, event_id int, ask array<double>, bid array<double>, asize array<double>, bsize array<double>")
    got = I.order_book_levels(quotes, 1, rows_back=1, seconds_back=20, step=20).first()
    assert got.change_1_rows == math.inf and got.change_20_s == math.inf


@pytest.fixture(scope="module")
def returns(spark):
    rng = random.Random(7)
    rows = [(t, t, f"i{k}", None if rng.random() < 0.1 else rng.gauss(0, 1 + k)) for t in range(30) for k in range(9)]
    return spark.createDataFrame(rows, "date int, ix int, instrument string, ret double").cache()


def test_pairs_of_blocks_do_not_multiply_with_the_names(spark, returns):
    few, many = ({(r.i, r.j): (r.cov, r.n) for r in Q.covariance(returns, n, block=2).collect()} for n in (2, 90_000))
    assert few.keys() == many.keys() and len(few) == 81
    assert all(few[k][0] == pytest.approx(many[k][0], abs=1e-12) and few[k][1] == many[k][1] for k in few)
    # a vector is copied once for each block
    dealt = Q._block_pairs(Q._return_vectors(returns, "ret"), 90_000, 2).count()
    assert dealt.agg({"count": "sum"}).first()[0] == 9 * Q.MOST_BLOCKS


def test_shrunk_pairs_are_not_joined(spark, returns):
    cov, more = Q.covariance(returns, 9, block=2), Q.covariance(returns, 9, block=2, variances=True)
    levels = {"const_var": Q.mean_variance(returns), "const_corr": Q.mean_correlation(returns, 9, block=2)}
    made = [(Q.threshold(cov, 0.05), Q.threshold(more, 0.05))]
    made += [(Q.shrink(cov, 0.3, target), Q.shrink(more, 0.3, target, level)) for target, level in levels.items()]
    for plain, direct in made:
        want, got = ({(r.i, r.j): r.cov for r in d.collect()} for d in (plain, direct))
        assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
        assert "Join Inner, (" not in direct._jdf.queryExecution().optimizedPlan().toString()
    shrunk = Q.shrink_returns(returns, 9, "single_factor", "lw", block=2)
    assert "Join" not in shrunk._jdf.queryExecution().optimizedPlan().toString()


def test_growing_statistics_make_one_pass_of_an_instrument(spark):
    rows = [(f"i{k % 3}", k // 3, None if k % 7 == 0 else float(k * 37 % 11)) for k in range(90)]
    df = spark.createDataFrame(rows, "instrument string, cal_ix int, x double")
    for made in (G.quantile(df, "x", "o", 0.5), G.rank(df, "x", "o"), G.mean_distance(df, "x", "o")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        # no windows of running counts, and no join of questions with answers
        assert "Window" not in plan and "Join" not in plan and "Union" not in plan
        assert made.count() > 70


def test_component_steps_do_not_shuffle_the_returns(spark, returns):
    x = returns.where("ret IS NOT NULL").select("date", "instrument", F.col("ret").alias("x"))
    made = []
    plain, Q._times = Q._times, lambda *a: made.append(plain(*a)) or made[-1]
    try:
        Q.principal_components(x, 2)
    finally:
        Q._times = plain
    plans = [m._jdf.queryExecution().optimizedPlan().toString() for m in made]
    assert plans and all("broadcast" in p for p in plans)
