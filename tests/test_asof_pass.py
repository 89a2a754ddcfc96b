"""The carry of an as-of join is one aggregation of both sides."""

import datetime as dt

from tidepanel.operators.joins import asof_join


def test_carry_takes_one_aggregation(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    left = spark.createDataFrame([("a", day(i)) for i in range(0, 300, 7)] + [("b", day(3)), (None, day(5))], "instrument string, datetime date")
    right = spark.createDataFrame([("a", day(2), 1.0), ("a", day(200), None), ("b", day(9), 3.0)], "instrument string, datetime date, v double")
    out = asof_join(left, right, chunk_days=30)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    got = {(r.instrument, r.datetime): (r.matched_at, r.v) for r in out.collect()}
    want = {("a", day(i)): (None, None) if i < 2 else (day(2), 1.0) if i < 200 else (day(200), None) for i in range(0, 300, 7)}
    assert got == {**want, ("b", day(3)): (None, None), (None, day(5)): (None, None)}
