"""Point-in-time values on a small revision history."""

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.operators import pit as B

D = dt.date


def records(spark):
    rows = [
        ("a", "roe", D(2020, 4, 10), 202001, 1.0, 1),
        ("a", "roe", D(2020, 7, 10), 202002, 2.0, 2),
        ("a", "roe", D(2020, 8, 1), 202001, 1.5, 3),
        ("a", "roe", D(2020, 12, 1), 202004, 4.0, 4),
    ]
    return spark.createDataFrame(rows, "instrument string, field string, date date, period int, value double, seq long")


def days(spark):
    ds = [D(2020, 4, 9), D(2020, 4, 10), D(2020, 7, 9), D(2020, 7, 10), D(2020, 8, 2), D(2020, 12, 2)]
    return spark.createDataFrame([("a", d) for d in ds], "instrument string, datetime date")


def values(df):
    return [r.value for r in df.orderBy("datetime").collect()]


def test_newest_visible_period(spark):
    c = B.collapse(records(spark), 1, lambda a: F.element_at(a, -1))
    assert values(B.on_calendar(c, days(spark))) == [None, 1.0, 1.0, 2.0, 2.0, 4.0]


def test_sum_over_periods_follows_revisions_and_gaps(spark):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    c = B.collapse(records(spark), 2, total)
    # the third quarter is missing, so the last value pairs the fourth with nothing
    assert values(B.on_calendar(c, days(spark))) == [None, 1.0, 1.0, 3.0, 3.5, 4.0]


def test_fixed_period(spark):
    assert values(B.on_calendar(B.fixed_period(records(spark), 202001), days(spark))) == [None, 1.0, 1.0, 1.0, 1.5, 1.5]


def test_dense_periods(spark):
    assert [r.period for r in B.dense_periods(records(spark)).orderBy("period").collect()] == [202001, 202002, 202003, 202004]
