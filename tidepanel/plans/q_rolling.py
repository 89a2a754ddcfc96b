"""Rolling and expanding functions per instrument."""

from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import intraday as I
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query

_W = "PARTITION BY instrument ORDER BY datetime ROWS BETWEEN"
W10 = f"({_W} 9 PRECEDING AND CURRENT ROW)"
W0 = f"({_W} UNBOUNDED PRECEDING AND CURRENT ROW)"
P = "(PARTITION BY instrument ORDER BY datetime)"
_FLAT = "stddev_samp(close) OVER w > 2e-5"
_CV = "list(close) FILTER (WHERE close IS NOT NULL) OVER w"

# SQL with {w}: the same statement serves the finite and the expanding form
ROLL = {
    "roll_mean": ("Mean($close,{n})", "avg(close) OVER w"),
    "roll_sum": ("Sum($close,{n})", "sum(close) OVER w"),
    "roll_std": ("Std($close,{n})", "stddev_samp(close) OVER w"),
    "roll_var": ("Var($close/1000,{n})", "var_samp(close / 1000) OVER w"),
    "roll_skew": ("Skew($close,{n})", "CASE WHEN count(close) OVER w >= 3 THEN skewness(close) OVER w END"),
    "roll_kurt": ("Kurt($close,{n})", "CASE WHEN count(close) OVER w >= 4 THEN kurtosis(close) OVER w END"),
    "roll_max": ("Max($close,{n})", "max(close) OVER w"),
    "roll_min": ("Min($close,{n})", "min(close) OVER w"),
    "roll_quantile": ("Quantile($close,{n},0.8)", "quantile_cont(close, 0.8) OVER w"),
    "roll_median": ("Med($close,{n})", "quantile_cont(close, 0.5) OVER w"),
    "roll_count": ("Count($close,{n})", "CAST(count(close) OVER w AS DOUBLE)"),
    "roll_slope": ("Slope($close,{n})", "CASE WHEN count(close) OVER w > 1 THEN regr_slope(close, cal_ix) OVER w END"),
    "roll_rsquare": ("Rsquare($close,{n})", f"CASE WHEN {_FLAT} THEN regr_r2(close, cal_ix) OVER w END"),
    "roll_resi": (
        "Resi($close,{n})",
        "CASE WHEN count(close) OVER w > 1 THEN close - (regr_intercept(close, cal_ix) OVER w + regr_slope(close, cal_ix) OVER w * cal_ix) END",
    ),
    "roll_cov": ("Cov($close/1000,$volume,{n})", "covar_samp(close / 1000, volume) OVER w"),
    "roll_corr": (
        "Corr($close,$volume,{n})",
        """CASE WHEN NOT coalesce(stddev_samp(close) OVER w <= 2e-5 OR stddev_samp(volume) OVER w <= 2e-5, false)
        AND stddev_samp(close) OVER w > 0 AND stddev_samp(volume) OVER w > 0 THEN corr(close, volume) OVER w END""",
    ),
    "wma": (
        "WMA($close,{n})",
        """(sum(close * cal_ix) OVER w - (cal_ix - count(*) OVER w) * sum(close) OVER w)
        / (count(*) OVER w * (count(*) OVER w + 1) / 2) / nullif(count(close) OVER w, 0)""",
    ),
    "roll_mad": (
        "Mad($close,{n})",
        f"""CASE WHEN count(close) OVER w > 0 THEN list_sum(list_transform({_CV}, lambda v : abs(v - avg(close) OVER w))) / count(close) OVER w END""",
    ),
}
_RANKED = {
    "roll_rank": ("Rank($close,{n})", "CASE WHEN x IS NOT NULL THEN (len(list_filter(vs, lambda v : v < x)) + (len(list_filter(vs, lambda v : v = x)) + 1) / 2.0::DOUBLE) / len(list_filter(vs, lambda v : v IS NOT NULL)) END"),
    "idx_max": ("IdxMax($close,{n})", "CAST(coalesce(list_position(list_transform(vs, lambda v : v IS NULL), true), list_position(vs, list_max(vs))) AS DOUBLE)"),
    "idx_min": ("IdxMin($close,{n})", "CAST(coalesce(list_position(list_transform(vs, lambda v : v IS NULL), true), list_position(vs, list_min(vs))) AS DOUBLE)"),
}


def _rolling(name, text, sql, two_step):
    def statement(w):
        if two_step:
            return f"""WITH {T.PANEL}, held AS (SELECT instrument, datetime, close AS x, list(close) OVER w AS vs FROM panel WINDOW w AS {w})
            SELECT instrument, datetime, {sql} AS value FROM held"""
        if name == "roll_mad":
            return f"""WITH {T.PANEL}, held AS (SELECT instrument, datetime, {_CV} AS vs, avg(close) OVER w AS m FROM panel WINDOW w AS {w})
            SELECT instrument, datetime, list_sum(list_transform(vs, lambda v : abs(v - m))) / nullif(len(vs), 0) AS value FROM held"""
        return f"WITH {T.PANEL} SELECT instrument, datetime, {sql} AS value FROM panel WINDOW w AS {w}"

    @query(name, "instrument:s datetime:d value:f5", statement(W10))
    def run(spark, sf_dir):
        return X.features(T.panel(spark, sf_dir), {"value": text.format(n=10)})

    @query(f"{name}_expanding", "instrument:s datetime:d value:f5", statement(W0))
    def run_all(spark, sf_dir):
        return X.features(T.panel(spark, sf_dir), {"value": text.format(n=0)})


for _n, (_t, _s) in ROLL.items():
    _rolling(_n, _t, _s, False)
for _n, (_t, _s) in _RANKED.items():
    _rolling(_n, _t, _s, True)


@query(
    "ref",
    "instrument:s datetime:d back:f ahead:f first:f",
    f"""WITH {T.PANEL} SELECT instrument, datetime, lag(close, 3) OVER {P} AS back, lead(close, 2) OVER {P} AS ahead,
    first_value(close) OVER {W0} AS first FROM panel""",
)
def ref(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), {"back": "Ref($close,3)", "ahead": "Ref($close,-2)", "first": "Ref($close,0)"})


@query(
    "delta",
    "instrument:s datetime:d step:f total:f",
    f"""WITH {T.PANEL} SELECT instrument, datetime, close - lag(close, 3) OVER {P} AS step, close - first_value(close) OVER {W0} AS total FROM panel""",
)
def delta(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), {"step": "Delta($close,3)", "total": "Delta($close,0)"})


def _ema_sql(q):
    return f"""WITH {T.PANEL}
    SELECT a.instrument, a.datetime, sum(pow({q}::DOUBLE, a.cal_ix - b.cal_ix) * b.close) / sum(CASE WHEN b.close IS NOT NULL THEN pow({q}::DOUBLE, a.cal_ix - b.cal_ix) END) AS value
    FROM panel a JOIN panel b ON a.instrument = b.instrument AND b.cal_ix <= a.cal_ix GROUP BY 1, 2"""


@query("ema", "instrument:s datetime:d value:f5", _ema_sql(1 - 2 / 11))
def ema(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), {"value": "EMA($close,10)"})


@query("roll_ewm_alpha", "instrument:s datetime:d value:f5", _ema_sql(0.7))
def roll_ewm_alpha(spark, sf_dir):
    """A window below one is the weight of an exponential mean, whatever the function."""
    return X.features(T.panel(spark, sf_dir), {"value": "Mean($close,0.3)"})


@query(
    "ema_expanding",
    "instrument:s datetime:d value:f5",
    f"""WITH {T.PANEL}, placed AS (SELECT instrument, datetime, cal_ix, close, row_number() OVER {P} AS n FROM panel)
    SELECT a.instrument, a.datetime, coalesce(sum(pow(1 - 2.0::DOUBLE / (1 + a.n), a.n - b.n) * b.close), 0) / sum(pow(1 - 2.0::DOUBLE / (1 + a.n), a.n - b.n)) AS value
    FROM placed a JOIN placed b ON a.instrument = b.instrument AND b.n <= a.n GROUP BY 1, 2""",
)
def ema_expanding(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), {"value": "EMA($close,0)"})


@query(
    "nested_windows",
    "instrument:s datetime:d value:f",
    f"""WITH {T.PANEL}, a AS (SELECT instrument, datetime, close, lag(close) OVER {P} AS prev FROM panel),
    b AS (SELECT *, avg(CASE WHEN coalesce(close > prev, false) THEN 1.0::DOUBLE ELSE 0 END) OVER {W10} AS up FROM a)
    SELECT instrument, datetime, up - avg(up) OVER {W10} AS value FROM b""",
)
def nested_windows(spark, sf_dir):
    up = "Mean($close>Ref($close,1),10)"
    return X.features(T.panel(spark, sf_dir), {"value": f"{up}-Mean({up},10)"})


@query(
    "lookback_bounds",
    "instrument:s datetime:d value:f",
    f"""WITH {T.PANEL}, a AS (SELECT instrument, datetime, avg(close) OVER {W10} AS value FROM panel)
    SELECT * FROM a WHERE datetime BETWEEN DATE '1997-01-06' AND DATE '1999-12-27'""",
)
def lookback_bounds(spark, sf_dir):
    """A time range answered from the rows in [start - lookback, end] only; values equal the cut of the full query."""
    import datetime as dt

    start, end = dt.date(1997, 1, 6), dt.date(1999, 12, 27)
    back, ahead = X.lookback_bounds([X.term("Mean($close,10)")])
    cal = T.calendar(spark, sf_dir)
    lo, hi = cal.where(F.col("datetime").between(F.lit(start), F.lit(end))).agg(F.min("cal_ix"), F.max("cal_ix")).first()
    read = T.panel(spark, sf_dir).where(F.col("cal_ix").between(lo - back, hi + ahead))
    return X.features(read, {"value": "Mean($close,10)"}, start, end)


@query(
    "ffill",
    "instrument:s datetime:d value:f",
    f"WITH {T.PANEL} SELECT instrument, datetime, last_value(close IGNORE NULLS) OVER {W0} AS value FROM panel",
)
def ffill(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), {"value": "FFillNan($close)"})


@query(
    "bfill",
    "instrument:s datetime:d value:f",
    f"WITH {T.PANEL} SELECT instrument, datetime, first_value(close IGNORE NULLS) OVER ({_W} CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM panel",
)
def bfill(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), {"value": "BFillNan($close)"})


@query(
    "roll_generic",
    "event_id:i rows10:f n60:i size_ms:f",
    f"""WITH {T.TICKS} SELECT event_id,
    avg(price) OVER (PARTITION BY instrument ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rows10,
    count(*) OVER r AS n60, sum(size) OVER r AS size_ms FROM ticks
    WINDOW r AS (PARTITION BY instrument ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW)""",
)
def roll_generic(spark, sf_dir):
    """Row-count and time-offset windows on irregular rows, cut into time chunks so that a busy instrument spreads."""
    return I.tick_windows(T.ticks(spark, sf_dir), rows=10, seconds=3600)


@query(
    "day_cumsum",
    "event_id:i value:f",
    f"""WITH {T.TICKS} SELECT event_id, CASE WHEN CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '14:59:00' THEN
    sum(CASE WHEN CAST(ts AS TIME) BETWEEN TIME '09:30:00' AND TIME '14:59:00' THEN size ELSE 0 END)
     OVER (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) ELSE 0 END AS value FROM ticks""",
)
def day_cumsum(spark, sf_dir):
    return I.day_cumsum(T.ticks(spark, sf_dir), "size", "09:30:00", "14:59:00")


@query(
    "day_last",
    "event_id:i value:f",
    f"""WITH {T.TICKS} SELECT event_id, last_value(CASE WHEN code <> 'error' THEN price END IGNORE NULLS)
    OVER (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS value FROM ticks""",
)
def day_last(spark, sf_dir):
    df = T.ticks(spark, sf_dir).withColumn("px", F.expr("CASE WHEN code <> 'error' THEN price END"))
    return I.day_last(df, "px")
