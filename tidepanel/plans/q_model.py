"""Model tables, sorts and set operations, user functions."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tidepanel.operators import evaluate as E
from tidepanel.operators import joins as J
from tidepanel.operators import model as M
from tidepanel.operators.scale import Bounds, bounded, xs_top
from tidepanel.plans import fixtures as T
from tidepanel.plans.q_evaluate import FULL, corr, ic_sql
from tidepanel.plans.q_universe import SEGMENT, segment_table
from tidepanel.plans.registry import query
from tidepanel.operators.universe import tag_segments
from tidepanel.session import stored
from tidepanel.sources import panel as P

KEY = "instrument:s datetime:d "
FEATURES = ["score", "f_std", "f_vol"]
CUT = dt.date(1999, 1, 1)


def _rows(spark, sf_dir):
    return T.pred(spark, sf_dir).where("score IS NOT NULL AND f_std IS NOT NULL AND f_vol IS NOT NULL AND label IS NOT NULL")


# the rows that fits take, and the normal equations of three features by Cramer's rule: coefficients from a table ``s`` of sums
USE = f"{T.PRED}, use_rows AS (SELECT *, score AS x1, f_std AS x2, f_vol AS x3 FROM pred WHERE score IS NOT NULL AND f_std IS NOT NULL AND f_vol IS NOT NULL AND label IS NOT NULL)"
SUMS = "sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x1 * x3) AS c, sum(x2 * x2) AS d, sum(x2 * x3) AS e, sum(x3 * x3) AS f, sum(x1 * label) AS u, sum(x2 * label) AS v, sum(x3 * label) AS w"
SOLVED = """(u * (d * f - e * e) - b * (v * f - e * w) + c * (v * e - d * w)) / det AS b1, (a * (v * f - e * w) - u * (b * f - c * e) + c * (b * w - c * v)) / det AS b2,
 (a * (d * w - e * v) - b * (b * w - c * v) + u * (b * e - c * d)) / det AS b3"""
DET = "a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det"


@query(
    "linear_fit",
    KEY + "pred:f4",
    f"""WITH {USE}, s AS (SELECT a + 0.1::DOUBLE AS a, b, c, d + 0.1::DOUBLE AS d, e, f + 0.1::DOUBLE AS f, u, v, w FROM (SELECT {SUMS} FROM use_rows WHERE datetime < DATE '1999-01-01')),
    k AS (SELECT {SOLVED} FROM (SELECT *, {DET} FROM s)) SELECT instrument, datetime, b1 * x1 + b2 * x2 + b3 * x3 AS pred FROM use_rows, k WHERE datetime >= DATE '1999-01-01'""",
)
def linear_fit(spark, sf_dir):
    d = _rows(spark, sf_dir)
    m = M.linear_fit(d.where(F.col("datetime") < F.lit(CUT)), FEATURES, ridge=0.1)
    return M.predict(m, d.where(F.col("datetime") >= F.lit(CUT)), FEATURES)


@query(
    "linear_fit_single",
    "slope:f4 intercept:f4",
    f"WITH {T.PRED}, {FULL} SELECT regr_slope(label, score) AS slope, regr_intercept(label, score) AS intercept FROM full_rows WHERE f_std IS NOT NULL AND f_vol IS NOT NULL",
)
def linear_fit_single(spark, sf_dir):
    """One-factor least squares; the coefficients are checked against the closed form."""
    m = M.linear_fit(_rows(spark, sf_dir), ["score"], intercept=True)
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")


@query("gbt_fit", KEY + "pred:f4")
def gbt_fit(spark, sf_dir):
    d = _rows(spark, sf_dir)
    m = M.gbt_fit(d.where(F.col("datetime") < F.lit(CUT)), FEATURES, trees=5)
    return M.predict(m, d.where(F.col("datetime") >= F.lit(CUT)), FEATURES)


_TASKS = f"""{T.CALENDAR}, h AS (SELECT max(cal_ix) AS hi FROM calendar), t AS (SELECT CAST(unnest(generate_series(200, hi, 50)) AS INTEGER) AS a, hi FROM h),
 s AS (SELECT (a - 200) // 50 AS task, 'train' AS segment, greatest(a - 2 - 150, 0) AS x, a - 3 AS y FROM t UNION ALL SELECT (a - 200) // 50, 'test', a, least(a + 49, hi) FROM t),
 tasks AS (SELECT task, segment, p.datetime AS "start", q.datetime AS "end" FROM s JOIN calendar p ON p.cal_ix = x JOIN calendar q ON q.cal_ix = y)"""


def _tasks(spark, sf_dir):
    return M.rolling_tasks(T.calendar(spark, sf_dir), 200, 50, train=150, gap=2)


@query("rolling_tasks", "task:i segment:s start:d end:d", f"WITH {_TASKS} SELECT * FROM tasks")
def rolling_tasks(spark, sf_dir):
    return _tasks(spark, sf_dir)


@query("horizon_tasks", "task:i segment:s start:d end:d horizon:i", f"WITH {_TASKS} SELECT tasks.*, unnest([1, 5, 10]) AS horizon FROM tasks")
def horizon_tasks(spark, sf_dir):
    return _tasks(spark, sf_dir).withColumn("horizon", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))


@query(
    "walk_forward",
    KEY + "task:i score:f4",
    f"""WITH {USE}, {_TASKS[len(T.CALENDAR) + 2 :]}, sums AS (SELECT task, {SUMS} FROM use_rows JOIN tasks ON segment = 'train' AND datetime BETWEEN "start" AND "end" GROUP BY task),
    k AS (SELECT task, {SOLVED} FROM (SELECT *, {DET} FROM sums)) SELECT instrument, datetime, task, b1 * x1 + b2 * x2 + b3 * x3 AS score
    FROM use_rows JOIN tasks ON segment = 'test' AND datetime BETWEEN "start" AND "end" JOIN k USING (task)""",
)
def walk_forward(spark, sf_dir):
    return M.walk_forward(_rows(spark, sf_dir), _tasks(spark, sf_dir), FEATURES, bounds=T.bounds(spark, sf_dir))


_PM = f"{T.PRED}, mm AS (SELECT unnest(['score', 'f_std', 'f_vol']) AS model, instrument, year(datetime) AS period, datetime, unnest([score, f_std, f_vol]) AS x, label FROM pred), use_rows AS (SELECT * FROM mm WHERE x IS NOT NULL AND label IS NOT NULL)"


@query("perf_matrix", "model:s period:i rank_ic:f", f"WITH {_PM}, {ic_sql('use_rows', 'model, period, datetime', 'x')} SELECT model, period, avg(rank_ic) AS rank_ic FROM ic GROUP BY 1, 2")
def perf_matrix(spark, sf_dir):
    long = T.pred(spark, sf_dir).unpivot(["instrument", "datetime", "label"], FEATURES, "model", "x").withColumn("period", F.year("datetime"))
    i = E.ic(long, ("model", "period", "datetime"), "x", bounds=T.bounds(spark, sf_dir))
    return i.groupBy("model", "period").agg(F.avg("rank_ic").alias("rank_ic"))


@query("multi_segment_eval", "segment:s IC:f Rank_IC:f days:i", f"WITH {T.PRED}, {FULL}, {ic_sql()}, s AS (SELECT *, {SEGMENT} AS segment FROM ic) SELECT segment, avg(ic) AS IC, avg(rank_ic) AS Rank_IC, count(*) AS days FROM s WHERE segment IS NOT NULL GROUP BY 1")
def multi_segment_eval(spark, sf_dir):
    i = E.ic(T.pred(spark, sf_dir), bounds=T.bounds(spark, sf_dir))
    t = tag_segments(i, segment_table(spark))
    return t.groupBy("segment").agg(F.avg("ic").alias("IC"), F.avg("rank_ic").alias("Rank_IC"), F.count(F.lit(1)).alias("days"))


_LOSS = "l AS (SELECT CAST(p_partkey AS VARCHAR) AS instrument, unnest([1, 2, 3, 4]) AS iteration, unnest([abs(p_retailprice - 1000), abs(p_retailprice - 1000 - p_size * 2), abs(p_retailprice - 1000 - p_size * 4), abs(p_retailprice - 1000 - p_size * 6)]) AS loss FROM part)"


@query(
    "loss_reweight",
    "instrument:s bin:i weight:f",
    f"""WITH {_LOSS}, r AS (SELECT *, {T.avg_rank('loss', 'iteration')} / count(*) OVER (PARTITION BY iteration) AS norm FROM l),
    p AS (SELECT instrument, avg(norm) FILTER (WHERE iteration <= 1) AS b, avg(norm) FILTER (WHERE iteration > 3) AS f, max(CASE WHEN iteration = 4 THEN -loss END) AS v, 0 AS g FROM r GROUP BY 1),
    q AS (SELECT *, f / b AS ratio FROM p), h AS (SELECT instrument, {T.avg_rank('v', 'g')} / count(*) OVER () + {T.avg_rank('ratio', 'g')} / count(*) OVER () AS h FROM q),
    s AS (SELECT *, CAST(least(floor((h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()) * 10), 9) AS BIGINT) AS bin FROM h) SELECT instrument, bin, 1 / (0.5 * avg(h) OVER (PARTITION BY bin) + 0.1) AS weight FROM s""",
)
def loss_reweight(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    curve = F.array(*[F.struct(F.lit(k + 1).alias("iteration"), F.abs(F.col("p_retailprice") - 1000 - F.col("p_size") * (2 * k)).alias("loss")) for k in range(4)])
    l = p.select(F.col("p_partkey").cast("string").alias("instrument"), F.explode(curve).alias("e")).select("instrument", "e.*")
    return M.loss_reweight(l, 4)


_ORDERS = ", ".join(f"row_number() OVER (ORDER BY md5(instrument || '|' || CAST(datetime AS VARCHAR) || '|{k}')) AS o{k}" for k in range(1, 5))


@query(
    "permutation_importance",
    "feature:s importance:f4 bin:i chosen:b",
    f"""WITH {USE}, k AS (SELECT {SOLVED} FROM (SELECT *, {DET} FROM (SELECT {SUMS} FROM use_rows))), o AS (SELECT *, {_ORDERS} FROM use_rows),
    p AS (SELECT r.x1, r.x2, r.x3, r.label, q1.x1 AS y1, q2.x2 AS y2, q3.x3 AS y3 FROM o r JOIN o q1 ON q1.o2 = r.o1 JOIN o q2 ON q2.o3 = r.o1 JOIN o q3 ON q3.o4 = r.o1),
    l AS (SELECT (b1 * x1 + b2 * x2 + b3 * x3 - label) ** 2 AS l0, (b1 * y1 + b2 * x2 + b3 * x3 - label) ** 2 AS l1, (b1 * x1 + b2 * y2 + b3 * x3 - label) ** 2 AS l2,
     (b1 * x1 + b2 * x2 + b3 * y3 - label) ** 2 AS l3 FROM p, k),
    g AS (SELECT unnest(['score', 'f_std', 'f_vol']) AS feature, unnest([avg(l1 - l0) / (stddev_pop(l1 - l0) + 1e-7), avg(l2 - l0) / (stddev_pop(l2 - l0) + 1e-7), avg(l3 - l0) / (stddev_pop(l3 - l0) + 1e-7)]) AS importance FROM l),
    n AS (SELECT *, CAST(greatest(coalesce(ceil((importance - min(importance) OVER ()) / (max(importance) OVER () - min(importance) OVER ()) * 5) - 1, 0), 0) AS INTEGER) AS bin FROM g)
    SELECT feature, importance, bin, row_number() OVER (PARTITION BY bin ORDER BY md5(feature || '|1')) <= ceil([0.8, 0.7, 0.6, 0.5, 0.4][dense_rank() OVER (ORDER BY bin DESC)] * count(*) OVER (PARTITION BY bin)) AS chosen FROM n""",
)
def permutation_importance(spark, sf_dir):
    # the fit and each permutation read the rows again
    d = stored(_rows(spark, sf_dir).select("instrument", "datetime", "label", *FEATURES))
    return M.permutation_importance(M.linear_fit(d, FEATURES), d, FEATURES)


# ---- sorts, limits, set operations ----
@query("sort_panel", "datetime:d instrument:s close:f", f"WITH {T.BARS} SELECT datetime, instrument, close FROM bars ORDER BY 1, 2")
def sort_panel(spark, sf_dir):
    return T.bars(spark, sf_dir).orderBy("datetime", "instrument")


@query("topk_per_date", KEY + "side:s", f"WITH {T.PRED}, f AS (SELECT * FROM pred WHERE score IS NOT NULL) SELECT instrument, datetime, 'top' AS side FROM f QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY score DESC, instrument) <= 5 UNION ALL SELECT instrument, datetime, 'bottom' FROM f QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY score, instrument) <= 5")
def topk_per_date(spark, sf_dir):
    f = T.pred(spark, sf_dir).where("score IS NOT NULL")
    one = lambda o, s: xs_top(f, ["datetime"], [o, F.col("instrument")], 5).withColumn("side", F.lit(s))
    return one(F.col("score").desc(), "top").unionByName(one(F.col("score").asc(), "bottom"))


@query("tail_n", KEY + "close:f", f"WITH {T.BARS} SELECT instrument, datetime, close FROM bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY datetime DESC) <= 20")
def tail_n(spark, sf_dir):
    return xs_top(T.bars(spark, sf_dir), ["instrument"], [F.col("datetime").desc()], 20)


@query("union_keep_last", KEY + "close:f", f"WITH {T.BARS} SELECT instrument, datetime, CASE WHEN volume > 60 THEN -close ELSE close END AS close FROM bars")
def union_keep_last(spark, sf_dir):
    b = T.bars(spark, sf_dir)
    new = b.where("volume > 60").select("instrument", "datetime", (-F.col("close")).alias("close"))
    return P.union_keep_last([b.select("instrument", "datetime", "close"), new])


_TWO = f"{T.BARS}, a AS (SELECT datetime, instrument FROM bars QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY volume DESC, instrument) <= 10), b AS (SELECT datetime, instrument FROM bars QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY vwap DESC, instrument) <= 10)"


def _two(spark, sf_dir):
    b = T.bars(spark, sf_dir)
    return [xs_top(b, ["datetime"], [F.col(c).desc(), F.col("instrument")], 10).select("datetime", "instrument") for c in ("volume", "vwap")]


@query("set_diff", KEY.strip(), f"WITH {_TWO} SELECT instrument, datetime FROM a EXCEPT SELECT instrument, datetime FROM b")
def set_diff(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.subtract(b)


@query("set_intersect", KEY.strip(), f"WITH {_TWO} SELECT instrument, datetime FROM a INTERSECT SELECT instrument, datetime FROM b")
def set_intersect(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.intersect(b)


@query("pivot_unpivot", KEY + "close:f", f"WITH {T.BARS} SELECT instrument, datetime, close FROM bars")
def pivot_unpivot(spark, sf_dir):
    """Every instrument through wide rows and back to long ones; columns come in blocks of a fixed width."""
    b = T.bars(spark, sf_dir)
    places = J.column_blocks(b, T.bounds(spark, sf_dir).names)
    return J.unpivot_blocks(J.pivot_blocks(b, places, "close"), places, "close")


# ---- user functions ----
@query("udf_expr", KEY + "value:f", f"WITH {T.BARS} SELECT instrument, datetime, sqrt(abs(close - open)) AS value FROM bars")
def udf_expr(spark, sf_dir):
    """An Arrow function over whole batches as a user operator."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("double")
    def root(x: pd.Series) -> pd.Series:
        return np.sqrt(x.abs())

    return T.bars(spark, sf_dir).withColumn("value", root(F.col("close") - F.col("open")))


@query("udaf_window", KEY + "value:f", f"WITH {T.BARS} SELECT instrument, datetime, max(close) OVER w - min(close) OVER w AS value FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def udaf_window(spark, sf_dir):
    import pandas as pd
    from pyspark.sql import Window

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    w = Window.partitionBy("instrument").orderBy("datetime").rowsBetween(-4, 0)
    return T.bars(spark, sf_dir).withColumn("value", spread("close").over(w))


@query("udaf_resample", "instrument:s month:d value:f", f"WITH {T.BARS} SELECT instrument, CAST(date_trunc('month', datetime) AS DATE) AS month, max(close) - min(close) AS value FROM bars GROUP BY 1, 2")
def udaf_resample(spark, sf_dir):
    """A user aggregate in two parts: its state per batch of rows, then the states merged by group, so no group costs a Python call."""

    def states(batches):
        import pyarrow as pa

        for b in batches:
            g = pa.Table.from_batches([b]).group_by(["instrument", "month"]).aggregate([("close", "max"), ("close", "min")])
            yield from g.select(["instrument", "month", "close_max", "close_min"]).rename_columns(["instrument", "month", "hi", "lo"]).to_batches()

    rows = T.bars(spark, sf_dir).select("instrument", F.trunc("datetime", "month").alias("month"), F.when(~F.isnan("close"), F.col("close")).alias("close"))
    merged = rows.mapInArrow(states, "instrument string, month date, hi double, lo double").groupBy("instrument", "month")
    return merged.agg((F.max("hi") - F.min("lo")).alias("value"))


@query("udtf_inst", KEY + "value:f", f"WITH {T.BARS} SELECT instrument, datetime, sum(volume) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM bars")
def udtf_inst(spark, sf_dir):
    """A per-instrument table function; a panel holds at most one row per calendar slot, which bounds the group."""

    def run(pdf):
        pdf = pdf.sort_values("datetime")
        return pdf.assign(value=pdf["volume"].cumsum())[["instrument", "datetime", "value"]]

    return T.bars(spark, sf_dir).groupBy("instrument").applyInPandas(run, "instrument string, datetime date, value double")


@query("udtf_date", KEY + "value:f", f"WITH {T.BARS} SELECT instrument, datetime, close / max(close) OVER (PARTITION BY datetime) AS value FROM bars")
def udtf_date(spark, sf_dir):
    """A function of a row and of its date: the date's part is an aggregate that is joined back, so a date may hold any number of names."""
    b = T.bars(spark, sf_dir)
    top = b.groupBy("datetime").agg(F.max("close").alias("top"))
    return b.join(bounded(top, T.bounds(spark, sf_dir).dates), "datetime").select("instrument", "datetime", (F.col("close") / F.col("top")).alias("value"))
