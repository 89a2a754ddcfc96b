"""Per-date processors, fitted normalisers and samples."""

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import process as P
from tidepanel.operators.scale import Bounds
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query

A, B = dt.date(1995, 1, 2), dt.date(1998, 12, 28)
FIT = "datetime BETWEEN DATE '1995-01-02' AND DATE '1998-12-28'"
KEY = "instrument:s datetime:d "


@query("dropna", KEY + "score:f label:f", f"WITH {T.PRED} SELECT instrument, datetime, score, label FROM pred WHERE score IS NOT NULL AND label IS NOT NULL")
def dropna(spark, sf_dir):
    return P.dropna(T.pred(spark, sf_dir), ["score", "label"])


@query("dropcol", KEY + "score:f", f"WITH {T.PRED} SELECT instrument, datetime, score FROM pred")
def dropcol(spark, sf_dir):
    return P.drop_cols(P.filter_cols(T.pred(spark, sf_dir), ["score", "f_std", "label"]), ["f_std", "label"])


@query("tanh", KEY + "score:f", f"WITH {T.PRED} SELECT instrument, datetime, tanh(score - 1) AS score FROM pred")
def tanh(spark, sf_dir):
    return P.tanh(T.pred(spark, sf_dir), ["score"])


@query(
    "process_inf",
    KEY + "x:f",
    f"""WITH {T.PANEL}, raw AS (SELECT instrument, datetime, CASE WHEN high - low <> 0 THEN vwap / (high - low) WHEN vwap > 0 AND high - low = 0 THEN 'inf'::DOUBLE END AS x FROM panel)
    SELECT instrument, datetime, CASE WHEN isinf(x) THEN avg(CASE WHEN NOT isinf(x) THEN x END) OVER (PARTITION BY datetime) ELSE x END AS x FROM raw""",
)
def process_inf(spark, sf_dir):
    df = X.features(T.panel(spark, sf_dir), {"x": "$vwap/($high-$low)"})
    return P.process_inf(df, ["x"], T.bounds(spark, sf_dir))


@query("fillna", KEY + "f_vol:f", f"WITH {T.PRED} SELECT instrument, datetime, coalesce(f_vol, 0) AS f_vol FROM pred")
def fillna(spark, sf_dir):
    return P.fillna(T.pred(spark, sf_dir), ["f_vol"])


@query(
    "minmax_norm",
    KEY + "score:f one:f",
    f"""WITH {T.PRED}, s AS (SELECT min(score) AS lo, max(score) AS hi FROM pred WHERE {FIT})
    SELECT instrument, datetime, (score - lo) / (hi - lo) AS score, 1 AS one FROM pred, s""",
)
def minmax_norm(spark, sf_dir):
    return P.minmax_norm(T.pred(spark, sf_dir).withColumn("one", F.lit(1.0)), ["score", "one"], A, B)


@query(
    "zscore_norm",
    KEY + "score:f one:f",
    f"""WITH {T.PRED}, s AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM pred WHERE {FIT})
    SELECT instrument, datetime, (score - m) / s AS score, 1 AS one FROM pred, s""",
)
def zscore_norm(spark, sf_dir):
    return P.zscore_norm(T.pred(spark, sf_dir).withColumn("one", F.lit(1.0)), ["score", "one"], A, B)


@query(
    "robust_zscore_norm",
    KEY + "score:f",
    f"""WITH {T.PRED}, m AS (SELECT quantile_cont(score, 0.5) AS med FROM pred WHERE {FIT}),
    d AS (SELECT quantile_cont(abs(score - med), 0.5) AS mad FROM pred, m WHERE {FIT}),
    z AS (SELECT instrument, datetime, (score - med) / ((mad + 1e-12) * 1.4826::DOUBLE) AS z FROM pred, m, d)
    SELECT instrument, datetime, CASE WHEN z IS NOT NULL THEN greatest(-3, least(3, z)) END AS score FROM z""",
)
def robust_zscore_norm(spark, sf_dir):
    return P.robust_zscore_norm(T.pred(spark, sf_dir), ["score"], A, B)


@query(
    "cs_zscore",
    KEY + "score:f f_std:f",
    f"""WITH {T.PRED} SELECT instrument, datetime,
    (score - avg(score) OVER d) / nullif(stddev_samp(score) OVER d, 0) AS score, (f_std - avg(f_std) OVER d) / nullif(stddev_samp(f_std) OVER d, 0) AS f_std
    FROM pred WINDOW d AS (PARTITION BY datetime)""",
)
def cs_zscore(spark, sf_dir):
    return P.cs_zscore(T.pred(spark, sf_dir), ["score", "f_std"], T.bounds(spark, sf_dir))


_ROBUST = f"""WITH {T.PRED}, m AS (SELECT datetime, quantile_cont(score, 0.5) AS med FROM pred GROUP BY 1),
    d AS (SELECT datetime, quantile_cont(abs(score - med), 0.5) AS mad FROM pred JOIN m USING (datetime) GROUP BY 1)
    SELECT instrument, datetime, (score - med) / nullif(mad * 1.4826::DOUBLE, 0) AS score FROM pred JOIN m USING (datetime) JOIN d USING (datetime)"""


@query("cs_zscore_robust", KEY + "score:f", _ROBUST)
def cs_zscore_robust(spark, sf_dir):
    return P.cs_robust_zscore(T.pred(spark, sf_dir), ["score"], T.bounds(spark, sf_dir))


@query("cs_zscore_robust_unbounded", KEY + "score:f", _ROBUST)
def cs_zscore_robust_unbounded(spark, sf_dir):
    """The same without a proven group size: bracketed exact quantiles."""
    return P.cs_robust_zscore(T.pred(spark, sf_dir), ["score"], Bounds())


_RANK = f"""WITH {T.PRED} SELECT instrument, datetime,
    CASE WHEN score IS NOT NULL THEN ({T.avg_rank('score', 'datetime')} / count(score) OVER (PARTITION BY datetime) - 0.5) * 3.46::DOUBLE END AS score,
    CASE WHEN f_vol IS NOT NULL THEN ({T.avg_rank('f_vol', 'datetime')} / count(f_vol) OVER (PARTITION BY datetime) - 0.5) * 3.46::DOUBLE END AS f_vol FROM pred"""


@query("cs_rank_norm", KEY + "score:f f_vol:f", _RANK)
def cs_rank_norm(spark, sf_dir):
    return P.cs_rank_norm(T.pred(spark, sf_dir), ["score", "f_vol"], T.bounds(spark, sf_dir))


@query("cs_rank_norm_unbounded", KEY + "score:f f_vol:f", _RANK)
def cs_rank_norm_unbounded(spark, sf_dir):
    """The same without a proven group size: ranks from value buckets and offsets."""
    return P.cs_rank_norm(T.pred(spark, sf_dir), ["score", "f_vol"], Bounds())


@query("cs_fillna", KEY + "f_vol:f", f"WITH {T.PRED} SELECT instrument, datetime, coalesce(f_vol, avg(f_vol) OVER (PARTITION BY datetime)) AS f_vol FROM pred")
def cs_fillna(spark, sf_dir):
    return P.cs_fillna(T.pred(spark, sf_dir), ["f_vol"], T.bounds(spark, sf_dir))


def _section(x, name):
    return f""", {name}_0 AS (SELECT instrument, datetime, {x} AS x FROM pred),
    {name}_m AS (SELECT datetime, quantile_cont(x, 0.5) AS med FROM {name}_0 GROUP BY 1),
    {name}_d AS (SELECT datetime, quantile_cont(abs(x - med), 0.5) AS mad FROM {name}_0 JOIN {name}_m USING (datetime) GROUP BY 1),
    {name}_z AS (SELECT instrument, datetime, (x - med) / nullif(mad * 1.4826::DOUBLE, 0) AS z FROM {name}_0 JOIN {name}_m USING (datetime) JOIN {name}_d USING (datetime)),
    {name} AS (SELECT instrument, datetime, CASE WHEN z > 3 THEN 3 + (z - 3) / (max(z) OVER d - 3) * 0.5::DOUBLE WHEN z < -3 THEN -3 - (z + 3) / (min(z) OVER d + 3) * 0.5::DOUBLE ELSE coalesce(z, 0) END AS v
     FROM {name}_z WINDOW d AS (PARTITION BY datetime))"""


@query(
    "config_section",
    KEY + "ROC5:f STD5:f VOLUME0:f LABEL0:f",
    f"""WITH {T.PRED}{_section('score', 'a')}{_section('CASE WHEN f_std > 0 THEN ln(f_std) END', 'b')}{_section('ln(f_vol)', 'c')}
    SELECT instrument, datetime, a.v AS ROC5, b.v AS STD5, c.v AS VOLUME0,
     coalesce((label - avg(label) OVER d) / nullif(stddev_samp(label) OVER d, 0), 0) AS LABEL0
    FROM pred JOIN a USING (instrument, datetime) JOIN b USING (instrument, datetime) JOIN c USING (instrument, datetime) WINDOW d AS (PARTITION BY datetime)""",
)
def config_section(spark, sf_dir):
    df = T.pred(spark, sf_dir).select(
        "instrument", "datetime", F.col("score").alias("ROC5"), F.col("f_std").alias("STD5"), F.col("f_vol").alias("VOLUME0"), F.col("label").alias("LABEL0")
    )
    return P.config_section(df, ["ROC5", "STD5", "VOLUME0"], ["LABEL0"], T.bounds(spark, sf_dir))


@query("hf_cast", KEY + "up:i close:f2", f"WITH {T.PANEL} SELECT instrument, datetime, CAST(coalesce(close > open, false) AS TINYINT) AS up, CAST(CAST(close AS FLOAT) AS DOUBLE) AS close FROM panel")
def hf_cast(spark, sf_dir):
    df = T.panel(spark, sf_dir).withColumn("up", F.coalesce(F.col("close") > F.col("open"), F.lit(False)))
    return P.hf_cast(df, ["up"], ["close"])


@query(
    "hf_norm",
    KEY + "open:f close:f volume:f",
    f"""WITH {T.PANEL}, fit AS (SELECT unnest([open, close]) AS x FROM panel WHERE {FIT}), m AS (SELECT avg(x) AS m FROM fit), s AS (SELECT stddev_pop(abs(x - m)) AS s FROM fit, m),
    vfit AS (SELECT ln(1 + volume) AS x FROM panel WHERE {FIT}), vm AS (SELECT avg(x) AS vm FROM vfit), vs AS (SELECT stddev_pop(abs(x - vm)) AS vs FROM vfit, vm)
    SELECT instrument, datetime, coalesce((open - m) / s, 0) AS open, coalesce((close - m) / s, 0) AS close, coalesce((ln(1 + volume) - vm) / vs, 0) AS volume FROM panel, m, s, vm, vs""",
)
def hf_norm(spark, sf_dir):
    return P.hf_norm(T.panel(spark, sf_dir), {"price": ["open", "close"], "volume": ["volume"]}, A, B)


@query(
    "fit_then_apply",
    KEY + "score:f label:f",
    f"""WITH {T.PRED}, s AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM pred WHERE {FIT}), k AS (SELECT instrument, datetime, (score - m) / s AS score, label FROM pred, s WHERE score IS NOT NULL AND label IS NOT NULL)
    SELECT instrument, datetime, score, (label - avg(label) OVER d) / nullif(stddev_samp(label) OVER d, 0) AS label FROM k WINDOW d AS (PARTITION BY datetime)""",
)
def fit_then_apply(spark, sf_dir):
    b = T.bounds(spark, sf_dir)
    shared = [lambda d: P.zscore_norm(d, ["score"], A, B)]
    infer, learn = P.run_chain(
        T.pred(spark, sf_dir), shared, [lambda d: P.fillna(d, ["score"])], [lambda d: P.dropna(d, ["score", "label"]), lambda d: P.cs_zscore(d, ["label"], b)]
    )
    return learn


@query("monthly_apply", "month:s names:i mean_score:f", f"WITH {T.PRED} SELECT strftime(datetime, '%Y-%m') AS month, count(score) AS names, avg(score) AS mean_score FROM pred GROUP BY 1")
def monthly_apply(spark, sf_dir):
    """Group work by month needs no manual split: the shuffle by month is the split, and the aggregate is partial."""
    return T.pred(spark, sf_dir).groupBy(F.date_format("datetime", "yyyy-MM").alias("month")).agg(F.count("score").alias("names"), F.avg("score").alias("mean_score"))


_SAMPLE_SQL = f"""WITH {T.PANEL}, filled AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l0,
 last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING) AS l2 FROM panel)
 SELECT instrument, datetime, 5 AS len, lag(close, 4) OVER p AS oldest, close AS newest, l2 AS f2, l0 AS f0 FROM filled WINDOW p AS (PARTITION BY instrument ORDER BY datetime)"""


@query("ts_samples", KEY + "len:i oldest:f newest:f f2:f f0:f", _SAMPLE_SQL)
def ts_samples(spark, sf_dir):
    panel = T.panel(spark, sf_dir)
    plain = P.ts_samples(panel, ["close", "volume"], 5).select(
        "instrument", "datetime", F.size("sample").alias("len"), F.expr("sample[0].close").alias("oldest"), F.expr("sample[4].close").alias("newest")
    )
    filled = P.ts_samples(panel, ["close", "volume"], 5, "ffill").select("instrument", "datetime", F.expr("sample[2].close").alias("f2"), F.expr("sample[4].close").alias("f0"))
    return plain.join(filled, ["instrument", "datetime"])


@query("ts_extend_slice", "start:d", f"WITH {T.CALENDAR} SELECT datetime AS start FROM calendar WHERE cal_ix = (SELECT min(cal_ix) FROM calendar WHERE datetime >= DATE '1997-01-01') - 19")
def ts_extend_slice(spark, sf_dir):
    return P.extend_start(T.calendar(spark, sf_dir), dt.date(1997, 1, 1), 20)


@query(
    "ts_slices",
    KEY + "len:i first_day:d total:f",
    f"""WITH {T.BARS} SELECT instrument, datetime, count(*) OVER w AS len, min(datetime) OVER w AS first_day, sum(volume) OVER w AS total FROM bars
    WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def ts_slices(spark, sf_dir):
    out = P.ts_slices(T.bars(spark, sf_dir), ["volume"], 10)
    return out.select("instrument", "datetime", F.size("slice").alias("len"), F.expr("slice[0].datetime").alias("first_day"), F.aggregate("slice", F.lit(0.0), lambda a, r: a + r["volume"]).alias("total"))


@query(
    "time_weight",
    KEY + "weight:f",
    f"""WITH {T.BARS} SELECT instrument, datetime, CASE WHEN datetime < DATE '1997-01-01' THEN 0.25 WHEN datetime <= DATE '1999-12-31' THEN 0.5 ELSE 1 END AS weight FROM bars""",
)
def time_weight(spark, sf_dir):
    w = spark.createDataFrame(
        [(dt.date(1990, 1, 1), dt.date(1996, 12, 31), 0.25), (dt.date(1997, 1, 1), dt.date(1999, 12, 31), 0.5)], "start date, end date, weight double"
    )
    return P.time_weight(T.bars(spark, sf_dir).select("instrument", "datetime"), w)
