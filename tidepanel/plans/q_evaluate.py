"""Signal evaluation."""

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import evaluate as E
from tidepanel.operators.scale import Bounds
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query

FULL = "full_rows AS (SELECT * FROM pred WHERE score IS NOT NULL AND label IS NOT NULL)"


def corr(x, y):
    return f"CASE WHEN stddev_samp({x}) > 0 AND stddev_samp({y}) > 0 THEN corr({x}, {y}) END"


def ic_sql(source="full_rows", keys="datetime", x="score", y="label", name="ic"):
    return f"""{name}_r AS (SELECT {keys}, {x} AS x, {y} AS y, {T.avg_rank(x, keys)} AS rx, {T.avg_rank(y, keys)} AS ry FROM {source}),
    {name} AS (SELECT {keys}, count(*) AS n, {corr('x', 'y')} AS ic, {corr('rx', 'ry')} AS rank_ic FROM {name}_r GROUP BY ALL)"""


RN = "row_number() OVER (PARTITION BY {k} ORDER BY {x} NULLS LAST, md5(instrument))"


def tails_sql(source="pred", keys="datetime", x="score", k="floor(count(*) OVER g * 0.2)", name="tails"):
    """top / bottom flags; nulls never count as scored."""
    rn = RN.format(k=keys, x=x)
    return f"""{name}_a AS (SELECT *, {rn} AS rn, count({x}) OVER g AS nn, {k} AS kk FROM {source} WINDOW g AS (PARTITION BY {keys})),
    {name} AS (SELECT *, {x} IS NOT NULL AND rn > nn - kk AS top, {x} IS NOT NULL AND rn <= kk AS bottom FROM {name}_a)"""


@query("flagship_ic", "datetime:d n:i ic:f rank_ic:f", f"WITH {T.PRED}, {FULL}, {ic_sql()} SELECT * FROM ic")
def flagship_ic(spark, sf_dir):
    return E.ic(T.pred(spark, sf_dir), bounds=T.bounds(spark, sf_dir))


@query("ic", "datetime:d n:i ic:f rank_ic:f", f"WITH {T.PRED}, {FULL}, {ic_sql()} SELECT * FROM ic")
def ic(spark, sf_dir):
    """Without a proven group size: the distributed ranks are used."""
    return E.ic(T.pred(spark, sf_dir), bounds=Bounds())


_MODELS = "models AS (SELECT 'score' AS model, instrument, datetime, score AS x, label FROM pred UNION ALL SELECT 'f_std', instrument, datetime, f_std, label FROM pred)"


@query(
    "ic_many",
    "model:s datetime:d n:i ic:f rank_ic:f",
    f"WITH {T.PRED}, {_MODELS}, m AS (SELECT * FROM models WHERE x IS NOT NULL AND label IS NOT NULL), {ic_sql('m', 'model, datetime', 'x')} SELECT * FROM ic",
)
def ic_many(spark, sf_dir):
    long = T.pred(spark, sf_dir).unpivot(["instrument", "datetime", "label"], ["score", "f_std"], "model", "x")
    return E.ic(long, ("model", "datetime"), "x", bounds=T.bounds(spark, sf_dir))


_SUM = "avg(ic) AS IC, avg(ic) / stddev_samp(ic) AS ICIR, avg(rank_ic) AS Rank_IC, avg(rank_ic) / stddev_samp(rank_ic) AS Rank_ICIR"
_LSR = f"""{tails_sql()}, lsr AS (SELECT datetime, (avg(CASE WHEN top THEN label END) - avg(CASE WHEN bottom THEN label END)) / 2 AS long_short, avg(label) AS average FROM tails GROUP BY 1)"""


@query(
    "ic_summary",
    "IC:f ICIR:f Rank_IC:f Rank_ICIR:f annual_return:f sharpe:f",
    f"""WITH {T.PRED}, {FULL}, {ic_sql()}, {_LSR} SELECT * FROM (SELECT {_SUM} FROM ic),
    (SELECT avg(long_short) * 52 AS annual_return, avg(long_short) / stddev_samp(long_short) * sqrt(52) AS sharpe FROM lsr)""",
)
def ic_summary(spark, sf_dir):
    p, b = T.pred(spark, sf_dir), T.bounds(spark, sf_dir)
    return E.ic_summary(E.ic(p, bounds=b)).crossJoin(E.annual(E.long_short_return(p, bounds=b), "long_short", 52))


_DEMEAN = "dm AS (SELECT * REPLACE (label - avg(label) OVER (PARTITION BY datetime) AS label) FROM pred)"
_PREC = """SELECT datetime, count(CASE WHEN top AND label > 0 THEN 1 END) / nullif(count(CASE WHEN top THEN label END), 0) AS long_prec,
 count(CASE WHEN bottom AND label < 0 THEN 1 END) / nullif(count(CASE WHEN bottom THEN label END), 0) AS short_prec"""


@query(
    "hf_signal_record",
    "IC:f ICIR:f Rank_IC:f Rank_ICIR:f long_prec:f short_prec:f ls_mean:f ls_sharpe:f",
    f"""WITH {T.PRED}, {FULL}, {ic_sql()}, {_LSR}, {_DEMEAN}, {tails_sql('dm', name='t2')}, prec AS ({_PREC} FROM t2 GROUP BY 1)
    SELECT * FROM (SELECT {_SUM} FROM ic), (SELECT avg(long_prec) AS long_prec, avg(short_prec) AS short_prec FROM prec),
    (SELECT avg(long_short) AS ls_mean, avg(long_short) / stddev_samp(long_short) AS ls_sharpe FROM lsr)""",
)
def hf_signal_record(spark, sf_dir):
    return E.hf_signal_record(T.pred(spark, sf_dir), bounds=T.bounds(spark, sf_dir))


@query(
    "ic_monthly",
    "month:d ic:f",
    f"""WITH {T.PRED}, {FULL}, {ic_sql()}, m AS (SELECT CAST(date_trunc('month', datetime) AS DATE) AS month, avg(ic) AS ic FROM ic GROUP BY 1)
    SELECT g.month, m.ic FROM (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m) g LEFT JOIN m USING (month)""",
)
def ic_monthly(spark, sf_dir):
    return E.ic_monthly(E.ic(T.pred(spark, sf_dir), bounds=T.bounds(spark, sf_dir)))


@query("long_short_prec", "datetime:d long_prec:f short_prec:f", f"WITH {T.PRED}, {tails_sql()} {_PREC} FROM tails GROUP BY 1")
def long_short_prec(spark, sf_dir):
    return E.long_short_prec(T.pred(spark, sf_dir), bounds=Bounds())


@query("long_short_prec_alpha", "datetime:d long_prec:f short_prec:f", f"WITH {T.PRED}, {_DEMEAN}, {tails_sql('dm')} {_PREC} FROM tails GROUP BY 1")
def long_short_prec_alpha(spark, sf_dir):
    return E.long_short_prec(T.pred(spark, sf_dir), demean=True, bounds=T.bounds(spark, sf_dir))


@query("long_short_return", "datetime:d long_short:f average:f", f"WITH {T.PRED}, {_LSR} SELECT * FROM lsr")
def long_short_return(spark, sf_dir):
    return E.long_short_return(T.pred(spark, sf_dir), bounds=T.bounds(spark, sf_dir))


@query(
    "group_return",
    "datetime:d group1:f group2:f group3:f group4:f group5:f long_short:f long_average:f cum_group1:f cum_long_short:f cum_long_average:f",
    f"""WITH {T.PRED}, r AS (SELECT *, {RN.format(k='datetime', x='score')} AS rn, count(*) OVER (PARTITION BY datetime) AS n FROM pred WHERE score IS NOT NULL),
    g AS (SELECT *, CAST(floor((n - rn) / nullif(floor(n / 5), 0)) AS INTEGER) + 1 AS g FROM r),
    per AS (SELECT datetime, {', '.join(f'avg(label) FILTER (WHERE g = {i}) AS group{i}' for i in range(1, 6))} FROM g GROUP BY 1),
    j AS (SELECT per.*, group1 - group5 AS long_short, group1 - m.a AS long_average FROM per JOIN (SELECT datetime, avg(label) AS a FROM pred GROUP BY 1) m USING (datetime))
    SELECT *, sum(group1) OVER w AS cum_group1, sum(long_short) OVER w AS cum_long_short, sum(long_average) OVER w AS cum_long_average
    FROM j WHERE group1 IS NOT NULL OR long_short IS NOT NULL WINDOW w AS (ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def group_return(spark, sf_dir):
    return E.group_return(T.pred(spark, sf_dir), bounds=T.bounds(spark, sf_dir))


@query(
    "pred_autocorr",
    "datetime:d autocorr:f",
    f"WITH {T.PRED} SELECT a.datetime, {corr('a.s', 'a.p')} AS autocorr FROM (SELECT a.datetime, CASE WHEN b.score IS NOT NULL THEN a.score END AS s, CASE WHEN a.score IS NOT NULL THEN b.score END AS p FROM pred a JOIN pred b ON a.instrument = b.instrument AND a.cal_ix = b.cal_ix + 1) a GROUP BY 1",
)
def pred_autocorr(spark, sf_dir):
    return E.pred_autocorr(T.pred(spark, sf_dir))


_LAST = "lastp AS (SELECT *, lag(score) OVER (PARTITION BY instrument ORDER BY datetime) AS score_last FROM pred)"


@query(
    "pred_autocorr_rank",
    "datetime:d autocorr:f",
    f"""WITH {T.PRED}, {_LAST}, r AS (SELECT datetime, CASE WHEN score IS NOT NULL THEN {T.avg_rank('score', 'datetime')} END AS a, CASE WHEN score_last IS NOT NULL THEN {T.avg_rank('score_last', 'datetime')} END AS b FROM lastp),
    p AS (SELECT datetime, CASE WHEN b IS NOT NULL THEN a END AS a, CASE WHEN a IS NOT NULL THEN b END AS b FROM r) SELECT datetime, {corr('a', 'b')} AS autocorr FROM p GROUP BY 1""",
)
def pred_autocorr_rank(spark, sf_dir):
    return E.pred_autocorr_rank(T.pred(spark, sf_dir), bounds=T.bounds(spark, sf_dir))


_K5 = "floor(count(*) OVER g / 5)"


@query(
    "pred_turnover",
    "datetime:d top:f bottom:f",
    f"""WITH {T.PRED}, {_LAST}, {tails_sql('lastp', k=_K5, name='now')}, n2 AS (SELECT instrument, datetime, score_last, top AS tn, bottom AS bn FROM now), {tails_sql('n2', x='score_last', k=_K5)}
    SELECT datetime, 1 - count(CASE WHEN tn AND top THEN 1 END) / nullif(max(kk), 0) AS top, 1 - count(CASE WHEN bn AND bottom THEN 1 END) / nullif(max(kk), 0) AS bottom FROM tails GROUP BY 1""",
)
def pred_turnover(spark, sf_dir):
    return E.pred_turnover(T.pred(spark, sf_dir), bounds=T.bounds(spark, sf_dir))


@query(
    "hf_signal_test",
    "up_prec:f down_prec:f up_alpha:f down_alpha:f",
    f"""WITH {T.PRED}, {FULL}, r AS (SELECT datetime, label - avg(label) OVER (PARTITION BY datetime) AS a, {RN.format(k='datetime', x='score')} AS rn, count(*) OVER (PARTITION BY datetime) AS n FROM full_rows),
    per AS (SELECT datetime, avg(CASE WHEN rn > floor(n * 0.8) THEN CAST(a > 0 AS INT) END) AS up_prec, avg(CASE WHEN rn <= floor(n * 0.2) THEN CAST(a < 0 AS INT) END) AS down_prec,
     avg(CASE WHEN rn > floor(n * 0.8) THEN a END) AS up_alpha, avg(CASE WHEN rn <= floor(n * 0.2) THEN a END) AS down_alpha FROM r WHERE floor(n * 0.2) >= 10 GROUP BY 1)
    SELECT avg(up_prec) AS up_prec, avg(down_prec) AS down_prec, avg(up_alpha) AS up_alpha, avg(down_alpha) AS down_alpha FROM per""",
)
def hf_signal_test(spark, sf_dir):
    return E.hf_signal_test(T.pred(spark, sf_dir), bounds=T.bounds(spark, sf_dir))


@query("mse", "mse:f4 rmse:f n:i", f"WITH {T.PRED} SELECT avg(pow(score - label, 2)) AS mse, sqrt(avg(pow(score - label, 2))) AS rmse, count(score - label) AS n FROM pred")
def mse(spark, sf_dir):
    return E.mse(T.pred(spark, sf_dir))


_LONG = "long_rows AS (SELECT 'score' AS feature, instrument, datetime, cal_ix, label, score AS x FROM pred UNION ALL SELECT 'f_vol', instrument, datetime, cal_ix, label, f_vol FROM pred)"
_FIC_COLS = "observations:i dates:i coverage:f ic_mean:f rank_ic_mean:f positive_ic:f positive_rank_ic:f"


def _fic(keys, source):
    using = keys.replace(" ", "")
    return f"""WITH {T.PRED}, {T.GROUPS}, {_LONG}, lg AS (SELECT l.*, sector FROM long_rows l JOIN groups USING (instrument)), use_rows AS (SELECT * FROM {source} WHERE x IS NOT NULL AND label IS NOT NULL),
    {ic_sql('use_rows', keys + ', datetime', 'x')}, d AS (SELECT * FROM ic WHERE n >= 3 AND (ic IS NOT NULL OR rank_ic IS NOT NULL)),
    size_rows AS (SELECT {keys}, count(*) AS a, count(x + label) AS observations FROM {source} GROUP BY ALL),
    m AS (SELECT {keys}, count(*) AS dates, avg(ic) AS ic_mean, avg(rank_ic) AS rank_ic_mean, avg(CASE WHEN ic IS NOT NULL THEN CAST(ic > 1e-12 AS INT) END) AS positive_ic, avg(CASE WHEN rank_ic IS NOT NULL THEN CAST(rank_ic > 1e-12 AS INT) END) AS positive_rank_ic FROM d GROUP BY ALL)
    SELECT *, observations / a AS coverage FROM size_rows JOIN m USING ({using})"""


@query("feature_ic", "feature:s " + _FIC_COLS, _fic("feature", "long_rows"))
def feature_ic(spark, sf_dir):
    return E.feature_ic(T.pred(spark, sf_dir), ["score", "f_vol"], bounds=T.bounds(spark, sf_dir))


@query("feature_ic_by_sector", "feature:s sector:s " + _FIC_COLS, _fic("feature, sector", "lg"))
def feature_ic_by_sector(spark, sf_dir):
    df = T.pred(spark, sf_dir).join(T.groups(spark, sf_dir), "instrument")
    return E.feature_ic(df, ["score", "f_vol"], ("sector",), bounds=T.bounds(spark, sf_dir))


@query(
    "quantile_spread",
    "feature:s dates:i bottom_mean:f top_mean:f spread:f top_beats_bottom:f",
    f"""WITH {T.PRED}, {_LONG}, u AS (SELECT * FROM long_rows WHERE x IS NOT NULL AND label IS NOT NULL),
    r AS (SELECT *, {RN.format(k='feature, datetime', x='x')} AS rn, count(*) OVER (PARTITION BY feature, datetime) AS n FROM u),
    b AS (SELECT *, least(greatest(floor(rn / n * 5), 1), 5) AS b FROM r),
    d AS (SELECT feature, datetime, avg(label) FILTER (WHERE b = 1) AS bottom, avg(label) FILTER (WHERE b = 5) AS top FROM b GROUP BY 1, 2 HAVING count(*) >= 5 AND min(x) < max(x))
    SELECT feature, count(*) AS dates, avg(bottom) AS bottom_mean, avg(top) AS top_mean, avg(top - bottom) AS spread, avg(CAST(top > bottom AS INT)) AS top_beats_bottom FROM d WHERE top IS NOT NULL AND bottom IS NOT NULL GROUP BY 1""",
)
def quantile_spread(spark, sf_dir):
    return E.quantile_spread(T.pred(spark, sf_dir), ["score", "f_vol"], bounds=T.bounds(spark, sf_dir))


_SECTOR = f"{T.PRED}, {T.GROUPS}, {FULL}, gp AS (SELECT f.*, sector FROM full_rows f JOIN groups USING (instrument))"


@query(
    "group_ic",
    "sector:s days:i valid_ic:i ic_mean:f rank_ic_mean:f spread_mean:f spread_positive:f top_win_rate:f",
    f"""WITH {_SECTOR}, {ic_sql('gp', 'datetime, sector')}, {tails_sql('gp', 'datetime, sector', k='greatest(1, floor(count(*) OVER g / 5))')},
    m AS (SELECT *, avg(label) OVER (PARTITION BY datetime, sector) AS gm FROM tails),
    d AS (SELECT datetime, sector, count(*) AS c, avg(label) FILTER (WHERE top) AS t, avg(label) FILTER (WHERE bottom) AS b, avg(CAST(label > gm AS INT)) FILTER (WHERE top) AS w FROM m GROUP BY 1, 2),
    e AS (SELECT d.datetime, sector, ic, rank_ic, CASE WHEN c >= 5 THEN t - b END AS spread, CASE WHEN c >= 5 THEN w END AS w FROM d LEFT JOIN ic USING (datetime, sector))
    SELECT sector, count(DISTINCT datetime) AS days, count(ic) AS valid_ic, avg(ic) AS ic_mean, avg(rank_ic) AS rank_ic_mean, avg(spread) AS spread_mean, avg(CASE WHEN spread IS NOT NULL THEN CAST(spread > 0 AS INT) END) AS spread_positive, avg(w) AS top_win_rate FROM e GROUP BY 1""",
)
def group_ic(spark, sf_dir):
    df = T.pred(spark, sf_dir).join(T.groups(spark, sf_dir), "instrument")
    return E.group_summary(E.group_metrics(df, "sector", bounds=T.bounds(spark, sf_dir)), "sector")


@query(
    "group_quantiles",
    "sector:s quantile:i mean_return:f observations:i periods:i",
    f"""WITH {_SECTOR}, r AS (SELECT *, {RN.format(k='datetime, sector', x='score')} AS rn, count(*) OVER (PARTITION BY datetime, sector) AS n FROM gp),
    d AS (SELECT datetime, sector, CAST(floor((n - rn) * 5 / n) AS BIGINT) + 1 AS quantile, avg(label) AS r, count(*) AS c FROM r WHERE n >= 5 GROUP BY 1, 2, 3)
    SELECT sector, quantile, avg(r) AS mean_return, sum(c) AS observations, count(*) AS periods FROM d GROUP BY 1, 2""",
)
def group_quantiles(spark, sf_dir):
    df = T.pred(spark, sf_dir).join(T.groups(spark, sf_dir), "instrument")
    return E.group_quantiles(df, "sector", bounds=T.bounds(spark, sf_dir))


@query("value_count", "datetime:d feature:s values:i", f'WITH {T.PRED}, {_LONG} SELECT datetime, feature, count(DISTINCT x) AS "values" FROM long_rows WHERE x IS NOT NULL GROUP BY 1, 2')
def value_count(spark, sf_dir):
    return E.value_count(T.pred(spark, sf_dir), ["score", "f_vol"])


@query(
    "inf_nan_count",
    "datetime:d feature:s inf:i nulls:i inf_ratio:f null_ratio:f",
    f"""WITH {T.PANEL}, l AS (SELECT datetime, 'x' AS feature, CASE WHEN high - low <> 0 THEN vwap / (high - low) WHEN vwap > 0 AND high - low = 0 THEN 'inf'::DOUBLE END AS x FROM panel)
    SELECT datetime, feature, count(CASE WHEN isinf(x) THEN 1 END) AS inf, count(*) - count(x) AS nulls, count(CASE WHEN isinf(x) THEN 1 END) / count(*) AS inf_ratio, (count(*) - count(x)) / count(*) AS null_ratio FROM l GROUP BY 1, 2""",
)
def inf_nan_count(spark, sf_dir):
    return E.inf_nan_count(X.features(T.panel(spark, sf_dir), {"x": "$vwap/($high-$low)"}), ["x"])


@query(
    "feature_moments",
    "datetime:d feature:s mean:f std:f skew:f kurt:f",
    f"""WITH {T.PRED}, {_LONG} SELECT datetime, feature, avg(x) AS mean, stddev_samp(x) AS std, CASE WHEN count(x) >= 3 AND var_samp(x) > 1e-14 THEN skewness(x) END AS skew,
    CASE WHEN count(x) >= 4 AND var_samp(x) > 1e-14 THEN kurtosis(x) END AS kurt FROM long_rows GROUP BY 1, 2""",
)
def feature_moments(spark, sf_dir):
    return E.feature_moments(T.pred(spark, sf_dir), ["score", "f_vol"])


@query(
    "feature_autocorr",
    "feature:s datetime:d autocorr:f",
    f"""WITH {T.PRED}, {_LONG} SELECT feature, datetime, {corr('s', 'p')} AS autocorr FROM (SELECT a.feature, a.datetime, CASE WHEN b.x IS NOT NULL THEN a.x END AS s, CASE WHEN a.x IS NOT NULL THEN b.x END AS p
    FROM long_rows a JOIN long_rows b ON a.feature = b.feature AND a.instrument = b.instrument AND a.cal_ix = b.cal_ix + 1) GROUP BY 1, 2""",
)
def feature_autocorr(spark, sf_dir):
    return E.feature_autocorr(T.pred(spark, sf_dir), ["score", "f_vol"])


@query(
    "feature_hist",
    "feature:s bin:i n:i",
    f"""WITH {T.PRED}, {_LONG}, s AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long_rows GROUP BY 1)
    SELECT feature, CAST(least(floor((x - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM long_rows JOIN s USING (feature) WHERE x IS NOT NULL GROUP BY 1, 2""",
)
def feature_hist(spark, sf_dir):
    return E.feature_hist(T.pred(spark, sf_dir), ["score", "f_vol"])


_SETS = """sets AS (SELECT DATE '1995-01-01' AS set_start, datetime, instrument, score FROM pred WHERE datetime < DATE '1998-01-01'
 UNION ALL SELECT DATE '1997-01-01', datetime, instrument, f_std FROM pred WHERE datetime >= DATE '1997-01-01')"""


@query(
    "rolling_ensemble",
    "datetime:d instrument:s score:f",
    f"WITH {T.PRED}, {_SETS} SELECT datetime, instrument, score FROM sets QUALIFY row_number() OVER (PARTITION BY datetime, instrument ORDER BY set_start DESC) = 1",
)
def rolling_ensemble(spark, sf_dir):
    p = T.pred(spark, sf_dir)
    a = p.where(F.col("datetime") < F.lit(dt.date(1998, 1, 1))).select(F.lit(dt.date(1995, 1, 1)).alias("set_start"), "datetime", "instrument", "score")
    b = p.where(F.col("datetime") >= F.lit(dt.date(1997, 1, 1))).select(F.lit(dt.date(1997, 1, 1)).alias("set_start"), "datetime", "instrument", F.col("f_std").alias("score"))
    return E.rolling_ensemble(a.unionByName(b))


@query(
    "average_ensemble",
    "datetime:d instrument:s score:f",
    f"""WITH {T.PRED}, {_MODELS}, z AS (SELECT *, (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) AS z FROM models WINDOW w AS (PARTITION BY model, datetime))
    SELECT datetime, instrument, avg(z) AS score FROM z GROUP BY 1, 2""",
)
def average_ensemble(spark, sf_dir):
    long = T.pred(spark, sf_dir).unpivot(["instrument", "datetime"], ["score", "f_std"], "model", "score")
    return E.average_ensemble(long)


@query(
    "label_delta",
    "horizon:s segment:s n:i mean:f std:f ic_mean:f",
    f"""WITH {T.PRED}, h AS (SELECT p.instrument, p.datetime, p.score, lead(close, 2) OVER w / close - 1 AS h2, lead(close, 5) OVER w / close - 1 AS h5 FROM pred p JOIN panel USING (instrument, datetime) WINDOW w AS (PARTITION BY p.instrument ORDER BY p.datetime)),
    l AS (SELECT 'h2' AS horizon, instrument, datetime, score, h2 AS y FROM h UNION ALL SELECT 'h5', instrument, datetime, score, h5 FROM h),
    z AS (SELECT *, (y - avg(y) OVER w) / nullif(stddev_pop(y) OVER w, 0) AS z, count(y) OVER w AS c, CASE WHEN datetime <= DATE '1998-12-31' THEN 'train' ELSE 'valid' END AS segment FROM l WINDOW w AS (PARTITION BY horizon, datetime)),
    i AS (SELECT horizon, segment, datetime, {corr('a', 'b')} AS ic FROM (SELECT *, CASE WHEN y IS NOT NULL THEN score END AS a, CASE WHEN score IS NOT NULL THEN y END AS b FROM z WHERE c >= 3) GROUP BY 1, 2, 3)
    SELECT * FROM (SELECT horizon, segment, count(z) AS n, avg(z) AS mean, stddev_samp(z) AS std FROM z GROUP BY 1, 2) JOIN (SELECT horizon, segment, avg(ic) AS ic_mean FROM i GROUP BY 1, 2) USING (horizon, segment)""",
)
def label_delta(spark, sf_dir):
    df = X.features(T.panel(spark, sf_dir), {"score": "Mean($close,5)/$close", "h2": "Ref($close,-2)/$close-1", "h5": "Ref($close,-5)/$close-1"})
    seg = spark.createDataFrame([("train", dt.date(1990, 1, 1), dt.date(1998, 12, 31)), ("valid", dt.date(1999, 1, 1), dt.date(2010, 1, 1))], "segment string, start date, end date")
    return E.label_delta(df, ["h2", "h5"], seg)
