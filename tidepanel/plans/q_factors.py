"""Factor sets and labels."""

from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import factors as A
from tidepanel.operators.scale import bounded
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query

KEY = "instrument:s datetime:d "
P = "(PARTITION BY instrument ORDER BY datetime)"


def frame(d):
    return f"(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


_LAGS = A.lag_factors()


def _lag_sql():
    out = []
    for f in ("close", "open", "high", "low", "vwap"):
        out += [f"lag({f}, {i}) OVER p / close AS {f.upper()}{i}" if i else f"{f} / close AS {f.upper()}0" for i in range(60)]
    out += [f"lag(volume, {i}) OVER p / (volume + 1e-12) AS VOLUME{i}" if i else "volume / (volume + 1e-12) AS VOLUME0" for i in range(60)]
    return ", ".join(out)


@query("f360_lags", KEY + " ".join(f"{n}:f" for n in _LAGS), f"WITH {T.PANEL} SELECT instrument, datetime, {_lag_sql()} FROM panel WINDOW p AS {P}")
def f360_lags(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), _LAGS)


_KBAR_SQL = """(close - open) / open AS KMID, (high - low) / open AS KLEN, (close - open) / (high - low + 1e-12) AS KMID2,
 (high - greatest(open, close)) / open AS KUP, (high - greatest(open, close)) / (high - low + 1e-12) AS KUP2,
 (least(open, close) - low) / open AS KLOW, (least(open, close) - low) / (high - low + 1e-12) AS KLOW2,
 (2 * close - high - low) / open AS KSFT, (2 * close - high - low) / (high - low + 1e-12) AS KSFT2"""


@query("f158_kbar", KEY + " ".join(f"{n}:f" for n in A.KBAR), f"WITH {T.PANEL} SELECT instrument, datetime, {_KBAR_SQL} FROM panel")
def f158_kbar(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), A.KBAR)


_PRICE = A.price_factors(lags=(0, 1), volume_lags=(0, 1))


@query(
    "f158_price",
    KEY + " ".join(f"{n}:f" for n in _PRICE),
    f"""WITH {T.PANEL} SELECT instrument, datetime, {', '.join(f'{f} / close AS {f.upper()}0, lag({f}) OVER p / close AS {f.upper()}1' for f in ('open', 'high', 'low', 'vwap'))},
    volume / (volume + 1e-12) AS VOLUME0, lag(volume) OVER p / (volume + 1e-12) AS VOLUME1 FROM panel WINDOW p AS {P}""",
)
def f158_price(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), _PRICE)


_CORR = "CASE WHEN NOT coalesce(stddev_samp({a}) OVER w{d} <= 2e-5 OR stddev_samp({b}) OVER w{d} <= 2e-5, false) AND stddev_samp({x}) OVER w{d} > 0 AND stddev_samp({y}) OVER w{d} > 0 THEN corr({x}, {y}) OVER w{d} END"
_IDX = "coalesce(list_position(list_transform(list({f}) OVER w{d}, lambda v : v IS NULL), true), list_position(list({f}) OVER w{d}, {m}({f}) OVER w{d}))"
_HI = _IDX.replace("{f}", "high").replace("{m}", "max")
_LO = _IDX.replace("{f}", "low").replace("{m}", "min")
_ROLL_SQL = {
    "ROC": "lag(close, {d}) OVER p / close",
    "MA": "avg(close) OVER w{d} / close",
    "STD": "stddev_samp(close) OVER w{d} / close",
    "BETA": "CASE WHEN count(close) OVER w{d} > 1 THEN regr_slope(close, cal_ix) OVER w{d} END / close",
    "RSQR": "CASE WHEN stddev_samp(close) OVER w{d} > 2e-5 THEN regr_r2(close, cal_ix) OVER w{d} END",
    "RESI": "CASE WHEN count(close) OVER w{d} > 1 THEN close - (regr_intercept(close, cal_ix) OVER w{d} + regr_slope(close, cal_ix) OVER w{d} * cal_ix) END / close",
    "MAX": "max(high) OVER w{d} / close",
    "MIN": "min(low) OVER w{d} / close",
    "QTLU": "quantile_cont(close, 0.8) OVER w{d} / close",
    "QTLD": "quantile_cont(close, 0.2) OVER w{d} / close",
    "RANK": "CASE WHEN close IS NOT NULL THEN (len(list_filter(vs{d}, lambda v : v < close)) + (len(list_filter(vs{d}, lambda v : v = close)) + 1) / 2.0::DOUBLE) / len(list_filter(vs{d}, lambda v : v IS NOT NULL)) END",
    "RSV": "(close - min(low) OVER w{d}) / (max(high) OVER w{d} - min(low) OVER w{d} + 1e-12)",
    "IMAX": f"{_HI} / {{d}}",
    "IMIN": f"{_LO} / {{d}}",
    "IMXD": f"({_HI} - {_LO}) / {{d}}",
    "CORR": _CORR.format(a="close", b="lv", x="close", y="lv", d="{d}"),
    "CORD": _CORR.format(a="rc", b="rv", x="CASE WHEN rv IS NOT NULL THEN rc END", y="CASE WHEN rc IS NOT NULL THEN rv END", d="{d}"),
    "CNTP": "avg(up) OVER w{d}",
    "CNTN": "avg(dn) OVER w{d}",
    "CNTD": "avg(up) OVER w{d} - avg(dn) OVER w{d}",
    "SUMP": "sum(greatest(dc, 0)) OVER w{d} / (sum(abs(dc)) OVER w{d} + 1e-12)",
    "SUMN": "sum(greatest(-dc, 0)) OVER w{d} / (sum(abs(dc)) OVER w{d} + 1e-12)",
    "SUMD": "(sum(greatest(dc, 0)) OVER w{d} - sum(greatest(-dc, 0)) OVER w{d}) / (sum(abs(dc)) OVER w{d} + 1e-12)",
    "VMA": "avg(volume) OVER w{d} / (volume + 1e-12)",
    "VSTD": "stddev_samp(volume) OVER w{d} / (volume + 1e-12)",
    "WVMA": "stddev_samp(wv) OVER w{d} / (avg(wv) OVER w{d} + 1e-12)",
    "VSUMP": "sum(greatest(dv, 0)) OVER w{d} / (sum(abs(dv)) OVER w{d} + 1e-12)",
    "VSUMN": "sum(greatest(-dv, 0)) OVER w{d} / (sum(abs(dv)) OVER w{d} + 1e-12)",
    "VSUMD": "(sum(greatest(dv, 0)) OVER w{d} - sum(greatest(-dv, 0)) OVER w{d}) / (sum(abs(dv)) OVER w{d} + 1e-12)",
}
_ROLL = A.rolling_factors()


def _rolling_sql(names=tuple(_ROLL_SQL), windows=A.WINDOWS):
    # greatest skips nulls in DuckDB, so the steps keep their null
    cols = [f"{s.format(d=d).replace('greatest(dc, 0)', 'dc_up').replace('greatest(-dc, 0)', 'dc_dn').replace('greatest(dv, 0)', 'dv_up').replace('greatest(-dv, 0)', 'dv_dn')} AS {n}{d}" for n, s in _ROLL_SQL.items() if n in names for d in windows]
    wins = ", ".join(f"w{d} AS {frame(d)}" for d in windows)
    return f"""WITH {T.PANEL}, s0 AS (SELECT *, lag(close) OVER p AS pc, lag(volume) OVER p AS pv FROM panel WINDOW p AS {P}),
    s1 AS (SELECT *, ln(volume + 1) AS lv, close / pc AS rc, ln(volume / pv + 1) AS rv, CAST(coalesce(close > pc, false) AS INT) AS up, CAST(coalesce(close < pc, false) AS INT) AS dn,
     close - pc AS dc, CASE WHEN close - pc IS NOT NULL THEN greatest(close - pc, 0) END AS dc_up, CASE WHEN close - pc IS NOT NULL THEN greatest(pc - close, 0) END AS dc_dn,
     volume - pv AS dv, CASE WHEN volume - pv IS NOT NULL THEN greatest(volume - pv, 0) END AS dv_up, CASE WHEN volume - pv IS NOT NULL THEN greatest(pv - volume, 0) END AS dv_dn, abs(close / pc - 1) * volume AS wv FROM s0),
    s2 AS (SELECT *, {', '.join(f'list(close) OVER w{d} AS vs{d}' for d in windows)} FROM s1 WINDOW {wins})
    SELECT instrument, datetime, {', '.join(cols)} FROM s2 WINDOW p AS {P}, {wins}"""


@query("f158_rolling", KEY + " ".join(f"{n}:f5" for n in _ROLL), _rolling_sql())
def f158_rolling(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir).drop("open", "vwap"), _ROLL)


# the 14-factor data set of the published timing
_FOURTEEN = ("ROC", "MA", "STD", "BETA", "RSQR", "RESI", "MAX", "MIN", "QTLU", "QTLD", "RANK", "RSV", "CORR", "CORD")
_DATASET = A.rolling_factors((10,), _FOURTEEN)


@query("dataset_build", KEY + " ".join(f"{n}:f5" for n in _DATASET), _rolling_sql(_FOURTEEN, (10,)))
def dataset_build(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir).drop("open", "vwap"), _DATASET)


@query(
    "label_forward",
    KEY + "label:f label_vwap:f",
    f"WITH {T.PANEL} SELECT instrument, datetime, lead(close, 2) OVER p / lead(close, 1) OVER p - 1 AS label, lead(vwap, 2) OVER p / lead(vwap, 1) OVER p - 1 AS label_vwap FROM panel WINDOW p AS {P}",
)
def label_forward(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), {"label": A.label_forward(), "label_vwap": A.label_forward("vwap")})


def _paused(df):
    return df.withColumn("paused_num", F.when(F.coalesce(F.col("volume"), F.lit(0.0)) > 20, 2.0).otherwise(1.0))


_FFC = "last_value({c} IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DAYL = "last_value({c} IGNORE NULLS) OVER (PARTITION BY instrument, CAST(datetime AS DATE) ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _hf_sql(fields, extra="", source="hours"):
    steps, outs = [], []
    for f in fields:
        for s, tail in ((0, ""), (24, "_1")):
            px = f"coalesce({f}, close)"
            px = f"lag({px}, {s}) OVER p" if s else px
            steps.append(f"{px} / base AS r_{f}{tail}")
            outs.append(f"CASE WHEN live THEN {_FFC.format(c=f'r_{f}{tail}')} END AS {f}{tail}")
    return f"""h0 AS (SELECT *, coalesce(volume, 0) > 20 AS live, {_FFC.format(c='close')} AS fc, avg(volume) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) AS mv FROM {source}),
    h1 AS (SELECT *, lag(fc, 27) OVER p AS lc, {_DAYL.format(c='mv')} AS dmv FROM h0 WINDOW p AS {P}),
    h2 AS (SELECT *, {_DAYL.format(c='lc')} AS base, lag(dmv, 24) OVER p AS bv, lag(volume, 24) OVER p AS v1 FROM h1 WINDOW p AS {P}),
    h3 AS (SELECT *, {', '.join(steps)} FROM h2 WINDOW p AS {P})
    SELECT instrument, datetime, {', '.join(outs)}, CASE WHEN live AND volume / bv >= 0 THEN volume / bv ELSE 0 END AS volume, CASE WHEN live AND v1 / bv >= 0 THEN v1 / bv ELSE 0 END AS volume_1{extra} FROM h3"""


@query("hf_norm_features", "instrument:s datetime:t open:f open_1:f close:f close_1:f volume:f volume_1:f", f"WITH {T.HOURS}, {_hf_sql(('open', 'close'))}")
def hf_norm_features(spark, sf_dir):
    return X.features(_paused(T.hours(spark, sf_dir)), A.intraday_features(("open", "close"), 24, 72))


_BA = "qh AS (SELECT *, low AS bid, high AS ask FROM hours)"


@query("hf_order_features", "instrument:s datetime:t close:f close_1:f bid:f bid_1:f ask:f ask_1:f volume:f volume_1:f", f"WITH {T.HOURS}, {_BA}, {_hf_sql(('close', 'bid', 'ask'), source='qh')}")
def hf_order_features(spark, sf_dir):
    df = _paused(T.hours(spark, sf_dir)).withColumns({"bid": F.col("low"), "ask": F.col("high")})
    return X.features(df, A.intraday_features(("close", "bid", "ask"), 24, 72))


@query(
    "hf_backtest_fields",
    "instrument:s datetime:t close0:f vwap0:f volume0:f median0:f",
    f"""WITH {T.HOURS}, {_BA}, l AS (SELECT *, coalesce(volume, 0) > 20 AS live, {_FFC.format(c='close')} AS fc, CASE WHEN coalesce(volume, 0) > 20 THEN close END AS lc FROM qh)
    SELECT instrument, datetime, {_FFC.format(c='lc')} AS close0, CASE WHEN live THEN coalesce(vwap, fc) END AS vwap0, CASE WHEN live THEN coalesce(volume, 0) END AS volume0, CASE WHEN live THEN coalesce((bid + ask) / 2, 0) END AS median0 FROM l""",
)
def hf_backtest_fields(spark, sf_dir):
    df = _paused(T.hours(spark, sf_dir)).withColumns({"bid": F.col("low"), "ask": F.col("high")})
    return X.features(df, A.intraday_quotes(("volume",), ("bid", "ask")))


_MF = ", ".join(
    f"CASE WHEN count(*) OVER w{n} = {n} THEN ln(1 + avg(money) OVER w{n}) END AS log_mean_money_{n}, CASE WHEN count(*) OVER w{n} = {n} THEN ln(1 + quantile_cont(money, 0.5) OVER w{n}) END AS log_median_money_{n}, "
    f"close / lag(close, {n}) OVER p - 1 AS momentum_{n}, CASE WHEN count(r) OVER w{n} = {n} THEN stddev_samp(r) OVER w{n} * sqrt(252) END AS volatility_{n}"
    for n in (20, 60)
)


@query(
    "market_features",
    KEY + "log_close:f age_years:f " + " ".join(f"{c}_{n}:f" for n in (20, 60) for c in ("log_mean_money", "log_median_money", "momentum", "volatility")),
    f"""WITH {T.BARS}, m AS (SELECT *, vwap * volume AS money, close / lag(close) OVER {P} - 1 AS r FROM bars WHERE close > 0 AND vwap IS NOT NULL AND volume IS NOT NULL)
    SELECT instrument, datetime, ln(close) AS log_close, row_number() OVER p / 252 AS age_years, {_MF} FROM m WINDOW p AS {P}, w20 AS {frame(20)}, w60 AS {frame(60)}""",
)
def market_features(spark, sf_dir):
    return A.market_features(T.bars(spark, sf_dir))


_G = f"{T.PRED}, {T.GROUPS}, g AS (SELECT p.*, industry, sector FROM pred p JOIN groups USING (instrument))"


def _pct(x, by):
    return f"CASE WHEN {x} IS NOT NULL THEN {T.avg_rank(x, by)} / count({x}) OVER (PARTITION BY {by}) END"


@query("relative_rank", KEY + "sector:s group_size:i pct:f", f"WITH {_G} SELECT instrument, datetime, sector, count(*) OVER s AS group_size, CASE WHEN count(*) OVER s >= 18 THEN {_pct('score', 'datetime, sector')} END AS pct FROM g WINDOW s AS (PARTITION BY datetime, sector)")
def relative_rank(spark, sf_dir):
    df = T.pred(spark, sf_dir).join(T.groups(spark, sf_dir), "instrument")
    return A.relative_rank(df, "sector", "score", 18, T.bounds(spark, sf_dir))


@query(
    "industry_features",
    KEY + "industry_size:i sector_size:i used_sector:f industry_rank:f industry_pct:f sector_pct:f",
    f"""WITH {_G}, s AS (SELECT *, count(*) OVER (PARTITION BY datetime, industry) AS industry_size, count(*) OVER (PARTITION BY datetime, sector) AS sector_size FROM g),
    e AS (SELECT *, CASE WHEN industry_size < 5 THEN sector ELSE industry END AS eff FROM s)
    SELECT instrument, datetime, industry_size, sector_size, CAST(industry_size < 5 AS INT) AS used_sector, CASE WHEN score IS NOT NULL THEN {T.avg_rank('score', 'datetime, eff')} END AS industry_rank, {_pct('score', 'datetime, eff')} AS industry_pct, {_pct('score', 'datetime, sector')} AS sector_pct FROM e""",
)
def industry_features(spark, sf_dir):
    df = T.pred(spark, sf_dir).join(T.groups(spark, sf_dir), "instrument")
    return A.industry_features(df, "score", 5, T.bounds(spark, sf_dir))


def _period(k):
    return f"latest / CASE WHEN n <= {k} THEN first_close ELSE c{k} END - 1"


_SCORE = " + ".join(f"coalesce({_pct(c, 'one')} * 100, 0) * {w}::DOUBLE" for c, w in A.SCORE_WEIGHTS.items())


@query(
    "composite_score",
    "instrument:s ret_12m:f ret_6m:f vol_3m:f max_drawdown_1y:f score:f",
    f"""WITH {T.BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime DESC) AS rn FROM bars),
    l AS (SELECT *, close / lag(close) OVER {P} - 1 AS ret, close / max(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM r WHERE rn <= 252),
    f AS (SELECT instrument, arg_min(close, datetime) AS first_close, count(*) AS n FROM bars GROUP BY 1),
    a AS (SELECT instrument, 1 AS one, max(close) FILTER (WHERE rn = 1) AS latest, {', '.join(f'max(close) FILTER (WHERE rn = {k}) AS c{k}' for k in (21, 63, 126, 252))}, avg(close) FILTER (WHERE rn <= 200) AS ma200,
     CASE WHEN count(ret) FILTER (WHERE rn <= 63) > 5 THEN stddev_samp(ret) FILTER (WHERE rn <= 63) * sqrt(252) END AS vol_3m, min(dd) AS max_drawdown_1y FROM l GROUP BY 1),
    b AS (SELECT *, {_period(252)} AS ret_12m, {_period(126)} AS ret_6m, {_period(63)} AS ret_3m, {_period(21)} AS ret_1m, latest / ma200 - 1 AS ma200_gap FROM a JOIN f USING (instrument)),
    c AS (SELECT *, ret_12m - ret_1m AS ret_12m_ex_1m, ret_6m / nullif(vol_3m, 0) AS risk_adjusted_6m FROM b) SELECT *, {_SCORE} AS score FROM c""",
)
def composite_score(spark, sf_dir):
    return A.composite_score(A.latest_price_features(T.bars(spark, sf_dir)), T.bounds(spark, sf_dir))


@query(
    "symbol_risk",
    KEY + "vol_60:f drawdown_60:f beta_120:f",
    f"""WITH {T.BARS}, bench AS (SELECT datetime, close / lag(close) OVER (ORDER BY datetime) - 1 AS bench FROM bars WHERE instrument = '0'),
    j AS (SELECT b.*, bench, close / lag(close) OVER {P.replace('instrument', 'b.instrument').replace('datetime', 'b.datetime')} - 1 AS ret FROM bars b LEFT JOIN bench USING (datetime)),
    m AS (SELECT *, CASE WHEN ret IS NOT NULL THEN bench END AS x, CASE WHEN bench IS NOT NULL THEN ret END AS y, row_number() OVER {P} AS rn FROM j),
    dd AS (SELECT c.instrument, c.datetime, min(c.close / c.top - 1) AS drawdown_60 FROM (SELECT a.instrument, a.datetime, b.close, max(b.close) OVER (PARTITION BY a.instrument, a.datetime ORDER BY b.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top
      FROM m a JOIN m b ON a.instrument = b.instrument AND b.rn BETWEEN a.rn - 59 AND a.rn) c GROUP BY 1, 2)
    SELECT instrument, datetime, CASE WHEN count(ret) OVER w60 > 1 THEN stddev_samp(ret) OVER w60 * sqrt(252) END AS vol_60, drawdown_60,
    CASE WHEN count(x) OVER w120 >= 20 AND var_samp(x) OVER w120 > 1e-9 THEN covar_samp(y, x) OVER w120 / var_samp(x) OVER w120 END AS beta_120 FROM m JOIN dd USING (instrument, datetime) WINDOW w60 AS {frame(60)}, w120 AS {frame(120)}""",
)
def symbol_risk(spark, sf_dir):
    bars = T.bars(spark, sf_dir)
    bench = X.features(T.bars(spark, sf_dir).where("instrument = '0'").join(bounded(T.calendar(spark, sf_dir), T.bounds(spark, sf_dir).dates), "datetime"), {"bench": "$close/Ref($close,1)-1"})
    return A.symbol_risk(bars, bench.select("datetime", "bench"), T.bounds(spark, sf_dir).dates)


@query(
    "regime_label",
    "datetime:d level:s trend:s flag:s",
    f"""WITH {T.BARS}, d AS (SELECT datetime, avg(close) AS m, sum(volume) AS v FROM bars GROUP BY 1), e AS (SELECT *, m - lag(m, 4) OVER (ORDER BY datetime) AS ch, v > lag(v, 4) OVER (ORDER BY datetime) AS f FROM d), q AS (SELECT quantile_cont(m, 0.3) AS lo, quantile_cont(m, 0.7) AS hi FROM d)
    SELECT datetime, CASE WHEN m IS NULL THEN 'unknown' WHEN m >= hi THEN 'high' WHEN m <= lo THEN 'low' ELSE 'mid' END AS level, CASE WHEN ch IS NULL THEN 'unknown' WHEN ch > 0 THEN 'up' ELSE 'down' END AS trend, CASE WHEN f IS NULL THEN 'unknown' WHEN f THEN 'yes' ELSE 'no' END AS flag FROM e, q""",
)
def regime_label(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.orderBy("datetime")
    d = T.bars(spark, sf_dir).groupBy("datetime").agg(F.avg("close").alias("m"), F.sum("volume").alias("v"))
    # one row per date
    d = d.withColumns({"ch": F.col("m") - F.lag("m", 4).over(w), "f": F.col("v") > F.lag("v", 4).over(w)})
    return A.regime_label(d, "m", "ch", "f")


@query(
    "vol_signal",
    KEY + "trend:f5 volatility:f5",
    f"""WITH {T.PANEL}, r AS (SELECT *, ln(close / lag(close) OVER {P}) AS r FROM panel), v AS (SELECT instrument, datetime, cal_ix, close, sum(r * r) OVER w / 9 - pow(sum(r) OVER w, 2) / 90 AS v FROM r WINDOW w AS {frame(10)}),
    e AS (SELECT a.instrument, a.cal_ix, sum(pow(9 / 11.0::DOUBLE, a.cal_ix - b.cal_ix) * b.close) / sum(CASE WHEN b.close IS NOT NULL THEN pow(9 / 11.0::DOUBLE, a.cal_ix - b.cal_ix) END)
     - sum(pow(19 / 21.0::DOUBLE, a.cal_ix - b.cal_ix) * b.close) / sum(CASE WHEN b.close IS NOT NULL THEN pow(19 / 21.0::DOUBLE, a.cal_ix - b.cal_ix) END) AS trend FROM panel a JOIN panel b ON a.instrument = b.instrument AND b.cal_ix <= a.cal_ix GROUP BY 1, 2)
    SELECT instrument, datetime, trend, CASE WHEN v >= 0 THEN sqrt(v) END AS volatility FROM v JOIN e USING (instrument, cal_ix)""",
)
def vol_signal(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), {"trend": A.trend_signal(), "volatility": A.volatility_signal(10)})
