"""Factor sets as expression tables, and factors of the study kind (full windows, ranks in groups)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.functions.elem import try_ratio
from tidepanel.operators.scale import Bounds, attach_stats, bounded, exact_quantiles, xs_order

WINDOWS = (5, 10, 20, 30, 60)

# fixed values: the bar-shape factors
KBAR = {
    "KMID": "($close-$open)/$open",
    "KLEN": "($high-$low)/$open",
    "KMID2": "($close-$open)/($high-$low+1e-12)",
    "KUP": "($high-Greater($open,$close))/$open",
    "KUP2": "($high-Greater($open,$close))/($high-$low+1e-12)",
    "KLOW": "(Less($open,$close)-$low)/$open",
    "KLOW2": "(Less($open,$close)-$low)/($high-$low+1e-12)",
    "KSFT": "(2*$close-$high-$low)/$open",
    "KSFT2": "(2*$close-$high-$low)/($high-$low+1e-12)",
}

# fixed values: the rolling families, {d} is the window
ROLLING = {
    "ROC": "Ref($close,{d})/$close",
    "MA": "Mean($close,{d})/$close",
    "STD": "Std($close,{d})/$close",
    "BETA": "Slope($close,{d})/$close",
    "RSQR": "Rsquare($close,{d})",
    "RESI": "Resi($close,{d})/$close",
    "MAX": "Max($high,{d})/$close",
    "MIN": "Min($low,{d})/$close",
    "QTLU": "Quantile($close,{d},0.8)/$close",
    "QTLD": "Quantile($close,{d},0.2)/$close",
    "RANK": "Rank($close,{d})",
    "RSV": "($close-Min($low,{d}))/(Max($high,{d})-Min($low,{d})+1e-12)",
    "IMAX": "IdxMax($high,{d})/{d}",
    "IMIN": "IdxMin($low,{d})/{d}",
    "IMXD": "(IdxMax($high,{d})-IdxMin($low,{d}))/{d}",
    "CORR": "Corr($close,Log($volume+1),{d})",
    "CORD": "Corr($close/Ref($close,1),Log($volume/Ref($volume,1)+1),{d})",
    "CNTP": "Mean($close>Ref($close,1),{d})",
    "CNTN": "Mean($close<Ref($close,1),{d})",
    "CNTD": "Mean($close>Ref($close,1),{d})-Mean($close<Ref($close,1),{d})",
    "SUMP": "Sum(Greater($close-Ref($close,1),0),{d})/(Sum(Abs($close-Ref($close,1)),{d})+1e-12)",
    "SUMN": "Sum(Greater(Ref($close,1)-$close,0),{d})/(Sum(Abs($close-Ref($close,1)),{d})+1e-12)",
    "SUMD": "(Sum(Greater($close-Ref($close,1),0),{d})-Sum(Greater(Ref($close,1)-$close,0),{d}))/(Sum(Abs($close-Ref($close,1)),{d})+1e-12)",
    "VMA": "Mean($volume,{d})/($volume+1e-12)",
    "VSTD": "Std($volume,{d})/($volume+1e-12)",
    "WVMA": "Std(Abs($close/Ref($close,1)-1)*$volume,{d})/(Mean(Abs($close/Ref($close,1)-1)*$volume,{d})+1e-12)",
    "VSUMP": "Sum(Greater($volume-Ref($volume,1),0),{d})/(Sum(Abs($volume-Ref($volume,1)),{d})+1e-12)",
    "VSUMN": "Sum(Greater(Ref($volume,1)-$volume,0),{d})/(Sum(Abs($volume-Ref($volume,1)),{d})+1e-12)",
    "VSUMD": "(Sum(Greater($volume-Ref($volume,1),0),{d})-Sum(Greater(Ref($volume,1)-$volume,0),{d}))/(Sum(Abs($volume-Ref($volume,1)),{d})+1e-12)",
}


def lag_factors(lags=60):
    """Price and volume lags over the current close and volume."""
    out = {}
    for f in ("close", "open", "high", "low", "vwap"):
        for i in range(lags - 1, 0, -1):
            out[f"{f.upper()}{i}"] = f"Ref(${f},{i})/$close"
        out[f"{f.upper()}0"] = f"${f}/$close"
    for i in range(lags - 1, 0, -1):
        out[f"VOLUME{i}"] = f"Ref($volume,{i})/($volume+1e-12)"
    out["VOLUME0"] = "$volume/($volume+1e-12)"
    return out


def price_factors(fields=("open", "high", "low", "vwap"), lags=(0,), volume_lags=()):
    out = {f"{f.upper()}{i}": f"Ref(${f},{i})/$close" if i else f"${f}/$close" for f in fields for i in lags}
    out.update({f"VOLUME{i}": f"Ref($volume,{i})/($volume+1e-12)" if i else "$volume/($volume+1e-12)" for i in volume_lags})
    return out


def rolling_factors(windows=WINDOWS, include=None, exclude=()):
    names = [n for n in ROLLING if (include is None or n in include) and n not in exclude]
    return {f"{n}{d}": ROLLING[n].format(d=d) for n in names for d in windows}


def label_forward(field="close"):
    return f"Ref(${field},-2)/Ref(${field},-1)-1"


_LIVE = "Select($paused_num>1.001,{0})"


def intraday_price(field, shift, day_rows, lead=3):
    """Price over the last close of the day before, filled forward, paused rows out."""
    px = f"If(IsNull({field}),$close,{field})"
    px = f"Ref({px},{shift})" if shift else px
    return _LIVE.format(f"FFillNan({px}/DayLast(Ref(FFillNan($close),{day_rows + lead})))")


def intraday_volume(shift, day_rows, mean_rows):
    """Volume over the mean volume as known on the day before; missing and negative become 0."""
    v = f"Ref($volume,{shift})" if shift else "$volume"
    r = f"{v}/Ref(DayLast(Mean($volume,{mean_rows})),{day_rows})"
    live = _LIVE.format(f"If(IsNull({r}),0,{r})")
    return f"If({live}>=0,{live},0)"


def intraday_features(fields, day_rows=240, mean_rows=7200):
    out = {}
    for shift in (0, day_rows):
        tail = "_1" if shift else ""
        out.update({f"{f}{tail}": intraday_price(f"${f}", shift, day_rows) for f in fields})
        out[f"volume{tail}"] = intraday_volume(shift, day_rows, mean_rows)
    return out


def intraday_quotes(fields=("volume",), mid=None):
    """Quote fields for execution: filled close, vwap with the filled close behind it, the rest 0 where missing."""
    out = {"close0": f"FFillNan({_LIVE.format('$close')})", "vwap0": _LIVE.format("If(IsNull($vwap),FFillNan($close),$vwap)")}
    for f in fields:
        out[f"{f}0"] = _LIVE.format(f"If(IsNull(${f}),0,${f})")
    if mid:
        m = f"(${mid[0]}+${mid[1]})/2"
        out["median0"] = _LIVE.format(f"If(IsNull({m}),0,{m})")
    return out


def trend_signal(fast=10, slow=20):
    return f"EMA($close,{fast})-EMA($close,{slow})"


def volatility_signal(n):
    r = "Log($close/Ref($close,1))"
    return f"Power(Sum(Power({r},2),{n})/{n - 1}-Power(Sum({r},{n}),2)/({n}*{n - 1}),0.5)"


def market_features(bars, windows=(20, 60), year=252):
    """Log close, money volume, momentum, volatility over full windows, and age; rows without a price are left out."""
    df = bars.where("close > 0 AND vwap IS NOT NULL AND volume IS NOT NULL")
    w = Window.partitionBy("instrument").orderBy("datetime")
    df = df.withColumns(
        {
            "money": F.col("vwap") * F.col("volume"),
            "log_close": F.ln("close"),
            "age_rows": F.row_number().over(w).cast("double"),
            "__r": F.col("close") / F.lag("close").over(w) - 1,
        }
    )
    out = {"age_years": F.col("age_rows") / year}
    for n in windows:
        f = w.rowsBetween(-(n - 1), 0)
        full = F.count(F.lit(1)).over(f) == n
        out[f"log_mean_money_{n}"] = F.when(full, F.log1p(F.avg("money").over(f)))
        out[f"log_median_money_{n}"] = F.when(full, F.log1p(F.percentile("money", F.lit(0.5)).over(f)))
        out[f"momentum_{n}"] = F.col("close") / F.lag("close", n).over(w) - 1
        out[f"volatility_{n}"] = F.when(F.count("__r").over(f) == n, F.stddev_samp("__r").over(f) * year**0.5)
    return df.withColumns(out).drop("__r")


def relative_rank(df, group, value, min_size=3, bounds=Bounds()):
    """Percentile rank inside (date, group); null in small groups."""
    known = df.where(F.col(group).isNotNull())
    r = xs_order(known, ["datetime", group], value, "instrument", "__v", Bounds(None, bounds.names), number=False)
    r = attach_stats(r, ["datetime", group], {"group_size": F.count(F.lit(1))})
    pct = F.col("__v_avg") / F.when(F.col("__v_n") > 0, F.col("__v_n"))
    return r.withColumn("pct", F.when(F.col("group_size") >= min_size, pct)).drop("__v_avg", "__v_n")


def industry_features(df, value, min_size=5, bounds=Bounds()):
    """Ranks in the industry, or in the sector where the industry is small."""
    df = attach_stats(df, ["datetime", "industry"], {"industry_size": F.count(F.lit(1))})
    df = attach_stats(df, ["datetime", "sector"], {"sector_size": F.count(F.lit(1))})
    small = F.col("industry_size") < min_size
    df = df.withColumns({"used_sector": small.cast("double"), "effective": F.when(small, F.col("sector")).otherwise(F.col("industry"))})
    b = Bounds(None, bounds.names)
    df = xs_order(df, ["datetime", "effective"], value, "instrument", "__e", b, number=False)
    df = xs_order(df, ["datetime", "sector"], value, "instrument", "__s", b, number=False)
    return df.withColumns(
        {
            "industry_rank": F.col("__e_avg"),
            "industry_pct": F.col("__e_avg") / F.when(F.col("__e_n") > 0, F.col("__e_n")),
            "sector_pct": F.col("__s_avg") / F.when(F.col("__s_n") > 0, F.col("__s_n")),
        }
    ).drop("__e_avg", "__e_n", "__s_avg", "__s_n")


# fixed values: weights of the composite score
SCORE_WEIGHTS = {"ret_12m_ex_1m": 0.30, "ret_6m": 0.20, "ret_3m": 0.15, "ma200_gap": 0.15, "risk_adjusted_6m": 0.10, "max_drawdown_1y": 0.10}


def latest_price_features(bars):
    """Period returns, drawdown, volatility and average gap at the latest row of each instrument.

    Only the last 252 rows per instrument are read into the arrays.
    """
    w = Window.partitionBy("instrument").orderBy(F.col("datetime").desc())
    last = bars.where("close IS NOT NULL").withColumn("__rn", F.row_number().over(w))
    # the first close matters only for short histories
    first = bars.where("close IS NOT NULL").groupBy("instrument").agg(F.min_by("close", "datetime").alias("first_close"), F.count(F.lit(1)).alias("n"))
    last = last.where("__rn <= 252")
    line = Window.partitionBy("instrument").orderBy("datetime")
    last = last.withColumns(
        {
            "__ret": F.col("close") / F.lag("close").over(line) - 1,
            "__dd": F.col("close") / F.max("close").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1,
        }
    )

    def at(k):
        return F.max(F.when(F.col("__rn") == k, F.col("close")))

    agg = last.groupBy("instrument").agg(
        at(1).alias("latest"),
        *[at(k).alias(f"c{k}") for k in (21, 63, 126, 252)],
        F.avg(F.when(F.col("__rn") <= 200, F.col("close"))).alias("ma200"),
        F.stddev_samp(F.when(F.col("__rn") <= 63, F.col("__ret"))).alias("sd"),
        F.count(F.when(F.col("__rn") <= 63, F.col("__ret"))).alias("sd_n"),
        F.min("__dd").alias("max_drawdown_1y"),
    ).join(first, "instrument")

    def period(k):
        base = F.when(F.col("n") <= k, F.col("first_close")).otherwise(F.col(f"c{k}"))
        return F.col("latest") / F.when(base != 0, base) - 1

    out = agg.withColumns({"ret_12m": period(252), "ret_6m": period(126), "ret_3m": period(63), "ret_1m": period(21)})
    vol = F.when(F.col("sd_n") > 5, F.col("sd") * 252**0.5)
    return out.withColumns(
        {
            "ret_12m_ex_1m": F.col("ret_12m") - F.col("ret_1m"),
            "vol_3m": vol,
            "ma200_gap": F.col("latest") / F.col("ma200") - 1,
            "risk_adjusted_6m": F.col("ret_6m") / F.when(vol != 0, vol),
        }
    )


def composite_score(features, bounds=Bounds()):
    df = features.withColumn("__all", F.lit(0))
    score = F.lit(0.0)
    for c, weight in SCORE_WEIGHTS.items():
        df = xs_order(df, ["__all"], c, "instrument", f"__{c}", Bounds(1, bounds.names), number=False)
        score = score + F.coalesce(F.col(f"__{c}_avg") / F.when(F.col(f"__{c}_n") > 0, F.col(f"__{c}_n")) * 100, F.lit(0.0)) * weight
    return df.withColumn("score", score).select(*features.columns, "score")


def trailing_drawdown(df, w, value, rows, name):
    """Deepest fall below an earlier value within the last ``rows`` rows, 0 where there is none.

    Top, bottom and fall of 1, 2, 4, ... rows come from two neighbouring blocks of half the rows: the deepest fall lies in one of them
    or leads from the top of the older to the bottom of the newer. A row costs the logarithm of ``rows``, and no list is made.
    """
    here = lambda n: (F.col(f"__top{n}"), F.col(f"__low{n}"), F.col(f"__fall{n}"))
    earlier = lambda n, k: tuple(F.lag(c, k).over(w) for c in here(n))

    def merge(new, old):
        across = new[1] / F.when(old[0] > 0, old[0]) - 1
        return F.greatest(new[0], old[0]), F.least(new[1], old[1]), F.least(new[2], old[2], across)

    out = df.withColumns({"__top1": F.col(value), "__low1": F.col(value), "__fall1": F.lit(0.0)})
    made, size = ["__top1", "__low1", "__fall1"], 1
    while 2 * size <= rows:
        names = [f"__{k}{2 * size}" for k in ("top", "low", "fall")]
        out = out.withColumns(dict(zip(names, merge(here(size), earlier(size, size)))))
        made, size = made + names, 2 * size
    total, done = here(size), size
    while done < rows:
        size = 1 << (rows - done).bit_length() - 1
        total, done = merge(total, earlier(size, done)), done + size
    return out.withColumn(name, total[2]).drop(*made)


def symbol_risk(panel, benchmark, calendar_rows=None):
    """Trailing volatility (60), drawdown (60) and beta (120 rows) on every date. ``benchmark``: (datetime, bench)."""
    df = panel.where("close IS NOT NULL").join(bounded(benchmark, calendar_rows), "datetime", "left")
    w = Window.partitionBy("instrument").orderBy("datetime")
    df = df.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    f60, f120 = w.rowsBetween(-59, 0), w.rowsBetween(-119, 0)
    x = F.when(F.col("ret").isNotNull(), F.col("bench"))
    y = F.when(F.col("bench").isNotNull(), F.col("ret"))
    var = F.var_samp(x).over(f120)
    return trailing_drawdown(df, w, "close", 60, "drawdown_60").withColumns(
        {
            "vol_60": F.when(F.count("ret").over(f60) > 1, F.stddev_samp("ret").over(f60) * 252**0.5),
            "beta_120": F.when((F.count(x).over(f120) >= 20) & (var > 1e-9), F.covar_samp(y, x).over(f120) / F.when(var > 0, var)),
        }
    )


def regime_label(daily, level, trend, flag):
    """Low / mid / high at the 30 % and 70 % quantiles of the history, up / down trend, yes / no flag; null is unknown."""
    q = exact_quantiles(daily, [], level, {"__lo": 0.3, "__hi": 0.7})
    d = daily.crossJoin(F.broadcast(q))
    v = F.col(level)
    tern = F.when(v.isNull(), "unknown").when(v >= F.col("__hi"), "high").when(v <= F.col("__lo"), "low").otherwise("mid")
    up = F.when(F.col(trend).isNull(), "unknown").when(F.col(trend) > 0, "up").otherwise("down")
    yes = F.when(F.col(flag).isNull(), "unknown").when(F.col(flag), "yes").otherwise("no")
    return d.withColumns({"level": tern, "trend": up, "flag": yes}).drop("__lo", "__hi")
