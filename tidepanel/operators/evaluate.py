"""Signal evaluation on (datetime, instrument, score, label) tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.elem import INF
from tidepanel.operators.scale import Bounds, attach_stats, bounded, xs_order


ZERO = 1e-12  # a correlation this small is rounding noise around zero


def pearson(x, y):
    """Correlation aggregate over complete pairs; null for a flat side (plain corr raises there)."""
    px, py = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    sx, sy = F.stddev_samp(px), F.stddev_samp(py)
    return F.covar_samp(x, y) / F.when((sx > 0) & (sy > 0), sx * sy)


def ic(df, keys=("datetime",), x="score", y="label", bounds=Bounds(), tie="instrument", min_rows=0):
    """Pearson and rank correlation per group, complete pairs only."""
    keys = list(keys)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, tie, x, y)
    pairs = xs_order(pairs, keys, x, tie, "__x", bounds, number=False)
    pairs = xs_order(pairs, keys, y, tie, "__y", bounds, number=False)
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), pearson(x, y).alias("ic"), pearson("__x_avg", "__y_avg").alias("rank_ic")
    )
    return out.where(F.col("n") >= min_rows) if min_rows else out


def ratio(a, b):
    return a / F.when(b != 0, b)


def ic_summary(ic_table, by=()):
    return ic_table.groupBy(*by).agg(
        F.avg("ic").alias("IC"),
        ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ICIR"),
        F.avg("rank_ic").alias("Rank_IC"),
        ratio(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("Rank_ICIR"),
    )


def ic_monthly(ic_table):
    """Mean IC per month on the full grid of months between the first and the last."""
    m = ic_table.select(F.trunc("datetime", "month").alias("month"), "ic")
    means = m.groupBy("month").agg(F.avg("ic").alias("ic"))
    grid = m.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")
    )
    return grid.join(means, "month", "left")


def tails(df, share, keys=("datetime",), score="score", bounds=Bounds(), count_nulls=True):
    """Flags ``top`` and ``bottom``: the int(rows * share) highest and lowest scores of each group."""
    keys = list(keys)
    df = xs_order(df, keys, score, "instrument", "__s", bounds)
    if count_nulls:
        df = attach_stats(df, keys, {"__rows": F.count(F.lit(1))}, bounds.dates)
    else:
        df = df.withColumn("__rows", F.col("__s_n"))
    k = share(F.col("__rows")) if callable(share) else F.floor(F.col("__rows") * share)
    df = df.withColumns({"__k": k, "__place": F.col("__s_rn")})
    top = F.coalesce(F.col("__place") > F.col("__s_n") - F.col("__k"), F.lit(False))
    bottom = F.coalesce(F.col("__place") <= F.col("__k"), F.lit(False))
    return df.withColumns({"top": top, "bottom": bottom}).drop("__s_avg", "__place")


_HELPERS = ("__rows", "__k", "__s_n", "__s_rn")


def long_short_prec(df, share=0.2, demean=False, bounds=Bounds()):
    if demean:
        df = attach_stats(df, ["datetime"], {"__m": F.avg("label")}, bounds.dates)
        df = df.withColumn("label", F.col("label") - F.col("__m")).drop("__m")
    t = tails(df, share, bounds=bounds)

    def hit(side, good):
        n = F.count(F.when(F.col(side), F.col("label")))
        return F.count(F.when(F.col(side) & good, 1)) / F.when(n > 0, n)

    return t.groupBy("datetime").agg(hit("top", F.col("label") > 0).alias("long_prec"), hit("bottom", F.col("label") < 0).alias("short_prec"))


def long_short_return(df, share=0.2, bounds=Bounds()):
    t = tails(df, share, bounds=bounds)
    top, bottom = F.avg(F.when(F.col("top"), F.col("label"))), F.avg(F.when(F.col("bottom"), F.col("label")))
    return t.groupBy("datetime").agg(((top - bottom) / 2).alias("long_short"), F.avg("label").alias("average"))


def annual(table, name, scale):
    """Annual mean and Sharpe ratio of a per-date series."""
    return table.agg(
        (F.avg(name) * scale).alias("annual_return"),
        (ratio(F.avg(name), F.stddev_samp(name)) * scale**0.5).alias("sharpe"),
    )


def hf_signal_record(df, share=0.2, bounds=Bounds()):
    i = ic_summary(ic(df, bounds=bounds))
    p = long_short_prec(df, share, True, bounds).agg(F.avg("long_prec").alias("long_prec"), F.avg("short_prec").alias("short_prec"))
    r = long_short_return(df, share, bounds).agg(
        F.avg("long_short").alias("ls_mean"), ratio(F.avg("long_short"), F.stddev_samp("long_short")).alias("ls_sharpe")
    )
    return i.crossJoin(p).crossJoin(r)


def group_return(df, groups=5, bounds=Bounds()):
    """Mean label of equal groups by descending score (size n // groups), spreads and running sums."""
    scored = xs_order(df.where("score IS NOT NULL"), ["datetime"], "score", "instrument", "__s", bounds)
    size = F.floor(F.col("__s_n") / groups)
    place = F.col("__s_n") - F.col("__s_rn")
    g = F.floor(place / F.when(size > 0, size)) + 1
    per = scored.withColumn("g", g).groupBy("datetime").agg(
        *[F.avg(F.when(F.col("g") == i, F.col("label"))).alias(f"group{i}") for i in range(1, groups + 1)]
    )
    mean = df.groupBy("datetime").agg(F.avg("label").alias("__all"))
    out = per.join(mean, "datetime").withColumns(
        {"long_short": F.col("group1") - F.col(f"group{groups}"), "long_average": F.col("group1") - F.col("__all")}
    )
    # one row per date from here on: the running sums see dates only
    w = Window.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    return out.where(F.col("long_short").isNotNull() | F.col("group1").isNotNull()).withColumns(
        {f"cum_{c}": F.sum(c).over(w) for c in ("group1", "long_short", "long_average")}
    )


def pred_autocorr(df, lag=1, keys=(), value="score"):
    """Correlation of the scores of a date with those of ``lag`` dates before, by instrument."""
    past = df.select(*keys, "instrument", (F.col("cal_ix") + lag).alias("cal_ix"), F.col(value).alias("__past"))
    both = df.select(*keys, "instrument", "datetime", "cal_ix", value).join(past, [*keys, "instrument", "cal_ix"])
    return both.groupBy(*keys, "datetime").agg(pearson(value, "__past").alias("autocorr"))


def with_last_score(df, lag=1):
    w = Window.partitionBy("instrument").orderBy("datetime")
    return df.withColumn("score_last", F.lag("score", lag).over(w))


def pred_autocorr_rank(df, lag=1, bounds=Bounds()):
    """Correlation of percentile ranks; each side is ranked over its own non-null rows of the date."""
    p = with_last_score(df, lag)
    p = xs_order(p, ["datetime"], "score", "instrument", "__a", bounds, number=False)
    p = xs_order(p, ["datetime"], "score_last", "instrument", "__b", bounds, number=False)
    return p.groupBy("datetime").agg(pearson("__a_avg", "__b_avg").alias("autocorr"))


def pred_turnover(df, groups=5, lag=1, bounds=Bounds()):
    share = lambda n: F.floor(n / groups)
    p = with_last_score(df, lag)
    now = tails(p, share, bounds=bounds).withColumnsRenamed({"top": "top_now", "bottom": "bottom_now"}).drop(*_HELPERS)
    both = tails(now, share, score="score_last", bounds=bounds)
    k = F.max("__k")

    def part(side):
        kept = F.count(F.when(F.col(f"{side}_now") & F.col(side), 1))
        return (1 - kept / F.when(k > 0, k)).alias(side)

    return both.groupBy("datetime").agg(part("top"), part("bottom"))


def hf_signal_test(df, share=0.2, min_tail=10, bounds=Bounds()):
    """Mean precision and mean alpha of both tails over the dates with tails of at least ``min_tail`` rows."""
    full = df.where("score IS NOT NULL AND label IS NOT NULL")
    full = attach_stats(full, ["datetime"], {"__m": F.avg("label")}, bounds.dates)
    t = xs_order(full.withColumn("alpha", F.col("label") - F.col("__m")), ["datetime"], "score", "instrument", "__s", bounds)
    low = F.col("__s_rn") <= F.floor(F.col("__s_n") * share)
    high = F.col("__s_rn") > F.floor(F.col("__s_n") * (1 - share))
    t = t.where(F.floor(F.col("__s_n") * share) >= min_tail)
    per = t.groupBy("datetime").agg(
        (F.count(F.when(high & (F.col("alpha") > 0), 1)) / F.count(F.when(high, 1))).alias("up_prec"),
        (F.count(F.when(low & (F.col("alpha") < 0), 1)) / F.count(F.when(low, 1))).alias("down_prec"),
        F.avg(F.when(high, F.col("alpha"))).alias("up_alpha"),
        F.avg(F.when(low, F.col("alpha"))).alias("down_alpha"),
    )
    return per.agg(*[F.avg(c).alias(c) for c in ("up_prec", "down_prec", "up_alpha", "down_alpha")])


def mse(df):
    e = F.pow(F.col("score") - F.col("label"), 2)
    return df.agg(F.avg(e).alias("mse"), F.sqrt(F.avg(e)).alias("rmse"), F.count(e).alias("n"))


def melt(df, features, keep):
    """Wide to long: one row per (row, feature)."""
    return df.unpivot([F.col(c) for c in keep], [F.col(c) for c in features], "feature", "x")


def feature_ic(df, features, by=(), min_observations=0, bounds=Bounds()):
    """IC and rank IC per feature (and group): means over dates with three pairs at least."""
    long = melt(df, features, ["instrument", "datetime", "label", *by])
    usable = F.col("x").isNotNull() & F.col("label").isNotNull()
    size = long.groupBy("feature", *by).agg(F.count(F.lit(1)).alias("__all"), F.count(F.when(usable, 1)).alias("observations"))
    daily = ic(long, ("feature", *by, "datetime"), "x", "label", Bounds(None, bounds.names), min_rows=3)
    daily = daily.where("ic IS NOT NULL OR rank_ic IS NOT NULL")
    means = daily.groupBy("feature", *by).agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg("ic").alias("ic_mean"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > ZERO).cast("double"))).alias("positive_ic"),
        F.avg(F.when(F.col("rank_ic").isNotNull(), (F.col("rank_ic") > ZERO).cast("double"))).alias("positive_rank_ic"),
    )
    out = size.join(means, ["feature", *by], "left").withColumn("coverage", ratio(F.col("observations"), F.col("__all")))
    enough = F.col("observations") >= min_observations
    cols = ("ic_mean", "rank_ic_mean", "positive_ic", "positive_rank_ic")
    return out.withColumns({**{c: F.when(enough, F.col(c)) for c in cols}, "dates": F.when(enough, F.coalesce("dates", F.lit(0))).otherwise(0)})


def quantile_spread(df, features, quantiles=5, bounds=Bounds()):
    """Top against bottom quantile label mean per feature, averaged over dates."""
    long = melt(df, features, ["instrument", "datetime", "label"]).where("x IS NOT NULL AND label IS NOT NULL")
    r = xs_order(long, ["feature", "datetime"], "x", "instrument", "__x", Bounds(None, bounds.names))
    b = F.greatest(F.lit(1), F.floor(F.col("__x_rn") / F.col("__x_n") * quantiles))
    daily = (
        r.withColumn("b", F.least(b, F.lit(quantiles)))
        .groupBy("feature", "datetime")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
            F.avg(F.when(F.col("b") == 1, F.col("label"))).alias("bottom"),
            F.avg(F.when(F.col("b") == quantiles, F.col("label"))).alias("top"),
        )
        .where((F.col("n") >= max(quantiles, 3)) & (F.col("lo") < F.col("hi")) & F.col("top").isNotNull() & F.col("bottom").isNotNull())
    )
    return daily.groupBy("feature").agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg("bottom").alias("bottom_mean"),
        F.avg("top").alias("top_mean"),
        F.avg(F.col("top") - F.col("bottom")).alias("spread"),
        F.avg((F.col("top") > F.col("bottom")).cast("double")).alias("top_beats_bottom"),
    )


def group_metrics(df, group, min_size=5, quantiles=5, bounds=Bounds()):
    """Per (date, group): IC, rank IC, top and bottom means, spread, top win rate against the group mean."""
    keys = ["datetime", group]
    full = df.where(F.col("score").isNotNull() & F.col("label").isNotNull() & F.col(group).isNotNull())
    corr = ic(full, keys, bounds=bounds)
    t = tails(full, lambda n: F.greatest(F.lit(1), F.floor(n / quantiles)), keys, bounds=Bounds(None, bounds.names), count_nulls=False)
    t = attach_stats(t, keys, {"__mean": F.avg("label")})
    sides = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tradable"),
        F.avg("label").alias("group_mean"),
        F.avg(F.when(F.col("top"), F.col("label"))).alias("top_mean"),
        F.avg(F.when(F.col("bottom"), F.col("label"))).alias("bottom_mean"),
        F.avg(F.when(F.col("top"), (F.col("label") > F.col("__mean")).cast("double"))).alias("top_win_rate"),
    )
    enough = F.col("tradable") >= min_size
    sides = sides.withColumns({c: F.when(enough, F.col(c)) for c in ("top_mean", "bottom_mean", "top_win_rate")})
    return sides.withColumn("spread", F.col("top_mean") - F.col("bottom_mean")).join(corr.drop("n"), keys, "left")


def group_summary(daily, group):
    return daily.groupBy(group).agg(
        F.count_distinct("datetime").alias("days"),
        F.count("ic").alias("valid_ic"),
        F.avg("ic").alias("ic_mean"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        F.avg("spread").alias("spread_mean"),
        F.avg(F.when(F.col("spread").isNotNull(), (F.col("spread") > 0).cast("double"))).alias("spread_positive"),
        F.avg("top_win_rate").alias("top_win_rate"),
    )


def group_quantiles(df, group, min_size=5, quantiles=5, bounds=Bounds()):
    """Mean label per score quantile inside groups; quantile 1 holds the highest scores."""
    keys = ["datetime", group]
    full = df.where(F.col("score").isNotNull() & F.col("label").isNotNull() & F.col(group).isNotNull())
    r = xs_order(full, keys, "score", "instrument", "__s", Bounds(None, bounds.names)).where(F.col("__s_n") >= min_size)
    q = F.floor((F.col("__s_n") - F.col("__s_rn")) * quantiles / F.col("__s_n")) + 1
    daily = r.withColumn("quantile", q).groupBy(*keys, "quantile").agg(F.avg("label").alias("ret"), F.count(F.lit(1)).alias("n"))
    return daily.groupBy(group, "quantile").agg(F.avg("ret").alias("mean_return"), F.sum("n").alias("observations"), F.count(F.lit(1)).alias("periods"))


def value_count(df, features):
    """Exact distinct values per date and column: distinct pairs first, then a plain count."""
    long = melt(df, features, ["datetime"]).where("x IS NOT NULL")
    return long.select("datetime", "feature", "x").distinct().groupBy("datetime", "feature").agg(F.count(F.lit(1)).alias("values"))


def inf_nan_count(df, features):
    long = melt(df, features, ["datetime"])
    inf, nul = F.count(F.when(F.abs("x") == INF, 1)), F.count(F.when(F.col("x").isNull(), 1))
    n = F.count(F.lit(1))
    return long.groupBy("datetime", "feature").agg(
        inf.alias("inf"), nul.alias("nulls"), (inf / n).alias("inf_ratio"), (nul / n).alias("null_ratio")
    )


def feature_moments(df, features):
    n = F.count("x")
    flat = F.var_samp("x") <= 1e-14
    skew, kurt = F.skewness("x"), F.kurtosis("x")
    s = F.when((n >= 3) & ~flat, skew * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
    k = F.when((n >= 4) & ~flat, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * kurt + 6))
    return melt(df, features, ["datetime"]).groupBy("datetime", "feature").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), s.alias("skew"), k.alias("kurt")
    )


def feature_autocorr(df, features, lag=1):
    return pred_autocorr(melt(df, features, ["instrument", "datetime", "cal_ix"]), lag, ("feature",), "x")


def feature_hist(df, features, bins=20):
    """Equal-width histogram per feature; the last bin is closed on the right."""
    long = melt(df, features, []).where(F.col("x").isNotNull() & (F.abs("x") != INF))
    span = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # one row per feature
    long = long.join(bounded(span, len(features)), "feature")
    b = F.least(F.floor((F.col("x") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return long.groupBy("feature", F.coalesce(b, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rolling_ensemble(preds, start="set_start"):
    """Predictions of rolling sets on one key: the set that starts last wins."""
    return preds.groupBy("datetime", "instrument").agg(F.max_by("score", start).alias("score"))


def average_ensemble(preds, bounds=Bounds()):
    """Scores of each model are standardised per date and then averaged over the models."""
    z = attach_stats(preds, ["model", "datetime"], {"__m": F.avg("score"), "__s": F.stddev_samp("score")}, bounds.dates)
    z = z.withColumn("z", (F.col("score") - F.col("__m")) / F.when(F.col("__s") != 0, F.col("__s")))
    return z.groupBy("datetime", "instrument").agg(F.avg("z").alias("score"))


def label_delta(df, horizons, segments, feature="score", bounds=Bounds()):
    """Label horizons side by side: count, mean and std of the per-date z-score (ddof 0) per segment, and mean feature IC."""
    long = df.unpivot([F.col(c) for c in ("instrument", "datetime", feature)], [F.col(c) for c in horizons], "horizon", "label")
    long = attach_stats(long, ["horizon", "datetime"], {"__m": F.avg("label"), "__s": F.stddev_pop("label"), "__n": F.count("label")})
    long = long.withColumn("z", (F.col("label") - F.col("__m")) / F.when(F.col("__s") != 0, F.col("__s")))
    seg = F.broadcast(segments)
    tagged = long.join(seg, F.col("datetime").between(seg["start"], seg["end"]))
    stats = tagged.groupBy("horizon", "segment").agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.stddev_samp("z").alias("std"))
    daily = tagged.where("__n >= 3").groupBy("horizon", "segment", "datetime").agg(pearson(feature, "label").alias("ic"))
    return stats.join(daily.groupBy("horizon", "segment").agg(F.avg("ic").alias("ic_mean")), ["horizon", "segment"], "left")
