"""Per-date processors and fitted normalisers. Group statistics are partial aggregates joined back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.elem import INF, finite
from tidepanel.operators.scale import GROUP_ROWS, Bounds, attach, attach_stats, bounded, exact_quantiles, xs_order

EPS = 1e-12  # fixed value: added to a fitted median distance


def dropna(df, cols):
    return df.na.drop(subset=cols)


def drop_cols(df, cols):
    return df.drop(*cols)


def filter_cols(df, cols):
    return df.select("instrument", "datetime", *cols)


def tanh(df, cols):
    return df.withColumns({c: F.tanh(F.col(c) - 1) for c in cols})


def fillna(df, cols, value=0.0):
    return df.na.fill(value, subset=cols)


def process_inf(df, cols, bounds=Bounds()):
    """Infinity becomes the mean of the finite values of that date."""
    out = attach_stats(df, ["datetime"], {f"__m_{c}": F.avg(finite(F.col(c))) for c in cols}, bounds.dates)
    return out.withColumns({c: F.when(F.abs(c) == INF, F.col(f"__m_{c}")).otherwise(F.col(c)) for c in cols}).drop(
        *[f"__m_{c}" for c in cols]
    )


def _in_range(df, start, end):
    return df.where(F.col("datetime").between(F.lit(start), F.lit(end)))


def fit_stats(df, aggs, start, end):
    """One row of statistics over the fit range. One row by construction, so it may be broadcast."""
    return _in_range(df, start, end).agg(*[c.alias(n) for n, c in aggs.items()])


def apply_stats(df, stats, exprs):
    joined = df.crossJoin(F.broadcast(stats))
    return joined.withColumns(exprs).drop(*stats.columns)


def minmax_norm(df, cols, start, end):
    stats = fit_stats(df, {f"__{k}_{c}": fn(c) for c in cols for k, fn in (("lo", F.min), ("hi", F.max))}, start, end)

    def scaled(c):
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        return F.when(hi != lo, (F.col(c) - lo) / F.when(hi != lo, hi - lo)).otherwise(F.col(c))

    return apply_stats(df, stats, {c: scaled(c) for c in cols})


def zscore_norm(df, cols, start, end):
    stats = fit_stats(df, {f"__{k}_{c}": fn(c) for c in cols for k, fn in (("m", F.avg), ("s", F.stddev_pop))}, start, end)

    def scaled(c):
        m, s = F.col(f"__m_{c}"), F.col(f"__s_{c}")
        return F.when(s != 0, (F.col(c) - m) / F.when(s != 0, s)).otherwise(F.col(c))

    return apply_stats(df, stats, {c: scaled(c) for c in cols})


def _medians(long, names):
    """One row with the median of ``v`` per column number ``k``: the columns share every pass over the rows."""
    each = exact_quantiles(long, ["k"], "v", {"m": 0.5}, Bounds(len(names)))
    return each.groupBy().agg(*[F.max(F.when(F.col("k") == i, F.col("m"))).alias(n) for i, n in enumerate(names)])


def robust_zscore_norm(df, cols, start, end, clip=True):
    """(x - median) / (median distance * 1.4826) of all columns together, the medians from the fit range."""
    fit = _in_range(df, start, end).select(*cols)
    long = lambda d, values: d.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), v.cast("double").alias("v")) for i, v in enumerate(values)])).alias("e")).select("e.*")
    med = _medians(long(fit, [F.col(c) for c in cols]), [f"__med_{c}" for c in cols])
    away = long(fit.crossJoin(F.broadcast(med)), [F.abs(F.col(c) - F.col(f"__med_{c}")) for c in cols])
    stats = med.crossJoin(_medians(away, [f"__mad_{c}" for c in cols]))

    def scaled(c):
        z = (F.col(c) - F.col(f"__med_{c}")) / ((F.col(f"__mad_{c}") + EPS) * 1.4826)
        return F.when(z.isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z))) if clip else z

    return apply_stats(df, stats, {c: scaled(c) for c in cols})


def cs_zscore(df, cols, bounds=Bounds(), by=("datetime",)):
    aggs = {f"__{k}_{c}": fn(c) for c in cols for k, fn in (("m", F.avg), ("s", F.stddev_samp))}
    out = attach_stats(df, list(by), aggs, bounds.dates)
    z = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") != 0, F.col(f"__s_{c}")) for c in cols}
    return out.withColumns(z).drop(*aggs)


def _date_medians(df, named, bounds):
    """Medians per date of several columns (output name -> column) from one reading of ``df``."""
    if bounds.names is not None and bounds.names <= GROUP_ROWS:
        return df.groupBy("datetime").agg(*[F.percentile(c, F.lit(0.5)).alias(n) for n, c in named.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).cast("double").alias("x")) for n, c in named.items()]))
    long = df.select("datetime", each.alias("e")).select("datetime", "e.n", "e.x")
    rows = bounds.dates * len(named) if bounds.dates is not None else None
    long = exact_quantiles(long, ["datetime", "n"], "x", {"m": 0.5}, Bounds(rows, bounds.names))
    return long.groupBy("datetime").agg(*[F.max(F.when(F.col("n") == n, F.col("m"))).alias(n) for n in named])


def cs_robust_zscore(df, cols, bounds=Bounds()):
    """(x - median) / (1.4826 * median distance) per date. All columns share the two readings of ``df`` that the medians take."""
    df = attach(df, _date_medians(df, {f"__med_{c}": c for c in cols}, bounds), ["datetime"], bounds.dates)
    df = df.withColumns({f"__d_{c}": F.abs(F.col(c) - F.col(f"__med_{c}")) for c in cols})
    df = attach(df, _date_medians(df, {f"__mad_{c}": f"__d_{c}" for c in cols}, bounds), ["datetime"], bounds.dates)
    scale = {c: F.col(f"__mad_{c}") * 1.4826 for c in cols}
    df = df.withColumns({c: (F.col(c) - F.col(f"__med_{c}")) / F.when(scale[c] != 0, scale[c]) for c in cols})
    return df.drop(*[f"__{k}_{c}" for c in cols for k in ("med", "mad", "d")])


def cs_rank_norm(df, cols, bounds=Bounds()):
    for c in cols:
        df = xs_order(df, ["datetime"], c, "instrument", "__r", bounds, number=False)
        df = df.withColumn(c, (F.col("__r_avg") / F.when(F.col("__r_n") > 0, F.col("__r_n")) - 0.5) * 3.46).drop("__r_avg", "__r_n")
    return df


def cs_fillna(df, cols, bounds=Bounds()):
    out = attach_stats(df, ["datetime"], {f"__m_{c}": F.avg(c) for c in cols}, bounds.dates)
    return out.withColumns({c: F.coalesce(c, f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def shrink_norm(df, cols, bounds=Bounds()):
    """Robust score per date, tails beyond 3 pulled into [3, 3.5], nulls to 0."""
    df = cs_robust_zscore(df, cols, bounds)
    aggs = {f"__{k}_{c}": fn(c) for c in cols for k, fn in (("hi", F.max), ("lo", F.min))}
    df = attach_stats(df, ["datetime"], aggs, bounds.dates)

    def shrunk(c):
        x, hi, lo = F.col(c), F.col(f"__hi_{c}"), F.col(f"__lo_{c}")
        up = F.when(x > 3, 3 + (x - 3) / F.when(hi != 3, hi - 3) * 0.5)
        down = F.when(x < -3, -3 - (x + 3) / F.when(lo != -3, lo + 3) * 0.5)
        return F.coalesce(up, down, x, F.lit(0.0))

    return df.withColumns({c: shrunk(c) for c in cols}).drop(*aggs)


# fixed values: transform by factor family (prefix of the column name), before the robust norm
FAMILY_TRANSFORMS = (
    (("KLOW2", "KUP2"), lambda x: F.pow(x, 0.125)),
    (("KLEN", "KLOW", "KUP"), lambda x: F.pow(x, 0.25)),
    (("MAX", "HIGH0"), lambda x: F.sqrt(x - 1)),
    (("MIN", "LOW0"), lambda x: F.sqrt(1 - x)),
    (("STD", "VOLUME", "VMA", "VSTD"), lambda x: F.when(x > 0, F.ln(x))),
    (("RSQR",), lambda x: F.coalesce(x, F.lit(0.0))),
    (("CORR", "CORD"), F.exp),
    (("WVMA",), F.log1p),
)


def config_section(df, features, labels, bounds=Bounds()):
    """Transform by factor family, then the robust norm per date; labels get a plain score."""

    def transform(c):
        for prefixes, fn in FAMILY_TRANSFORMS:
            if c.startswith(prefixes):
                v = fn(F.col(c))
                return F.when(~F.isnan(v), v)
        return F.col(c)

    df = df.withColumns({c: transform(c) for c in features})
    df = shrink_norm(df, features, bounds)
    return cs_zscore(df, labels, bounds).na.fill(0.0, subset=labels)


def hf_cast(df, flags, floats):
    return df.withColumns({**{c: F.col(c).cast("tinyint") for c in flags}, **{c: F.col(c).cast("float") for c in floats}})


def hf_norm(df, blocks, start, end):
    """One mean and one std of |x - mean| per block of columns; log1p on volume blocks; missing becomes 0."""
    ready = df.withColumns({c: F.log1p(c) for b, cols in blocks.items() if b.endswith("volume") for c in cols})
    fit = _in_range(ready, start, end)
    means = None
    for b, cols in blocks.items():
        long = fit.select(F.explode(F.array(*cols)).alias("__x"))
        m = long.agg(F.avg("__x").alias(f"__m_{b}"))
        means = m if means is None else means.crossJoin(m)
    for b, cols in blocks.items():
        long = fit.crossJoin(F.broadcast(means)).select(F.explode(F.array(*[F.abs(F.col(c) - F.col(f"__m_{b}")) for c in cols])).alias("__x"))
        ready = ready.crossJoin(F.broadcast(long.agg(F.stddev_pop("__x").alias(f"__s_{b}"))))
    ready = ready.crossJoin(F.broadcast(means))
    out = {
        c: F.coalesce((F.col(c) - F.col(f"__m_{b}")) / F.when(F.col(f"__s_{b}") != 0, F.col(f"__s_{b}")), F.lit(0.0))
        for b, cols in blocks.items()
        for c in cols
    }
    return ready.withColumns(out).drop(*[f"__{k}_{b}" for b in blocks for k in "ms"])


def run_chain(df, steps, infer=(), learn=()):
    """Shared steps, then an inference and a learning branch. Each step is ``df -> df``; fitted ones close over their range."""
    for s in steps:
        df = s(df)
    a, b = df, df
    for s in infer:
        a = s(a)
    for s in learn:
        b = s(b)
    return a, b


def ts_samples(panel, cols, length, fill=None):
    """Last ``length`` rows per (instrument, date) as an array, padded with null rows on the left."""
    w = Window.partitionBy("instrument").orderBy("cal_ix")
    frame = w.rowsBetween(-(length - 1), 0)
    row = F.struct(*cols)
    empty = F.struct(*[F.lit(None).cast("double").alias(c) for c in cols])
    rows = F.collect_list(row).over(frame)
    out = panel.select("instrument", "datetime", "cal_ix", rows.alias("__r"))
    block = F.concat(F.array_repeat(empty, F.lit(length) - F.size("__r")), F.col("__r"))
    out = out.select("instrument", "datetime", "cal_ix", block.alias("sample"))
    if fill in ("ffill", "ffill+bfill"):
        filled = _fill_block("sample", cols)
        if fill == "ffill+bfill":
            filled = F.reverse(_fill_block(F.reverse(filled), cols))
        out = out.withColumn("sample", filled)
    return out


def _fill_block(block, cols):
    block = F.col(block) if isinstance(block, str) else block

    def step(acc, row):
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(*[F.coalesce(row[c], last[c]).alias(c) for c in cols])))

    first = F.slice(block, 1, 1)
    return F.aggregate(F.slice(block, 2, F.greatest(F.size(block), F.lit(1))), first, step)


def ts_slices(df, cols, length):
    """Trailing rows per instrument without a date grid (rows as they are)."""
    w = Window.partitionBy("instrument").orderBy("datetime").rowsBetween(-(length - 1), 0)
    return df.select("instrument", "datetime", F.collect_list(F.struct("datetime", *cols)).over(w).alias("slice"))


def extend_start(calendar, start, length):
    """First date whose sample of ``length`` rows ends at the first trade date on or after ``start``."""
    at = calendar.where(F.col("datetime") >= F.lit(start)).agg(F.min("cal_ix").alias("__ix"))
    return (
        calendar.join(F.broadcast(at), F.col("cal_ix") == F.greatest(F.col("__ix") - (length - 1), F.lit(0)))
        .select(F.col("datetime").alias("start"))
    )


def time_weight(df, weights):
    """Weight of the age bucket a row falls into: ``weights`` holds (start, end, weight), a handful of rows."""
    w = F.broadcast(weights)
    return df.join(w, F.col("datetime").between(w["start"], w["end"]), "left").drop("start", "end").na.fill(1.0, ["weight"])
