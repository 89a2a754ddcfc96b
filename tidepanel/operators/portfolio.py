"""Portfolio, attribution and return-series tables. Series hold one row per date (and series key)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidepanel.operators.evaluate import pearson, ratio
from tidepanel.operators.scale import Bounds, attach_stats, bounded, xs_top
from tidepanel.session import cut_lineage, stored


def line(*keys):
    """Running window along the dates of a series."""
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def nav(df, ret="ret", keys=("series",), name="nav"):
    """Running product of 1 + r as exp of a sum of logs; a loss of everything stays at zero."""
    r = F.coalesce(F.col(ret), F.lit(0.0))
    logs = F.sum(F.when(r > -1, F.ln(1 + r)).otherwise(F.lit(0.0))).over(line(*keys))
    dead = F.max((r <= -1).cast("int")).over(line(*keys)) == 1
    return df.withColumn(name, F.when(dead, 0.0).otherwise(F.exp(logs)))


def risk_analysis(df, ret="ret", keys=("series",), scale=52, mode="sum"):
    """Mean, std, annual return, information ratio and max drawdown per series."""
    keys = list(keys)
    w = line(*keys)
    if mode == "sum":
        d = df.withColumn("__c", F.sum(ret).over(w))
        d = d.withColumn("__dd", F.col("__c") - F.max("__c").over(w))
        mean, std = F.avg(ret), F.stddev_samp(ret)
        annual = mean * scale
        ir = ratio(mean, std) * scale**0.5
    else:
        d = nav(df, ret, keys, "__c")
        d = d.withColumn("__dd", F.col("__c") / F.max("__c").over(w) - 1)
        # geometric mean, log-return deviation
        mean = F.exp(F.avg(F.ln(1 + F.col(ret)))) - 1
        std = F.stddev_samp(F.ln(1 + F.col(ret)))
        annual = F.pow(1 + mean, F.lit(float(scale))) - 1
        ir = ratio(mean, std) * scale**0.5
    return d.groupBy(*keys).agg(
        mean.alias("mean"), std.alias("std"), annual.alias("annual_return"), ir.alias("information_ratio"), F.min("__dd").alias("max_drawdown")
    )


def melt_series(df, cols, name="series", value="ret"):
    return df.unpivot([F.col("date")], [F.col(c) for c in cols], name, value)


def portfolio_stats(df, days=250):
    """Annual return, Sharpe, volatility, max drawdown, beta and alpha of ``ret`` against ``bench`` (population moments)."""
    d = nav(df.withColumn("series", F.lit("p")), "ret")
    d = d.withColumn("__dd", F.col("nav") / F.max("nav").over(line("series")) - 1)
    beta = ratio(F.covar_pop("ret", "bench"), F.var_pop("bench"))
    a, b = F.avg("ret") * days, F.avg("bench") * days
    return d.agg(
        a.alias("annual_return"),
        (ratio(F.avg("ret"), F.stddev_pop("ret")) * days**0.5).alias("sharpe"),
        (F.stddev_pop("ret") * days**0.5).alias("volatility"),
        F.min("__dd").alias("max_drawdown"),
        beta.alias("beta"),
        (a - beta * b).alias("alpha"),
    )


def report_curves(df, keys=("series",)):
    """Cumulative return, excess and drawdown with and without cost; input: date, ret, bench, cost."""
    w = line(*keys)
    net = F.col("ret") - F.col("cost")
    d = df.withColumns(
        {
            "cum_ret": F.sum("ret").over(w),
            "cum_net": F.sum(net).over(w),
            "cum_bench": F.sum("bench").over(w),
            "cum_ex": F.sum(F.col("ret") - F.col("bench")).over(w),
            "cum_ex_net": F.sum(net - F.col("bench")).over(w),
        }
    )
    return d.withColumns({"drawdown": F.col("cum_net") - F.max("cum_net").over(w), "ex_drawdown": F.col("cum_ex_net") - F.max("cum_ex_net").over(w)})


def position_status(pos, dates, bounds=Bounds()):
    """Hold 0, buy 1, sell -1 against the date before. ``dates`` is the small (date, ix) table."""
    p = pos.join(bounded(dates, bounds.dates), "date")
    old = p.select("instrument", (F.col("ix") + 1).alias("ix"), F.lit(True).alias("__old"))
    now = p.select("instrument", "ix", F.lit(True).alias("__now"))
    first = dates.agg(F.min("ix").alias("__lo"), F.max("ix").alias("__hi"))
    j = now.join(old, ["instrument", "ix"], "outer").crossJoin(F.broadcast(first)).where("ix <= __hi")
    s = F.when(F.col("__now") & F.col("__old"), 0).when(F.col("__now"), 1).otherwise(-1)
    return j.withColumn("status", s).join(bounded(dates, bounds.dates), "ix").select("date", "instrument", "status")


def decompose(df, group):
    """Group weight, weight inside the group and group return per date; input: date, instrument, weight, ret."""
    total, earned = F.sum("weight"), F.sum(F.col("weight") * F.col("ret"))
    return df.groupBy("date", group).agg(total.alias("group_weight"), ratio(earned, total).alias("group_return"))


def brinson(port, bench, group):
    """Allocation, selection, interaction and total excess per date."""
    p = decompose(port, group).withColumnsRenamed({"group_weight": "pw", "group_return": "pr"})
    b = decompose(bench, group).withColumnsRenamed({"group_weight": "bw", "group_return": "br"})
    j = p.join(b, ["date", group], "outer").na.fill(0.0, ["pw", "pr", "bw", "br"])
    return j.groupBy("date").agg(
        F.sum((F.col("pw") - F.col("bw")) * F.col("br")).alias("allocation"),
        F.sum(F.col("bw") * (F.col("pr") - F.col("br"))).alias("selection"),
        F.sum((F.col("pw") - F.col("bw")) * (F.col("pr") - F.col("br"))).alias("interaction"),
        F.sum(F.col("pw") * F.col("pr") - F.col("bw") * F.col("br")).alias("total"),
    )


def topk_positions(signals, dates, k, every, bounds=Bounds()):
    """Top k by score on every ``every``-th date, equal weight. ``signals``: (date, instrument, score)."""
    s = signals.join(bounded(dates.where(F.col("ix") % every == 0), bounds.dates), "date").where("score IS NOT NULL")
    top = xs_top(s, ["date", "ix"], [F.col("score").desc(), F.col("instrument")], k)
    # at most k rows per date
    return top.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date"))).drop("top_rank")


def topk_periods(pos, prices, dates, every, lag=1, cost=0.001, bounds=Bounds()):
    """Entry and exit returns, turnover, cost and NAV per rebalance date."""
    p = prices.join(bounded(dates, bounds.dates), "date")
    entry = p.select("instrument", (F.col("ix") - lag).alias("ix"), F.col("price").alias("entry"))
    leave = p.select("instrument", (F.col("ix") - lag - every).alias("ix"), F.col("price").alias("exit"))
    held = pos.join(entry, ["instrument", "ix"], "left").join(leave, ["instrument", "ix"], "left")
    held = held.withColumn("ret", F.col("exit") / F.col("entry") - 1)
    old = pos.select("instrument", (F.col("ix") + every).alias("ix"), F.col("weight").alias("__old"))
    top = pos.agg(F.max("ix").alias("__hi"))
    moved = pos.select("instrument", "ix", "weight").join(old, ["instrument", "ix"], "outer").crossJoin(F.broadcast(top)).where("ix <= __hi")
    turn = moved.groupBy("ix").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("__old", F.lit(0.0)))).alias("turnover"))
    per = held.groupBy("ix", "date").agg(F.count(F.lit(1)).alias("positions"), (F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0)))).alias("gross")).join(turn, "ix")
    per = per.withColumns({"cost": F.col("turnover") * cost, "ret": F.col("gross") - F.col("turnover") * cost})
    return nav(per.withColumn("series", F.lit("p")), "ret").drop("series")


def capped_topn(df, n, caps):
    """Greedy choice by score under several group caps per date; a missing group has no cap.

    Names beyond the cap of a group inside that group's own order can never be chosen, but two caps interact, so the choice is a
    fold over the date's names in order. Its input is bounded first: per date only the best rows of every combination of groups can
    matter, and the state holds the chosen ones.
    """
    groups = list(caps)
    w = Window.partitionBy("date", *groups).orderBy(F.col("score").desc(), "instrument")
    most = F.least(F.lit(n), *[F.when(F.col(g).isNotNull(), c).otherwise(n) for g, c in caps.items()])
    few = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
    order = F.struct((-F.col("score")).alias("__o"), "instrument", *[c for c in few.columns if c not in ("date", "instrument")])
    walk = few.groupBy("date").agg(F.array_sort(F.collect_list(order)).alias("names"))

    def room(chosen, x):
        ok = F.size(chosen) < n
        for g, cap in caps.items():
            # a comparison with a missing group is never true
            ok = ok & (F.size(F.filter(chosen, lambda y: y[g] == x[g])) < cap)
        return ok

    chosen = F.aggregate("names", F.slice("names", 1, 0), lambda acc, x: F.when(room(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return walk.select("date", F.explode(chosen).alias("x")).select("date", "x.*").select(*df.columns)


def positive_shift(df, value, keys=("date",)):
    """Values moved above zero within each group: minus the smallest, plus a trifle. Groups are a day's chosen rows."""
    return F.col(value) - F.min(value).over(Window.partitionBy(*keys)) + 1e-6


def trailing_risk(prices, vol_rows=12, beta_rows=24, per_year=52):
    """Per row of ``prices`` (date, instrument, price): yearly volatility and beta against the mean change of all names, both over the
    changes known on that date."""
    own = Window.partitionBy("instrument").orderBy("date")
    d = prices.withColumn("m", F.col("price") / F.lag("price").over(own) - 1)
    market = d.groupBy("date").agg(F.avg("m").alias("k"))
    d = d.join(market, "date").withColumn("k", F.when(F.col("m").isNotNull(), F.col("k")))
    long = own.rowsBetween(1 - beta_rows, 0)
    spread = F.var_samp("k").over(long)
    vol = F.stddev_samp("m").over(own.rowsBetween(1 - vol_rows, 0)) * per_year**0.5
    return d.select("date", "instrument", vol.alias("vol"), (F.covar_samp("m", "k").over(long) / F.when(spread > 0, spread)).alias("beta"))


def scheme_values(df):
    """Scheme name -> weight before scaling and caps, from score, vol and beta. Small or missing risks take the floors and defaults of the
    surveyed code (fixed values)."""
    vol = F.greatest(F.coalesce("vol", F.lit(0.5)), F.lit(0.05))
    beta = F.greatest(F.coalesce("beta", F.lit(1.0)), F.lit(0.3))
    return {"equal": F.lit(1.0), "score": positive_shift(df, "score"), "inverse_vol": 1 / vol, "beta": 1 / beta, "beta_neutral": 1 / (beta * beta)}


def cap_weights(df, cap, rounds=20, keys=("date",)):
    """Cap and renormalise per group: what lies over the cap is spread over the rest, repeated; at the end the weights are divided by
    their total, so they sum to one even where the cap leaves no room. Input holds top-n rows only."""
    by = Window.partitionBy(*keys)
    df = df.withColumn("weight", F.col("weight") / F.sum("weight").over(by))
    w = F.col("weight")
    for _ in range(rounds):
        df = df.withColumns({"__over": F.sum(F.greatest(w - cap, F.lit(0.0))).over(by), "__rest": F.sum(F.when(w <= cap, w).otherwise(0.0)).over(by)})
        spread = F.when((F.col("__rest") > 0) & (F.col("__over") > 0), w + w / F.col("__rest") * F.col("__over")).otherwise(w)
        df = df.withColumn("weight", F.when(w > cap, F.lit(cap)).otherwise(spread)).drop("__over", "__rest")
    return df.withColumn("weight", w / F.sum("weight").over(by))


#: Blocks of instruments at most: a vector is copied once for each, so what is shuffled grows with the instruments. Sides of a tile of
#: pairs, which is what a task holds besides the vectors of two blocks.
MOST_BLOCKS, TILE = 12, (256, 2048)
#: With more instruments than this, vectors are written once, in blocks of so many at most (so many blocks at least), and the blocks are
#: crossed: no vector is copied to disk.
CROSSED, BLOCK_NAMES, LEAST_BLOCKS = 4096, 1024, 20
#: Dates at most whose products are taken two by two.
GRAM_DATES = 2048


def _return_vectors(df, value):
    """One row per instrument: the calendar slots (``ix``) and values (``x``) of its series, which the calendar bounds."""
    vec = df.where(F.col(value).isNotNull()).groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct("ix", F.col(value).cast("double").alias("x")))).alias("v"))
    return vec.select("instrument", F.col("v.ix").cast("array<bigint>").alias("ix"), F.col("v.x").alias("x"))


def _block_pairs(vec, names, block):
    """``vec`` dealt to pairs (a, b) of blocks of instruments, grouped by them."""
    blocks = min(MOST_BLOCKS, max(1, -(-names // block)))
    dealt = vec.withColumn("home", F.pmod(F.hash("instrument"), F.lit(blocks)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.withColumns({"a": F.least("home", "other"), "b": F.greatest("home", "other")}).drop("other").groupBy("a", "b")


def _whole_blocks(vec, names):
    """``vec`` as one row (block, data) per block of about ``BLOCK_NAMES`` instruments, data being its rows as a compressed Arrow stream."""

    def pack(t):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(t)
        return pa.table([t.column("home").slice(0, 1), pa.array([sink.getvalue().to_pybytes()])], names=["block", "data"])

    return vec.withColumn("home", F.pmod(F.hash("instrument"), F.lit(max(LEAST_BLOCKS, -(-names // BLOCK_NAMES))))).groupBy("home").applyInArrow(pack, "block int, data binary")


def _multiplied(vec, names, block):
    """Function of (run, schema): the rows that ``run`` makes of every pair of blocks of ``vec``, which it gets as ``_block_matrix``. It may
    be called several times."""
    if names <= CROSSED:
        grouped = _block_pairs(vec, names, block)
        return lambda run, ddl: grouped.applyInArrow(_stream(lambda batches: run(*_block_matrix(pa.Table.from_batches(list(batches))))), ddl)
    whole = stored(_whole_blocks(vec, names))
    pairs = whole.toDF("a", "left").join(whole.toDF("b", "right"), F.col("a") <= F.col("b"))

    def matrix(a, left, b, right):
        tables = [pa.ipc.open_stream(d).read_all() for d in ([left] if a == b else [left, right])]
        t = pa.concat_tables(tables)
        ends = {"a": a, "b": b}
        return _block_matrix(pa.table({**{c: t.column(c) for c in t.column_names}, **{c: pa.array(np.full(t.num_rows, e, np.int32)) for c, e in ends.items()}}))

    def crossed(run):
        def each(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    a, left, b, right = (batch.column(c)[k] for c in ("a", "left", "b", "right"))
                    yield from run(*matrix(a.as_py(), left.as_buffer(), b.as_py(), right.as_buffer()))

        return each

    return lambda run, ddl: pairs.mapInArrow(crossed(run), ddl)


def _block_matrix(t):
    """(table without the series, dense matrix with NaN where a slot is missing, rows of the first and of the second block, whether
    these are the same block)."""
    t = t.combine_chunks()
    ix, x = (t.column(c).combine_chunks() for c in ("ix", "x"))
    at = ix.flatten().to_numpy()
    first, last = (at.min(), at.max()) if len(at) else (0, -1)
    if (last - first + 1) * t.num_rows <= 4 * len(at):
        at, slots = at - first, last - first + 1
    else:  # slots far apart
        slots, at = np.unique(at, return_inverse=True)
        slots = len(slots)
    m = np.full((t.num_rows, slots), np.nan)
    m[np.repeat(np.arange(t.num_rows), ix.value_lengths().to_numpy()), at] = x.flatten().to_numpy()
    home, a, b = t.column("home").to_numpy(), t.column("a")[0].as_py(), t.column("b")[0].as_py()
    return t.drop_columns(["ix", "x"]), m, np.flatnonzero(home == a), np.flatnonzero(home == b), a == b


def _tiles(left, right):
    for p in range(0, len(left), TILE[0]):
        for q in range(0, len(right), TILE[1]):
            yield left[p : p + TILE[0]], right[q : q + TILE[1]]


def _product(m, centre):
    """Function of two arrays of rows: (number of common slots, covariance) of their pairs; and the variance of every row."""
    seen = (~np.isnan(m)).astype(float)
    # columns are shifted by their mean first, which keeps the sums well scaled
    if centre:
        count = seen.sum(axis=1, keepdims=True)
        m = m - np.divide(np.nansum(m, axis=1, keepdims=True), count, out=np.zeros_like(count), where=count > 0)
    m = np.where(seen > 0, m, 0.0)

    def pairs(i, j):
        n, s = seen[i] @ seen[j].T, m[i] @ m[j].T
        with np.errstate(divide="ignore", invalid="ignore"):
            if centre:
                s = s - (m[i] @ seen[j].T) * (seen[i] @ m[j].T) / n
                return n, np.where(n > 1, s / (n - 1), np.nan)
            return n, np.where(n > 0, s / n, np.nan)

    k = seen.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if centre:
            v = np.where(k > 1, ((m * m).sum(axis=1) - m.sum(axis=1) ** 2 / k) / (k - 1), np.nan)
        else:
            v = np.where(k > 0, (m * m).sum(axis=1) / k, np.nan)
    return pairs, v


def covariance(df, names, centre=True, value="ret", block=256, variances=False):
    """Long covariance table (i, j, cov, n) over complete pairs, as a blocked matrix product; with ``variances`` also those of both
    instruments (vi, vj).

    An instrument's series is one vector (bounded by the calendar). Vectors are dealt into blocks of ``block`` instruments or, where
    there are more than ``MOST_BLOCKS`` of them, larger ones, and each task multiplies one pair of blocks tile by tile, so no row pair is
    ever shuffled or held; ``names`` is the instrument count. With more than ``CROSSED`` of them, see ``_multiplied``, vectors are not copied.
    """

    def run(t, m, left, right, same):
        name = t.column("instrument").combine_chunks()
        pairs, v = _product(m, centre)
        for p, q in _tiles(left, right):
            n, c = pairs(p, q)
            i, j = np.nonzero(n > 0)
            c, n, i, j = pa.array(c[i, j], from_pandas=True), pa.array(n[i, j].astype("int64")), p[i], q[j]
            for x, y in ((i, j),) if same else ((i, j), (j, i)):
                more = [pa.array(v[x], from_pandas=True), pa.array(v[y], from_pandas=True)] if variances else []
                yield pa.RecordBatch.from_arrays([name.take(pa.array(x)), name.take(pa.array(y)), c, n, *more], names=columns)

    columns = ["i", "j", "cov", "n", *["vi", "vj"] * variances]
    ddl = "i string, j string, cov double, n bigint" + ", vi double, vj double" * variances
    return _multiplied(_return_vectors(df, value), names, block)(run, ddl)


def _stream(run):
    """``run`` as a function of a group's batches, so that its output need not be held."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return each


def mean_variance(df, value="ret"):
    """One row (level): the mean variance of the instruments."""
    v = df.where("instrument IS NOT NULL").groupBy("instrument").agg(F.var_samp(value).alias("v"))
    return v.agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("level"))


def mean_correlation(df, names, value="ret", block=256):
    """One row (level): the mean correlation of different instruments over complete pairs. Tasks add up their pairs."""

    def run(t, m, left, right, same):
        pairs, v = _product(m, True)
        known = np.array([x is not None for x in t.column("instrument").to_pylist()])
        s, total, number = np.sqrt(v), 0.0, 0
        for p, q in _tiles(left, right):
            n, c = pairs(p, q)
            scale = np.outer(s[p], s[q])
            take = (n > 0) & (scale > 0) & ~np.isnan(c) & np.outer(known[p], known[q]) & (p[:, None] != q[None, :])
            total += float((c[take] / scale[take]).sum()) * (1 if same else 2)
            number += int(take.sum()) * (1 if same else 2)
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([number], pa.int64())], names=["total", "number"])

    parts = _multiplied(_return_vectors(df, value), names, block)(run, "total double, number bigint")
    return parts.agg(ratio(F.sum("total"), F.sum("number")).alias("level"))


def correlation(cov):
    """``cov`` with the standard deviations si, sj and the correlation; a table with the variances vi, vj needs no join."""
    if "vi" in cov.columns:
        c = cov.where("i IS NOT NULL AND j IS NOT NULL").withColumns({"si": F.sqrt("vi"), "sj": F.sqrt("vj")}).drop("vi", "vj")
    else:
        v = cov.where("i = j").select(F.col("i").alias("k"), F.sqrt("cov").alias("s"))
        c = cov.join(v.withColumnsRenamed({"k": "i", "s": "si"}), "i").join(v.withColumnsRenamed({"k": "j", "s": "sj"}), "j")
    return c.withColumn("corr", F.col("cov") / F.when(F.col("si") * F.col("sj") > 0, F.col("si") * F.col("sj")))


def shrink(cov, alpha, target="const_var", level=None):
    """(1 - alpha) * S + alpha * F with a constant-variance or constant-correlation target. ``level`` is the one-row table of that constant,
    as ``mean_variance`` or ``mean_correlation`` give it; without it, it is taken from the pairs."""
    diag = F.when(F.col("i") == F.col("j"), F.col("cov"))
    if target == "const_var":
        m = cov.agg(F.avg(diag).alias("level")) if level is None else level
        t = F.when(F.col("i") == F.col("j"), F.col("level")).otherwise(0.0)
        return cov.crossJoin(F.broadcast(m)).withColumn("cov", (1 - alpha) * F.col("cov") + alpha * t).drop("level")
    c = correlation(cov)
    m = c.agg(F.avg(F.when(F.col("i") != F.col("j"), F.col("corr"))).alias("level")) if level is None else level
    t = F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise(F.col("level") * F.col("si") * F.col("sj"))
    return c.crossJoin(F.broadcast(m)).withColumn("cov", (1 - alpha) * F.col("cov") + alpha * t).drop("level", "si", "sj", "corr")


def shrink_returns(df, names, target="single_factor", alpha="lw", value="ret", block=256):
    """Covariance table (i, j, cov, alpha) of returns (date, ix, instrument, ``value``), shrunk to ``const_var``, ``const_corr`` or
    ``single_factor`` by a fixed share or the ``lw`` (Ledoit-Wolf) or ``oas`` intensity.

    Returns are centred per instrument and a missing one counts as its mean. Products of two names summed over all pairs are products
    of sums per date; squares of S are added up inside the tasks that multiply blocks, and again for the distance from the target, so
    that no pair is shuffled or kept; single rows of totals go to the driver.
    """
    d = df.where(F.col(value).isNotNull()).select("ix", "instrument", F.col(value).alias("r"))
    t = df.select("date").distinct().count()
    vec = _return_vectors(d, "r").where("instrument IS NOT NULL")
    mean = F.aggregate("x", F.lit(0.0), lambda acc, e: acc + e) / F.size("x")
    vec = cut_lineage(vec.withColumn("mean", mean).select("instrument", "ix", F.transform("x", lambda e: e - F.col("mean")).alias("x")))
    p = vec.count()
    long = lambda v, *more: v.select("instrument", *more, F.explode(F.arrays_zip("ix", "x")).alias("e")).select("instrument", *more, "e.*")
    market = cut_lineage(long(vec).groupBy("ix").agg((F.sum("x") / p).alias("m")))
    one = long(vec).join(bounded(market, t), "ix").groupBy("instrument").agg((F.sum(F.col("x") ** 2) / t).alias("v"), (F.sum(F.col("x") * F.col("m")) / t).alias("c"))
    var_m = market.agg(F.sum(F.col("m") ** 2) / t).first()[0]
    vec = cut_lineage(vec.join(one, "instrument"))

    def tiles(table, m, left, right, same):
        """Per tile: names, S and the rows' variances, deviations and covariances with the market; whether the block stands alone."""
        m = np.nan_to_num(m, nan=0.0, posinf=np.inf, neginf=-np.inf)
        name = table.column("instrument").combine_chunks()
        v, c = (table.column(k).to_numpy() for k in ("v", "c"))
        sd = np.sqrt(v)
        for i, j in _tiles(left, right):
            s = m[i] @ m[j].T / t
            yield name, i, j, np.where(np.isnan(s), 0.0, s), v, sd, c, same

    def totals(*blocks):
        out = np.zeros(6)
        for _, i, j, s, v, sd, c, same in tiles(*blocks):
            times, eq, both = 1 if same else 2, i[:, None] == j[None, :], np.outer(sd[i], sd[j])
            apart = ~eq & (both > 0)
            share = lambda x, y, s: (s * np.outer(np.divide(v[x], sd[x], out=np.zeros(len(x)), where=sd[x] > 0), sd[y])).sum()
            vss = share(i, j, s) + (0 if same else share(j, i, s.T))
            out += [times * (s**2).sum(), s[eq].sum(), (s[eq] ** 2).sum(), times * (s[apart] / both[apart]).sum(), times * (np.outer(c[i], c[j]) * s).sum(), vss]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=["s2", "tr", "v2", "r", "ccs", "vss"])

    pairs = _multiplied(vec, names, block)
    sums = ("s2", "tr", "v2", "r", "ccs", "vss")
    q = pairs(totals, ", ".join(f"{c} double" for c in sums)).agg(*[F.sum(c).alias(c) for c in sums]).first()
    r = (q.r or 0.0) / (p * (p - 1)) if p > 1 else 0.0

    def goal(i, j, s, sd, c):
        eq = i[:, None] == j[None, :]
        off = {"const_var": 0.0, "const_corr": r * np.outer(sd[i], sd[j]), "single_factor": np.outer(c[i], c[j]) / (var_m or float("inf"))}[target]
        return np.where(eq, q.tr / p if target == "const_var" else s, off)

    def distance(*blocks):
        total = 0.0
        for _, i, j, s, _, sd, c, same in tiles(*blocks):
            total += float(((s - goal(i, j, s, sd, c)) ** 2).sum()) * (1 if same else 2)
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["gamma"])

    if alpha == "oas":
        alpha = (1 - 2 / p) * (q.s2 + q.tr**2) / ((t + 1 - 2 / p) * (q.s2 + q.tr**2 / p))
    elif alpha == "lw":
        y, m, c, sd = F.col("x"), F.col("m"), F.col("c"), F.sqrt("v")
        day = long(vec, "v", "c").join(bounded(market, t), "ix").groupBy("ix", "m").agg(
            F.sum(y**2).alias("y2"), F.sum(y**4).alias("y4"), F.sum(y * c).alias("yc"), F.sum(y * sd).alias("ys"),
            F.sum(F.when(sd > 0, y**3 / F.when(sd > 0, sd))).alias("y3s"), F.sum(y**3 * c).alias("y3c"), F.sum(y**2 * c**2).alias("y2c2"),
        )
        mean = lambda e: F.sum(e) / t
        w = day.agg(
            mean(F.col("y2") ** 2).alias("phi"),
            mean(F.col("y4")).alias("diag"),
            mean(F.coalesce("y3s", F.lit(0.0)) * F.col("ys") - F.col("y4")).alias("theta"),
            mean(m * (F.col("y2") * F.col("yc") - F.col("y3c"))).alias("first"),
            mean(m * m * (F.col("yc") ** 2 - F.col("y2c2"))).alias("third"),
        ).first()
        cv = one.agg(F.sum(c**2 * F.col("v"))).first()[0]
        gamma = pairs(distance, "gamma double").agg(F.sum("gamma")).first()[0]
        rho = 0.0
        if target == "const_corr":
            rho = w.diag - q.v2 + r * (w.theta - (q.vss or 0.0) + q.v2)
        elif target == "single_factor" and var_m:
            common = q.ccs - cv
            rho = w.diag - q.v2 + 2 * (w.first - common) / var_m - (w.third - var_m * common) / var_m**2
        alpha = max(0.0, min(1.0, (w.phi - q.s2 - rho) / gamma / t)) if gamma else 0.0

    def run(*blocks):
        for name, i, j, s, _, sd, c, same in tiles(*blocks):
            cov = pa.array(((1 - alpha) * s + alpha * goal(i, j, s, sd, c)).ravel())
            x, y = name.take(pa.array(np.repeat(i, len(j)))), name.take(pa.array(np.tile(j, len(i))))
            for a, b in ((x, y),) if same else ((x, y), (y, x)):
                yield pa.RecordBatch.from_arrays([a, b, cov], names=["i", "j", "cov"])

    return pairs(run, "i string, j string, cov double").withColumn("alpha", F.lit(float(alpha)))


def threshold(cov, level, kind="soft"):
    """Hard, soft or SCAD threshold of the correlations; the diagonal stays."""
    c = correlation(cov)
    r = F.col("corr")
    size = F.abs(r)
    soft = F.signum(r) * F.greatest(size - level, F.lit(0.0))
    a = 3.7  # fixed value: SCAD shape
    scad = F.when(size <= 2 * level, soft).when(size <= a * level, ((a - 1) * r - F.signum(r) * a * level) / (a - 2)).otherwise(r)
    new = {"hard": F.when(size >= level, r).otherwise(0.0), "soft": soft, "scad": scad}[kind]
    return c.withColumn("cov", F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise(new * F.col("si") * F.col("sj"))).drop("si", "sj", "corr")


def _add_up(rows, columns, per_batch):
    """Sum over all rows of matrices that ``per_batch`` (a dictionary of arrays, one per column) gives: tasks add up their own, and
    what goes to the driver is one matrix."""

    def run(batches):
        total = None
        for b in batches:
            arrays = {c: np.array(b.column(c).to_pylist(), float) for c in columns}
            one = per_batch(arrays) if b.num_rows else None
            total = one if total is None else total if one is None else total + one
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat, pa.float64())], names=["at", "v"])

    parts = rows.select(*columns).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    return np.array([r.v for r in parts])


def _vectors(rows, inputs, outputs):
    """(instrument, vectors): each of ``outputs`` is a function of the matrices that the batch's vectors of ``inputs`` make up."""
    ddl = "instrument string, " + ", ".join(f"{o} array<double>" for o in outputs)

    def run(batches):
        for b in batches:
            if b.num_rows:
                arrays = {c: np.array(b.column(c).to_pylist(), float) for c in inputs}
                made = [fn(arrays) for fn in outputs.values()]
                yield pa.RecordBatch.from_arrays([b.column("instrument"), *(pa.array(list(m), pa.list_(pa.float64())) for m in made)], names=["instrument", *outputs])

    return rows.select("instrument", *inputs).mapInArrow(run, ddl)


def _times(x, keyed, on, by, width, name):
    """Per ``by``, the sum of x times the vector that ``keyed`` (``on``, v) holds: one half of a product with the covariance."""
    sums = x.join(keyed, on).groupBy(by).agg(*[F.sum(F.col("x") * F.col("v")[k]).alias(f"s{k}") for k in range(width)])
    return sums.select(by, F.array(*[F.coalesce(f"s{k}", F.lit(0.0)) for k in range(width)]).alias(name))


def _by_dates(x, width):
    """(vectors: instrument, v; values): the ``width`` leading directions of x (date, instrument, x) and their sums of squares, from the
    products of every two dates, which tasks add up; what goes to the driver is one number for each two dates. None where there are
    more dates than ``GRAM_DATES`` or not so many directions."""
    days = [r.date for r in x.where("date IS NOT NULL").select("date").distinct().limit(GRAM_DATES + 1).collect()]
    if not days or len(days) > GRAM_DATES:
        return None
    count = len(days)
    place = x.sparkSession.createDataFrame(list(zip(days, range(count))), StructType([x.schema["date"], StructField("at", IntegerType())]))
    pairs = x.where("instrument IS NOT NULL").join(F.broadcast(place), "date").groupBy("instrument").agg(F.collect_list(F.struct("at", "x")).alias("v"))
    series = stored(pairs.select("instrument", F.col("v.at").alias("at"), F.col("v.x").alias("x")))

    def dense(batches):
        """Instruments and their series, a few at a time."""
        rows = max(1, 4_000_000 // count)
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                at, v = part.column("at"), part.column("x")
                m = np.zeros((part.num_rows, count))
                np.add.at(m, (np.repeat(np.arange(part.num_rows), at.value_lengths().to_numpy()), at.flatten().to_numpy()), v.flatten().to_numpy())
                yield part.column("instrument"), m

    def products(batches):
        total = np.zeros((count, count))
        for _, m in dense(batches):
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array([r.tobytes() for r in total])], names=["at", "sums"])

    def added(t):
        sums = np.sum([np.frombuffer(r) for r in t.column("sums").to_pylist()], axis=0)
        return pa.table([t.column("at").slice(0, 1), pa.array([sums.tobytes()])], names=["at", "sums"])

    parts = series.mapInArrow(products, "at int, sums binary").groupBy("at").applyInArrow(added, "at int, sums binary")
    gram = np.zeros((count, count))
    for r in parts.collect():
        gram[r.at] = np.frombuffer(r.sums)
    if not np.isfinite(gram).all():
        return None
    values, vectors = (a[..., ::-1][..., :width] for a in np.linalg.eigh((gram + gram.T) / 2))
    if len(values) < width or values[-1] <= 1e-10 * values[0]:
        return None
    turn = vectors / np.sqrt(values)

    def directions(batches):
        for names, m in dense(batches):
            yield pa.RecordBatch.from_arrays([names, pa.array(list(m @ turn), pa.list_(pa.float64()))], names=["instrument", "v"])

    return series.mapInArrow(directions, "instrument string, v array<double>"), values


def principal_components(x, factors, extra=5, tolerance=1e-13, steps=200):
    """(loadings: instrument, f; variances) of the leading components of x (date, instrument, x), which is centred per instrument.

    Block Krylov iteration, which starts at the leading directions where the dates are few enough for the products of every two of them,
    and then ends after a step or two. The covariance is never formed: a step multiplies a block of vectors by the returns, once by name and
    once by date, both joins and sums. Each new block is freed of the earlier ones and orthonormalised with small matrices on the
    driver (the block's width times the width of all blocks). It ends when the leading variances of the space spanned so far stand
    still, or the space holds all names or every direction of the returns.
    """
    names, dates = x.select("instrument").distinct().count(), x.select("date").distinct().count()
    width = min(factors + extra, names, max(1, dates))
    found, before = _by_dates(x, width), None
    if found:
        block, before = cut_lineage(found[0]), found[1][:factors] / max(1, dates - 1)
    else:
        # start vectors from a hash of the name, so that every run is the same
        start = F.array(*[F.xxhash64("instrument", F.lit(k)).cast("double") / float(2**63) for k in range(width)])
        block = x.select("instrument").distinct().select("instrument", start.alias("v"))
    r = np.linalg.cholesky(_add_up(block, ["v"], lambda a: a["v"].T @ a["v"]).reshape(width, width)).T
    basis = cut_lineage(_vectors(block, ["v"], {"v": lambda a, m=np.linalg.inv(r): a["v"] @ m}))
    span, projected = [width], np.zeros((0, 0))
    while True:
        columns, last = sum(span), span[-1]
        tail = basis.select("instrument", F.slice("v", columns - last + 1, last).alias("v"))
        by_date = _times(x, bounded(tail, names), "instrument", "date", last, "v")
        image = _times(x, bounded(by_date, dates), "date", "instrument", last, "w")
        both = cut_lineage(basis.join(image, "instrument").select("instrument", "v", F.transform("w", lambda e: e / max(1, dates - 1)).alias("w")))
        # V'SV grows by the columns of this block
        inside = _add_up(both, ["v", "w"], lambda a: a["v"].T @ a["w"]).reshape(columns, last)
        grown = np.zeros((columns, columns))
        grown[: columns - last, : columns - last] = projected
        grown[:, columns - last :], grown[columns - last :, :] = inside, inside.T
        projected = (grown + grown.T) / 2
        values, vectors = np.linalg.eigh(projected)
        top = values[::-1][:factors]
        size = max(abs(top[0]), 1e-300)
        still = before is not None and len(before) == len(top) and np.abs(top - before).max() <= tolerance * size
        if still or columns >= names or len(span) >= steps:
            break
        before = top
        # the part of the image outside the space so far, twice because the first pass leaves rounding; what is left of a direction
        # that lies within the space is dropped
        clean = _vectors(both, ["v", "w"], {"v": lambda a: a["v"], "w": lambda a, m=inside: a["w"] - a["v"] @ m})
        again = _add_up(clean, ["v", "w"], lambda a: np.hstack([a["v"], a["w"]]).T @ a["w"]).reshape(columns + last, last)
        s, u = np.linalg.eigh((again[columns:] + again[columns:].T) / 2)
        keep = s > (1e-10 * size) ** 2
        if not keep.any():
            break
        turn, rest = u[:, keep] / np.sqrt(s[keep]), again[:columns]
        basis = cut_lineage(_vectors(clean, ["v", "w"], {"v": lambda a, m=turn, n=rest: np.hstack([a["v"], (a["w"] - a["v"] @ n) @ m])}))
        span = [*span, int(keep.sum())]
    lead = vectors[:, ::-1][:, :factors]
    return _vectors(basis, ["v"], {"f": lambda a: a["v"][:, : lead.shape[0]] @ lead}), top


def _combine(column, matrix):
    """The vector of ``column`` times a small matrix."""
    v = F.col(column)
    return F.array(*[sum((v[i] * float(matrix[i, k]) for i in range(matrix.shape[0])), F.lit(0.0)) for k in range(matrix.shape[1])])


def pca_covariance(df, factors=5, value="ret", bounds=Bounds()):
    """Structured covariance (i, j, cov): the leading components with the covariance of their scores, and the variance of what they leave
    on the diagonal. A missing return counts as its instrument's mean. Any number of instruments."""
    stats = df.groupBy("instrument").agg(F.avg(value).alias("m"))
    x = df.where(F.col(value).isNotNull()).join(bounded(stats, bounds.names), "instrument").select("date", "instrument", (F.col(value) - F.col("m")).alias("x"))
    x = cut_lineage(x)
    dates = df.select("date").distinct().count()
    loads, _ = principal_components(x, factors)
    loads = cut_lineage(loads)
    k = len(loads.first().f)
    keyed = loads.withColumnRenamed("f", "v")
    scores = cut_lineage(_times(x, bounded(keyed, bounds.names), "instrument", "date", k, "v"))
    inner = _add_up(scores, ["v"], lambda a: a["v"].T @ a["v"]).reshape(k, k)
    # sum over dates of (x - f'b)^2 = sum x^2 - 2 f'(sum x b) + f'(sum b b')f; where x is missing it is 0
    total = x.groupBy("instrument").agg(F.sum(F.col("x") ** 2).alias("xx"))
    one = loads.join(_times(x, bounded(scores, dates), "date", "instrument", k, "xb"), "instrument").join(total, "instrument")
    f, half = F.col("f"), _combine("f", inner / max(1, dates - 1))
    dot = lambda a, b: sum((a[i] * b[i] for i in range(k)), F.lit(0.0))
    rest = (F.col("xx") - 2 * dot(f, F.col("xb")) + dot(f, _combine("f", inner))) / dates
    one = cut_lineage(one.select("instrument", "f", half.alias("h"), rest.alias("rv")))
    left = one.select(F.col("instrument").alias("i"), "h", "rv")
    if (bounds.names or 0) > CROSSED:
        # a few MB that make a row for each pair
        left = left.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, "i")
    right = bounded(one.select(F.col("instrument").alias("j"), F.col("f").alias("g")), bounds.names)
    cov = dot(F.col("h"), F.col("g")) + F.when(F.col("i") == F.col("j"), F.col("rv")).otherwise(0.0)
    return left.crossJoin(right).select("i", "j", cov.alias("cov"))


def event_attribution(event, contributions, levels):
    """level, name, contribution, share, days: what each name of every level added between the event's peak (not itself) and its trough.

    ``event``: one row with peak and trough; ``contributions``: date, contribution and the columns ``levels``. The span is one row, so
    the range join is a filter, and names are summed up per task before they are shuffled.
    """
    span = event.select("peak", "trough").limit(1)
    inside = contributions.join(bounded(span, 1), (F.col("date") > F.col("peak")) & (F.col("date") <= F.col("trough")))
    named = F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("name")) for k in levels])
    long = inside.select("date", "contribution", F.explode(named).alias("e")).select("e.*", "date", "contribution")
    sums = long.groupBy("level", "name").agg(F.sum("contribution").alias("contribution"), F.count_distinct("date").alias("days"))
    total = inside.agg(F.sum("contribution").alias("__all"))
    return sums.crossJoin(bounded(total, 1)).withColumn("share", F.col("contribution") / F.when(F.col("__all") != 0, F.col("__all"))).drop("__all")


def benchmark_summary(df, scale):
    """One row: a strategy (``ret``) against a benchmark (``bench``) per period; ``scale`` periods are a year.

    Net values run over all periods, a missing return counting as none; everything else takes the periods that have both. Of the net
    values the last such period counts.
    """
    runs = nav(nav(df.withColumn("series", F.lit(1)), "ret", name="own"), "bench", name="market")
    runs = runs.withColumn("relative", ratio(F.col("own"), F.col("market"))).where("ret IS NOT NULL AND bench IS NOT NULL")
    w = line("series")
    runs = runs.withColumns({"market_dd": ratio(F.col("market"), F.max("market").over(w)) - 1, "relative_dd": ratio(F.col("relative"), F.max("relative").over(w)) - 1})
    ex, n = F.col("ret") - F.col("bench"), F.count(F.lit(1))
    grown = lambda c: F.when(F.min(c) <= -1, -1.0).otherwise(F.exp(F.sum(F.ln(1 + F.col(c)))) - 1)
    beta = ratio(F.covar_samp("ret", "bench"), F.var_samp("bench"))
    return runs.agg(
        n.alias("periods"), grown("ret").alias("cumulative"), grown("bench").alias("bench_cumulative"), (F.max_by("relative", "date") - 1).alias("excess_cumulative"),
        (F.pow(1 + grown("bench"), scale / n) - 1).alias("bench_annual"), (F.stddev_samp("bench") * scale**0.5).alias("bench_volatility"),
        F.min("market_dd").alias("bench_drawdown"), F.min("relative_dd").alias("relative_drawdown"), (F.stddev_samp(ex) * scale**0.5).alias("tracking_error"),
        (ratio(F.avg(ex), F.stddev_samp(ex)) * scale**0.5).alias("ir"), beta.alias("beta"), ((F.avg("ret") - beta * F.avg("bench")) * scale).alias("alpha"),
        pearson("ret", "bench").alias("corr"), F.avg(ex).alias("mean_excess"), F.avg((ex > 0).cast("double")).alias("win_rate"),
    )


def backtest_summary(periods, scale, cost):
    """One row over holding periods (date, gross, turnover, positions): returns after ``cost`` times turnover, risk, drawdown, turnover."""
    d = nav(periods.withColumns({"series": F.lit(1), "ret": F.col("gross") - cost * F.col("turnover")}))
    d = d.withColumn("dd", ratio(F.col("nav"), F.max("nav").over(line("series"))) - 1)
    n, last = F.count(F.lit(1)), F.max_by("nav", "date")
    return d.agg(
        n.alias("periods"), (last - 1).alias("cumulative"), (F.pow(last, scale / n) - 1).alias("annual"), (F.stddev_samp("ret") * scale**0.5).alias("volatility"),
        (ratio(F.avg("ret"), F.stddev_samp("ret")) * scale**0.5).alias("ir"), F.min("dd").alias("drawdown"), F.avg("gross").alias("mean_gross"), F.avg("ret").alias("mean_net"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("turnover").alias("turnover"), (F.sum("turnover") * cost).alias("cost"), F.avg("positions").alias("positions"),
    )
