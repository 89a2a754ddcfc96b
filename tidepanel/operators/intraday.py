"""Irregular rows: ticks and intraday bars. Work is cut by time as well as by instrument."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.elem import quotient
from tidepanel.operators.joins import asof_join


def epoch(ts):
    """Whole seconds of a timestamp without zone."""
    return F.unix_seconds(F.col(ts).cast("timestamp")) if isinstance(ts, str) else F.unix_seconds(ts.cast("timestamp"))


def micros(ts):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def time_halo(df, ts, back_seconds, chunk_seconds=None):
    """Copy the last ``back_seconds`` of every time chunk into the next one."""
    size = max(chunk_seconds or 3600, back_seconds)
    # every chunk is at least as long as the window, so one neighbour is enough
    sec = epoch(ts)
    home = F.floor(sec / size).cast("bigint")
    late = sec - home * size >= size - back_seconds - 1
    target = F.when(late, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("chunk", F.explode(target)).withColumn("own", F.col("chunk") == home)


def row_halo(df, key, order, rows, ts="ts", chunk_seconds=3600):
    """Give every time chunk the ``rows`` rows before it, however many chunks they come from.

    Only the last ``rows`` rows of each chunk travel, so the per-instrument step sees a small table.
    """
    df = df.withColumn("chunk", F.floor(epoch(ts) / chunk_seconds).cast("bigint"))
    newest = Window.partitionBy(key, "chunk").orderBy(*[F.col(c).desc() for c in order])
    tail = df.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= rows).drop("__rn")
    line = Window.partitionBy(key).orderBy(*order)
    packed = F.struct(*[c for c in df.columns if c != "chunk"])
    copies = (
        tail.withColumns(
            {
                "__first": F.coalesce(F.lag("chunk").over(line) != F.col("chunk"), F.lit(True)),
                "__past": F.collect_list(packed).over(line.rowsBetween(-rows, -1)),
            }
        )
        .where("__first")
        .select("chunk", F.explode("__past").alias("__r"))
        .select("chunk", "__r.*", F.lit(False).alias("own"))
    )
    return df.withColumn("own", F.lit(True)).unionByName(copies)


def tick_windows(ticks, rows, seconds):
    """Rolling mean of n rows, and count and sum over a time offset, on ticks."""
    by_rows = row_halo(ticks.select("instrument", "ts", "event_id", "price", "size"), "instrument", ["ts", "event_id"], rows - 1)
    w = Window.partitionBy("instrument", "chunk").orderBy("ts", "event_id").rowsBetween(-(rows - 1), 0)
    a = by_rows.withColumn("rows10", F.avg("price").over(w)).where("own").drop("chunk", "own")
    by_time = time_halo(a, "ts", seconds).withColumn("__us", micros("ts"))
    r = Window.partitionBy("instrument", "chunk").orderBy("__us").rangeBetween(-seconds * 1_000_000, 0)
    out = by_time.withColumns({"n60": F.count(F.lit(1)).over(r), "size_ms": F.sum("size").over(r)})
    return out.where("own").drop("chunk", "own", "__us")


def running_sum(df, keys, order, value, name, ts="ts", chunk_seconds=900):
    """Running sum inside a group: sums of earlier time chunks plus the running sum of the own chunk."""
    chunk = F.floor(epoch(ts) / chunk_seconds).cast("bigint")
    df = df.withColumn("__chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "__chunk").agg(F.sum(value).alias("__s"))
    sums = sums.select(*keys, "__chunk", F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(sums, [*keys, "__chunk"])
        .withColumn(name, F.col("__before") + F.sum(value).over(inside))
        .drop("__chunk", "__before")
    )


def day_cumsum(df, value, start, end, name="value"):
    """Cumulative sum inside a day between two times, 0 outside."""
    clock = F.date_format("ts", "HH:mm:ss.SSSSSS")
    inside = clock.between(f"{start}.000000", f"{end}.000000")
    df = df.withColumns({"__day": F.to_date("ts"), "__in": inside})
    df = df.withColumn("__v", F.when(F.col("__in"), F.col(value)).otherwise(F.lit(0.0)))
    out = running_sum(df, ["instrument", "__day"], ["ts", "event_id"], "__v", "__sum")
    return out.withColumn(name, F.when(F.col("__in"), F.col("__sum")).otherwise(F.lit(0.0))).drop("__day", "__in", "__v", "__sum")


def day_last(df, value, name="value"):
    """Last non-null value of the day on all its rows; the group is reduced before it meets the rows again."""
    order = F.when(F.col(value).isNotNull(), F.struct("ts", "event_id"))
    df = df.withColumn("__day", F.to_date("ts"))
    last = df.groupBy("instrument", "__day").agg(F.max_by(value, order).alias(name))
    return df.join(last, ["instrument", "__day"], "left").drop("__day")


def tresample(ticks, freq, aggs, fill_empty=False):
    """Aggregates per time bin; with ``fill_empty`` every bin between the first and last one of an instrument exists.

    Bins of one instrument are bounded by the clock, and the aggregates are partial, so a busy instrument does no harm.
    """
    out = ticks.groupBy("instrument", F.window("ts", freq)["start"].alias("bin")).agg(*[c.alias(n) for n, c in aggs.items()])
    if not fill_empty:
        return out
    w = Window.partitionBy("instrument").orderBy("bin")
    step = F.expr(f"interval {freq}")
    nxt = F.coalesce(F.lead("bin").over(w) - step, F.col("bin"))
    names = [n for n in aggs]
    return (
        out.withColumn("__to", nxt)
        .select("instrument", F.explode(F.sequence("bin", "__to", step)).alias("__b"), "bin", *names)
        .select("instrument", F.col("__b").alias("bin"), *[F.when(F.col("__b") == F.col("bin"), F.col(n)).alias(n) for n in names])
    )


def tresample_ffill(ticks, freq, value):
    """Densify to fixed bins and carry the last value forward: each bin is expanded up to the next one."""
    last = ticks.groupBy("instrument", F.window("ts", freq)["start"].alias("bin")).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value))
    w = Window.partitionBy("instrument").orderBy("bin")
    step = F.expr(f"interval {freq}")
    to = F.coalesce(F.lead("bin").over(w) - step, F.col("bin"))
    return last.withColumn("__to", to).select("instrument", F.explode(F.sequence("bin", "__to", step)).alias("bin"), value)


def resample_calendar(days, unit, n=1):
    """Every n-th day, first trade day of each week or of each month, every n-th of them."""
    d = days.select("datetime")
    if unit != "day":
        d = d.groupBy(F.date_trunc(unit, "datetime").alias("__u")).agg(F.min("datetime").alias("datetime"))
    # a calendar: one row per trade day
    ix = F.row_number().over(Window.orderBy("datetime")) - 1
    return d.withColumn("__ix", ix).where(F.col("__ix") % n == 0).select("datetime")


def resample_method(df, start, end, method, value, time="datetime"):
    """One value per instrument over a time range."""
    v, t = F.col(value), F.col(time)
    known = F.when(v.isNotNull(), t)
    agg = {
        "last": F.max_by(v, t),
        "first": F.min_by(v, t),
        "mean": F.avg(v),
        "sum": F.sum(v),
        "all": F.bool_and(v) if method == "all" else None,
        "last_valid": F.max_by(v, known),
        "first_valid": F.min_by(v, known),
    }[method]
    return df.where(t.between(F.lit(start), F.lit(end))).groupBy("instrument").agg(agg.alias(method))


def minute_calendar(days, sessions, step="1 minute"):
    """Session minutes of each trade day; sessions are (first, last) clock times."""
    one = lambda a, b: F.sequence(*[F.to_timestamp_ntz(F.concat(F.date_format("datetime", "yyyy-MM-dd"), F.lit(f" {t}"))) for t in (a, b)], F.expr(f"interval {step}"))
    return days.select(F.explode(F.concat(*[one(a, b) for a, b in sessions])).alias("datetime"))


def calendar_by_ratio(df, ratio, time="datetime"):
    """Dates on which at least ``ratio`` of the instruments founded by then traded."""
    first = df.groupBy("instrument").agg(F.min(time).alias(time)).groupBy(time).agg(F.count(F.lit(1)).alias("founded"))
    daily = df.select("instrument", time).distinct().groupBy(time).agg(F.count(F.lit(1)).alias("traded"))
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    j = daily.join(first, time, "left").withColumn("alive", F.sum(F.coalesce("founded", F.lit(0))).over(w))
    return j.where(F.col("traded") >= ratio * F.col("alive")).select(time, "traded", "alive")


def order_book_features(quotes):
    """Per hour, for one level: relative spread at the last quote, size share and last price."""
    last = lambda c: F.max_by(c, F.struct("ts", "event_id"))
    g = quotes.groupBy("instrument", F.window("ts", "60 minutes")["start"].alias("bin")).agg(
        last(F.col("ask") - F.col("bid")).alias("spread"),
        last(F.col("ask") + F.col("bid")).alias("total"),
        F.avg("size").alias("mean_size"),
        F.sum("size").alias("volume"),
        last("price").alias("last_price"),
    )
    return g.select(
        "instrument", "bin",
        (2 * F.col("spread") / F.when(F.col("total") != 0, F.col("total"))).alias("p_spread"),
        (F.col("mean_size") / F.col("volume")).alias("v_share"),
        "last_price",
    )


def intensity(ticks, code, short_seconds, long_seconds):
    """Share of one event code over a short and a long time window, per row; averaged per hour by the caller."""
    flag = (F.col("code") == code).cast("int")
    df = time_halo(ticks.withColumns({"__us": micros("ts"), "__f": flag}), "ts", long_seconds)
    part = Window.partitionBy("instrument", "chunk").orderBy("__us")

    def inside(count, s):
        """Rows of the window: those up to now without those before it. Both counts only grow, so a row costs the same in a dense window."""
        until = lambda end: part.rangeBetween(Window.unboundedPreceding, end)
        return count.over(until(0)) - F.coalesce(count.over(until(-s * 1_000_000 - 1)), F.lit(0))

    def ratio(s):
        known = inside(F.count("__f"), s)
        return F.when(known > 0, inside(F.count_if(F.col("__f") == 1), s) / inside(F.count(F.lit(1)), s))

    out = df.withColumns({"short": ratio(short_seconds), "long": ratio(long_seconds)}).where("own")
    return out.groupBy("instrument", F.window("ts", "60 minutes")["start"].alias("bin")).agg(
        F.avg("short").alias("intensity"), F.avg((F.col("short") > F.col("long")).cast("double")).alias("relative_intensity")
    )


def order_book_levels(quotes, levels, rows_back=5, seconds_back=60, step=3):
    """Per minute, over books of ``levels`` levels (arrays ask, bid, asize, bsize; level 1 first).

    At the last quote and relative to half the sum of its best prices: spread and mid per level, differences between neighbouring
    levels and between the outermost ones, accumulated spread over all levels. Relative to all sizes of the minute: mean sizes per level,
    on average, and their imbalance. Change rates: of the best prices between steps of ``step`` seconds, and of their sum against the
    quote ``rows_back`` rows and ``seconds_back`` seconds before; the minute takes their mean. What has no partner is missing.
    """
    minute = F.window("ts", "1 minute")["start"]
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    q = quotes.select("instrument", "ts", "event_id", "ask", "bid", "asize", "bsize")
    last = F.max_by(F.struct("ask", "bid"), F.struct("ts", "event_id")).alias("q")
    sizes = [F.avg(F.col(c)[i]).alias(f"{c}_{i + 1}") for c in ("asize", "bsize") for i in range(levels)]
    g = q.groupBy("instrument", minute.alias("bin")).agg(last, F.sum(total("asize") + total("bsize")).alias("volume"), *sizes)
    ask, bid, best = F.col("q.ask"), F.col("q.bid"), F.col("q.ask")[0] + F.col("q.bid")[0]
    price = lambda e: 2 * e / F.when(best != 0, best)
    share = lambda e: e / F.when(F.col("volume") != 0, F.col("volume"))
    side = lambda c: sum((F.col(f"{c}_{i + 1}") for i in range(levels)), F.lit(0.0))
    out = {}
    for i in range(levels):
        out[f"p_spread_{i + 1}"], out[f"p_mid_{i + 1}"] = price(ask[i] - bid[i]), price((ask[i] + bid[i]) / 2)
        for c in ("asize", "bsize"):
            out[f"v_{c}_{i + 1}"] = share(F.col(f"{c}_{i + 1}"))
    for name, e in (("ask", ask), ("bid", bid)):
        for i in range(levels - 1):
            out[f"p_diff_{name}_{i + 1}_{i + 2}"] = price(F.abs(e[i + 1] - e[i]))
        out[f"p_diff_{name}_1_{levels}"] = price(F.abs(e[levels - 1] - e[0]))
    out["p_accspread"] = price(total(ask) - total(bid))
    out.update({"v_avg_asize": share(side("asize") / levels), "v_avg_bsize": share(side("bsize") / levels), "v_accspread": share(side("asize") - side("bsize"))})
    g = g.select("instrument", "bin", best.alias("__best"), *[e.alias(n) for n, e in out.items()])

    # steps that follow one another: an equal join on the step's number
    steps = q.groupBy("instrument", F.floor(epoch("ts") / step).cast("long").alias("__k")).agg(F.max_by(F.struct(F.col("ask")[0].alias("a"), F.col("bid")[0].alias("b")), F.struct("ts", "event_id")).alias("now"))
    before = steps.select("instrument", (F.col("__k") + 1).alias("__k"), F.col("now").alias("then"))
    rate = lambda c: F.avg(2 * (F.col(f"now.{c}") - F.col(f"then.{c}")) / step)
    moved = steps.join(before, ["instrument", "__k"]).groupBy("instrument", F.timestamp_seconds(F.floor(F.col("__k") * step / 60) * 60).cast("timestamp_ntz").alias("bin")).agg(rate("a").alias("__a"), rate("b").alias("__b"))

    s = q.select("instrument", "ts", "event_id", (F.col("ask")[0] + F.col("bid")[0]).alias("s"))
    near = row_halo(s, "instrument", ["ts", "event_id"], rows_back)
    line = Window.partitionBy("instrument", "chunk").orderBy("ts", "event_id")
    near = near.withColumn("then", F.lag("s", rows_back).over(line)).where("own").groupBy("instrument", minute.alias("bin")).agg(F.avg(quotient(F.col("s"), F.col("then")) - 1).alias(f"change_{rows_back}_rows"))
    past = s.select("instrument", (F.col("ts") - F.expr(f"INTERVAL {seconds_back} SECOND")).alias("at"), "ts", "event_id", F.col("s").alias("now"))
    held = asof_join(past.withColumnRenamed("ts", "here"), s.select("instrument", F.col("ts").alias("at"), F.col("event_id").alias("e"), F.col("s").alias("then")), time="at", tie="e")
    held = held.groupBy("instrument", F.window("here", "1 minute")["start"].alias("bin")).agg(F.avg(quotient(F.col("now"), F.col("then")) - 1).alias(f"change_{seconds_back}_s"))
    g = g.join(moved, ["instrument", "bin"], "left").join(near, ["instrument", "bin"]).join(held, ["instrument", "bin"])
    best = F.when(F.col("__best") != 0, F.col("__best"))
    return g.withColumns({f"p_diff_ask_1_{step}s": F.col("__a") / best, f"p_diff_bid_1_{step}s": F.col("__b") / best}).drop("__a", "__b", "__best")
