"""Market-data cleaning, price adjustment and health checks."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.elem import quotient

PRICES = ["open", "high", "low", "close"]


def by_time(time="datetime"):
    return Window.partitionBy("instrument").orderBy(time)


def norm_bars(panel, volume_rule=True):
    """Aligned bars: values become null where nothing traded; change against the last valid close."""
    dead = F.coalesce(F.col("volume") <= 0, F.lit(True)) if volume_rule else F.lit(False)
    d = panel.withColumns({c: F.when(~dead, F.col(c)) for c in [*PRICES, "volume"]})
    w = by_time()
    known = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    prev = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumns({"change": quotient(known, prev) - 1})


def fix_unit_jump(df, low=89.0, high=111.0):
    """Rows whose close jumps by a factor of about a hundred are divided by 100, repeated until no row jumps.

    A repair can show the next jump, so the number of rounds depends on the series. An instrument's rows, which the calendar
    bounds, are repaired together; a jump is measured against the last close before it that is not null.
    """
    names = df.columns

    def repair(f):
        f = f.sort_values("datetime", kind="stable").reset_index(drop=True)
        at = np.flatnonzero(f["close"].notna().to_numpy())
        prices = f[PRICES].to_numpy(dtype=float, copy=True)
        close = PRICES.index("close")
        while True:
            c = prices[at, close]
            with np.errstate(divide="ignore", invalid="ignore"):
                change = c[1:] / c[:-1] - 1
            jumps = at[1:][(change >= low) & (change <= high)]
            if not len(jumps):
                break
            prices[jumps] /= 100
        f[PRICES] = prices
        return f[names]

    return df.groupBy("instrument").applyInPandas(repair, df.schema)


def adjust_price(df):
    """factor = last valid adjusted close / close; prices times factor, volume over factor."""
    f = F.last(F.when(F.col("close") != 0, F.col("adjclose") / F.when(F.col("close") != 0, F.col("close"))), ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("factor", f)
    return d.withColumns({**{c: F.col(c) * F.col("factor") for c in PRICES}, "volume": F.col("volume") / F.col("factor")})


def rebase_first(df):
    """Prices over the first valid close, volume times it. The first close is an aggregate joined back."""
    first = df.groupBy("instrument").agg(F.min_by("close", F.when(F.col("close").isNotNull(), F.col("datetime"))).alias("__first"))
    d = df.join(first, "instrument")
    return d.withColumns({**{c: F.col(c) / F.col("__first") for c in PRICES}, "volume": F.col("volume") * F.col("__first")}).drop("__first")


def rebase_extend(new, stored):
    """New rows scaled to the stored level at the last stored date of each instrument."""
    last = stored.where("close IS NOT NULL").groupBy("instrument").agg(F.max("datetime").alias("__at"), F.max_by("close", "datetime").alias("__level"))
    at = new.join(last, "instrument").where(F.col("datetime") == F.col("__at")).select("instrument", (F.col("__level") / F.col("close")).alias("__k"))
    d = new.join(last.select("instrument", "__at"), "instrument", "left").join(at, "instrument", "left").where(F.col("__at").isNull() | (F.col("datetime") > F.col("__at")))
    k = F.coalesce("__k", F.lit(1.0))
    return d.withColumns({**{c: F.col(c) * k for c in PRICES}, "volume": F.col("volume") / k}).drop("__at", "__k")


def adjust_intraday(minutes, daily, paused_min=1):
    """Intraday bars scaled by day close / last intraday close of the day; days without volume are paused."""
    d = minutes.withColumn("day", F.to_date("datetime"))
    last = d.groupBy("instrument", "day").agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("datetime"))).alias("__last"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("__v")
    )
    day = daily.select("instrument", F.col("datetime").alias("day"), F.col("close").alias("__day"))
    k = last.join(day, ["instrument", "day"], "left").select("instrument", "day", (F.col("__day") / F.when(F.col("__last") != 0, F.col("__last"))).alias("__k"), (F.col("__v") <= 0).alias("paused"))
    d = d.join(k, ["instrument", "day"])
    return d.withColumns({c: F.col(c) * F.col("__k") for c in PRICES}).drop("__k")


def paused_num(panel):
    """Running count of traded days since the last pause; leading and trailing empty days are dropped by the panel's spans."""
    w = by_time()
    on = F.col("close").isNotNull()
    d = panel.withColumn("__run", F.sum((~on).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("instrument", "__run").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("paused_num", F.sum(on.cast("int")).over(inside)).drop("__run")


def fill_minutes(daily, minutes, sessions, step):
    """Instruments with daily but without intraday rows: empty rows for their days."""
    from tidepanel.operators.intraday import minute_calendar

    gone = daily.join(minutes.select("instrument").distinct(), "instrument", "left_anti").select("instrument", F.col("datetime"))
    slots = minute_calendar(gone.select("datetime").distinct(), sessions, step).select(F.col("datetime").alias("minute"), F.to_date("datetime").alias("datetime"))
    return gone.join(slots, "datetime").select("instrument", F.col("minute").alias("datetime"))


def total_return_adjust(df, ret="ret"):
    """Adjusted close from returns: the first close times the running product of 1 + r, prices scaled along.

    A missing return falls back to the change of the raw close; after a total loss the adjusted close stays zero.
    """
    line = by_time()
    w = line.rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("close", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("__r", F.coalesce(F.col(ret), F.col("close") / F.when(before != 0, before) - 1, F.lit(0.0)))
    lost = F.max(F.col("__r") <= -1).over(w)
    growth = F.when(lost, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(F.when(F.col("__r") > -1, 1 + F.col("__r")).otherwise(1.0))).over(w)))
    first = F.first("close", ignorenulls=True).over(w)
    d = d.withColumn("adj_close", first * growth).withColumn("__k", F.col("adj_close") / F.when(F.col("close") != 0, F.col("close")))
    d = d.withColumns({f"adj_{c}": F.col(c) * F.col("__k") for c in ("open", "high", "low")}).drop("__k", "__r")
    return d.withColumn("adj_vwap", (F.col("adj_open") + F.col("adj_high") + F.col("adj_low") + F.col("adj_close")) / 4)


def forward_return(df, h, ret="ret"):
    """Compound return of the next h rows; all of them must exist."""
    w = by_time().rowsBetween(1, h)
    full = F.count(ret).over(w) == h
    return df.withColumn("forward", F.when(full, F.product(1 + F.col(ret)).over(w) - 1))


def pit_normalize(df):
    """Missing report date = period end + 45 days (quarter) or 90 (year); period as yyyyqq or yyyy."""
    lag = F.when(F.col("annual"), 90).otherwise(45)
    return df.withColumns(
        {
            "date": F.coalesce("date", F.date_add("period_end", lag)),
            "period": F.when(F.col("annual"), F.year("period_end")).otherwise(F.year("period_end") * 100 + F.quarter("period_end")),
        }
    )


def to_prefix(symbol):
    """600000.SH -> SH600000."""
    return F.upper(F.regexp_replace(symbol, r"^(\w+)\.(\w+)$", "$2$1"))


def to_suffix(symbol):
    return F.regexp_replace(F.upper(symbol), r"^([A-Z]{2})(\d+)$", "$2.$1")


# fixed values: names that a file system reserves
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(10)], *[f"LPT{i}" for i in range(10)])


def to_file_name(symbol):
    return F.when(F.upper(symbol).isin(*RESERVED), F.concat(F.lit("_file_"), symbol)).otherwise(symbol)


def missing_counts(df, cols, limit):
    n = df.groupBy("instrument").agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return n.where(" OR ".join(f"{c} > {limit}" for c in cols))


def large_steps(df, col, limit):
    """Largest absolute percent change above a limit and the first date it was broken."""
    step = F.abs(F.col(col) / F.when(F.lag(col).over(by_time()) != 0, F.lag(col).over(by_time())) - 1)
    d = df.withColumn("__s", step)
    out = d.groupBy("instrument").agg(F.max("__s").alias("largest"), F.min(F.when(F.col("__s") > limit, F.col("datetime"))).alias("first_date"))
    return out.where(F.col("largest") > limit)


def missing_columns(df, required=("open", "high", "low", "close", "volume")):
    """Required columns that the table lacks, and the filled rows of the others."""
    have = {c: F.count(c) if c in df.columns else F.lit(0).cast("bigint") for c in required}
    counts = df.agg(*[v.alias(c) for c, v in have.items()])
    long = counts.unpivot([], [F.col(c) for c in required], "name", "rows")
    return long.withColumn("missing", F.col("name").isin([c for c in required if c not in df.columns]))


def empty_factor(df, factor, exempt):
    return df.groupBy("instrument").agg(F.count(factor).alias("n")).where((F.col("n") == 0) & ~F.col("instrument").rlike(exempt))


def check(name, df, bad):
    """One-row check: how many rows fail and how many pass."""
    return df.agg(F.lit(name).alias("check_id"), F.count(F.when(bad, 1)).alias("fails"), F.count(F.when(~bad, 1)).alias("passes"))
