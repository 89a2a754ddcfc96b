"""Joins on panel keys, as-of joins and calendar joins."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.session import cut_lineage
from tidepanel.operators.scale import bounded

KEYS = ["instrument", "datetime"]


def join_groups(groups, keys=KEYS):
    """Column groups side by side (full outer); columns are named group_column."""
    parts = [df.select(*keys, *[F.col(c).alias(f"{g}_{c}") for c in df.columns if c not in keys]) for g, df in groups.items()]
    return reduce(lambda a, b: a.join(b, keys, "outer"), parts)


def join_nested(left, right, how="left", keys=KEYS):
    """On an equal column name the right side wins."""
    twice = [c for c in left.columns if c in right.columns and c not in keys]
    return left.drop(*twice).join(right, keys, how)


def index_align(a, b, op, fill, keys=("label",), value="value"):
    """Binary operation over the union of keys; a missing side takes the fill value."""
    r = b.select(*keys, F.col(value).alias("__b"))
    j = a.select(*keys, F.col(value).alias("__a")).join(r, list(keys), "outer")
    f = F.lit(fill)
    return j.select(*keys, op(F.coalesce("__a", f), F.coalesce("__b", f)).alias(value))


#: Rows of a key (both sides of an as-of join) that one window takes; a busier key is cut in time.
SPLIT_ROWS = 1_000_000
#: Quantiles that such cuts are taken from.
PARTS = 256


def asof_join(left, right, key="instrument", time="datetime", valid_until=None, chunk_days=None, tie=None, split_rows=SPLIT_ROWS):
    """Newest right row at or before each left row: both sides in one sequence, last value carried. One shuffle, no Python.

    A key with more than ``split_rows`` rows is cut at approximate quantiles of its times, so that no window takes a large share of
    the table; ``chunk_days`` cuts every key into chunks of so many days instead. The last right row of each part is carried
    forward. Of right rows at one time the one with the largest ``tie`` counts.
    """
    values = [c for c in right.columns if c not in (key, time)]
    packed = F.struct(F.col(time).alias("__at"), *values)
    lv = [c for c in left.columns if c not in (key, time)]
    last = F.col(tie).cast("string") if tie and dict(right.dtypes)[tie] == "string" else F.col(tie) if tie else F.lit(0)
    b = right.select(key, time, F.lit(None).cast(left.select(F.struct(*lv).alias("x")).schema["x"].dataType).alias("__l"), packed.alias("__r"), F.lit(0).alias("__side"), last.alias("__tie"))
    none = F.lit(None).cast(b.schema["__tie"].dataType)
    a = left.select(key, time, F.struct(*lv).alias("__l"), F.lit(None).cast(b.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__side"), none.alias("__tie"))
    both = a.unionByName(b)
    part = [key, "__chunk"]
    if chunk_days:
        both = both.withColumn("__chunk", F.floor(F.datediff(F.col(time), F.lit("1970-01-01").cast("date")) / chunk_days))
    else:
        at = F.unix_micros(F.col(time).cast("timestamp"))
        load = left.select(key, time).unionByName(right.select(key, time)).groupBy(key)
        load = load.agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx(at, [i / PARTS for i in range(1, PARTS)], F.lit(1000)).alias("__cuts"))
        # at most one row for every ``split_rows`` rows of the input
        busy = cut_lineage(load.where(F.col("__n") > split_rows).select(key, "__n", "__cuts"))
        step = F.greatest(F.lit(1), F.floor(F.lit(PARTS) * split_rows / F.col("__n"))).cast("int")
        busy = busy.select(key, F.array_distinct(F.filter("__cuts", lambda c, i: (i + 1) % step == 0)).alias("__cuts"))
        chunk = F.size(F.filter("__cuts", lambda c: c < at))
        both = both.join(bounded(busy, busy.count()), key, "left").withColumn("__chunk", F.when(F.col("__cuts").isNotNull(), chunk).otherwise(0)).drop("__cuts")
    w = Window.partitionBy(*part).orderBy(time, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w))
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    # every part that has a left row needs a carry, also one without right rows
    chunks = both.groupBy(*part).agg(F.max_by("__r", F.when(F.col("__side") == 0, F.struct(time, "__tie"))).alias("__c"))
    carry = chunks.select(*part, F.last("__c", ignorenulls=True).over(before).alias("__carry"))
    # only parts after the first have one
    carry = carry.where("__carry IS NOT NULL")
    both = both.join(carry, part, "left").withColumn("__m", F.coalesce("__m", "__carry"))
    out = both.where("__side = 1").select(key, time, "__l.*", F.col("__m.__at").alias("matched_at"), *[F.col(f"__m.{c}").alias(c) for c in values])
    if valid_until:
        ok = F.col(time) <= F.col(valid_until)
        out = out.withColumns({c: F.when(ok, F.col(c)) for c in (*values, "matched_at")})
    return out


def next_date_join(events, calendar, date="date", lag=1, calendar_rows=None):
    """First trade date strictly after the event (and ``lag`` - 1 dates later).

    The number of trade dates up to the event is the slot of the next one; it comes from an as-of pass over the days.
    """
    cal = calendar.select(F.col("datetime"), F.col("cal_ix"))
    line = calendar.select(F.col("datetime").alias("__from"), F.lead("datetime").over(Window.orderBy("datetime")).alias("__to"), F.col("cal_ix").alias("__ix"))
    # days after the last trade date have no next one; days before the first have the first
    days = line.where("__to IS NOT NULL").select(F.explode(F.sequence("__from", F.date_sub("__to", 1))).alias(date), (F.col("__ix") + lag).alias("cal_ix"))
    first = calendar.agg(F.min("datetime").alias("__first"), F.min("cal_ix").alias("__ix"))
    head = events.agg(F.min(date).cast("date").alias("__from")).crossJoin(F.broadcast(first)).where("__from < __first")
    early = head.select(F.explode(F.sequence("__from", F.date_sub("__first", 1))).alias(date), (F.col("__ix") + lag - 1).alias("cal_ix"))
    found = events.join(bounded(days.unionByName(early), None), date, "left")
    return found.join(bounded(cal, calendar_rows), "cal_ix", "left").withColumnRenamed("datetime", "visible_date")


def broadcast_dates(daily, instruments, rows=None):
    """Market-wide daily table for every instrument. The dates are the bounded side."""
    return instruments.crossJoin(bounded(daily, rows))


def forward_prices(signals, prices, calendar, lag, hold, calendar_rows=None):
    """Entry and exit price per signal: trade date + lag and + lag + hold."""
    cal = bounded(calendar, calendar_rows)
    s = signals.join(cal, "datetime")
    p = prices.join(cal, "datetime").select("instrument", "cal_ix", "datetime", "price")
    entry = p.select("instrument", (F.col("cal_ix") - lag).alias("cal_ix"), F.col("datetime").alias("entry_date"), F.col("price").alias("entry_price"))
    leave = p.select("instrument", (F.col("cal_ix") - lag - hold).alias("cal_ix"), F.col("datetime").alias("exit_date"), F.col("price").alias("exit_price"))
    return s.join(entry, ["instrument", "cal_ix"], "left").join(leave, ["instrument", "cal_ix"], "left")


def position_diff(a, b, keys=("date", "instrument")):
    x, y = a.select(*keys, F.col("weight").alias("weight_a")), b.select(*keys, F.col("weight").alias("weight_b"))
    kind = F.when(F.col("weight_a").isNull(), "added").when(F.col("weight_b").isNull(), "removed").otherwise("kept")
    return x.join(y, list(keys), "outer").withColumn("change", kind)


def order_diff(target, current, unit=100, tradable=None):
    """Target minus current amounts as orders: whole units, a full sale keeps its odd lot, non-tradable names are left out."""
    t, c = target.select("instrument", F.col("amount").alias("t")), current.select("instrument", F.col("amount").alias("c"))
    j = t.join(c, "instrument", "outer").na.fill(0.0, ["t", "c"])
    if tradable is not None:
        j = j.join(tradable, "instrument", "left_semi")
    diff = F.abs(F.col("t") - F.col("c"))
    whole = F.floor(diff / unit) * unit
    amount = F.when(F.col("t") == 0, F.col("c")).otherwise(whole)
    return j.withColumns({"direction": F.when(F.col("t") > F.col("c"), "buy").otherwise("sell"), "amount": amount}).where("amount > 0 AND t <> c").select("instrument", "direction", "amount")


def column_blocks(df, names, width=64):
    """A column of its own for each instrument: (instrument, bucket, block, col), where col is one of c0 .. c{width - 1}.

    ``names`` is the instrument count. A bucket takes about ``width`` instruments; one that takes more has several blocks, so no block
    is wider than that.
    """
    buckets = max(1, -(-names // width))
    d = df.select("instrument").distinct().withColumn("bucket", F.pmod(F.hash("instrument"), F.lit(buckets)))
    n = F.row_number().over(Window.partitionBy("bucket").orderBy("instrument")) - 1
    return d.select("instrument", "bucket", F.floor(n / width).alias("block"), F.concat(F.lit("c"), n % width).alias("col"))


def pivot_blocks(df, places, value, width=64):
    """One wide row per date and block of ``column_blocks``."""
    return df.join(places, "instrument").groupBy("datetime", "bucket", "block").pivot("col", [f"c{k}" for k in range(width)]).agg(F.max(value))


def unpivot_blocks(wide, places, value, width=64):
    """Back to long rows; empty cells give none."""
    long = wide.unpivot(["datetime", "bucket", "block"], [f"c{k}" for k in range(width)], "col", value).where(F.col(value).isNotNull())
    return long.join(places, ["bucket", "block", "col"]).select("instrument", "datetime", value)
