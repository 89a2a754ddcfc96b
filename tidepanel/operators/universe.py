"""Instruments, member spans, filters and universe selection."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators.scale import bounded, exact_quantiles, xs_top


def clip_spans(spans, start, end):
    s, e = F.greatest("start", F.lit(start)), F.least("end", F.lit(end))
    return spans.withColumns({"start": s, "end": e}).where("start <= end")


def membership_mask(df, spans):
    """Rows inside any span of their instrument."""
    s = spans.select(F.col("instrument").alias("__i"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    return df.join(s, (df["instrument"] == F.col("__i")) & F.col("datetime").between(F.col("__s"), F.col("__e")), "left_semi")


def name_filter(df, pattern):
    """Keep names that match the pattern from their start on."""
    return df.where(F.col("instrument").rlike(f"^(?:{pattern})"))


def expression_filter(df, flag, start, end, keep):
    """AND a boolean column into membership between two dates; missing flags follow ``keep``, other dates pass."""
    inside = F.col("datetime").between(F.lit(start), F.lit(end))
    return df.where(~inside | F.coalesce(F.col(flag), F.lit(keep)))


def flags_to_spans(df, flag="flag"):
    """Runs of True along each instrument's calendar rows as (start, end)."""
    w = Window.partitionBy("instrument").orderBy("datetime")
    on = F.coalesce(F.col(flag), F.lit(False))
    begins = on & ~F.coalesce(F.lag(on).over(w), F.lit(False))
    run = F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = df.select("instrument", "datetime", on.alias("__on"), run.alias("__run")).where("__on")
    return runs.groupBy("instrument", "__run").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end")).drop("__run")


def spans_to_flags(spans, calendar, calendar_rows=None):
    """True / false per calendar slot and instrument. Span ends are turned into slots and expanded, no range join."""
    cal = bounded(calendar, calendar_rows)
    ends = calendar.agg(F.min("cal_ix").alias("__lo"), F.max("cal_ix").alias("__hi"))
    at = calendar.select(F.col("datetime").alias("start"), F.col("cal_ix").alias("__a"))
    to = calendar.select(F.col("datetime").alias("end"), F.col("cal_ix").alias("__b"))
    inside = (
        spans.join(bounded(at, calendar_rows), "start")
        .join(bounded(to, calendar_rows), "end")
        .select("instrument", F.explode(F.sequence("__a", "__b")).alias("cal_ix"))
        .distinct()
        .withColumn("__in", F.lit(True))
    )
    grid = spans.select("instrument").distinct().crossJoin(F.broadcast(ends)).select("instrument", F.explode(F.sequence("__lo", "__hi")).alias("cal_ix"))
    return (
        grid.join(inside, ["instrument", "cal_ix"], "left")
        .join(cal, "cal_ix")
        .select("instrument", "datetime", F.coalesce("__in", F.lit(False)).alias("flag"))
    )


def filter_pipe(df, filters):
    for f in filters:
        df = f(df)
    return df


def cover_range(df, start, end):
    """Instruments whose data reaches over the whole range."""
    full = df.groupBy("instrument").agg(F.min("datetime").alias("a"), F.max("datetime").alias("b"))
    full = full.where((F.col("a") <= F.lit(start)) & (F.col("b") >= F.lit(end)))
    return df.join(full, "instrument", "left_semi")


def select_slice(df, start=None, end=None, instruments=None, keys=None):
    if start is not None:
        df = df.where(F.col("datetime") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("datetime") <= F.lit(end))
    if instruments is not None:
        df = df.where(F.col("instrument").isin(list(instruments)))
    return df.join(keys, ["instrument", "datetime"], "left_semi") if keys is not None else df


def select_colset(df, group):
    """Columns of one group (prefix ``group.``), without the prefix; ``all`` keeps every column."""
    if group == "all":
        return df
    names = [c for c in df.columns if c.startswith(group + ".")]
    return df.select("instrument", "datetime", *[F.col(f"`{c}`").alias(c[len(group) + 1 :]) for c in names])


def last_dates(calendar, date, k):
    """The last k trade dates up to a date."""
    upto = calendar.where(F.col("datetime") <= F.lit(date))
    top = upto.agg(F.max("cal_ix").alias("__top"))
    return upto.join(F.broadcast(top), F.col("cal_ix") > F.col("__top") - k).drop("__top")


def trailing_slices(df, calendar, k, calendar_rows=None):
    """Rows of the trailing k dates of every date: each row goes to the k slices that contain it."""
    last = calendar.agg(F.max("cal_ix").alias("__top"))
    spread = df.crossJoin(F.broadcast(last)).withColumn(
        "slice_ix", F.explode(F.sequence(F.col("cal_ix"), F.least(F.col("cal_ix") + (k - 1), F.col("__top"))))
    )
    ends = calendar.select(F.col("cal_ix").alias("slice_ix"), F.col("datetime").alias("slice_end"))
    return spread.join(bounded(ends, calendar_rows), "slice_ix").drop("__top")


def tag_segments(df, segments):
    """Rows with the name of their time segment; ``segments`` is a handful of rows (segment, start, end)."""
    s = F.broadcast(segments)
    return df.join(s, F.col("datetime").between(s["start"], s["end"])).drop("start", "end")


def spans_from_changes(changes, current, first_date, last_date):
    """Add / remove events and the members of today -> member spans.

    An add opens a span that the next remove closes; a remove without an add before it was open from the start;
    a member of today without any event was always in.
    """
    w = Window.partitionBy("instrument").orderBy("date", "kind")
    e = changes.withColumns({"next_date": F.lead("date").over(w), "next_kind": F.lead("kind").over(w), "prev_kind": F.lag("kind").over(w)})
    adds = e.where("kind = 'add'").select(
        "instrument",
        F.col("date").alias("start"),
        F.when(F.col("next_kind") == "remove", F.col("next_date")).otherwise(F.coalesce("next_date", F.lit(last_date))).alias("end"),
    )
    opens = e.where("kind = 'remove' AND (prev_kind IS NULL OR prev_kind = 'remove')").select(
        "instrument", F.lit(first_date).alias("start"), F.col("date").alias("end")
    )
    always = current.join(changes, "instrument", "left_anti").select(
        "instrument", F.lit(first_date).alias("start"), F.lit(last_date).alias("end")
    )
    return adds.unionByName(opens).unionByName(always)


def snapshot_diff(members, calendar, calendar_rows=None):
    """Members per snapshot (instrument, cal_ix) -> add / remove events at the later snapshot of each pair."""
    cal = bounded(calendar, calendar_rows)
    tops = members.agg(F.min("cal_ix").alias("__lo"), F.max("cal_ix").alias("__hi"))
    both = members.select("instrument", "cal_ix").crossJoin(F.broadcast(tops))
    before = both.select("instrument", (F.col("cal_ix") - 1).alias("cal_ix"))
    after = both.select("instrument", (F.col("cal_ix") + 1).alias("cal_ix"))
    adds = both.where("cal_ix > __lo").join(after, ["instrument", "cal_ix"], "left_anti").select("instrument", "cal_ix", F.lit("add").alias("kind"))
    gone = both.where("cal_ix < __hi").join(before, ["instrument", "cal_ix"], "left_anti").select("instrument", (F.col("cal_ix") + 1).alias("cal_ix"), F.lit("remove").alias("kind"))
    return adds.unionByName(gone).join(cal, "cal_ix").select("instrument", "datetime", "kind")


def monthly_topn(df, calendar, n, cap="cap", calendar_rows=None):
    """Top n by size on the last trade date of each month, effective from the next trade date to the day before the next start."""
    month = F.trunc("datetime", "month")
    ends = calendar.groupBy(month.alias("month")).agg(F.max("cal_ix").alias("cal_ix"))
    line = Window.orderBy("cal_ix")
    starts = calendar.select((F.col("cal_ix") - 1).alias("cal_ix"), F.col("datetime").alias("effective_start"))
    # one row per month
    plan = ends.join(starts, "cal_ix", "left").withColumn("effective_end", F.date_sub(F.lead("effective_start").over(line), 1))
    chosen = df.join(bounded(plan, calendar_rows), "cal_ix").where(F.col(cap).isNotNull())
    return xs_top(chosen, ["month"], [F.col(cap).desc(), F.col("instrument")], n)


# fixed values: what counts as common equity
COMMON_TYPES = ("COMMON", "CS", "ADR")
EXCLUDED_NAME = r"(?i)\b(warrant|unit|right|preferred|etf|fund|note)s?\b"


def equity_filter(df, types=COMMON_TYPES, exchanges=None, allow_adr=True, excluded=EXCLUDED_NAME):
    keep = F.col("type").isin(list(types))
    if exchanges:
        keep &= F.col("exchange").isin(list(exchanges))
    if not allow_adr:
        keep &= ~F.coalesce(F.col("is_adr"), F.lit(False))
    return df.where(keep & ~F.col("name").rlike(excluded))


def latest_members(df):
    """Latest row per instrument with first and last membership and the number of months."""
    values = [c for c in df.columns if c not in ("instrument", "datetime")]
    return df.groupBy("instrument").agg(
        F.max(F.struct("datetime", *values)).alias("__r"),
        F.min("datetime").alias("first_member"),
        F.max("datetime").alias("last_member"),
        F.count_distinct(F.trunc("datetime", "month")).alias("months"),
    ).select("instrument", *[F.col(f"__r.{c}").alias(c) for c in values], "first_member", "last_member", "months")


def asof_universe(caps, bars, asof, n):
    """Size as of a date = size today * close as of / latest close; reasons for leaving a name out; the top n."""
    past = F.col("datetime") <= F.lit(asof)
    px = bars.where("close IS NOT NULL").groupBy("instrument").agg(
        F.max_by("close", "datetime").alias("latest"),
        F.max_by(F.when(past, F.col("close")), F.when(past, F.col("datetime"))).alias("asof_close"),
    )
    j = caps.join(px, "instrument", "left").withColumn("asof_cap", F.col("cap") * F.col("asof_close") / F.when(F.col("latest") > 0, F.col("latest")))
    reason = (
        F.when(F.col("cap").isNull(), "no_cap").when(F.col("latest").isNull(), "no_price").when(F.col("asof_close").isNull(), "no_price_asof")
    )
    j = j.withColumn("reason", reason)
    order = [F.col("asof_cap").desc(), F.col("instrument")]
    # the limit keeps n rows a task; only n rows are numbered
    top = j.where("reason IS NULL").orderBy(*order).limit(n).withColumn("top_rank", F.row_number().over(Window.orderBy(*order)))
    return top, j


# fixed values: security kinds by name text, first match wins
SECURITY_RULES = (
    ("warrant", r"(?i)\bwarrants?\b"),
    ("unit", r"(?i)\bunits?\b"),
    ("preferred", r"(?i)\b(preferred|preference)\b"),
    ("fund", r"(?i)\b(etf|fund|trust)\b"),
    ("adr", r"(?i)\b(adr|ads|depositary)\b"),
)


def classify(name, rules=SECURITY_RULES, default="common"):
    out = F
    for kind, pattern in rules:
        out = out.when(name.rlike(pattern), F.lit(kind))
    return out.otherwise(F.lit(default))


def liquidity_profile(df, min_volume=0.0, max_zero=1.0):
    """Last 20 / 60 rows per instrument: mean and median money volume, zero-volume share, last close; then a threshold."""
    w = Window.partitionBy("instrument").orderBy(F.col("datetime").desc())
    last = df.withColumn("__rn", F.row_number().over(w)).where("__rn <= 60")
    money = F.col("close") * F.col("volume")
    near = F.col("__rn") <= 20
    # at most 60 rows per instrument reach the median
    out = last.groupBy("instrument").agg(
        F.avg(F.when(near, money)).alias("mean20"),
        F.avg(money).alias("mean60"),
        F.percentile(F.when(near, money), F.lit(0.5)).alias("median20"),
        F.percentile(money, F.lit(0.5)).alias("median60"),
        F.avg((F.coalesce(F.col("volume"), F.lit(0.0)) <= 0).cast("double")).alias("zero_share"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("datetime"))).alias("last_close"),
    )
    return out.where((F.col("mean20") >= min_volume) & (F.col("zero_share") <= max_zero))


def history_bucket(df, limits=((60, "new"), (120, "short"), (250, "medium"))):
    """Row count per instrument -> age bucket, limits inclusive."""
    rows = df.groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))
    b = F
    for top, name in limits:
        b = b.when(F.col("rows") <= top, F.lit(name))
    return rows.withColumn("bucket", b.otherwise(F.lit("long")))
