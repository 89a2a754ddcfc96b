"""Point-in-time records: (instrument, field, date, period, value, seq)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators.joins import asof_join


def quarter_number(period):
    return F.expr(f"{period} div 100 * 4 + {period} % 100 - 1").cast("int")


def revision_pick(records, asof=None):
    """Newest record per period (not after a date). A max over a struct merges map-side."""
    if asof is not None:
        records = records.where(F.col("date") <= F.lit(asof))
    return records.groupBy("instrument", "field", "period").agg(F.max(F.struct("date", "seq", "value")).alias("r")).select(
        "instrument", "field", "period", "r.date", "r.seq", "r.value"
    )


def dense_periods(records):
    """Every quarter between the first and the last period."""
    span = records.groupBy("instrument", "field").agg(F.min(quarter_number("period")).alias("a"), F.max(quarter_number("period")).alias("b"))
    q = span.select("instrument", "field", F.explode(F.sequence("a", "b")).alias("q"))
    return q.select("instrument", "field", F.expr("q div 4 * 100 + q % 4 + 1").alias("period"))


def collapse(records, lookback, fn):
    """Expression over the last periods as known on every change date; the value of the newest visible period.

    State per change date is the newest period and, for the ``lookback`` periods up to it, the newest revision. Both come from
    windows over the records of one instrument, so the work is records x lookback and never dates x records.
    ``fn`` maps an array of values (oldest first, missing periods null) to a Column.
    """
    r = records.withColumn("q", quarter_number("period"))
    # one row per (date, period): the last revision of the day
    r = r.groupBy("instrument", "field", "date", "q").agg(F.max_by("value", "seq").alias("value"))
    line = Window.partitionBy("instrument", "field").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    top = r.select("instrument", "field", "date", F.max("q").over(line).alias("newest")).distinct()
    want = top.select("*", F.explode(F.sequence(F.col("newest") - (lookback - 1), F.col("newest"))).alias("q"))
    both = want.withColumn("ask", F.lit(1)).withColumn("value", F.lit(None).cast("double")).unionByName(
        r.withColumns({"newest": F.lit(None).cast("int"), "ask": F.lit(0)}).select("instrument", "field", "date", "newest", "q", "ask", "value")
    )
    seen = Window.partitionBy("instrument", "field", "q").orderBy("date", "ask").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("v", F.last("value", ignorenulls=True).over(seen)).where("ask = 1")
    arr = known.groupBy("instrument", "field", "date").agg(F.array_sort(F.collect_list(F.struct("q", "v"))).alias("a"))
    return arr.select("instrument", "field", "date", fn(F.transform("a", lambda e: e["v"])).alias("value"))


def fixed_period(records, period):
    """Change dates of one named period."""
    r = records.where(F.col("period") == period)
    return r.groupBy("instrument", "field", "date").agg(F.max_by("value", "seq").alias("value"))


def on_calendar(changes, days):
    """Value as known on each trade date; ``days`` holds (instrument, datetime)."""
    c = changes.select("instrument", F.col("date").alias("datetime"), "value")
    return asof_join(days, c).drop("matched_at")


def macro_asof(observations, days):
    """Per trade date the newest observation and its newest visible revision, with ages in days."""
    o = observations.groupBy("series", "visible", "obs_date").agg(F.max_by("value", "seq").alias("value"))
    w = Window.partitionBy("series").orderBy("visible").rangeBetween(Window.unboundedPreceding, 0)
    newest = o.select("series", "visible", F.max(F.struct("obs_date", "visible", "value")).over(w).alias("n")).distinct()
    c = newest.select(F.col("series").alias("instrument"), F.col("visible").alias("datetime"), "n.obs_date", "n.value", F.col("n.visible").alias("revised"))
    out = asof_join(days, c).drop("matched_at")
    return out.withColumns({"obs_age": F.datediff("datetime", "obs_date"), "revision_age": F.datediff("datetime", "revised")})


def macro_transforms(daily, k=20, year=52, z=60, stale=45):
    """level, change, percent change, year on year and a full-window z-score per series; stale levels are dropped first."""
    w = Window.partitionBy("instrument").orderBy("datetime")
    v = F.when(F.col("obs_age") <= stale, F.col("value"))
    d = daily.withColumn("level", v)
    f = w.rowsBetween(-(z - 1), 0)
    full = F.count("level").over(f) == z
    sd = F.stddev_samp("level").over(f)
    past, yr = F.lag("level", k).over(w), F.lag("level", year).over(w)
    return d.withColumns(
        {
            "change": F.col("level") - past,
            "pct_change": F.col("level") / F.when(past != 0, past) - 1,
            "yoy": F.col("level") / F.when(yr != 0, yr) - 1,
            "zscore": F.when(full & (sd > 0), (F.col("level") - F.avg("level").over(f)) / F.when(sd > 0, sd)),
        }
    )


def event_ratios(events):
    """Sums over four events, margin and growth against the event four back."""
    w = Window.partitionBy("instrument").orderBy("period")
    four = w.rowsBetween(-3, 0)
    ttm = lambda c: F.when(F.count(c).over(four) == 4, F.sum(c).over(four))
    ratio = lambda a, b: a / F.when(b != 0, b)
    return events.withColumns(
        {
            "revenue_ttm": ttm("revenue"),
            "margin": ratio(F.col("income"), F.col("revenue")),
            "yoy": ratio(F.col("revenue"), F.lag("revenue", 4).over(w)) - 1,
        }
    )


def field_asof_fill(df, fields, max_age):
    """Last known value per field, dropped once it is older than ``max_age`` days."""
    w = Window.partitionBy("instrument").orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for f in fields:
        last = F.last(F.when(F.col(f).isNotNull(), F.struct(F.col(f).alias("v"), F.col("datetime").alias("d"))), ignorenulls=True).over(w)
        out = out.withColumn(f"__{f}", last)
    cols = {}
    for f in fields:
        age = F.datediff("datetime", F.col(f"__{f}.d"))
        cols[f"{f}_days"] = age
        cols[f] = F.when(age <= max_age, F.col(f"__{f}.v"))
    return out.withColumns(cols).drop(*[f"__{f}" for f in fields])


def last_form_dates(days, filings, forms, recent=100):
    """Last filing date per form on each trade date, days since then, recent flag."""
    wide = filings.groupBy("instrument", F.col("date").alias("datetime")).agg(*[F.max(F.when(F.col("form") == f, F.col("date"))).alias(f"last_{n}") for n, f in forms.items()])
    w = Window.partitionBy("instrument").orderBy("datetime", "__side").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"last_{n}" for n in forms]
    both = days.withColumn("__side", F.lit(1)).unionByName(wide.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    both = both.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names}).where("__side = 1").drop("__side")
    return both.withColumns({**{f"days_{n}": F.datediff("datetime", f"last_{n}") for n in forms}, "recent": F.coalesce(F.datediff("datetime", F.greatest(*names)) <= recent, F.lit(False))})


def clean_clip(df, non_negative, limits):
    """Negative valuation becomes null, values are clipped; a second table counts the changes."""
    cols, counts = {}, []
    for c in {*non_negative, *limits}:
        v = F.when(F.col(c) >= 0, F.col(c)) if c in non_negative else F.col(c)
        if c in limits:
            lo, hi = limits[c]
            cut = F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))
            counts.append(F.count(F.when(cut != v, 1)).alias(f"{c}_clipped"))
        else:
            cut = v
        if c in non_negative:
            counts.append(F.count(F.when(F.col(c) < 0, 1)).alias(f"{c}_negative"))
        cols[c] = cut
    return df.withColumns(cols), df.agg(*counts)


#: Company facts as they are published: concept -> units -> unit -> reported values.
FACTS = "struct<facts: struct<`us-gaap`: map<string, struct<units: map<string, array<struct<accn: string, end: string, filed: string, val: double>>>>>>>"


def facts_extract(companies, wanted, concepts, units, key="company"):
    """``key``, accession, concept, unit, val, end, filed: for each wanted accession the first concept, and there the first unit, in order of
    preference that reports it; of several reports the newest by (end, filed), ties to the one that stands last.

    ``companies``: ``key``, json; ``wanted``: ``key``, accession. Reports without a value are passed over; malformed JSON holds none. A
    missing date sorts first. Accessions that no concept reports give no row.
    """
    rank = lambda names: F.create_map(*[F.lit(x) for kv in enumerate(names) for x in kv[::-1]])
    concept = companies.select(key, F.from_json("json", FACTS)["facts"]["us-gaap"].alias("m"))
    concept = concept.select(key, F.explode(F.map_filter("m", lambda c, v: c.isin(*concepts))).alias("concept", "v"))
    unit = concept.select(key, "concept", F.explode(F.map_filter("v.units", lambda u, v: u.isin(*units))).alias("unit", "reports"))
    report = unit.select(key, "concept", "unit", F.posexplode("reports").alias("pos", "r")).where("r.val IS NOT NULL")
    first = [-F.element_at(rank(concepts), F.col("concept")), -F.element_at(rank(units), F.col("unit"))]
    order = F.struct(first[0].alias("c"), first[1].alias("u"), F.coalesce("r.end", F.lit("")).alias("e"), F.coalesce("r.filed", F.lit("")).alias("f"), "pos", "concept", "unit", "r")
    report = report.select(key, F.col("r.accn").alias("accession"), order.alias("o")).join(wanted.select(key, "accession").distinct(), [key, "accession"], "left_semi")
    best = report.groupBy(key, "accession").agg(F.max("o").alias("o"))
    return best.select(key, "accession", "o.concept", "o.unit", "o.r.val", "o.r.end", "o.r.filed")


def _month(c):
    return F.year(c) * 12 + F.month(c)


def _rivals(monthly, key):
    """Of the spans open in a month (``key``, __m, __a, __b, __rank, __v, __s) those that can win a day of it. One that covers the whole
    month beats all that rank behind it, wherever they lie, so mostly a few are left of many."""
    order = F.struct("__rank", -F.datediff("__a", F.lit("1970-01-01")), "__v", "__s")
    first = F.make_date(F.expr("(__m - 1) div 12").cast("int"), F.expr("(__m - 1) % 12 + 1").cast("int"), F.lit(1))
    whole = F.when((F.col("__a") <= first) & (F.col("__b") > F.last_day(first)), order)
    best = F.min(whole).over(Window.partitionBy(key, "__m"))
    return monthly.withColumns({"__order": order, "__best": best}).where(F.col("__best").isNull() | (F.col("__order") <= F.col("__best"))).drop("__order", "__best")


def disjoint_intervals(spans, priority, key="instrument", start="start", end="end", value="code", source="source"):
    """``key``, ``start``, ``end``, ``value``, ``source``: overlapping spans resolved into disjoint ones.

    Both ends are inclusive dates; spans without a start, or that end before they start, are dropped, a missing end is open. On every
    day the open span of the source that stands first in ``priority`` counts; of one source the one that started last, then the
    smallest value. Neighbouring days with the same value and source are one interval.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in enumerate(priority) for x in kv[::-1]]), F.col(source))
    known = spans.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start)))).withColumn("__rank", rank).where("__rank IS NOT NULL")
    open_end = F.lit("9999-12-31").cast("date")
    known = known.select(key, F.col(start).alias("__a"), F.when(F.col(end).isNull() | (F.col(end) >= open_end), open_end).otherwise(F.date_add(end, 1)).alias("__b"), "__rank", F.col(source).alias("__s"), F.col(value).alias("__v")).distinct()
    # between two neighbouring borders nothing changes: each such piece takes the best of the spans that cover it
    borders = known.select(key, F.explode(F.array("__a", "__b")).alias("__a")).distinct()
    line = Window.partitionBy(key).orderBy("__a")
    pieces = borders.withColumn("__to", F.lead("__a").over(line)).where("__to IS NOT NULL")
    # a piece meets only the spans that are open in the month in which it begins, so a busy key spreads over months
    last = borders.where(F.col("__a") < open_end).groupBy(key).agg(F.max("__a").alias("__last"))
    monthly = _rivals(known.join(last, key).withColumn("__m", F.explode(F.sequence(_month("__a"), _month(F.least("__b", "__last"))))), key)
    same_month = (F.col(f"p.{key}") == F.col(f"k.{key}")) & (F.col("p.__m") == F.col("k.__m"))
    cover = pieces.withColumn("__m", _month("__a")).alias("p").join(monthly.alias("k"), same_month & (F.col("p.__a") >= F.col("k.__a")) & (F.col("p.__a") < F.col("k.__b")))
    best = F.min(F.struct(F.col("__rank").alias("r"), (-F.datediff("k.__a", F.lit("1970-01-01"))).alias("d"), F.col("__v").alias("v"), F.col("__s").alias("s")))
    chosen = cover.groupBy(F.col(f"p.{key}").alias(key), F.col("p.__a").alias("a"), F.col("p.__to").alias("b")).agg(best.alias("x")).select(key, "a", "b", "x.v", "x.s")
    # islands: a piece goes on from the one before if it begins where that ends and says the same
    before = Window.partitionBy(key).orderBy("a")
    same = (F.lag("b").over(before) == F.col("a")) & F.lag("v").over(before).eqNullSafe(F.col("v")) & (F.lag("s").over(before) == F.col("s"))
    island = chosen.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("__i", F.sum("__new").over(before))
    out = island.groupBy(key, "__i").agg(F.min("a").alias(start), F.max("b").alias("__b"), F.first("v").alias(value), F.first("s").alias(source))
    return out.select(key, start, F.when(F.col("__b") < open_end, F.date_sub("__b", 1)).alias(end), value, source)
