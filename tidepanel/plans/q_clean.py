"""Cleaning, adjustment and data health."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import clean as C
from tidepanel.operators import joins as J
from tidepanel.operators.scale import exact_quantiles
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query

KEY = "instrument:s datetime:d "
P = "(PARTITION BY instrument ORDER BY datetime)"
UPTO = "(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = "(PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_NORM = f"""n0 AS (SELECT instrument, datetime, CASE WHEN volume > 10 THEN close END AS close, CASE WHEN volume > 10 THEN volume END AS volume FROM panel),
 norm AS (SELECT *, last_value(close IGNORE NULLS) OVER {UPTO} / last_value(close IGNORE NULLS) OVER {BEFORE} - 1 AS change FROM n0)"""


@query("norm_bars", KEY + "close:f volume:f change:f", f"WITH {T.PANEL}, {_NORM} SELECT * FROM norm")
def norm_bars(spark, sf_dir):
    p = T.panel(spark, sf_dir).withColumn("volume", F.col("volume") - 10)
    return C.norm_bars(p).withColumn("volume", F.col("volume") + 10)


@query("norm_fund_crypto", KEY + "close:f change:f", f"WITH {T.PANEL} SELECT instrument, datetime, close, last_value(close IGNORE NULLS) OVER {UPTO} / last_value(close IGNORE NULLS) OVER {BEFORE} - 1 AS change FROM panel")
def norm_fund_crypto(spark, sf_dir):
    return C.norm_bars(T.panel(spark, sf_dir), volume_rule=False)


@query("norm_5min", "instrument:s datetime:t close:f change:f", f"WITH {T.HOURS} SELECT instrument, datetime, close, last_value(close IGNORE NULLS) OVER {UPTO} / last_value(close IGNORE NULLS) OVER {BEFORE} - 1 AS change FROM hours")
def norm_5min(spark, sf_dir):
    return C.norm_bars(T.hours(spark, sf_dir))


# up to four rows in a row at 100, 10,000, … times their price, where the price itself hardly moves: one repair shows the next
_CALM = "calm AS (SELECT instrument, datetime, 1000 + close % 300 AS close FROM bars)"
_STEADY = f"j AS (SELECT *, row_number() OVER {P} % 8 AS k, close / lag(close) OVER {P} BETWEEN 0.9::DOUBLE AND 1.12::DOUBLE AS steady FROM calm)"
_RUN = f"m AS (SELECT *, CASE WHEN k BETWEEN 1 AND 4 AND coalesce(steady, false) AND (k < 2 OR coalesce(lag(steady, 1) OVER {P}, false)) AND (k < 3 OR coalesce(lag(steady, 2) OVER {P}, false)) AND (k < 4 OR coalesce(lag(steady, 3) OVER {P}, false)) THEN k ELSE 0 END AS spoilt FROM j)"


@query("fix_unit_jump", KEY + "close:f spoilt:i", f"WITH {T.BARS}, {_CALM}, {_STEADY}, {_RUN} SELECT instrument, datetime, close, spoilt FROM m")
def fix_unit_jump(spark, sf_dir):
    w = Window.partitionBy("instrument").orderBy("datetime")
    b = T.bars(spark, sf_dir).withColumn("close", 1000 + F.col("close") % 300).withColumn("k", F.row_number().over(w) % 8).withColumn("steady", F.coalesce((F.col("close") / F.lag("close").over(w)).between(0.9, 1.12), F.lit(False)))
    run = F.col("k").between(1, 4) & F.col("steady")
    for n in (1, 2, 3):
        run = run & ((F.col("k") <= n) | F.coalesce(F.lag("steady", n).over(w), F.lit(False)))
    b = b.withColumn("spoilt", F.when(run, F.col("k")).otherwise(0)).drop("k", "steady")
    b = b.withColumns({c: F.col(c) * F.pow(F.lit(100.0), F.col("spoilt")) for c in C.PRICES})
    return C.fix_unit_jump(b)


_ADJ = "adjin AS (SELECT *, CASE WHEN volume > 30 THEN close * 0.9::DOUBLE END AS adjclose FROM panel)"


@query("adjust_price", KEY + "factor:f close:f volume:f", f"WITH {T.PANEL}, {_ADJ}, f AS (SELECT *, last_value(adjclose / close IGNORE NULLS) OVER {UPTO} AS factor FROM adjin) SELECT instrument, datetime, factor, close * factor AS close, volume / factor AS volume FROM f")
def adjust_price(spark, sf_dir):
    return C.adjust_price(T.panel(spark, sf_dir).withColumn("adjclose", F.when(F.col("volume") > 30, F.col("close") * 0.9)))


@query("rebase_first_close", KEY + "close:f volume:f", f"WITH {T.PANEL}, f AS (SELECT instrument, arg_min(close, datetime) FILTER (WHERE close IS NOT NULL) AS c FROM panel GROUP BY 1) SELECT instrument, datetime, close / c AS close, volume * c AS volume FROM panel JOIN f USING (instrument)")
def rebase_first_close(spark, sf_dir):
    return C.rebase_first(T.panel(spark, sf_dir))


@query(
    "rebase_extend",
    KEY + "close:f volume:f",
    f"""WITH {T.BARS}, l AS (SELECT instrument, max(datetime) AS upto FROM bars WHERE datetime < DATE '2000-01-01' GROUP BY 1), k AS (SELECT b.instrument, 0.5::DOUBLE AS k FROM bars b JOIN l ON b.instrument = l.instrument AND b.datetime = l.upto)
    SELECT b.instrument, b.datetime, close * coalesce(k, 1) AS close, volume / coalesce(k, 1) AS volume FROM bars b LEFT JOIN l USING (instrument) LEFT JOIN k USING (instrument) WHERE upto IS NULL OR b.datetime > upto""",
)
def rebase_extend(spark, sf_dir):
    b = T.bars(spark, sf_dir)
    stored = b.where(F.col("datetime") < F.lit(dt.date(2000, 1, 1))).withColumn("close", F.col("close") * 0.5)
    return C.rebase_extend(b, stored)


_DAY = "dayc AS (SELECT instrument, CAST(ts AS DATE) AS day, avg(price) AS dc FROM ticks GROUP BY 1, 2)"


@query(
    "adjust_intraday",
    "instrument:s datetime:t close:f paused:b",
    f"""WITH {T.HOURS}, {_DAY}, l AS (SELECT instrument, CAST(datetime AS DATE) AS day, arg_max(close, datetime) FILTER (WHERE close IS NOT NULL) AS last, sum(coalesce(volume, 0)) AS v FROM hours GROUP BY 1, 2)
    SELECT h.instrument, h.datetime, close * dc / nullif(last, 0) AS close, v <= 0 AS paused FROM hours h JOIN l ON h.instrument = l.instrument AND CAST(h.datetime AS DATE) = l.day LEFT JOIN dayc d ON d.instrument = l.instrument AND d.day = l.day""",
)
def adjust_intraday(spark, sf_dir):
    day = T.ticks(spark, sf_dir).groupBy("instrument", F.to_date("ts").alias("datetime")).agg(F.avg("price").alias("close"))
    return C.adjust_intraday(T.hours(spark, sf_dir), day)


@query("paused_num", KEY + "paused_num:i", f"WITH {T.PANEL}, r AS (SELECT *, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER {UPTO} AS run FROM panel) SELECT instrument, datetime, sum(CASE WHEN close IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, run ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paused_num FROM r")
def paused_num(spark, sf_dir):
    return C.paused_num(T.panel(spark, sf_dir))


@query("fill_minutes", "instrument:s datetime:t", "WITH d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS instrument, CAST(ts AS DATE) AS day FROM events) SELECT instrument, unnest(generate_series(CAST(day AS TIMESTAMP) + INTERVAL 9 HOUR, CAST(day AS TIMESTAMP) + INTERVAL 599 MINUTE, INTERVAL 15 MINUTE)) AS datetime FROM d WHERE instrument NOT IN (SELECT CAST(user_id % 10 AS VARCHAR) FROM events)")
def fill_minutes(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    daily = e.select(F.col("user_id").cast("string").alias("instrument"), F.to_date("ts").alias("datetime")).distinct()
    return C.fill_minutes(daily, T.ticks(spark, sf_dir), (("09:00:00", "09:59:00"),), "15 minutes")


_RET = f"rets AS (SELECT *, close / lag(close) OVER {P} - 1 AS r FROM bars)"


def _ret(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("instrument").orderBy("datetime")
    return T.bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)


# every seventh return is missing; one row in 97 is a total loss
_HARD = f"hard AS (SELECT *, CASE WHEN n % 97 = 50 THEN -1 WHEN n % 7 = 3 THEN NULL ELSE r / 500 END AS x FROM (SELECT *, row_number() OVER {P} AS n FROM rets) AS y)"
_GROWN = f"a AS (SELECT *, first_value(close) OVER {UPTO} * CASE WHEN bool_or(e <= -1) OVER {UPTO} THEN 0 ELSE exp(sum(ln(CASE WHEN e > -1 THEN 1 + e ELSE 1 END)) OVER {UPTO}) END AS adj_close FROM (SELECT *, coalesce(x, r, 0) AS e FROM hard) AS z)"


@query("total_return_adjust", KEY + "adj_close:f2 adj_vwap:f2", f"WITH {T.BARS}, {_RET}, {_HARD}, {_GROWN} SELECT instrument, datetime, adj_close, (open + high + low + close) * adj_close / close / 4 AS adj_vwap FROM a")
def total_return_adjust(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("instrument").orderBy("datetime"))
    d = _ret(spark, sf_dir).withColumn("n", n)
    return C.total_return_adjust(d.withColumn("ret", F.when(F.col("n") % 97 == 50, F.lit(-1.0)).when(F.col("n") % 7 == 3, F.lit(None)).otherwise(F.col("ret") / 500)))


@query("forward_return", KEY + "forward:f4", f"WITH {T.BARS}, {_RET} SELECT instrument, datetime, CASE WHEN count(r) OVER w = 5 THEN product(1 + r) OVER w - 1 END AS forward FROM rets WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
def forward_return(spark, sf_dir):
    return C.forward_return(_ret(spark, sf_dir), 5)


@query("pit_normalize", "o_orderkey:i date:d period:i", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 7 ELSE CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'P' THEN 90 ELSE 45 END END AS date, CASE WHEN o_orderstatus = 'P' THEN year(o_orderdate) ELSE year(o_orderdate) * 100 + quarter(o_orderdate) END AS period FROM orders")
def pit_normalize(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("period_end"), (F.col("o_orderstatus") == "P").alias("annual"))
    return C.pit_normalize(o.withColumn("date", F.when(F.col("o_orderkey") % 4 != 0, F.date_add("period_end", 7))))


@query("symbol_text", "s_suppkey:i prefixed:s suffixed:s file:s", "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'SH' ELSE 'SZ' END || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS prefixed, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || CASE WHEN s_nationkey % 2 = 0 THEN '.SH' ELSE '.SZ' END AS suffixed, CASE WHEN s_suppkey = 3 THEN '_file_COM3' ELSE 'COMX' || s_suppkey END AS file FROM supplier")
def symbol_text(spark, sf_dir):
    code = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    d = T.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(code, F.when(F.col("s_nationkey") % 2 == 0, ".sh").otherwise(".sz")).alias("raw"))
    d = d.withColumn("prefixed", C.to_prefix(F.col("raw")))
    name = F.when(F.col("s_suppkey") == 3, "COM3").otherwise(F.concat(F.lit("COMX"), "s_suppkey"))
    return d.withColumns({"suffixed": C.to_suffix(F.col("prefixed")), "file": C.to_file_name(name)})


# ---- health ----


@query("health_missing", "instrument:s open:i close:i", f"WITH {T.PANEL} SELECT instrument, count(*) - count(open) AS open, count(*) - count(close) AS close FROM panel GROUP BY 1 HAVING count(*) - count(open) > 65 OR count(*) - count(close) > 65")
def health_missing(spark, sf_dir):
    return C.missing_counts(T.panel(spark, sf_dir), ["open", "close"], 65)


@query("health_large_step", "instrument:s largest:f first_date:d", f"WITH {T.BARS}, s AS (SELECT instrument, datetime, abs(close / lag(close) OVER {P} - 1) AS s FROM bars) SELECT instrument, max(s) AS largest, min(datetime) FILTER (WHERE s > 20) AS first_date FROM s GROUP BY 1 HAVING max(s) > 20")
def health_large_step(spark, sf_dir):
    return C.large_steps(T.bars(spark, sf_dir), "close", 20.0)


@query("health_required_cols", "name:s missing:b rows:i", f"WITH {T.BARS} SELECT unnest(['open', 'high', 'low', 'close', 'volume']) AS name, unnest([false, true, false, false, false]) AS missing, unnest([count(open), 0, count(low), count(close), count(volume)]) AS rows FROM bars")
def health_required_cols(spark, sf_dir):
    return C.missing_columns(T.bars(spark, sf_dir).drop("high"))


@query("health_factor", "instrument:s n:i", f"WITH {T.BARS} SELECT instrument, count(CASE WHEN CAST(instrument AS INT) % 5 <> 0 THEN close END) AS n FROM bars GROUP BY 1 HAVING n = 0 AND NOT regexp_matches(instrument, '^1')")
def health_factor(spark, sf_dir):
    d = T.bars(spark, sf_dir).withColumn("factor", F.when(F.col("instrument").cast("int") % 5 != 0, F.col("close")))
    return C.empty_factor(d, "factor", "^1")


@query(
    "adjust_check",
    "year:i mean_diff:f p99:f largest:f order_violations:i",
    f"""WITH {T.BARS}, s AS (SELECT *, close / lag(close) OVER {P} - 1 AS rc, vwap / lag(vwap) OVER {P} - 1 AS rv FROM bars)
    SELECT year(datetime) AS year, avg(abs(rc - rv)) AS mean_diff, quantile_cont(abs(rc - rv), 0.99) AS p99, max(abs(rc - rv)) AS largest, count(CASE WHEN vwap > high OR vwap < low THEN 1 END) AS order_violations FROM s GROUP BY 1""",
)
def adjust_check(spark, sf_dir):
    d = X.features(_panelled(spark, sf_dir), {"d": "Abs($close/$pc-$vwap/$pv)"}, keep=("high", "low", "vwap"))
    d = d.withColumn("year", F.year("datetime"))
    agg = d.groupBy("year").agg(F.avg("d").alias("mean_diff"), F.max("d").alias("largest"), F.count(F.when((F.col("vwap") > F.col("high")) | (F.col("vwap") < F.col("low")), 1)).alias("order_violations"))
    # a year is an unbounded group: bracketed exact quantile
    return agg.join(exact_quantiles(d, ["year"], "d", {"p99": 0.99}), "year", "left")


def _panelled(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("instrument").orderBy("datetime")
    b = T.bars(spark, sf_dir)
    return b.withColumns({"pc": F.lag("close").over(w), "pv": F.lag("vwap").over(w), "cal_ix": F.lit(0)})


_TOPM = f"""tm AS (SELECT CAST(date_trunc('month', datetime) AS DATE) AS month, instrument, datetime FROM bars WHERE volume > 80)"""


@query("membership_check", "check_id:s fails:i passes:i", f"WITH {T.BARS}, {_TOPM}, c AS (SELECT month, count(DISTINCT instrument) AS n FROM tm GROUP BY 1) SELECT 'count' AS check_id, count(CASE WHEN n < 60 THEN 1 END) AS fails, count(CASE WHEN NOT n < 60 THEN 1 END) AS passes FROM c UNION ALL SELECT 'after_month_start', count(CASE WHEN claimed < month THEN 1 END), count(CASE WHEN NOT claimed < month THEN 1 END) FROM (SELECT month, CASE WHEN CAST(instrument AS INTEGER) % 13 = 0 THEN datetime - 20 ELSE datetime END AS claimed FROM tm)")
def membership_check(spark, sf_dir):
    """Members per month, and first use against the month of membership; every thirteenth instrument claims a use 20 days early."""
    tm = T.bars(spark, sf_dir).where("volume > 80").withColumn("month", F.trunc("datetime", "month"))
    n = tm.select("month", "instrument").distinct().groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    claimed = tm.withColumn("claimed", F.when(F.col("instrument").cast("int") % 13 == 0, F.date_sub("datetime", 20)).otherwise(F.col("datetime")))
    return C.check("count", n, F.col("n") < 60).unionByName(C.check("after_month_start", claimed, F.col("claimed") < F.col("month")))


_VERDICT = "SELECT '{0}' AS check_id, '{1}' AS severity, CASE WHEN count(CASE WHEN {3} THEN 1 END) = 0 THEN 'pass' ELSE 'fail' END AS status, count(CASE WHEN {3} THEN 1 END) AS evidence FROM {2}"
_VERDICTS = " UNION ALL ".join(
    [
        _VERDICT.format("pit_future_period", "high", "pit", "period > year(date) * 100 + quarter(date)"),
        _VERDICT.format("pit_negative_value", "medium", "pit", "value < 0"),
        _VERDICT.format("price_not_positive", "high", "bars", "close <= 0"),
    ]
)


@query("pit_quality", "check_id:s severity:s status:s evidence:i", f"WITH {T.PIT}, {T.BARS} {_VERDICTS}")
def pit_quality(spark, sf_dir):
    pit, b = T.pit(spark, sf_dir), T.bars(spark, sf_dir)
    rows = [
        ("pit_future_period", "high", pit, F.col("period") > F.year("date") * 100 + F.quarter("date")),
        ("pit_negative_value", "medium", pit, F.col("value") < 0),
        ("price_not_positive", "high", b, F.col("close") <= 0),
    ]
    out = None
    for name, severity, df, bad in rows:
        c = C.check(name, df, bad).select("check_id", F.lit(severity).alias("severity"), F.when(F.col("fails") == 0, "pass").otherwise("fail").alias("status"), F.col("fails").alias("evidence"))
        out = c if out is None else out.unionByName(c)
    return out


@query("leakage_audit", "check_id:s fails:i passes:i", f"WITH {T.PIT}, {T.CALENDAR}, v AS (SELECT p.*, (SELECT min(c.datetime) FROM calendar c WHERE c.datetime > p.date) AS visible FROM pit p), u AS (SELECT *, CASE WHEN seq % 11 = 0 THEN date ELSE visible END AS used FROM v WHERE visible IS NOT NULL) SELECT 'used_before_visible' AS check_id, count(CASE WHEN used < visible THEN 1 END) AS fails, count(CASE WHEN NOT used < visible THEN 1 END) AS passes FROM u")
def leakage_audit(spark, sf_dir):
    """Claimed dates of use against the first trade date after each event; every eleventh claim is the day of the event itself."""
    cal, ev = T.calendar(spark, sf_dir), T.pit(spark, sf_dir)
    seen = J.next_date_join(ev, cal, calendar_rows=T.bounds(spark, sf_dir).dates).where("visible_date IS NOT NULL")
    used = seen.withColumn("used", F.when(F.col("seq") % 11 == 0, F.col("date")).otherwise(F.col("visible_date")))
    return C.check("used_before_visible", used, F.col("used") < F.col("visible_date"))


@query("industry_coverage", "year:i coverage:f", f"WITH {T.BARS}, {T.GROUPS} SELECT year(datetime) AS year, avg(CASE WHEN sector <> 'ASIA' THEN 1 ELSE 0 END) AS coverage FROM bars JOIN groups USING (instrument) GROUP BY 1")
def industry_coverage(spark, sf_dir):
    g = T.bounded(T.groups(spark, sf_dir), T.bounds(spark, sf_dir).names)
    return T.bars(spark, sf_dir).join(g, "instrument").groupBy(F.year("datetime").alias("year")).agg(F.avg((F.col("sector") != "ASIA").cast("double")).alias("coverage"))


@query("feature_missingness", "feature:s year:i null_share:f", f"WITH {T.PRED}, l AS (SELECT 'score' AS feature, datetime, score AS x FROM pred UNION ALL SELECT 'label', datetime, label FROM pred) SELECT feature, year(datetime) AS year, avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS null_share FROM l GROUP BY 1, 2")
def feature_missingness(spark, sf_dir):
    long = T.pred(spark, sf_dir).unpivot(["datetime"], ["score", "label"], "feature", "x")
    return long.groupBy("feature", F.year("datetime").alias("year")).agg(F.avg(F.col("x").isNull().cast("double")).alias("null_share"))


@query("label_distribution", "year:i n:i mean:f q05:f q50:f q95:f", f"WITH {T.PRED} SELECT year(datetime) AS year, count(label) AS n, avg(label) AS mean, quantile_cont(label, 0.05) AS q05, quantile_cont(label, 0.5) AS q50, quantile_cont(label, 0.95) AS q95 FROM pred GROUP BY 1 HAVING count(label) > 0")
def label_distribution(spark, sf_dir):
    p = T.pred(spark, sf_dir).withColumn("year", F.year("datetime"))
    return p.groupBy("year").agg(F.count("label").alias("n"), F.avg("label").alias("mean")).join(exact_quantiles(p, ["year"], "label", {"q05": 0.05, "q50": 0.5, "q95": 0.95}), "year")
