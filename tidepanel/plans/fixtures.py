"""Panels derived from the given tables, with the matching DuckDB table expressions."""

from pyspark.sql import functions as F

from tidepanel.operators import scale
from tidepanel.operators.scale import Bounds, bounded, many
from tidepanel.sources import panel as P

_bounds, _trades = {}, {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounds(spark, sf_dir):
    """Proven limits from two cheap scans: days between first and last ship date, and the instruments of the trades or, if these are
    more, the suppliers."""
    if sf_dir not in _bounds:
        lo, hi, names = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate"), F.max("l_shipdate"), F.count_distinct("l_suppkey")).first()
        _bounds[sf_dir] = Bounds((hi - lo).days + 1, max(names, table(spark, sf_dir, "supplier").count()))
    return _bounds[sf_dir]


def trades(spark, sf_dir):
    """Trades in all, and those of the instrument that has most: one cheap scan."""
    if sf_dir not in _trades:
        each = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
        _trades[sf_dir] = each.agg(F.sum("n"), F.max("n")).first()
    return _trades[sf_dir]


def bars(spark, sf_dir, by_instrument=0):
    li = table(spark, sf_dir, "lineitem")
    return P.bars_from_trades(
        li,
        F.col("l_suppkey").cast("string"),
        F.to_date(F.date_trunc("week", "l_shipdate")),
        F.col("l_extendedprice") / F.col("l_quantity"),
        F.col("l_quantity"),
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"],
        by_instrument,
    )


def calendar(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return P.build_calendar(li.select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("datetime")))


def days(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return P.build_calendar(li.select(F.to_date("l_shipdate").alias("datetime")))


def panel(spark, sf_dir):
    """Weekly bars aligned to the calendar; about a fifth of the rows are gaps."""
    b, li = bounds(spark, sf_dir), table(spark, sf_dir, "lineitem")
    # an instrument has a slot a week
    rows = b.names * (b.dates // 7 + 2)
    if many(li, rows):
        total, most = trades(spark, sf_dir)
        # few trades a slot: adding them up before the shuffle would not make them fewer
        if most <= scale.TASK_ROWS and total <= 4 * rows:
            return P.align_calendar(bars(spark, sf_dir, many(li, max(total, rows))), calendar(spark, sf_dir), b.dates)
    return P.align_calendar(bars(spark, sf_dir), calendar(spark, sf_dir), b.dates, rows)


def groups(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = bounded(table(spark, sf_dir, "nation"), 25)
    r = bounded(table(spark, sf_dir, "region"), 5)
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").cast("string").alias("instrument"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))
    )


def membership(spark, sf_dir):
    """Member spans of two markets: every supplier, and the suppliers of one region."""
    spans = P.build_instruments(bars(spark, sf_dir))
    every = spans.select(F.lit("all").alias("market"), "instrument", "start", "end")
    some = spans.join(groups(spark, sf_dir).where("sector = 'EUROPE'"), "instrument", "left_semi")
    return every.unionByName(some.select(F.lit("part").alias("market"), "instrument", "start", "end"))


def ticks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.pmod("user_id", F.lit(10)).cast("string").alias("instrument"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("price"),
        (F.pmod("event_id", F.lit(100)) + 1).cast("double").alias("size"),
        F.col("event_type").alias("code"),
        "event_id",
        "user_id",
        "props",
    )


def hours(spark, sf_dir):
    """Hourly bars from ticks on the hourly calendar of all instruments; a day has 24 slots."""
    t = ticks(spark, sf_dir)
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    b = P.bars_from_trades(t, F.col("instrument"), hour, F.col("price"), F.col("size"), ["ts", "event_id"])
    cal = P.build_calendar(t.select(hour.alias("datetime")))
    return P.align_calendar(b, cal)


def quotes(spark, sf_dir):
    step = 0.01 * (F.pmod("event_id", F.lit(5)) + 1)
    return ticks(spark, sf_dir).withColumns({"ask": F.col("price") + step, "bid": F.col("price") - step})


def pit(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.to_date("o_orderdate")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").cast("string").alias("instrument"),
        F.lit("total_q").alias("field"),
        F.expr("date_add(to_date(o_orderdate), cast(45 + o_orderkey % 60 as int))").alias("date"),
        (F.year(day) * 100 + F.quarter(day)).alias("period"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("seq"),
    )


def pred(spark, sf_dir):
    """Predictions and labels: a momentum factor, two more factors, and the return from the next to the second next week."""
    from tidepanel.functions.expr import features

    exprs = {
        "score": "Mean($close,5)/$close",
        "f_std": "Std($close,5)/$close",
        "f_vol": "$volume",
        "label": "Ref($close,-2)/Ref($close,-1)-1",
    }
    return features(panel(spark, sf_dir), exprs)


# DuckDB table expressions of the same panels
BARS = """bars AS (
 SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(date_trunc('week', l_shipdate) AS DATE) AS datetime,
  arg_min(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close,
  sum(l_extendedprice) / sum(l_quantity) AS vwap, sum(l_quantity) AS volume
 FROM lineitem GROUP BY 1, 2)"""
CALENDAR = """calendar AS (
 SELECT datetime, CAST(row_number() OVER (ORDER BY datetime) - 1 AS INTEGER) AS cal_ix
 FROM (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS datetime FROM lineitem))"""
DAYS = """days AS (
 SELECT datetime, CAST(row_number() OVER (ORDER BY datetime) - 1 AS INTEGER) AS cal_ix
 FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS datetime FROM lineitem))"""
SPANS = "spans AS (SELECT instrument, min(datetime) AS \"start\", max(datetime) AS \"end\" FROM bars GROUP BY 1)"
PANEL = f"""{BARS}, {CALENDAR}, {SPANS}, panel AS (
 SELECT s.instrument, c.datetime, c.cal_ix, b.open, b.high, b.low, b.close, b.vwap, b.volume
 FROM spans s JOIN calendar c ON c.datetime BETWEEN s."start" AND s."end"
 LEFT JOIN bars b ON b.instrument = s.instrument AND b.datetime = c.datetime)"""
GROUPS = """groups AS (
 SELECT CAST(s_suppkey AS VARCHAR) AS instrument, n_name AS industry, r_name AS sector
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MEMBERSHIP = f"""{SPANS}, {GROUPS}, membership AS (
 SELECT 'all' AS market, instrument, "start", "end" FROM spans
 UNION ALL SELECT 'part', instrument, "start", "end" FROM spans
 WHERE instrument IN (SELECT instrument FROM groups WHERE sector = 'EUROPE'))"""
TICKS = """ticks AS (
 SELECT CAST(user_id % 10 AS VARCHAR) AS instrument, CAST(ts AS TIMESTAMP) AS ts, value AS price,
  CAST(event_id % 100 + 1 AS DOUBLE) AS size, event_type AS code, event_id, user_id, props FROM events)"""
QUOTES = f"""{TICKS}, quotes AS (
 SELECT *, price + 0.01::DOUBLE * (event_id % 5 + 1) AS ask, price - 0.01::DOUBLE * (event_id % 5 + 1) AS bid FROM ticks)"""
HOURS = f"""{TICKS}, hbars AS (
 SELECT instrument, date_trunc('hour', ts) AS datetime, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row(ts, event_id)) AS close, sum(price * size) / sum(size) AS vwap, sum(size) AS volume FROM ticks GROUP BY 1, 2),
 hcal AS (SELECT datetime, CAST(row_number() OVER (ORDER BY datetime) - 1 AS INTEGER) AS cal_ix FROM (SELECT DISTINCT date_trunc('hour', ts) AS datetime FROM ticks)),
 hspans AS (SELECT instrument, min(datetime) AS a, max(datetime) AS b FROM hbars GROUP BY 1),
 hours AS (SELECT s.instrument, c.datetime, c.cal_ix, open, high, low, close, vwap, volume FROM hspans s JOIN hcal c ON c.datetime BETWEEN a AND b
  LEFT JOIN hbars h ON h.instrument = s.instrument AND h.datetime = c.datetime)"""
PIT = """pit AS (
 SELECT CAST(c_nationkey AS VARCHAR) AS instrument, 'total_q' AS field,
  CAST(o_orderdate AS DATE) + CAST(45 + o_orderkey % 60 AS INTEGER) AS date,
  year(o_orderdate) * 100 + quarter(o_orderdate) AS period, o_totalprice AS value, o_orderkey AS seq
 FROM orders JOIN customer ON o_custkey = c_custkey)"""
PRED = f"""{PANEL}, pred AS (
 SELECT instrument, datetime, cal_ix, avg(close) OVER w / close AS score, stddev_samp(close) OVER w / close AS f_std, volume AS f_vol,
  lead(close, 2) OVER p / lead(close, 1) OVER p - 1 AS label
 FROM panel WINDOW p AS (PARTITION BY instrument ORDER BY datetime), w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def avg_rank(x, by):
    """DuckDB text of an average-tie rank of non-null rows."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE)"
