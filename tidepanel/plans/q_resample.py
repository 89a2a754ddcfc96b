"""Resampling and calendars."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators import intraday as I
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query

_BIN = "date_trunc('hour', ts)"
_SERIES = f"{T.TICKS}, tb AS (SELECT instrument, {_BIN} AS bin, sum(size) AS total, arg_max(price, row(ts, event_id)) AS last FROM ticks GROUP BY 1, 2), tg AS (SELECT instrument, unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM tb GROUP BY 1)"


@query("tresample", "instrument:s bin:t total:f last:f", f"WITH {_SERIES} SELECT * FROM tg LEFT JOIN tb USING (instrument, bin)")
def tresample(spark, sf_dir):
    return I.tresample(T.ticks(spark, sf_dir), "60 minutes", {"total": F.sum("size"), "last": F.max_by("price", F.struct("ts", "event_id"))}, fill_empty=True)


@query("tresample_ffill", "instrument:s bin:t price:f", f"WITH {T.TICKS}, tb AS (SELECT instrument, time_bucket(INTERVAL 10 MINUTE, ts) AS bin, arg_max(price, row(ts, event_id)) AS price FROM ticks GROUP BY 1, 2), tg AS (SELECT instrument, unnest(generate_series(min(bin), max(bin), INTERVAL 10 MINUTE)) AS bin FROM tb GROUP BY 1) SELECT instrument, bin, last_value(price IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM tg LEFT JOIN tb USING (instrument, bin)")
def tresample_ffill(spark, sf_dir):
    return I.tresample_ffill(T.ticks(spark, sf_dir), "10 minutes", "price")


@query(
    "resam_calendar",
    "unit:s datetime:d",
    f"""WITH {T.DAYS}, w AS (SELECT min(datetime) AS datetime FROM days GROUP BY date_trunc('week', datetime)), m AS (SELECT min(datetime) AS datetime FROM days GROUP BY date_trunc('month', datetime))
    SELECT 'day' AS unit, datetime FROM days WHERE cal_ix % 5 = 0 UNION ALL SELECT 'week', datetime FROM w QUALIFY (row_number() OVER (ORDER BY datetime) - 1) % 2 = 0 UNION ALL SELECT 'month', datetime FROM m""",
)
def resam_calendar(spark, sf_dir):
    d = T.days(spark, sf_dir)
    part = lambda u, n: I.resample_calendar(d, u, n).select(F.lit(u).alias("unit"), "datetime")
    return part("day", 5).unionByName(part("week", 2)).unionByName(part("month", 1))


_R = "datetime BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"
A, B = dt.date(1997, 1, 1), dt.date(1998, 12, 31)


@query("resam_ts_data", "instrument:s last:f mean:f sum:f", f"WITH {T.BARS} SELECT instrument, arg_max(close, datetime) AS last, avg(volume) AS mean, sum(volume) AS sum FROM bars WHERE {_R} GROUP BY 1")
def resam_ts_data(spark, sf_dir):
    b = T.bars(spark, sf_dir)
    return I.resample_method(b, A, B, "last", "close").join(I.resample_method(b, A, B, "mean", "volume"), "instrument").join(I.resample_method(b, A, B, "sum", "volume"), "instrument")


@query("quote_slice", "instrument:s sum:f mean:f all:b", f"WITH {T.PANEL} SELECT instrument, sum(volume) AS sum, avg(close) AS mean, bool_and(coalesce(volume, 0) > 5) AS \"all\" FROM panel WHERE {_R} GROUP BY 1")
def quote_slice(spark, sf_dir):
    p = T.panel(spark, sf_dir).withColumn("ok", F.coalesce("volume", F.lit(0.0)) > 5)
    return I.resample_method(p, A, B, "sum", "volume").join(I.resample_method(p, A, B, "mean", "close"), "instrument").join(I.resample_method(p, A, B, "all", "ok"), "instrument")


@query("ts_last_valid", "instrument:s last_valid:f first_valid:f", f"WITH {T.PANEL} SELECT instrument, arg_max(close, datetime) FILTER (WHERE close IS NOT NULL) AS last_valid, arg_min(close, datetime) FILTER (WHERE close IS NOT NULL) AS first_valid FROM panel WHERE {_R} GROUP BY 1")
def ts_last_valid(spark, sf_dir):
    p = T.panel(spark, sf_dir)
    return I.resample_method(p, A, B, "last_valid", "close").join(I.resample_method(p, A, B, "first_valid", "close"), "instrument")


@query("recent_freq", "instrument:s bin:t volume:f", f"WITH {T.TICKS} SELECT instrument, date_trunc('day', ts) AS bin, sum(size) AS volume FROM ticks GROUP BY 1, 2")
def recent_freq(spark, sf_dir):
    """Asked for days but only ticks are stored: resample the nearest finer table up."""
    stored = {"tick": T.ticks(spark, sf_dir)}
    finer = next(f for f in ("day", "hour", "minute", "tick") if f in stored)
    return I.tresample(stored[finer], "1 day", {"volume": F.sum("size")})


@query("minute_calendar", "datetime:t", f"WITH {T.DAYS} SELECT unnest(generate_series(datetime + INTERVAL '9:30' HOUR TO MINUTE, datetime + INTERVAL '9:30' HOUR TO MINUTE + INTERVAL 119 MINUTE, INTERVAL 10 MINUTE) || generate_series(datetime + INTERVAL 13 HOUR, datetime + INTERVAL 899 MINUTE, INTERVAL 10 MINUTE)) AS datetime FROM days".replace("INTERVAL '9:30' HOUR TO MINUTE", "INTERVAL 570 MINUTE"))
def minute_calendar(spark, sf_dir):
    return I.minute_calendar(T.days(spark, sf_dir), (("09:30:00", "11:29:00"), ("13:00:00", "14:59:00")), "10 minutes")


@query(
    "calendar_by_ratio",
    "datetime:d traded:i alive:i",
    f"""WITH {T.BARS}, {T.SPANS}, f AS (SELECT "start" AS datetime, count(*) AS c FROM spans GROUP BY 1), d AS (SELECT datetime, count(DISTINCT instrument) AS traded FROM bars GROUP BY 1),
    a AS (SELECT d.*, sum(coalesce(c, 0)) OVER (ORDER BY d.datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alive FROM d LEFT JOIN f USING (datetime)) SELECT * FROM a WHERE traded >= 0.82 * alive""",
)
def calendar_by_ratio(spark, sf_dir):
    return I.calendar_by_ratio(T.bars(spark, sf_dir), 0.82)


@query(
    "calendar_align",
    "o_orderkey:i aligned:d shifted:d",
    f"""WITH {T.CALENDAR}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE o_orderkey % 7 WHEN 0 THEN 3000 WHEN 1 THEN -3000 ELSE 0 END AS day FROM orders), t AS (SELECT o_orderkey, max(cal_ix) AS ix FROM o LEFT JOIN calendar c ON c.datetime <= o.day GROUP BY 1)
    SELECT t.o_orderkey, a.datetime AS aligned, b.datetime AS shifted FROM t LEFT JOIN calendar a ON a.cal_ix = t.ix LEFT JOIN calendar b ON b.cal_ix = t.ix - 3""",
)
def calendar_align(spark, sf_dir):
    """Time points to the trade date at or before them, and three dates back; some points lie before or after the calendar."""
    b, cal = T.bounds(spark, sf_dir).dates, T.calendar(spark, sf_dir)
    shift = F.when(F.col("o_orderkey") % 7 == 0, 3000).when(F.col("o_orderkey") % 7 == 1, -3000).otherwise(0)
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), shift).alias("day"))
    # the last trade date holds for all points after it
    upto = F.broadcast(o.agg(F.max("day").alias("__max")))
    line = cal.withColumn("__to", F.lead("datetime").over(Window.orderBy("datetime"))).crossJoin(upto)
    until = F.coalesce(F.date_sub("__to", 1), F.greatest("datetime", "__max"))
    days = line.select(F.col("datetime").alias("aligned"), "cal_ix", F.explode(F.sequence("datetime", until)).alias("day"))
    back = cal.select((F.col("cal_ix") + 3).alias("cal_ix"), F.col("datetime").alias("shifted"))
    return o.join(T.bounded(days, None), "day", "left").join(T.bounded(back, b), "cal_ix", "left")


_SH = lambda s: f"avg(CAST(code = 'click' AS INT)) OVER (PARTITION BY instrument ORDER BY ts RANGE BETWEEN INTERVAL {s} SECOND PRECEDING AND CURRENT ROW)"


@query(
    "ob_features",
    "instrument:s bin:t p_spread:f v_share:f last_price:f intensity:f relative_intensity:f",
    f"""WITH {T.QUOTES}, g AS (SELECT instrument, {_BIN} AS bin, arg_max(ask - bid, row(ts, event_id)) AS sp, arg_max(ask + bid, row(ts, event_id)) AS tot, avg(size) / sum(size) AS v_share, arg_max(price, row(ts, event_id)) AS last_price FROM quotes GROUP BY 1, 2),
    r AS (SELECT instrument, ts, {_SH(1800)} AS s, {_SH(7200)} AS l FROM ticks), i AS (SELECT instrument, {_BIN} AS bin, avg(s) AS intensity, avg(CAST(s > l AS INT)) AS relative_intensity FROM r GROUP BY 1, 2)
    SELECT instrument, bin, 2 * sp / nullif(tot, 0) AS p_spread, v_share, last_price, intensity, relative_intensity FROM g JOIN i USING (instrument, bin)""",
)
def ob_features(spark, sf_dir):
    q = T.quotes(spark, sf_dir)
    return I.order_book_features(q).join(I.intensity(T.ticks(spark, sf_dir), "click", 1800, 7200), ["instrument", "bin"])


_BOOK = f"""{T.QUOTES}, book AS (SELECT instrument, ts, event_id, [ask, ask + 0.02::DOUBLE, ask + 0.05::DOUBLE + 0.01::DOUBLE * (event_id % 3)] AS ask, [bid, bid - 0.01::DOUBLE, bid - 0.03::DOUBLE - 0.01::DOUBLE * (event_id % 2)] AS bid,
 [size, size + event_id % 7, 2 * size] AS asize, [size + event_id % 3, 5.0::DOUBLE, size + 1] AS bsize, date_trunc('minute', ts) AS bin FROM quotes)"""
_LEVEL_COLUMNS = [*[f"{n}_{i}" for i in (1, 2, 3) for n in ("p_spread", "p_mid", "v_asize", "v_bsize")], *[f"p_diff_{s}_{d}" for s in ("ask", "bid") for d in ("1_2", "2_3", "1_3")]]
_LEVEL_SQL = ", ".join(
    [f"2 * (a[{i}] - b[{i}]) / nullif(a[1] + b[1], 0) AS p_spread_{i}, (a[{i}] + b[{i}]) / nullif(a[1] + b[1], 0) AS p_mid_{i}, a{i} / nullif(volume, 0) AS v_asize_{i}, b{i} / nullif(volume, 0) AS v_bsize_{i}" for i in (1, 2, 3)]
    + [f"2 * abs({c}[{j}] - {c}[{i}]) / nullif(a[1] + b[1], 0) AS p_diff_{s}_{i}_{j}" for s, c in (("ask", "a"), ("bid", "b")) for i, j in ((1, 2), (2, 3), (1, 3))]
)


@query(
    "ob_levels",
    "instrument:s bin:t " + " ".join(f"{c}:f" for c in [*_LEVEL_COLUMNS, "p_accspread", "v_avg_asize", "v_avg_bsize", "v_accspread", "change_5_rows", "change_600_s", "p_diff_ask_1_300s", "p_diff_bid_1_300s"]),
    f"""WITH {_BOOK}, g AS (SELECT instrument, bin, arg_max(ask, row(ts, event_id)) AS a, arg_max(bid, row(ts, event_id)) AS b, sum(list_sum(asize) + list_sum(bsize)) AS volume,
     avg(asize[1]) AS a1, avg(asize[2]) AS a2, avg(asize[3]) AS a3, avg(bsize[1]) AS b1, avg(bsize[2]) AS b2, avg(bsize[3]) AS b3 FROM book GROUP BY 1, 2),
    k AS (SELECT instrument, CAST(floor(epoch(ts) / 300) AS BIGINT) AS k, arg_max(ask[1], row(ts, event_id)) AS a, arg_max(bid[1], row(ts, event_id)) AS b FROM book GROUP BY 1, 2),
    m AS (SELECT n.instrument, make_timestamp(CAST(floor(n.k * 300 / 60) * 60 * 1000000 AS BIGINT)) AS bin, avg(2 * (n.a - o.a) / 300) AS ma, avg(2 * (n.b - o.b) / 300) AS mb FROM k n JOIN k o ON o.instrument = n.instrument AND o.k + 1 = n.k GROUP BY 1, 2),
    s AS (SELECT instrument, ts, event_id, bin, ask[1] + bid[1] AS s FROM book), r AS (SELECT instrument, bin, avg(s / p - 1) AS change_5_rows FROM (SELECT *, lag(s, 5) OVER (PARTITION BY instrument ORDER BY ts, event_id) AS p FROM s) GROUP BY 1, 2),
    d AS (SELECT instrument, ts, arg_max(s, event_id) AS s FROM s GROUP BY 1, 2), h AS (SELECT s.instrument, s.bin, avg(s.s / d.s - 1) AS change_600_s FROM s ASOF LEFT JOIN d ON d.instrument = s.instrument AND s.ts - INTERVAL 600 SECOND >= d.ts GROUP BY 1, 2)
    SELECT instrument, bin, {_LEVEL_SQL}, 2 * (list_sum(a) - list_sum(b)) / nullif(a[1] + b[1], 0) AS p_accspread, (a1 + a2 + a3) / 3 / nullif(volume, 0) AS v_avg_asize, (b1 + b2 + b3) / 3 / nullif(volume, 0) AS v_avg_bsize,
     (a1 + a2 + a3 - b1 - b2 - b3) / nullif(volume, 0) AS v_accspread, change_5_rows, change_600_s, ma / nullif(a[1] + b[1], 0) AS p_diff_ask_1_300s, mb / nullif(a[1] + b[1], 0) AS p_diff_bid_1_300s
    FROM g LEFT JOIN m USING (instrument, bin) JOIN r USING (instrument, bin) JOIN h USING (instrument, bin)""",
)
def ob_levels(spark, sf_dir):
    """Books of three levels; the given quotes are minutes apart, so the steps are longer than the defaults."""
    q = T.quotes(spark, sf_dir)
    more = lambda k: F.pmod("event_id", F.lit(k))
    book = q.select(
        "instrument", "ts", "event_id",
        F.array(F.col("ask"), F.col("ask") + 0.02, F.col("ask") + 0.05 + 0.01 * more(3)).alias("ask"),
        F.array(F.col("bid"), F.col("bid") - 0.01, F.col("bid") - 0.03 - 0.01 * more(2)).alias("bid"),
        F.array(F.col("size"), F.col("size") + more(7), 2 * F.col("size")).alias("asize"),
        F.array(F.col("size") + more(3), F.lit(5.0), F.col("size") + 1).alias("bsize"),
    )
    return I.order_book_levels(book, 3, rows_back=5, seconds_back=600, step=300)
