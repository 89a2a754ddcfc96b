"""Joins."""

from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import joins as J
from tidepanel.operators.scale import bounded
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query
from tidepanel.sources import panel as P

KEY = "instrument:s datetime:d "
_AB = f"{T.PRED}, a AS (SELECT instrument, datetime, score, f_vol AS vol FROM pred WHERE score IS NOT NULL AND cal_ix % 3 <> 0), b AS (SELECT instrument, datetime, label AS ret, 2 * f_vol AS vol FROM pred WHERE label IS NOT NULL AND cal_ix % 3 <> 1)"


def _ab(spark, sf_dir):
    """Two groups that overlap and together cover the panel: each lacks every third date."""
    p = T.pred(spark, sf_dir)
    a = p.where("score IS NOT NULL AND cal_ix % 3 <> 0").select("instrument", "datetime", "score", F.col("f_vol").alias("vol"))
    return a, p.where("label IS NOT NULL AND cal_ix % 3 <> 1").select("instrument", "datetime", F.col("label").alias("ret"), (2 * F.col("f_vol")).alias("vol"))


@query("join_groups", KEY + "feature_score:f feature_vol:f label_ret:f label_vol:f", f"WITH {_AB} SELECT instrument, datetime, score AS feature_score, a.vol AS feature_vol, ret AS label_ret, b.vol AS label_vol FROM a FULL JOIN b USING (instrument, datetime)")
def join_groups(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    return J.join_groups({"feature": a, "label": b})


@query("join_nested", KEY + "score:f ret:f vol:f", f"WITH {_AB} SELECT instrument, datetime, score, ret, b.vol AS vol FROM a LEFT JOIN b USING (instrument, datetime)")
def join_nested(spark, sf_dir):
    return J.join_nested(*_ab(spark, sf_dir))


@query("join_sep_frames", KEY + "score:f", f"WITH {_AB} SELECT instrument, datetime, score FROM a JOIN b USING (instrument, datetime)")
def join_sep_frames(spark, sf_dir):
    """Groups stay separate tables until a column is asked for; Catalyst prunes the rest."""
    a, b = _ab(spark, sf_dir)
    return a.join(b.select("instrument", "datetime"), ["instrument", "datetime"]).select("instrument", "datetime", "score")


_IDX = f"{T.BARS}, x AS (SELECT instrument AS label, sum(volume) AS value FROM bars WHERE datetime < DATE '1996-01-01' GROUP BY 1), y AS (SELECT instrument AS label, sum(volume) AS value FROM bars WHERE datetime >= DATE '2001-06-01' GROUP BY 1)"


def _xy(spark, sf_dir):
    b = T.bars(spark, sf_dir)
    s = lambda c: b.where(c).groupBy(F.col("instrument").alias("label")).agg(F.sum("volume").alias("value"))
    return s("datetime < DATE '1996-01-01'"), s("datetime >= DATE '2001-06-01'")


@query("join_index_align", "label:s value:f", f"WITH {_IDX} SELECT label, coalesce(x.value, 0) - coalesce(y.value, 0) AS value FROM x FULL JOIN y USING (label)")
def join_index_align(spark, sf_dir):
    return J.index_align(*_xy(spark, sf_dir), lambda a, b: a - b, 0.0)


@query("index_reduce", "total:f2 mean:f n:i filled:f magnitude:f2", f"WITH {T.PANEL} SELECT sum(close) AS total, avg(close) AS mean, count(close) AS n, sum(coalesce(CASE WHEN volume = 50 THEN 0 ELSE volume END, 1)) AS filled, sum(abs(close - open)) AS magnitude FROM panel")
def index_reduce(spark, sf_dir):
    p = T.panel(spark, sf_dir).replace(50.0, 0.0, ["volume"])
    return p.agg(F.sum("close").alias("total"), F.avg("close").alias("mean"), F.count("close").alias("n"), F.sum(F.coalesce("volume", F.lit(1.0))).alias("filled"), F.sum(F.abs(F.col("close") - F.col("open"))).alias("magnitude"))


_DAILY = "trades AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) AS datetime FROM lineitem)"


def _trade_days(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("instrument"), F.to_date("l_shipdate").alias("datetime")).distinct()


@query("asof_join", KEY + "matched_at:d close:f", f"WITH {T.BARS}, {_DAILY} SELECT t.instrument, t.datetime, b.datetime AS matched_at, b.close FROM trades t ASOF LEFT JOIN bars b ON t.instrument = b.instrument AND t.datetime >= b.datetime")
def asof_join(spark, sf_dir):
    """Instruments with more than 400 rows are cut in time, so that all of them are."""
    return J.asof_join(_trade_days(spark, sf_dir), T.bars(spark, sf_dir).select("instrument", "datetime", "close"), split_rows=400)


_SPARSE = "(SELECT instrument, datetime, close, datetime + 60 AS effective_end FROM bars)"


@query("interval_join", KEY + "close:f", f"WITH {T.BARS}, {_DAILY} SELECT t.instrument, t.datetime, CASE WHEN t.datetime <= b.effective_end THEN b.close END AS close FROM trades t ASOF LEFT JOIN {_SPARSE} b ON t.instrument = b.instrument AND t.datetime >= b.datetime")
def interval_join(spark, sf_dir):
    """Carried over time chunks of 200 days, so that one busy instrument spreads."""
    right = T.bars(spark, sf_dir).select("instrument", "datetime", "close", F.date_add("datetime", 60).alias("effective_end"))
    return J.asof_join(_trade_days(spark, sf_dir), right, valid_until="effective_end", chunk_days=200)


@query("next_date_join", "instrument:s date:d seq:i visible_date:d", f"WITH {T.PIT}, {T.CALENDAR} SELECT instrument, date, seq, (SELECT min(c.datetime) FROM calendar c WHERE c.datetime > p.date) AS visible_date FROM (SELECT instrument, CASE WHEN seq % 5 = 0 THEN date - 2600 ELSE date END AS date, seq FROM pit) p")
def next_date_join(spark, sf_dir):
    """All events; every fifth is moved before the calendar begins."""
    ev = T.pit(spark, sf_dir).withColumn("date", F.when(F.col("seq") % 5 == 0, F.date_sub("date", 2600)).otherwise(F.col("date")))
    return J.next_date_join(ev, T.calendar(spark, sf_dir), calendar_rows=T.bounds(spark, sf_dir).dates)


@query("broadcast_dates", KEY + "m:f", f"WITH {T.BARS}, {T.SPANS}, d AS (SELECT datetime, avg(close) AS m FROM bars GROUP BY 1) SELECT instrument, datetime, m FROM spans CROSS JOIN d")
def broadcast_dates(spark, sf_dir):
    b = T.bars(spark, sf_dir)
    return J.broadcast_dates(b.groupBy("datetime").agg(F.avg("close").alias("m")), P.build_instruments(b).select("instrument"), T.bounds(spark, sf_dir).dates)


@query("semi_anti_members", "instrument:s side:s", f"WITH {T.BARS}, {T.MEMBERSHIP} SELECT instrument, CASE WHEN instrument IN (SELECT instrument FROM membership WHERE market = 'part') THEN 'in' ELSE 'out' END AS side FROM spans")
def semi_anti_members(spark, sf_dir):
    names = P.build_instruments(T.bars(spark, sf_dir)).select("instrument")
    part = T.membership(spark, sf_dir).where("market = 'part'")
    return names.join(part, "instrument", "left_semi").withColumn("side", F.lit("in")).unionByName(names.join(part, "instrument", "left_anti").withColumn("side", F.lit("out")))


@query(
    "join_forward_price",
    KEY + "entry_date:d entry_price:f exit_date:d exit_price:f",
    f"""WITH {T.PANEL}, s AS (SELECT b.instrument, b.datetime, c.cal_ix FROM bars b JOIN calendar c USING (datetime)), q AS (SELECT b.instrument, b.datetime, b.vwap, c.cal_ix FROM bars b JOIN calendar c USING (datetime))
    SELECT s.instrument, s.datetime, e.datetime AS entry_date, e.vwap AS entry_price, x.datetime AS exit_date, x.vwap AS exit_price FROM s LEFT JOIN q e ON e.instrument = s.instrument AND e.cal_ix = s.cal_ix + 1 LEFT JOIN q x ON x.instrument = s.instrument AND x.cal_ix = s.cal_ix + 6""",
)
def join_forward_price(spark, sf_dir):
    b = T.bars(spark, sf_dir)
    return J.forward_prices(b.select("instrument", "datetime"), b.select("instrument", "datetime", F.col("vwap").alias("price")), T.calendar(spark, sf_dir), 1, 5, T.bounds(spark, sf_dir).dates)


_POS = f"{T.BARS}, pa AS (SELECT datetime AS date, instrument, 0.1 AS weight FROM bars QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY volume DESC, instrument) <= 10), pb AS (SELECT datetime AS date, instrument, 0.1 AS weight FROM bars QUALIFY row_number() OVER (PARTITION BY datetime ORDER BY vwap DESC, instrument) <= 10)"


def _positions(spark, sf_dir, by):
    from tidepanel.operators.scale import xs_top

    return xs_top(T.bars(spark, sf_dir), ["datetime"], [F.col(by).desc(), F.col("instrument")], 10).select(F.col("datetime").alias("date"), "instrument", F.lit(0.1).alias("weight"))


@query("position_diff", "date:d instrument:s weight_a:f weight_b:f change:s", f"WITH {_POS} SELECT date, instrument, pa.weight AS weight_a, pb.weight AS weight_b, CASE WHEN pa.weight IS NULL THEN 'added' WHEN pb.weight IS NULL THEN 'removed' ELSE 'kept' END AS change FROM pa FULL JOIN pb USING (date, instrument)")
def position_diff(spark, sf_dir):
    return J.position_diff(_positions(spark, sf_dir, "volume"), _positions(spark, sf_dir, "vwap"))


@query(
    "order_diff",
    "instrument:s direction:s amount:f",
    """WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, sum(l_quantity) AS t FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 <> 0 GROUP BY 1), c AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, sum(l_quantity) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    j AS (SELECT instrument, coalesce(t, 0) AS t, coalesce(c, 0) AS c FROM t FULL JOIN c USING (instrument))
    SELECT instrument, CASE WHEN t > c THEN 'buy' ELSE 'sell' END AS direction, CASE WHEN t = 0 THEN c ELSE floor(abs(t - c) / 100) * 100 END AS amount FROM j WHERE t <> c AND CASE WHEN t = 0 THEN c ELSE floor(abs(t - c) / 100) * 100 END > 0""",
)
def order_diff(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    amt = lambda c: li.where(c).groupBy(F.col("l_suppkey").cast("string").alias("instrument")).agg(F.sum("l_quantity").alias("amount"))
    return J.order_diff(amt("l_returnflag = 'A' AND l_suppkey % 3 <> 0"), amt("l_returnflag = 'R'"))
