"""Portfolio, attribution and risk tables."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators import evaluate as E
from tidepanel.operators import portfolio as Q
from tidepanel.operators import universe as U
from tidepanel.operators.process import cs_rank_norm
from tidepanel.operators.scale import Bounds, attach_stats, bounded, exact_quantiles, xs_order, xs_top
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query

# ---- shared inputs ----
_TOP = "row_number() OVER (PARTITION BY datetime ORDER BY score DESC NULLS LAST, instrument) <= 10 AND score IS NOT NULL"
SIG = f"{T.PRED}, sig AS (SELECT datetime AS date, cal_ix AS ix, instrument, score, label, {_TOP} AS top FROM pred)"
SER = f"{SIG}, ser AS (SELECT date, any_value(ix) AS ix, avg(label) FILTER (WHERE top) / 50 AS ret, avg(label) / 50 AS bench, 0.0005::DOUBLE AS cost FROM sig GROUP BY date HAVING ret IS NOT NULL)"
POS = f"""{SIG}, pos AS (SELECT date, ix, instrument, score, label, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM sig WHERE top AND ix % 4 = 0),
 px AS (SELECT b.instrument, c.cal_ix AS ix, c.datetime AS date, vwap AS price FROM bars b JOIN calendar c USING (datetime))"""
RUN = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
PER = f"""{POS}, held AS (SELECT p.*, x.price / e.price - 1 AS r FROM pos p LEFT JOIN px e ON e.instrument = p.instrument AND e.ix = p.ix + 1 LEFT JOIN px x ON x.instrument = p.instrument AND x.ix = p.ix + 5),
 moved AS (SELECT coalesce(p.ix, o.ix + 4) AS ix, abs(coalesce(p.weight, 0) - coalesce(o.weight, 0)) AS d FROM pos p FULL JOIN pos o ON o.instrument = p.instrument AND o.ix + 4 = p.ix),
 turn AS (SELECT ix, sum(d) AS turnover FROM moved WHERE ix <= (SELECT max(ix) FROM pos) GROUP BY 1),
 per AS (SELECT ix, date, count(*) AS positions, sum(weight * coalesce(r, 0)) AS gross, any_value(turnover) AS turnover FROM held JOIN turn USING (ix) GROUP BY 1, 2)"""


def sig(spark, sf_dir):
    return T.pred(spark, sf_dir).select(F.col("datetime").alias("date"), F.col("cal_ix").alias("ix"), "instrument", "score", "label")


def dates(spark, sf_dir):
    return T.calendar(spark, sf_dir).select(F.col("datetime").alias("date"), F.col("cal_ix").alias("ix"))


def top10(spark, sf_dir, every=1):
    s = sig(spark, sf_dir).where(F.col("score").isNotNull() & (F.col("ix") % every == 0))
    t = xs_top(s, ["date"], [F.col("score").desc(), F.col("instrument")], 10).drop("top_rank")
    return t.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("date")))


def series(spark, sf_dir):
    all_rows = sig(spark, sf_dir).groupBy("date").agg((F.avg("label") / 50).alias("bench"), F.min("ix").alias("ix"))
    best = top10(spark, sf_dir).groupBy("date").agg((F.avg("label") / 50).alias("ret"))
    return best.join(all_rows, "date").where("ret IS NOT NULL").withColumn("cost", F.lit(0.0005))


def prices(spark, sf_dir):
    return T.bars(spark, sf_dir).select(F.col("datetime").alias("date"), "instrument", F.col("vwap").alias("price"))


def periods(spark, sf_dir, lag=1, cost=0.0):
    return Q.topk_periods(top10(spark, sf_dir, 4).drop("label"), prices(spark, sf_dir), dates(spark, sf_dir), 4, lag, cost, T.bounds(spark, sf_dir))


# ---- execution tables ----
@query("tradability_flags", "instrument:s datetime:d limit_buy:b limit_sell:b suspended:b", f"WITH {T.PANEL}, c AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS ch FROM panel) SELECT instrument, datetime, close IS NULL OR coalesce(ch >= 5, false) AS limit_buy, close IS NULL OR coalesce(ch <= -0.8, false) AS limit_sell, close IS NULL AS suspended FROM c")
def tradability_flags(spark, sf_dir):
    w = Window.partitionBy("instrument").orderBy("cal_ix")
    d = T.panel(spark, sf_dir).withColumn("ch", F.col("close") / F.lag("close").over(w) - 1)
    gone = F.col("close").isNull()
    flag = lambda c: gone | F.coalesce(c, F.lit(False))
    return d.withColumns({"limit_buy": flag(F.col("ch") >= 5), "limit_sell": flag(F.col("ch") <= -0.8), "suspended": gone})


@query("base_price", "instrument:s twap:f vwap:f", f"WITH {T.TICKS} SELECT instrument, avg(price) AS twap, sum(price * size) / sum(size) AS vwap FROM ticks WHERE price > 1e-8 AND ts BETWEEN TIMESTAMP '2024-01-03 09:00:00' AND TIMESTAMP '2024-01-20 15:00:00' GROUP BY 1")
def base_price(spark, sf_dir):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    t = T.ticks(spark, sf_dir).where((F.col("price") > 1e-8) & F.col("ts").between(at("2024-01-03 09:00:00"), at("2024-01-20 15:00:00")))
    return t.groupBy("instrument").agg(F.avg("price").alias("twap"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"))


_ORD = f"""{T.BARS}, m AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(date_trunc('week', l_shipdate) AS DATE) AS datetime, l_quantity AS amount, l_quantity * (1 - l_discount) AS deal, l_extendedprice / l_quantity AS price, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side FROM lineitem),
 o AS (SELECT m.*, vwap AS base, deal / amount AS ffr, side * (1 - price / vwap) AS pa FROM m JOIN bars USING (instrument, datetime))"""


def _orders(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem")
    m = li.select(
        F.col("l_suppkey").cast("string").alias("instrument"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("datetime"), F.col("l_quantity").alias("amount"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("deal"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("side"),
    )
    o = m.join(T.bars(spark, sf_dir).select("instrument", "datetime", F.col("vwap").alias("base")), ["instrument", "datetime"])
    return o.withColumns({"ffr": F.col("deal") / F.col("amount"), "pa": F.col("side") * (1 - F.col("price") / F.col("base"))})


@query("order_metrics", "datetime:d ffr:f pa:f pos:f amount:f deal:f", f"WITH {_ORD} SELECT datetime, sum(ffr * amount) / sum(amount) AS ffr, sum(pa * deal * price) / sum(deal * price) AS pa, avg(CASE WHEN pa > 0 THEN 1 ELSE 0 END) AS pos, sum(amount) AS amount, sum(deal) AS deal FROM o GROUP BY 1")
def order_metrics(spark, sf_dir):
    v = F.col("deal") * F.col("price")
    return _orders(spark, sf_dir).groupBy("datetime").agg((F.sum(F.col("ffr") * F.col("amount")) / F.sum("amount")).alias("ffr"), (F.sum(F.col("pa") * v) / F.sum(v)).alias("pa"), F.avg((F.col("pa") > 0).cast("double")).alias("pos"), F.sum("amount").alias("amount"), F.sum("deal").alias("deal"))


@query("agg_order_metrics", "instrument:s amount:f deal:f value:f2 price:f", f"WITH {_ORD} SELECT instrument, sum(amount) AS amount, sum(deal) AS deal, sum(deal * price) AS value, sum(deal * price) / nullif(sum(deal), 0) AS price FROM o GROUP BY 1")
def agg_order_metrics(spark, sf_dir):
    v = F.sum(F.col("deal") * F.col("price"))
    return _orders(spark, sf_dir).groupBy("instrument").agg(F.sum("amount").alias("amount"), F.sum("deal").alias("deal"), v.alias("value"), E.ratio(v, F.sum("deal")).alias("price"))


@query("indicator_analysis", "method:s ffr:f pa:f", f"WITH {_ORD} SELECT 'mean' AS method, avg(ffr) AS ffr, avg(pa) AS pa FROM o UNION ALL SELECT 'amount', sum(ffr * deal) / sum(deal), sum(pa * deal) / sum(deal) FROM o UNION ALL SELECT 'value', sum(ffr * deal * price) / sum(deal * price), sum(pa * deal * price) / sum(deal * price) FROM o")
def indicator_analysis(spark, sf_dir):
    o = _orders(spark, sf_dir)
    w = F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in ("mean", "amount", "value")]), F.array(F.lit(1.0), F.col("deal"), F.col("deal") * F.col("price")))).alias("method", "w")
    return o.select("ffr", "pa", w).groupBy("method").agg((F.sum(F.col("ffr") * F.col("w")) / F.sum("w")).alias("ffr"), (F.sum(F.col("pa") * F.col("w")) / F.sum("w")).alias("pa"))


# ---- return series ----
@query("bench_return", "month:d ret:f", f"WITH {SER} SELECT CAST(date_trunc('month', date) AS DATE) AS month, product(1 + bench) - 1 AS ret FROM ser GROUP BY 1")
def bench_return(spark, sf_dir):
    return series(spark, sf_dir).groupBy(F.trunc("date", "month").alias("month")).agg((F.product(1 + F.col("bench")) - 1).alias("ret"))


_LS = f"{SER}, ls AS (SELECT 'ret' AS series, date, ret FROM ser UNION ALL SELECT 'excess', date, ret - bench FROM ser UNION ALL SELECT 'excess_net', date, ret - bench - cost FROM ser)"


def risk_sql(source, keys, scale=52):
    part = f"(PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""c AS (SELECT *, sum(ret) OVER {part} AS c FROM {source}), d AS (SELECT *, c - max(c) OVER {part} AS dd FROM c)
    SELECT {keys}, avg(ret) AS mean, stddev_samp(ret) AS std, avg(ret) * {scale} AS annual_return, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({scale}) AS information_ratio, min(dd) AS max_drawdown FROM d GROUP BY ALL"""


_RISK = "mean:f std:f annual_return:f information_ratio:f max_drawdown:f"


@query("risk_analysis", "series:s " + _RISK, f"WITH {_LS}, r AS (SELECT * FROM ls WHERE series = 'ret'), {risk_sql('r', 'series')}")
def risk_analysis(spark, sf_dir):
    return Q.risk_analysis(Q.melt_series(series(spark, sf_dir), ["ret"]))


@query("risk_analysis_product", "series:s mean:f annual_return:f max_drawdown:f", f"WITH {SER}, n AS (SELECT *, product(1 + ret) OVER {RUN} AS nav FROM ser), d AS (SELECT *, nav / max(nav) OVER {RUN} - 1 AS dd FROM n) SELECT 'ret' AS series, exp(avg(ln(1 + ret))) - 1 AS mean, pow(exp(avg(ln(1 + ret))), 52) - 1 AS annual_return, min(dd) AS max_drawdown FROM d")
def risk_analysis_product(spark, sf_dir):
    return Q.risk_analysis(Q.melt_series(series(spark, sf_dir), ["ret"]), mode="product")


def _excess(spark, sf_dir):
    s = series(spark, sf_dir).withColumns({"excess": F.col("ret") - F.col("bench"), "excess_net": F.col("ret") - F.col("bench") - F.col("cost")})
    return Q.melt_series(s, ["ret", "excess", "excess_net"])


@query("excess_risk", "series:s " + _RISK, f"WITH {_LS}, {risk_sql('ls', 'series')}")
def excess_risk(spark, sf_dir):
    return Q.risk_analysis(_excess(spark, sf_dir))


@query("multi_pass_summary", "metric:s mean:f std:f ratio:f", f"WITH {_LS}, k AS (SELECT * FROM ({'SELECT * FROM (WITH ' + risk_sql('ls', 'series') + ')'})), l AS (SELECT 'annual_return' AS metric, annual_return AS v FROM k UNION ALL SELECT 'max_drawdown', max_drawdown FROM k) SELECT metric, avg(v) AS mean, stddev_samp(v) AS std, avg(v) / stddev_samp(v) AS ratio FROM l GROUP BY 1")
def multi_pass_summary(spark, sf_dir):
    long = Q.risk_analysis(_excess(spark, sf_dir)).unpivot(["series"], ["annual_return", "max_drawdown"], "metric", "v")
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), E.ratio(F.avg("v"), F.stddev_samp("v")).alias("ratio"))


@query("portfolio_stats", "annual_return:f sharpe:f volatility:f max_drawdown:f beta:f alpha:f", f"WITH {SER}, n AS (SELECT *, product(1 + ret) OVER {RUN} AS nav FROM ser), d AS (SELECT *, nav / max(nav) OVER {RUN} - 1 AS dd FROM n) SELECT avg(ret) * 250 AS annual_return, avg(ret) / stddev_pop(ret) * sqrt(250) AS sharpe, stddev_pop(ret) * sqrt(250) AS volatility, min(dd) AS max_drawdown, covar_pop(ret, bench) / var_pop(bench) AS beta, avg(ret) * 250 - covar_pop(ret, bench) / var_pop(bench) * avg(bench) * 250 AS alpha FROM d")
def portfolio_stats(spark, sf_dir):
    return Q.portfolio_stats(series(spark, sf_dir))


@query("report_curves", "date:d cum_ret:f cum_net:f cum_bench:f cum_ex:f cum_ex_net:f drawdown:f ex_drawdown:f", f"WITH {SER}, c AS (SELECT date, sum(ret) OVER {RUN} AS cum_ret, sum(ret - cost) OVER {RUN} AS cum_net, sum(bench) OVER {RUN} AS cum_bench, sum(ret - bench) OVER {RUN} AS cum_ex, sum(ret - cost - bench) OVER {RUN} AS cum_ex_net FROM ser) SELECT *, cum_net - max(cum_net) OVER {RUN} AS drawdown, cum_ex_net - max(cum_ex_net) OVER {RUN} AS ex_drawdown FROM c")
def report_curves(spark, sf_dir):
    return Q.report_curves(series(spark, sf_dir).withColumn("series", F.lit("p")))


@query("monthly_risk", "month:d " + _RISK, f"WITH {SER}, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, date, ret FROM ser QUALIFY count(*) OVER (PARTITION BY date_trunc('month', date)) >= 3), {risk_sql('m', 'month')}")
def monthly_risk(spark, sf_dir):
    s = series(spark, sf_dir).withColumn("month", F.trunc("date", "month"))
    s = s.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("month"))).where("__n >= 3")
    return Q.risk_analysis(s, keys=("month",))


@query("rolling_beta", "date:d beta:f", f"WITH {SER} SELECT date, CASE WHEN count(*) OVER w >= 3 THEN covar_samp(ret, bench) OVER w / nullif(var_samp(bench) OVER w, 0) END AS beta FROM ser WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_beta(spark, sf_dir):
    w = Window.orderBy("date").rowsBetween(-11, 0)
    return series(spark, sf_dir).withColumn("beta", F.when(F.count(F.lit(1)).over(w) >= 3, E.ratio(F.covar_samp("ret", "bench").over(w), F.var_samp("bench").over(w))))


@query("capture_ratio", "date:d up:f down:f", f"WITH {SER} SELECT date, avg(CASE WHEN bench > 0 THEN ret END) OVER {RUN} / nullif(avg(CASE WHEN bench > 0 THEN bench END) OVER {RUN}, 0) AS up, avg(CASE WHEN bench < 0 THEN ret END) OVER {RUN} / nullif(avg(CASE WHEN bench < 0 THEN bench END) OVER {RUN}, 0) AS down FROM ser")
def capture_ratio(spark, sf_dir):
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda c: E.ratio(F.avg(F.when(c, F.col("ret"))).over(w), F.avg(F.when(c, F.col("bench"))).over(w))
    return series(spark, sf_dir).withColumns({"up": part(F.col("bench") > 0), "down": part(F.col("bench") < 0)})


@query(
    "drawdown_event",
    "peak:d trough:d recovery:d depth:f",
    f"""WITH {SER}, n AS (SELECT date, product(1 + ret - 0.02) OVER {RUN} AS nav FROM ser), d AS (SELECT *, max(nav) OVER {RUN} AS top FROM n), t AS (SELECT date AS trough, top, nav / top - 1 AS depth FROM d ORDER BY nav / top - 1, date LIMIT 1)
    SELECT (SELECT max(date) FROM d, t WHERE date <= trough AND nav = d.top) AS peak, trough, (SELECT min(date) FROM d, t WHERE date > trough AND nav >= t.top) AS recovery, depth FROM t""",
)
def drawdown_event(spark, sf_dir):
    """Peak, trough and recovery of the deepest drawdown (a table of dates, one window)."""
    d = Q.nav(series(spark, sf_dir).withColumns({"series": F.lit("p"), "ret": F.col("ret") - 0.02}))
    w = Q.line("series")
    d = d.withColumn("top", F.max("nav").over(w)).withColumn("dd", F.col("nav") / F.col("top") - 1)
    d = d.withColumn("peak_at", F.max(F.when(F.col("nav") == F.col("top"), F.col("date"))).over(w))
    t = d.agg(F.min(F.struct("dd", "date", "top", "peak_at")).alias("t")).select("t.*").withColumnsRenamed({"dd": "depth", "date": "trough", "top": "level", "peak_at": "peak"})
    back = d.crossJoin(F.broadcast(t)).where("date > trough AND nav >= level").agg(F.min("date").alias("recovery"))
    return t.crossJoin(back)


@query(
    "drawdown_attribution",
    "level:s name:s contribution:f share:f days:i",
    f"""WITH {SER}, {T.GROUPS}, n AS (SELECT date, product(1 + ret - 0.02) OVER {RUN} AS nav FROM ser), d AS (SELECT *, max(nav) OVER {RUN} AS top FROM n), t AS (SELECT date AS trough, top FROM d ORDER BY nav / top - 1, date LIMIT 1),
    e AS (SELECT (SELECT max(date) FROM d, t WHERE date <= trough AND nav = d.top) AS peak, trough FROM t),
    c AS (SELECT date, instrument, label / 50 / count(label) OVER (PARTITION BY date) AS contribution FROM sig WHERE top),
    i AS (SELECT c.date, c.instrument, g.sector, g.industry, contribution FROM c JOIN groups g USING (instrument), e WHERE date > peak AND date <= trough AND contribution IS NOT NULL),
    l AS (SELECT date, contribution, unnest(['instrument', 'sector', 'industry']) AS level, unnest([instrument, sector, industry]) AS name FROM i)
    SELECT level, name, sum(contribution) AS contribution, sum(contribution) / (SELECT sum(contribution) FROM i) AS share, count(DISTINCT date) AS days FROM l GROUP BY 1, 2""",
)
def drawdown_attribution(spark, sf_dir):
    """Which names, sectors and industries lost what between peak and trough of the deepest drawdown."""
    names = bounded(T.groups(spark, sf_dir), T.bounds(spark, sf_dir).names)
    part = F.col("label") / 50 / F.count("label").over(Window.partitionBy("date"))
    held = top10(spark, sf_dir).withColumn("contribution", part).where("contribution IS NOT NULL").join(names, "instrument")
    return Q.event_attribution(drawdown_event(spark, sf_dir), held, ["instrument", "sector", "industry"])


# ---- positions ----
_HOLD = f"{POS}, hold AS (SELECT date, ix, instrument, floor(1000 * weight * 7) AS amount, weight FROM pos)"


def _hold(spark, sf_dir):
    return top10(spark, sf_dir, 4).withColumn("amount", F.floor(1000 * F.col("weight") * 7).cast("double"))


@query("position_weights", "date:d instrument:s weight:f", f"WITH {_HOLD} SELECT h.date, h.instrument, amount * price / (sum(amount * price) OVER (PARTITION BY h.date) + 10000) AS weight FROM hold h JOIN px USING (instrument, ix)")
def position_weights(spark, sf_dir):
    h = _hold(spark, sf_dir).join(prices(spark, sf_dir), ["date", "instrument"])
    v = F.col("amount") * F.col("price")
    # at most ten rows per date
    return h.withColumn("weight", v / (F.sum(v).over(Window.partitionBy("date")) + 10000.0))


@query("position_fill_price", "date:d instrument:s price:f", f"WITH {_HOLD} SELECT h.date, h.instrument, CASE WHEN h.date - b.datetime <= 21 THEN b.vwap END AS price FROM hold h ASOF LEFT JOIN bars b ON b.instrument = h.instrument AND h.date >= b.datetime")
def position_fill_price(spark, sf_dir):
    from tidepanel.operators.joins import asof_join

    p = T.bars(spark, sf_dir).select("instrument", "datetime", F.col("vwap").alias("px"))
    h = _hold(spark, sf_dir).select("instrument", F.col("date").alias("datetime"), "amount")
    j = asof_join(h, p)
    return j.select(F.col("datetime").alias("date"), "instrument", F.when(F.datediff("datetime", "matched_at") <= 21, F.col("px")).alias("price"))


@query("position_value", "date:d value:f2 change:f", f"WITH {_HOLD}, v AS (SELECT h.date, sum(amount * price) + 10000 AS value FROM hold h JOIN px USING (instrument, ix) GROUP BY 1) SELECT date, value, value / lag(value) OVER (ORDER BY date) - 1 AS change FROM v")
def position_value(spark, sf_dir):
    v = _hold(spark, sf_dir).join(prices(spark, sf_dir), ["date", "instrument"]).groupBy("date").agg((F.sum(F.col("amount") * F.col("price")) + 10000).alias("value"))
    return v.withColumn("change", F.col("value") / F.lag("value").over(Window.orderBy("date")) - 1)


_STAT = f"""{SIG}, t AS (SELECT ix, instrument FROM sig WHERE top), st AS (SELECT coalesce(n.ix, o.ix + 1) AS ix, coalesce(n.instrument, o.instrument) AS instrument, CASE WHEN n.ix IS NOT NULL AND o.ix IS NOT NULL THEN 0 WHEN n.ix IS NOT NULL THEN 1 ELSE -1 END AS status FROM t n FULL JOIN t o ON o.instrument = n.instrument AND o.ix + 1 = n.ix),
 status AS (SELECT c.datetime AS date, st.instrument, status FROM st JOIN calendar c ON c.cal_ix = st.ix WHERE st.ix <= (SELECT max(ix) FROM t))"""


def _status(spark, sf_dir):
    return Q.position_status(top10(spark, sf_dir).select("date", "instrument"), dates(spark, sf_dir), T.bounds(spark, sf_dir))


@query("position_status", "date:d instrument:s status:i", f"WITH {_STAT} SELECT * FROM status")
def position_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query("hold_buy_sell_return", "date:d status:i ret:f cum:f", f"WITH {_STAT}, m AS (SELECT s.date, status, avg(label) AS ret FROM status s JOIN sig USING (date, instrument) GROUP BY 1, 2) SELECT *, sum(ret) OVER (PARTITION BY status ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM m")
def hold_buy_sell_return(spark, sf_dir):
    m = _status(spark, sf_dir).join(sig(spark, sf_dir), ["date", "instrument"]).groupBy("date", "status").agg(F.avg("label").alias("ret"))
    return m.withColumn("cum", F.sum("ret").over(Q.line("status")))


@query("rank_label", "date:d status:i rank_ratio:f excess:f", f"WITH {_STAT}, r AS (SELECT date, instrument, label, CASE WHEN label IS NOT NULL THEN {T.avg_rank('label', 'date')} / count(label) OVER (PARTITION BY date) END AS rr, label - avg(label) OVER (PARTITION BY date) AS ex FROM sig) SELECT date, status, avg(rr) AS rank_ratio, avg(ex) AS excess FROM status JOIN r USING (date, instrument) GROUP BY 1, 2")
def rank_label(spark, sf_dir):
    b = T.bounds(spark, sf_dir)
    r = attach_stats(xs_order(sig(spark, sf_dir), ["date"], "label", "instrument", "__l", b, number=False), ["date"], {"__m": F.avg("label")}, b.dates)
    r = r.select("date", "instrument", (F.col("__l_avg") / F.col("__l_n")).alias("rr"), (F.col("label") - F.col("__m")).alias("ex"))
    return _status(spark, sf_dir).join(r, ["date", "instrument"]).groupBy("date", "status").agg(F.avg("rr").alias("rank_ratio"), F.avg("ex").alias("excess"))


# ---- groups and attribution ----
_BW = f"{PER}, {T.GROUPS}, bw AS (SELECT datetime AS date, instrument, volume / sum(volume) OVER (PARTITION BY datetime) AS weight FROM bars)"


def _bench(spark, sf_dir):
    b = T.bars(spark, sf_dir).select(F.col("datetime").alias("date"), "instrument", "volume")
    d = attach_stats(b, ["date"], {"__v": F.sum("volume")}, T.bounds(spark, sf_dir).dates)
    return d.select("date", "instrument", (F.col("volume") / F.col("__v")).alias("weight"))


@query("bench_weights", "date:d instrument:s weight:f", f"WITH {_BW} SELECT * FROM bw WHERE date >= DATE '1999-01-01'")
def bench_weights(spark, sf_dir):
    return _bench(spark, sf_dir).where(F.col("date") >= F.lit(dt.date(1999, 1, 1)))


def _grouped(spark, sf_dir, df):
    """Weights with sector and label return."""
    g = bounded(T.groups(spark, sf_dir), T.bounds(spark, sf_dir).names)
    return df.select("date", "instrument", "weight").join(g, "instrument").join(sig(spark, sf_dir).select("date", "instrument", F.coalesce("label", F.lit(0.0)).alias("ret")), ["date", "instrument"])


_DEC = lambda src, out: f"{out} AS (SELECT w.date, sector, sum(weight) AS gw, sum(weight * coalesce(s.label, 0)) / sum(weight) AS gr FROM {src} w JOIN groups USING (instrument) JOIN sig s ON s.date = w.date AND s.instrument = w.instrument GROUP BY 1, 2)"


@query("decompose_portfolio", "date:d sector:s group_weight:f group_return:f", f"WITH {_BW}, {_DEC('bw', 'd')} SELECT date, sector, gw AS group_weight, gr AS group_return FROM d")
def decompose_portfolio(spark, sf_dir):
    return Q.decompose(_grouped(spark, sf_dir, _bench(spark, sf_dir)), "sector")


@query("group_bins", "date:d instrument:s bin:i", f"WITH {T.BARS}, q AS (SELECT datetime, quantile_cont(volume, 0.33) AS a, quantile_cont(volume, 0.66) AS b FROM bars GROUP BY 1) SELECT datetime AS date, instrument, CASE WHEN volume <= a THEN 0 WHEN volume <= b THEN 1 ELSE 2 END AS bin FROM bars JOIN q USING (datetime)")
def group_bins(spark, sf_dir):
    b, bd = T.bars(spark, sf_dir), T.bounds(spark, sf_dir)
    q = exact_quantiles(b, ["datetime"], "volume", {"a": 0.33, "b": 0.66}, bd)
    return b.join(bounded(q, bd.dates), "datetime").select(F.col("datetime").alias("date"), "instrument", F.when(F.col("volume") <= F.col("a"), 0).when(F.col("volume") <= F.col("b"), 1).otherwise(2).alias("bin"))


@query(
    "brinson",
    "date:d allocation:f selection:f interaction:f total:f",
    f"""WITH {_BW}, {_DEC('pos', 'p')}, {_DEC('bw', 'b')}, j AS (SELECT coalesce(p.date, b.date) AS date, coalesce(p.gw, 0) AS pw, coalesce(p.gr, 0) AS pr, coalesce(b.gw, 0) AS bw, coalesce(b.gr, 0) AS br FROM p FULL JOIN b ON p.date = b.date AND p.sector = b.sector)
    SELECT date, sum((pw - bw) * br) AS allocation, sum(bw * (pr - br)) AS selection, sum((pw - bw) * (pr - br)) AS interaction, sum(pw * pr - bw * br) AS total FROM j GROUP BY 1""",
)
def brinson(spark, sf_dir):
    return Q.brinson(_grouped(spark, sf_dir, top10(spark, sf_dir, 4)), _grouped(spark, sf_dir, _bench(spark, sf_dir)), "sector")


_NAV = lambda ret: f"product(1 + {ret}) OVER {RUN}"


@query("topk_periods", "date:d positions:i gross:f turnover:f cost:f ret:f log_nav:f", f"WITH {PER} SELECT date, positions, gross, turnover, turnover * 0.001 AS cost, gross - turnover * 0.001 AS ret, ln({_NAV('gross - turnover * 0.001')}) AS log_nav FROM per")
def topk_periods(spark, sf_dir):
    return periods(spark, sf_dir, 1, 0.001).withColumn("log_nav", F.ln("nav"))


@query("stress_grid", "lag:i cost:f date:d ret:f", f"WITH {PER}, h2 AS (SELECT p.ix, p.date, p.weight, x.price / e.price - 1 AS r FROM pos p LEFT JOIN px e ON e.instrument = p.instrument AND e.ix = p.ix + 2 LEFT JOIN px x ON x.instrument = p.instrument AND x.ix = p.ix + 6), p2 AS (SELECT ix, date, sum(weight * coalesce(r, 0)) AS gross, any_value(turnover) AS turnover FROM h2 JOIN turn USING (ix) GROUP BY 1, 2), v AS (SELECT unnest([0.0, 0.002]) AS cost) SELECT 1 AS lag, cost, date, gross - turnover * cost AS ret FROM per, v UNION ALL SELECT 2, cost, date, gross - turnover * cost FROM p2, v")
def stress_grid(spark, sf_dir):
    """One pass per lag; costs are a cross join with a handful of variants."""
    costs = F.broadcast(spark.createDataFrame([(0.0,), (0.002,)], "c double"))
    one = lambda lag: periods(spark, sf_dir, lag).select(F.lit(lag).alias("lag"), "date", "gross", "turnover")
    return one(1).unionByName(one(2)).crossJoin(costs).select("lag", F.col("c").alias("cost"), "date", (F.col("gross") - F.col("turnover") * F.col("c")).alias("ret"))


@query("sector_cap_stress", "cost:f final:f2 worst:f", f"WITH {PER}, v AS (SELECT unnest([0.0, 0.001, 0.005]) AS cost), n AS (SELECT cost, date, gross / 10 - turnover * cost AS r, product(1 + gross / 10 - turnover * cost) OVER (PARTITION BY cost ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM per, v), d AS (SELECT *, nav / max(nav) OVER (PARTITION BY cost ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM n) SELECT cost, arg_max(nav, date) AS final, min(dd) AS worst FROM d GROUP BY 1")
def sector_cap_stress(spark, sf_dir):
    costs = F.broadcast(spark.createDataFrame([(0.0,), (0.001,), (0.005,)], "cost_rate double"))
    d = periods(spark, sf_dir).select("date", "gross", "turnover").crossJoin(costs).withColumn("ret", F.col("gross") / 10 - F.col("turnover") * F.col("cost_rate"))
    d = Q.nav(d, keys=("cost_rate",))
    d = d.withColumn("dd", F.col("nav") / F.max("nav").over(Q.line("cost_rate")) - 1)
    return d.groupBy(F.col("cost_rate").alias("cost")).agg(F.max_by("nav", "date").alias("final"), F.min("dd").alias("worst"))


@query("asof_filters", "date:d instrument:s score:f", f"WITH {POS}, h AS (SELECT instrument, datetime, count(close) OVER u AS rows, avg(close * volume) OVER w AS money, close FROM panel WINDOW u AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT p.date, p.instrument, score FROM pos p JOIN h ON h.instrument = p.instrument AND h.datetime = p.date WHERE rows >= 20 AND money >= 50000 AND close >= 100")
def asof_filters(spark, sf_dir):
    from tidepanel.functions.expr import features

    f = features(T.panel(spark, sf_dir).withColumn("money", F.col("close") * F.col("volume")), {"rows": "Count($close,0)", "money20": "Mean($money,20)"}, keep=("close",))
    ok = f.where("rows >= 20 AND money20 >= 50000 AND close >= 100").select("instrument", F.col("datetime").alias("date"))
    return top10(spark, sf_dir, 4).join(ok, ["instrument", "date"], "left_semi")


_BUCKET = "CASE WHEN CAST(instrument AS INT) % 10 < 2 THEN 'new' WHEN CAST(instrument AS INT) % 10 < 5 THEN 'short' ELSE 'long' END"


def _bucketed(spark, sf_dir):
    k = F.col("instrument").cast("int") % 10
    return sig(spark, sf_dir).where("score IS NOT NULL").withColumn("bucket", F.when(k < 2, "new").when(k < 5, "short").otherwise("long"))


@query("score_calibration", "date:d instrument:s score:f reason:s", f"WITH {SIG} SELECT date, instrument, CASE WHEN score < 0.2 THEN NULL ELSE score - CASE {_BUCKET} WHEN 'new' THEN 0.3 WHEN 'short' THEN 0.1 ELSE 0 END END AS score, CASE WHEN score < 0.2 THEN 'illiquid' WHEN {_BUCKET} <> 'long' THEN 'penalised' END AS reason FROM sig WHERE score IS NOT NULL")
def score_calibration(spark, sf_dir):
    penalty = F.create_map(F.lit("new"), F.lit(0.3), F.lit("short"), F.lit(0.1), F.lit("long"), F.lit(0.0))
    thin = F.col("score") < 0.2
    return _bucketed(spark, sf_dir).withColumns({"reason": F.when(thin, "illiquid").when(F.col("bucket") != "long", "penalised"), "score": F.when(~thin, F.col("score") - F.element_at(penalty, F.col("bucket")))})


@query(
    "bucket_topn",
    "date:d instrument:s bucket:s",
    f"""WITH {SIG}, b AS (SELECT *, {_BUCKET} AS bucket FROM sig WHERE score IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY date, bucket ORDER BY score DESC, instrument) AS br FROM b),
    q AS (SELECT *, br <= CASE bucket WHEN 'new' THEN 2 WHEN 'short' THEN 3 ELSE 5 END AS inq, CASE bucket WHEN 'long' THEN 0 WHEN 'short' THEN 1 ELSE 2 END AS ord FROM r WHERE br <= 10)
    SELECT date, instrument, bucket FROM q QUALIFY row_number() OVER (PARTITION BY date ORDER BY CASE WHEN inq THEN 0 ELSE 1 END, ord, score DESC, instrument) <= 10""",
)
def bucket_topn(spark, sf_dir):
    """Quotas per bucket first, then refill by bucket order. At most n rows per bucket can matter."""
    r = xs_top(_bucketed(spark, sf_dir), ["date", "bucket"], [F.col("score").desc(), F.col("instrument")], 10)
    quota = F.when(F.col("bucket") == "new", 2).when(F.col("bucket") == "short", 3).otherwise(5)
    order = F.when(F.col("bucket") == "long", 0).when(F.col("bucket") == "short", 1).otherwise(2)
    r = r.withColumns({"late": (F.col("top_rank") > quota).cast("int"), "ord": order}).drop("top_rank")
    return xs_top(r, ["date"], ["late", "ord", F.col("score").desc(), F.col("instrument")], 10)


@query(
    "capped_topn",
    "date:d instrument:s sector:s industry:s score:f",
    f"""WITH RECURSIVE {SIG}, {T.GROUPS}, r AS (SELECT date, instrument, sector, industry, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument) AS i FROM sig JOIN groups USING (instrument) WHERE score IS NOT NULL),
    w AS (SELECT DISTINCT date, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS ss, CAST([] AS VARCHAR[]) AS ii FROM r
     UNION ALL SELECT date, i, CASE WHEN ok THEN list_append(names, instrument) ELSE names END, CASE WHEN ok THEN list_append(ss, sector) ELSE ss END, CASE WHEN ok THEN list_append(ii, industry) ELSE ii END
     FROM (SELECT w.date, r.i, names, ss, ii, instrument, sector, industry, len(names) < 10 AND len(list_filter(ss, lambda x : x = sector)) < 3 AND len(list_filter(ii, lambda x : x = industry)) < 2 AS ok FROM w JOIN r ON r.date = w.date AND r.i = w.i + 1)),
    z AS (SELECT date, arg_max(names, i) AS names FROM w GROUP BY date)
    SELECT r.date, r.instrument, sector, industry, score FROM r JOIN (SELECT date, unnest(names) AS instrument FROM z) USING (date, instrument)""",
)
def capped_topn(spark, sf_dir):
    g = bounded(T.groups(spark, sf_dir), T.bounds(spark, sf_dir).names)
    d = sig(spark, sf_dir).where("score IS NOT NULL").join(g, "instrument").select("date", "instrument", "sector", "industry", "score")
    return Q.capped_topn(d, 10, {"sector": 3, "industry": 2})


_MOM = f"{POS}, {T.GROUPS}, mo AS (SELECT date, instrument, price / lag(price) OVER (PARTITION BY instrument ORDER BY date) - 1 AS m FROM px)"


@query("sector_momentum", "date:d sector:s momentum:f top_rank:i cap:i", f"WITH {_MOM}, s AS (SELECT date, sector, avg(m) AS momentum FROM mo JOIN groups USING (instrument) WHERE m IS NOT NULL GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY date ORDER BY momentum DESC, sector) AS top_rank, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY momentum DESC, sector) <= 2 THEN 5 ELSE 3 END AS cap FROM s")
def sector_momentum(spark, sf_dir):
    w = Window.partitionBy("instrument").orderBy("date")
    m = prices(spark, sf_dir).withColumn("m", F.col("price") / F.lag("price").over(w) - 1).where("m IS NOT NULL")
    s = m.join(bounded(T.groups(spark, sf_dir), T.bounds(spark, sf_dir).names), "instrument").groupBy("date", "sector").agg(F.avg("m").alias("momentum"))
    # one row per sector
    s = s.withColumn("top_rank", F.row_number().over(Window.partitionBy("date").orderBy(F.col("momentum").desc(), "sector")))
    return s.withColumn("cap", F.when(F.col("top_rank") <= 2, 5).otherwise(3))


_CAP = 0.2
_ROUND = "w{k} AS (SELECT date, instrument, scheme, CASE WHEN weight > {cap}::DOUBLE THEN {cap}::DOUBLE WHEN u > 0 AND e > 0 THEN weight + weight / u * e ELSE weight END AS weight FROM (SELECT *, sum(greatest(weight - {cap}::DOUBLE, 0)) OVER p AS e, sum(CASE WHEN weight <= {cap}::DOUBLE THEN weight ELSE 0 END) OVER p AS u FROM w{j} WINDOW p AS (PARTITION BY date, scheme)) AS x)"
_RISK = """mv AS (SELECT date, instrument, price / lag(price) OVER (PARTITION BY instrument ORDER BY date) - 1 AS m FROM px), mk AS (SELECT *, CASE WHEN m IS NOT NULL THEN avg(m) OVER (PARTITION BY date) END AS k FROM mv),
 risk AS (SELECT date, instrument, stddev_samp(m) OVER v * sqrt(52) AS vol, covar_samp(m, k) OVER b / CASE WHEN var_samp(k) OVER b > 0 THEN var_samp(k) OVER b END AS beta FROM mk
  WINDOW v AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""
_SCHEMES = f"""{_RISK}, sh AS (SELECT pos.*, score - min(score) OVER (PARTITION BY date) + 1e-6::DOUBLE AS x, greatest(coalesce(vol, 0.5::DOUBLE), 0.05::DOUBLE) AS vo, greatest(coalesce(beta, 1::DOUBLE), 0.3::DOUBLE) AS be FROM pos LEFT JOIN risk USING (date, instrument)),
 v0 AS (SELECT date, instrument, unnest(['equal', 'score', 'inverse_vol', 'beta', 'beta_neutral']) AS scheme, unnest([1::DOUBLE, x, 1 / vo, 1 / be, 1 / (be * be)]) AS v FROM sh),
 w0 AS (SELECT date, instrument, scheme, v / sum(v) OVER (PARTITION BY date, scheme) AS weight FROM v0)"""
_CAPPED = ", ".join([_SCHEMES, *(_ROUND.format(k=k, j=k - 1, cap=_CAP) for k in range(1, 21))])


@query("weight_schemes", "date:d instrument:s scheme:s weight:f", f"WITH {POS}, {_CAPPED} SELECT date, instrument, scheme, weight / sum(weight) OVER (PARTITION BY date, scheme) AS weight FROM w20")
def weight_schemes(spark, sf_dir):
    """All holdings under equal weights, positively shifted scores, inverse volatility and two weights by beta, capped."""
    t = top10(spark, sf_dir, 4).join(Q.trailing_risk(prices(spark, sf_dir)), ["date", "instrument"], "left")
    schemes = F.array(*[F.struct(F.lit(k).alias("scheme"), v.alias("w")) for k, v in Q.scheme_values(t).items()])
    long = t.withColumn("s", schemes).select("date", "instrument", F.explode("s").alias("s")).select("date", "instrument", "s.scheme", F.col("s.w").alias("weight"))
    return Q.cap_weights(long, _CAP, keys=("date", "scheme"))


@query("attribution_groups", "instrument:s sector:s industry:s n:i win_rate:f total:f", f"WITH {PER}, {T.GROUPS} SELECT instrument, sector, industry, count(*) AS n, avg(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS win_rate, sum(weight * coalesce(r, 0)) AS total FROM held JOIN groups USING (instrument) GROUP BY GROUPING SETS ((instrument), (sector), (industry))")
def attribution_groups(spark, sf_dir):
    h = _held(spark, sf_dir).join(bounded(T.groups(spark, sf_dir), T.bounds(spark, sf_dir).names), "instrument")
    win = F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0))
    return h.groupingSets([["instrument"], ["sector"], ["industry"]], "instrument", "sector", "industry").agg(F.count(F.lit(1)).alias("n"), win.alias("win_rate"), F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("total"))


def _held(spark, sf_dir):
    b = T.bounds(spark, sf_dir)
    p = prices(spark, sf_dir).join(bounded(dates(spark, sf_dir), b.dates), "date")
    at = lambda k, n: p.select("instrument", (F.col("ix") - k).alias("ix"), F.col("price").alias(n))
    h = top10(spark, sf_dir, 4).join(at(1, "e"), ["instrument", "ix"], "left").join(at(5, "x"), ["instrument", "ix"], "left")
    return h.withColumn("r", F.col("x") / F.col("e") - 1)


_CMP = f"{PER}, bp AS (SELECT ix, avg(price) AS p FROM px GROUP BY 1), cmp AS (SELECT per.date, gross / 10 AS ret, (x.p / e.p - 1) / 10 AS bench FROM per JOIN bp e ON e.ix = per.ix + 1 JOIN bp x ON x.ix = per.ix + 5)"


def _cmp(spark, sf_dir):
    b = T.bounds(spark, sf_dir)
    bp = prices(spark, sf_dir).groupBy("date").agg(F.avg("price").alias("p")).join(dates(spark, sf_dir), "date")
    at = lambda k, n: bp.select((F.col("ix") - k).alias("ix"), F.col("p").alias(n))
    d = periods(spark, sf_dir).join(at(1, "e"), "ix").join(at(5, "x"), "ix")
    return d.select("date", (F.col("gross") / 10).alias("ret"), ((F.col("x") / F.col("e") - 1) / 10).alias("bench"))


@query(
    "benchmark_compare",
    "periods:i cumulative:f bench_cumulative:f excess_cumulative:f bench_annual:f bench_volatility:f bench_drawdown:f relative_drawdown:f tracking_error:f ir:f beta:f alpha:f corr:f mean_excess:f win_rate:f",
    f"""WITH {_CMP}, n AS (SELECT *, product(1 + coalesce(ret, 0)) OVER {RUN} AS own, product(1 + coalesce(bench, 0)) OVER {RUN} AS market FROM cmp), v AS (SELECT *, own / market AS relative FROM n WHERE ret IS NOT NULL AND bench IS NOT NULL),
    d AS (SELECT *, market / max(market) OVER {RUN} - 1 AS md, relative / max(relative) OVER {RUN} - 1 AS rd FROM v)
    SELECT count(*) AS periods, product(1 + ret) - 1 AS cumulative, product(1 + bench) - 1 AS bench_cumulative, arg_max(relative, date) - 1 AS excess_cumulative, pow(product(1 + bench), 13.0::DOUBLE / count(*)) - 1 AS bench_annual,
     stddev_samp(bench) * sqrt(13) AS bench_volatility, min(md) AS bench_drawdown, min(rd) AS relative_drawdown, stddev_samp(ret - bench) * sqrt(13) AS tracking_error, avg(ret - bench) / stddev_samp(ret - bench) * sqrt(13) AS ir,
     covar_samp(ret, bench) / var_samp(bench) AS beta, (avg(ret) - covar_samp(ret, bench) / var_samp(bench) * avg(bench)) * 13 AS alpha, corr(ret, bench) AS corr, avg(ret - bench) AS mean_excess, avg(CASE WHEN ret > bench THEN 1 ELSE 0 END) AS win_rate FROM d""",
)
def benchmark_compare(spark, sf_dir):
    return Q.benchmark_summary(_cmp(spark, sf_dir), 13)


@query(
    "backtest_summary",
    "periods:i cumulative:f annual:f volatility:f ir:f drawdown:f mean_gross:f mean_net:f win_rate:f turnover:f cost:f positions:f",
    f"""WITH {PER}, r AS (SELECT *, gross / 10 - 0.001::DOUBLE * turnover AS ret FROM per), n AS (SELECT *, product(1 + ret) OVER {RUN} AS nav FROM r), d AS (SELECT *, nav / max(nav) OVER {RUN} - 1 AS dd FROM n)
    SELECT count(*) AS periods, arg_max(nav, date) - 1 AS cumulative, pow(arg_max(nav, date), 13.0::DOUBLE / count(*)) - 1 AS annual, stddev_samp(ret) * sqrt(13) AS volatility, avg(ret) / stddev_samp(ret) * sqrt(13) AS ir, min(dd) AS drawdown,
     avg(gross / 10) AS mean_gross, avg(ret) AS mean_net, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS win_rate, avg(turnover) AS turnover, sum(turnover) * 0.001 AS cost, avg(positions) AS positions FROM d""",
)
def backtest_summary(spark, sf_dir):
    """Four-week holdings; returns are scaled down as elsewhere, because the given prices jump."""
    return Q.backtest_summary(periods(spark, sf_dir).withColumn("gross", F.col("gross") / 10), 13, 0.001)


@query(
    "top_held",
    "instrument:s periods:i top_rank:i",
    f"WITH {POS} SELECT instrument, count(*) AS periods, row_number() OVER (ORDER BY count(*) DESC, instrument) AS top_rank FROM pos GROUP BY 1 QUALIFY top_rank <= 10",
)
def top_held(spark, sf_dir):
    """The names that were held most often: partial counts, then ten rows."""
    order = [F.col("periods").desc(), F.col("instrument")]
    most = top10(spark, sf_dir, 4).groupBy("instrument").agg(F.count(F.lit(1)).alias("periods")).orderBy(*order).limit(10)
    return most.withColumn("top_rank", F.row_number().over(Window.orderBy(*order)))


@query("strategy_compare", "metric:s leader:s best:f", f"WITH {_LS}, k AS (SELECT * FROM (WITH {risk_sql('ls', 'series')})), l AS (SELECT series, 'annual_return' AS metric, annual_return AS v FROM k UNION ALL SELECT series, 'max_drawdown', max_drawdown FROM k) SELECT metric, arg_max(series, v) AS leader, max(v) AS best FROM l GROUP BY 1")
def strategy_compare(spark, sf_dir):
    long = Q.risk_analysis(_excess(spark, sf_dir)).unpivot(["series"], ["annual_return", "max_drawdown"], "metric", "v")
    return long.groupBy("metric").agg(F.max_by("series", "v").alias("leader"), F.max("v").alias("best"))


@query("experiment_deltas", "series:s annual_delta:f drawdown_delta:f", f"WITH {_LS}, k AS (SELECT * FROM (WITH {risk_sql('ls', 'series')})) SELECT a.series, a.annual_return - b.annual_return AS annual_delta, a.max_drawdown - b.max_drawdown AS drawdown_delta FROM k a, k b WHERE b.series = 'ret' AND a.series <> 'ret'")
def experiment_deltas(spark, sf_dir):
    """Metrics against a named base; one row per experiment."""
    k = Q.risk_analysis(_excess(spark, sf_dir))
    base = k.where("series = 'ret'").select(F.col("annual_return").alias("a"), F.col("max_drawdown").alias("d"))
    return k.where("series <> 'ret'").crossJoin(F.broadcast(base)).select("series", (F.col("annual_return") - F.col("a")).alias("annual_delta"), (F.col("max_drawdown") - F.col("d")).alias("drawdown_delta"))


@query("position_diff_summary", "change:s sector:s n:i mean_score:f", f"WITH {POS}, {T.GROUPS}, b2 AS (SELECT date, ix, instrument, score FROM sig WHERE score IS NOT NULL AND ix % 4 = 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, instrument) <= 15), j AS (SELECT coalesce(p.instrument, b2.instrument) AS instrument, coalesce(p.score, b2.score) AS score, CASE WHEN p.ix IS NULL THEN 'added' WHEN b2.ix IS NULL THEN 'removed' ELSE 'kept' END AS change FROM pos p FULL JOIN b2 ON p.ix = b2.ix AND p.instrument = b2.instrument) SELECT change, sector, count(*) AS n, avg(score) AS mean_score FROM j JOIN groups USING (instrument) GROUP BY GROUPING SETS ((change), (change, sector))")
def position_diff_summary(spark, sf_dir):
    from tidepanel.operators.joins import position_diff

    s = sig(spark, sf_dir).where("score IS NOT NULL AND ix % 4 = 0")
    more = xs_top(s, ["date"], [F.col("score").desc(), F.col("instrument")], 15).withColumn("weight", F.lit(1.0))
    d = position_diff(top10(spark, sf_dir, 4), more).join(s.select("date", "instrument", "score"), ["date", "instrument"])
    d = d.join(bounded(T.groups(spark, sf_dir), T.bounds(spark, sf_dir).names), "instrument")
    return d.groupingSets([["change"], ["change", "sector"]], "change", "sector").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query("ic_topk_divergence", "date:d ic:f ret:f kind:s", f"WITH {SER}, i AS (SELECT date, CASE WHEN stddev_samp(score) > 0 AND stddev_samp(label) > 0 THEN corr(score, label) END AS ic FROM sig WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY 1 HAVING count(*) > 2) SELECT date, ic, ret - bench AS ret, CASE WHEN ic > 0 AND ret < bench THEN 'ic_good_topk_bad' WHEN ic <= 0 AND ret >= bench THEN 'ic_bad_topk_good' ELSE 'same' END AS kind FROM ser JOIN i USING (date)")
def ic_topk_divergence(spark, sf_dir):
    full = sig(spark, sf_dir).where("score IS NOT NULL AND label IS NOT NULL")
    i = full.groupBy("date").agg(E.pearson("score", "label").alias("ic"), F.count(F.lit(1)).alias("n")).where("n > 2")
    ex = F.col("ret") - F.col("bench")
    kind = F.when((F.col("ic") > 0) & (ex < 0), "ic_good_topk_bad").when((F.col("ic") <= 0) & (ex >= 0), "ic_bad_topk_good").otherwise("same")
    return series(spark, sf_dir).join(i, "date").withColumn("kind", kind).withColumn("ret", ex)


@query("regime_summary", "regime:s n:i mean:f win_rate:f", f"WITH {SER}, q AS (SELECT quantile_cont(bench, 0.3) AS lo, quantile_cont(bench, 0.7) AS hi FROM ser) SELECT CASE WHEN bench >= hi THEN 'high' WHEN bench <= lo THEN 'low' ELSE 'mid' END AS regime, count(*) AS n, avg(ret) AS mean, avg(CASE WHEN ret > bench THEN 1 ELSE 0 END) AS win_rate FROM ser, q GROUP BY 1")
def regime_summary(spark, sf_dir):
    from tidepanel.operators.factors import regime_label

    s = regime_label(series(spark, sf_dir).withColumn("f", F.lit(True)), "bench", "ret", "f")
    return s.groupBy(F.col("level").alias("regime")).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.avg((F.col("ret") > F.col("bench")).cast("double")).alias("win_rate"))


_QTR = """CASE WHEN score_rn > n * 0.8 AND label_rn > n * 0.8 THEN 'high_winner' WHEN score_rn > n * 0.8 AND label_rn <= n * 0.2 THEN 'high_loser' WHEN score_rn <= n * 0.2 AND label_rn > n * 0.8 THEN 'low_winner' WHEN score_rn <= n * 0.2 AND label_rn <= n * 0.2 THEN 'low_loser' ELSE 'other' END"""


def _review_sql(by):
    return f"""r AS (SELECT f.*, row_number() OVER (PARTITION BY date ORDER BY score, md5(instrument)) AS score_rn, row_number() OVER (PARTITION BY date ORDER BY label, md5(instrument)) AS label_rn, count(*) OVER (PARTITION BY date) AS n FROM sig f WHERE score IS NOT NULL AND label IS NOT NULL)
    SELECT {_QTR} AS kind, {by}, count(*) AS cases, avg(score) AS mean_score, avg(label) AS mean_label FROM r JOIN groups USING (instrument) GROUP BY 1, 2"""


def _review(spark, sf_dir):
    b = T.bounds(spark, sf_dir)
    d = sig(spark, sf_dir).where("score IS NOT NULL AND label IS NOT NULL")
    d = xs_order(d, ["date"], "score", "instrument", "score", b)
    d = xs_order(d, ["date"], "label", "instrument", "label", b)
    return d.withColumn("kind", F.expr(_QTR.replace("n * ", "score_n * "))).join(bounded(T.groups(spark, sf_dir), b.names), "instrument")


_CASES = lambda by: [F.count(F.lit(1)).alias("cases"), F.avg("score").alias("mean_score"), F.avg("label").alias("mean_label")]


@query("error_review", "kind:s sector:s cases:i mean_score:f mean_label:f", f"WITH {SIG}, {T.GROUPS}, {_review_sql('sector')}")
def error_review(spark, sf_dir):
    return _review(spark, sf_dir).groupBy("kind", "sector").agg(*_CASES("sector"))


@query("bucket_review", "kind:s bucket:s cases:i mean_score:f mean_label:f", f"WITH {SIG}, {T.GROUPS}, {_review_sql(_BUCKET + ' AS bucket')}")
def bucket_review(spark, sf_dir):
    k = F.col("instrument").cast("int") % 10
    d = _review(spark, sf_dir).withColumn("bucket", F.when(k < 2, "new").when(k < 5, "short").otherwise("long"))
    return d.groupBy("kind", "bucket").agg(*_CASES("bucket"))


@query("hhi", "hhi:f", f"WITH {POS}, {T.GROUPS}, s AS (SELECT date, sector, sum(weight) AS w FROM pos JOIN groups USING (instrument) GROUP BY 1, 2), d AS (SELECT date, sum(w * w) AS h FROM s GROUP BY 1) SELECT avg(h) AS hhi FROM d")
def hhi(spark, sf_dir):
    s = top10(spark, sf_dir, 4).join(bounded(T.groups(spark, sf_dir), T.bounds(spark, sf_dir).names), "instrument").groupBy("date", "sector").agg(F.sum("weight").alias("w"))
    return s.groupBy("date").agg(F.sum(F.col("w") * F.col("w")).alias("h")).agg(F.avg("h").alias("hhi"))


# ---- covariance ----
_COV = f"{SIG}, x AS (SELECT date, instrument, label / 10 AS x FROM sig WHERE label IS NOT NULL), cov AS (SELECT a.instrument AS i, b.instrument AS j, covar_samp(a.x, b.x) AS cov FROM x a JOIN x b USING (date) GROUP BY 1, 2), sd AS (SELECT i AS k, sqrt(cov) AS s FROM cov WHERE i = j), cr AS (SELECT i, j, cov, a.s AS si, b.s AS sj, cov / (a.s * b.s) AS r FROM cov JOIN sd a ON a.k = i JOIN sd b ON b.k = j)"


def _returns(spark, sf_dir):
    return sig(spark, sf_dir).withColumn("ret", F.col("label") / 10)


def _cov(spark, sf_dir, variances=False):
    return Q.covariance(_returns(spark, sf_dir), T.bounds(spark, sf_dir).names, block=32, variances=variances)


@query("covariance", "i:s j:s cov:f", f"WITH {_COV} SELECT i, j, cov FROM cov")
def covariance(spark, sf_dir):
    return _cov(spark, sf_dir)


@query("shrink_cov", "i:s j:s cov:f", f"WITH {_COV} SELECT i, j, 0.7::DOUBLE * cov + 0.3::DOUBLE * CASE WHEN i = j THEN cov ELSE (SELECT avg(r) FROM cr WHERE i <> j) * si * sj END AS cov FROM cr")
def shrink_cov(spark, sf_dir):
    level = Q.mean_correlation(_returns(spark, sf_dir), T.bounds(spark, sf_dir).names, block=32)
    return Q.shrink(_cov(spark, sf_dir, True), 0.3, "const_corr", level)


@query("shrink_cov_var", "i:s j:s cov:f", f"WITH {_COV} SELECT i, j, 0.7::DOUBLE * cov + 0.3::DOUBLE * CASE WHEN i = j THEN (SELECT avg(cov) FROM cov WHERE i = j) ELSE 0 END AS cov FROM cov")
def shrink_cov_var(spark, sf_dir):
    return Q.shrink(_cov(spark, sf_dir), 0.3, "const_var", Q.mean_variance(_returns(spark, sf_dir)))


_SHRINK = f"""{SIG}, xr AS (SELECT date, instrument, label / 10 AS r FROM sig WHERE label IS NOT NULL), x AS (SELECT date, instrument, r - avg(r) OVER (PARTITION BY instrument) AS x FROM xr),
 z AS (SELECT (SELECT count(DISTINCT date) FROM sig)::DOUBLE AS t, count(DISTINCT instrument)::DOUBLE AS p FROM x), one AS (SELECT instrument, sum(x * x) / any_value(t) AS v FROM x, z GROUP BY 1),
 prod AS (SELECT a.instrument AS i, b.instrument AS j, sum(a.x * b.x) AS s FROM x a JOIN x b USING (date) GROUP BY 1, 2),
 g AS (SELECT a.instrument AS i, b.instrument AS j, coalesce(s, 0) / t AS s FROM one a CROSS JOIN one b CROSS JOIN z LEFT JOIN prod ON prod.i = a.instrument AND prod.j = b.instrument),
 q AS (SELECT sum(s * s) AS s2, sum(s) FILTER (WHERE i = j) AS tr, sum(s * s) FILTER (WHERE i = j) AS v2 FROM g)"""
_VARIANCE = f"""{_SHRINK}, f AS (SELECT i, j, s, CASE WHEN i = j THEN tr / p ELSE 0 END AS f FROM g, q, z)"""
_FACTOR = f"""{_SHRINK}, mk AS (SELECT date, sum(x) / any_value(p) AS m FROM x, z GROUP BY 1), vm AS (SELECT sum(m * m) / any_value(t) AS vm FROM mk, z), c AS (SELECT instrument, sum(x * m) / any_value(t) AS c FROM x JOIN mk USING (date), z GROUP BY 1),
 f AS (SELECT i, j, s, CASE WHEN i = j THEN s ELSE a.c * b.c / vm END AS f FROM g JOIN c a ON a.instrument = i JOIN c b ON b.instrument = j, vm),
 dy AS (SELECT date, any_value(m) AS m, sum(x * x) AS y2, sum(x ** 4) AS y4, sum(x * c) AS yc, sum(x ** 3 * c) AS y3c, sum(x * x * c * c) AS y2c2 FROM x JOIN mk USING (date) JOIN c USING (instrument) GROUP BY 1),
 w AS (SELECT sum(y2 * y2) / any_value(t) AS phi, sum(y4) / any_value(t) AS diag, sum(m * (y2 * yc - y3c)) / any_value(t) AS first, sum(m * m * (yc * yc - y2c2)) / any_value(t) AS third FROM dy, z),
 k AS (SELECT sum(a.c * b.c * s) - sum(CASE WHEN i = j THEN a.c * a.c * s ELSE 0 END) AS common FROM g JOIN c a ON a.instrument = i JOIN c b ON b.instrument = j),
 al AS (SELECT greatest(0, least(1, (phi - s2 - (diag - v2 + 2 * (first - common) / vm - (third - vm * common) / vm ** 2)) / (SELECT sum((s - f) ** 2) FROM f) / t)) AS alpha FROM w, q, k, vm, z)"""


def _shrunk(spark, sf_dir, target, alpha):
    return Q.shrink_returns(_returns(spark, sf_dir), T.bounds(spark, sf_dir).names, target, alpha, block=32)


@query(
    "shrink_cov_lw",
    "i:s j:s cov:f alpha:f",
    f"""WITH {_VARIANCE}, al AS (SELECT greatest(0, least(1, ((SELECT sum(y2 * y2) FROM (SELECT sum(x * x) AS y2 FROM x GROUP BY date)) / t - s2) / (SELECT sum((s - f) ** 2) FROM f) / t)) AS alpha FROM q, z)
    SELECT i, j, (1 - alpha) * s + alpha * f AS cov, alpha FROM f, al""",
)
def shrink_cov_lw(spark, sf_dir):
    """Constant-variance target, intensity from the returns."""
    return _shrunk(spark, sf_dir, "const_var", "lw")


@query(
    "shrink_cov_oas",
    "i:s j:s cov:f alpha:f",
    f"WITH {_VARIANCE}, al AS (SELECT (1 - 2 / p) * (s2 + tr * tr) / ((t + 1 - 2 / p) * (s2 + tr * tr / p)) AS alpha FROM q, z) SELECT i, j, (1 - alpha) * s + alpha * f AS cov, alpha FROM f, al",
)
def shrink_cov_oas(spark, sf_dir):
    return _shrunk(spark, sf_dir, "const_var", "oas")


@query("shrink_cov_factor", "i:s j:s cov:f alpha:f", f"WITH {_FACTOR} SELECT i, j, (1 - alpha) * s + alpha * f AS cov, alpha FROM f, al")
def shrink_cov_factor(spark, sf_dir):
    """Single-factor target: the mean of all names is the factor."""
    return _shrunk(spark, sf_dir, "single_factor", "lw")


@query("threshold_cov", "i:s j:s cov:f", f"WITH {_COV} SELECT i, j, CASE WHEN i = j THEN cov ELSE sign(r) * greatest(abs(r) - 0.05::DOUBLE, 0) * si * sj END AS cov FROM cr")
def threshold_cov(spark, sf_dir):
    return Q.threshold(_cov(spark, sf_dir, True), 0.05, "soft")


@query("pca_cov", "i:s j:s cov:f")
def pca_cov(spark, sf_dir):
    return Q.pca_covariance(_returns(spark, sf_dir), bounds=T.bounds(spark, sf_dir))
