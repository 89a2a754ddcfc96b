"""Leaves, element-wise and pair-wise functions (table-driven: expression text next to its SQL)."""

from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query

R = "close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime)"
_DIFF = "(close - open)"

# name: (expression text, output kind, SQL over panel)
SIMPLE = {
    "feature": ("$close", "f", "close"),
    "abs": ("Abs($close-$open)", "f", f"abs{_DIFF}"),
    "sign": ("Sign($close-$open)", "f", f"CAST(sign{_DIFF} AS DOUBLE)"),
    "log": ("Log($volume-1)", "f", "CASE WHEN volume - 1 > 0 THEN ln(volume - 1) WHEN volume - 1 = 0 THEN -'inf'::DOUBLE END"),
    "not": ("Not($close>$open)", "b", "NOT coalesce(close > open, false)"),
    "power": ("Power($volume,0.5)", "f", "pow(volume, 0.5)"),
    "add": ("$high+$low", "f", "high + low"),
    "sub": ("$high-$low", "f", "high - low"),
    "mul": ("$high*0.5", "f", "high * 0.5::DOUBLE"),
    "div": (
        "($close-$open)/($high-$low)",
        "f",
        f"CASE WHEN high - low <> 0 THEN {_DIFF} / (high - low) WHEN {_DIFF} > 0 THEN 'inf'::DOUBLE WHEN {_DIFF} < 0 THEN -'inf'::DOUBLE END",
    ),
    "greater": ("Greater($open,$close)", "f", "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN greatest(open, close) END"),
    "less": ("Less($open,$close)", "f", "CASE WHEN open IS NOT NULL AND close IS NOT NULL THEN least(open, close) END"),
    "gt": ("$close>$open", "b", "coalesce(close > open, false)"),
    "ge": ("$close>=$open", "b", "coalesce(close >= open, false)"),
    "lt": ("$close<$open", "b", "coalesce(close < open, false)"),
    "le": ("$close<=$open", "b", "coalesce(close <= open, false)"),
    "eq": ("$close==$open", "b", "coalesce(close = open, false)"),
    "ne": ("$close!=$open", "b", "coalesce(close <> open, true)"),
    "and": ("($close>$open)&($volume>30)", "b", "coalesce(close > open, false) AND coalesce(volume > 30, false)"),
    "or": ("($close>$open)|($volume>30)", "b", "coalesce(close > open, false) OR coalesce(volume > 30, false)"),
    "if": ("If($close>$open,$high,0-$low)", "f", "CASE WHEN coalesce(close > open, false) THEN high ELSE 0 - low END"),
    "is_null": ("IsNull($close)", "b", "close IS NULL"),
    "is_inf": (
        "IsInf(($close-$open)/($high-$low))",
        "b",
        f"high IS NOT NULL AND high - low = 0 AND {_DIFF} <> 0",
    ),
}


def _simple(name, text, kind, sql):
    @query(
        name,
        f"instrument:s datetime:d value:{kind}",
        f"WITH {T.PANEL} SELECT instrument, datetime, {sql} AS value FROM panel",
    )
    def run(spark, sf_dir):
        return X.features(T.panel(spark, sf_dir), {"value": text})


for _n, _v in SIMPLE.items():
    _simple(_n, *_v)


@query(
    "select_if",
    "instrument:s datetime:d value:f",
    f"WITH {T.PANEL} SELECT instrument, datetime, CASE WHEN coalesce(close > open, false) THEN volume END AS value FROM panel",
)
def select_if(spark, sf_dir):
    return X.features(T.panel(spark, sf_dir), {"value": "Select($close>$open,$volume)"})


@query(
    "cut_edges",
    "instrument:s datetime:d close:f",
    f"""WITH {T.PANEL} SELECT instrument, datetime, close FROM panel
    QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY datetime) > 3
    AND row_number() OVER (PARTITION BY instrument ORDER BY datetime DESC) > 2""",
)
def cut_edges(spark, sf_dir):
    """Drop the first 3 and last 2 rows per instrument; the panel is dense, so spans give the positions."""
    df = T.panel(spark, sf_dir)
    spans = df.groupBy("instrument").agg(F.min("cal_ix").alias("lo"), F.max("cal_ix").alias("hi"))
    b = T.bounds(spark, sf_dir)
    return df.join(T.bounded(spans, b.names), "instrument").where("cal_ix >= lo + 3 AND cal_ix <= hi - 2")


@query(
    "date_of",
    "event_id:i trade_date:d",
    "SELECT event_id, CAST(ts AS DATE) AS trade_date FROM events",
)
def date_of(spark, sf_dir):
    return T.ticks(spark, sf_dir).select("event_id", F.to_date("ts").alias("trade_date"))


_OTHER = """, pivot_close AS (SELECT datetime, close / lag(close) OVER (ORDER BY datetime) AS m FROM panel WHERE instrument = '0')"""


@query(
    "change_instrument",
    "instrument:s datetime:d market:f excess:f",
    f"""WITH {T.PANEL}{_OTHER} SELECT p.instrument, p.datetime, m AS market, {R.replace('close', 'p.close').replace('instrument', 'p.instrument').replace('datetime', 'p.datetime')} - m AS excess
    FROM panel p LEFT JOIN pivot_close USING (datetime)""",
)
def change_instrument(spark, sf_dir):
    market = "ChangeInstrument('0',$close/Ref($close,1))"
    exprs = {"market": market, "excess": f"$close/Ref($close,1)-{market}"}
    return X.features(T.panel(spark, sf_dir), exprs, calendar_rows=T.bounds(spark, sf_dir).dates)


@query(
    "mask",
    "instrument:s datetime:d other_mean:f",
    f"""WITH {T.PANEL}, one AS (SELECT datetime, close FROM panel WHERE instrument = '1'), all_rows AS (
     SELECT p.instrument, p.datetime, one.close FROM panel p LEFT JOIN one USING (datetime))
    SELECT instrument, datetime, avg(close) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS other_mean FROM all_rows""",
)
def mask(spark, sf_dir):
    return X.features(
        T.panel(spark, sf_dir), {"other_mean": "Mean(Mask($close,'1'),5)"}, calendar_rows=T.bounds(spark, sf_dir).dates
    )


@query("custom_op", "instrument:s datetime:d value:f", f"WITH {T.PANEL} SELECT instrument, datetime, abs(close - open) / (high + low) AS value FROM panel")
def custom_op(spark, sf_dir):
    """A user operator registered by name and used inside an expression."""
    if "BodyShare" not in X.FUNCTIONS:
        X.register("BodyShare", lambda o, c, h, l: X.Abs(X.term(c) - o) / (X.term(h) + l))
    return X.features(T.panel(spark, sf_dir), {"value": "BodyShare($open,$close,$high,$low)"})
