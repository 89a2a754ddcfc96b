"""Instruments, spans, filters, universe selection."""

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import universe as U
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query
from tidepanel.sources import panel as P

A, B = dt.date(1997, 1, 1), dt.date(1998, 12, 31)
_A, _B = "DATE '1997-01-01'", "DATE '1998-12-31'"
RANGE = f"datetime BETWEEN {_A} AND {_B}"
M = f"{T.BARS}, {T.MEMBERSHIP}"
PM = f"{T.PANEL}, {T.MEMBERSHIP.replace(T.SPANS + ', ', '')}"


@query("list_instruments", "market:s instrument:s start:d end:d", f'WITH {M}, c AS (SELECT market, instrument, greatest("start", {_A}) AS "start", least("end", {_B}) AS "end" FROM membership) SELECT * FROM c WHERE "start" <= "end"')
def list_instruments(spark, sf_dir):
    return U.clip_spans(T.membership(spark, sf_dir), A, B)


def _half(spark, sf_dir):
    """Member spans cut to the first half: start until the middle of the span."""
    return T.membership(spark, sf_dir).where("market = 'part'").select(
        "instrument", "start", F.expr("date_add(start, cast(datediff(`end`, start) / 2 as int))").alias("end")
    )


_HALF = """half AS (SELECT instrument, "start", "start" + CAST(trunc(("end" - "start") / 2) AS INTEGER) AS "end" FROM membership WHERE market = 'part')"""


@query("membership_mask", "instrument:s datetime:d close:f", f'WITH {PM}, {_HALF} SELECT instrument, datetime, close FROM panel p WHERE EXISTS (SELECT 1 FROM half h WHERE h.instrument = p.instrument AND p.datetime BETWEEN h."start" AND h."end")')
def membership_mask(spark, sf_dir):
    return U.membership_mask(T.panel(spark, sf_dir), _half(spark, sf_dir))


@query("name_filter", "instrument:s start:d end:d", f"WITH {T.BARS}, {T.SPANS} SELECT * FROM spans WHERE regexp_matches(instrument, '^(?:1[0-5]|7)')")
def name_filter(spark, sf_dir):
    return U.name_filter(P.build_instruments(T.bars(spark, sf_dir)), "1[0-5]|7")


@query("expression_filter", "instrument:s datetime:d close:f", f"WITH {T.PANEL} SELECT instrument, datetime, close FROM panel WHERE NOT ({RANGE}) OR coalesce(close > open, true)")
def expression_filter(spark, sf_dir):
    df = T.panel(spark, sf_dir).withColumn("flag", F.col("close") > F.col("open"))
    return U.expression_filter(df, "flag", A, B, True)


_RUNS = """on_rows AS (SELECT instrument, datetime, coalesce(close > open, false) AS f FROM panel),
 marks AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER p, false) THEN 1 ELSE 0 END AS b FROM on_rows WINDOW p AS (PARTITION BY instrument ORDER BY datetime)),
 runs AS (SELECT *, sum(b) OVER (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM marks)"""


@query("flags_to_intervals", "instrument:s start:d end:d", f'WITH {T.PANEL}, {_RUNS} SELECT instrument, min(datetime) AS "start", max(datetime) AS "end" FROM runs WHERE f GROUP BY instrument, r')
def flags_to_intervals(spark, sf_dir):
    return U.flags_to_spans(X.features(T.panel(spark, sf_dir), {"flag": "$close>$open"}))


@query(
    "intervals_to_flags",
    "instrument:s datetime:d flag:b",
    f"""WITH {T.PANEL} SELECT s.instrument, c.datetime, c.datetime BETWEEN s."start" AND s."end" AS flag FROM spans s CROSS JOIN calendar c""",
)
def intervals_to_flags(spark, sf_dir):
    return U.spans_to_flags(P.build_instruments(T.bars(spark, sf_dir)), T.calendar(spark, sf_dir), T.bounds(spark, sf_dir).dates)


@query(
    "filter_pipe",
    "instrument:s datetime:d close:f",
    f"WITH {PM} SELECT instrument, datetime, close FROM panel WHERE regexp_matches(instrument, '^[1-6]') AND coalesce(volume > 20, false) AND instrument IN (SELECT instrument FROM membership WHERE market = 'part')",
)
def filter_pipe(spark, sf_dir):
    members = T.membership(spark, sf_dir).where("market = 'part'")
    return U.filter_pipe(
        T.panel(spark, sf_dir),
        [lambda d: U.name_filter(d, "[1-6]"), lambda d: d.where("volume > 20"), lambda d: U.membership_mask(d, members)],
    )


@query("cover_range_filter", "instrument:s datetime:d close:f", f"WITH {T.BARS}, {T.SPANS} SELECT instrument, datetime, close FROM bars WHERE instrument IN (SELECT instrument FROM spans WHERE \"start\" <= DATE '1995-01-09' AND \"end\" >= DATE '2001-10-15')")
def cover_range_filter(spark, sf_dir):
    return U.cover_range(T.bars(spark, sf_dir), dt.date(1995, 1, 9), dt.date(2001, 10, 15))


@query("select_slice", "instrument:s datetime:d close:f", f"WITH {T.BARS} SELECT instrument, datetime, close FROM bars WHERE {RANGE} AND instrument IN ('1','2','3','10') AND (instrument, datetime) IN (SELECT instrument, datetime FROM bars WHERE volume > 40)")
def select_slice(spark, sf_dir):
    df = T.bars(spark, sf_dir)
    return U.select_slice(df, A, B, ["1", "2", "3", "10"], df.where("volume > 40").select("instrument", "datetime"))


@query("select_colset", "instrument:s datetime:d score:f f_vol:f", f"WITH {T.PRED} SELECT instrument, datetime, score, f_vol FROM pred")
def select_colset(spark, sf_dir):
    p = T.pred(spark, sf_dir)
    wide = p.select("instrument", "datetime", *[F.col(c).alias(f"feature.{c}") for c in ("score", "f_vol")], F.col("label").alias("label.ret"))
    return U.select_colset(wide, "feature")


@query(
    "range_selector",
    "slice_end:d rows:i total:f",
    f"""WITH {T.PANEL} SELECT c.datetime AS slice_end, count(*) AS rows, sum(p.volume) AS total FROM calendar c JOIN panel p ON p.cal_ix BETWEEN c.cal_ix - 4 AND c.cal_ix GROUP BY 1""",
)
def range_selector(spark, sf_dir):
    s = U.trailing_slices(T.panel(spark, sf_dir), T.calendar(spark, sf_dir), 5, T.bounds(spark, sf_dir).dates)
    return s.groupBy("slice_end").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("total"))


@query("range_selector_last", "datetime:d cal_ix:i", f"WITH {T.CALENDAR}, u AS (SELECT * FROM calendar WHERE datetime <= {_B}) SELECT * FROM u WHERE cal_ix > (SELECT max(cal_ix) FROM u) - 10")
def range_selector_last(spark, sf_dir):
    return U.last_dates(T.calendar(spark, sf_dir), B, 10)


def segment_table(spark):
    return spark.createDataFrame(
        [("train", dt.date(1995, 1, 1), dt.date(1998, 12, 31)), ("valid", dt.date(1999, 1, 1), dt.date(1999, 12, 31)), ("test", dt.date(2000, 1, 1), dt.date(2001, 12, 31))],
        "segment string, start date, end date",
    )


SEGMENT = "CASE WHEN datetime <= DATE '1998-12-31' THEN 'train' WHEN datetime <= DATE '1999-12-31' THEN 'valid' WHEN datetime <= DATE '2001-12-31' THEN 'test' END"


@query("segments", "segment:s first:d last:d rows:i", f"WITH {T.BARS} SELECT {SEGMENT} AS segment, min(datetime) AS first, max(datetime) AS last, count(*) AS rows FROM bars WHERE datetime >= DATE '1995-01-01' AND datetime <= DATE '2001-12-31' GROUP BY 1")
def segments(spark, sf_dir):
    t = U.tag_segments(T.bars(spark, sf_dir), segment_table(spark))
    return t.groupBy("segment").agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.count(F.lit(1)).alias("rows"))


# changes: the first order of a customer adds it, its last one with status F removes it
_CHANGES = """changes AS (SELECT CAST(o_custkey AS VARCHAR) AS instrument, CAST(min(o_orderdate) AS DATE) AS date, 'add' AS kind FROM orders WHERE o_orderstatus = 'O' GROUP BY 1
 UNION ALL SELECT CAST(o_custkey AS VARCHAR), CAST(max(o_orderdate) AS DATE), 'remove' FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


@query(
    "constituents_from_changes",
    "instrument:s start:d end:d",
    f"""WITH {_CHANGES}, e AS (SELECT *, lead(date) OVER w AS nd, lead(kind) OVER w AS nk, lag(kind) OVER w AS pk FROM changes WINDOW w AS (PARTITION BY instrument ORDER BY date, kind))
    SELECT instrument, date AS "start", coalesce(nd, DATE '2002-01-01') AS "end" FROM e WHERE kind = 'add'
    UNION ALL SELECT instrument, DATE '1995-01-01', date FROM e WHERE kind = 'remove' AND (pk IS NULL OR pk = 'remove')
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), DATE '1995-01-01', DATE '2002-01-01' FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT instrument FROM changes)""",
)
def constituents_from_changes(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("instrument"), F.to_date("o_orderdate").alias("date"), "o_orderstatus")
    adds = o.where("o_orderstatus = 'O'").groupBy("instrument").agg(F.min("date").alias("date")).withColumn("kind", F.lit("add"))
    gone = o.where("o_orderstatus = 'F'").groupBy("instrument").agg(F.max("date").alias("date")).withColumn("kind", F.lit("remove"))
    now = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("instrument"))
    return U.spans_from_changes(adds.unionByName(gone), now, dt.date(1995, 1, 1), dt.date(2002, 1, 1))


@query(
    "constituent_diff",
    "instrument:s datetime:d kind:s",
    f"""WITH {T.PANEL}, m AS (SELECT instrument, cal_ix FROM panel WHERE volume > 50), t AS (SELECT min(cal_ix) AS lo, max(cal_ix) AS hi FROM m)
    SELECT a.instrument, c.datetime, 'add' AS kind FROM m a JOIN calendar c USING (cal_ix), t WHERE a.cal_ix > lo AND NOT EXISTS (SELECT 1 FROM m b WHERE b.instrument = a.instrument AND b.cal_ix = a.cal_ix - 1)
    UNION ALL SELECT a.instrument, c.datetime, 'remove' FROM m a JOIN calendar c ON c.cal_ix = a.cal_ix + 1, t WHERE a.cal_ix < hi AND NOT EXISTS (SELECT 1 FROM m b WHERE b.instrument = a.instrument AND b.cal_ix = a.cal_ix + 1)""",
)
def constituent_diff(spark, sf_dir):
    m = T.panel(spark, sf_dir).where("volume > 50")
    return U.snapshot_diff(m, T.calendar(spark, sf_dir), T.bounds(spark, sf_dir).dates)


@query(
    "monthly_topn_universe",
    "month:d instrument:s top_rank:i effective_start:d effective_end:d",
    f"""WITH {T.PANEL}, e AS (SELECT CAST(date_trunc('month', datetime) AS DATE) AS month, max(cal_ix) AS cal_ix FROM calendar GROUP BY 1),
    pl AS (SELECT e.*, c.datetime AS effective_start, CAST(lead(c.datetime) OVER (ORDER BY e.cal_ix) AS DATE) - 1 AS effective_end FROM e LEFT JOIN calendar c ON c.cal_ix = e.cal_ix + 1)
    SELECT month, instrument, row_number() OVER (PARTITION BY month ORDER BY close * volume DESC, instrument) AS top_rank, effective_start, effective_end FROM panel JOIN pl USING (cal_ix) WHERE close IS NOT NULL QUALIFY top_rank <= 10""",
)
def monthly_topn_universe(spark, sf_dir):
    df = T.panel(spark, sf_dir).withColumn("cap", F.col("close") * F.col("volume"))
    return U.monthly_topn(df, T.calendar(spark, sf_dir), 10, calendar_rows=T.bounds(spark, sf_dir).dates)


@query(
    "equity_filter",
    "p_partkey:i name:s type:s",
    r"SELECT p_partkey, p_name AS name, p_type AS type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'SMALL') AND p_brand IN ('Brand#2', 'Brand#3', 'Brand#17') AND NOT regexp_matches(p_name, '(?i)\b(ring|bolt)s?\b')",
)
def equity_filter(spark, sf_dir):
    df = T.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("exchange"))
    return U.equity_filter(df, ("ECONOMY", "STANDARD", "SMALL"), ("Brand#2", "Brand#3", "Brand#17"), excluded=r"(?i)\b(ring|bolt)s?\b")


@query(
    "latest_member_universe",
    "instrument:s close:f volume:f first_member:d last_member:d months:i",
    f"WITH {T.BARS} SELECT instrument, arg_max_null(close, datetime) AS close, arg_max_null(volume, datetime) AS volume, min(datetime) AS first_member, max(datetime) AS last_member, count(DISTINCT date_trunc('month', datetime)) AS months FROM bars GROUP BY 1",
)
def latest_member_universe(spark, sf_dir):
    return U.latest_members(T.bars(spark, sf_dir).select("instrument", "datetime", "close", "volume"))


@query(
    "asof_universe",
    "instrument:s asof_cap:f top_rank:i",
    f"""WITH {T.BARS}, px AS (SELECT instrument, arg_max(close, datetime) AS latest, arg_max(close, datetime) FILTER (WHERE datetime <= {_B}) AS asof_close FROM bars GROUP BY 1),
    j AS (SELECT CAST(s_suppkey AS VARCHAR) AS instrument, s_acctbal * asof_close / latest AS asof_cap FROM supplier JOIN px ON px.instrument = CAST(s_suppkey AS VARCHAR) WHERE asof_close IS NOT NULL)
    SELECT *, row_number() OVER (ORDER BY asof_cap DESC, instrument) AS top_rank FROM j QUALIFY top_rank <= 20""",
)
def asof_universe(spark, sf_dir):
    caps = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("instrument"), F.col("s_acctbal").alias("cap"))
    return U.asof_universe(caps, T.bars(spark, sf_dir), B, 20)[0]


@query(
    "asof_universe_reasons",
    "instrument:s asof_cap:f reason:s",
    f"""WITH {T.BARS}, px AS (SELECT instrument, arg_max(close, datetime) AS latest, arg_max(close, datetime) FILTER (WHERE datetime <= DATE '1992-02-01') AS asof_close FROM bars WHERE close IS NOT NULL GROUP BY 1),
    c AS (SELECT CAST(s_suppkey AS VARCHAR) AS instrument, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS cap FROM supplier UNION ALL SELECT 'c' || c_custkey, c_acctbal FROM customer)
    SELECT instrument, cap * asof_close / latest AS asof_cap, CASE WHEN cap IS NULL THEN 'no_cap' WHEN latest IS NULL THEN 'no_price' WHEN asof_close IS NULL THEN 'no_price_asof' END AS reason FROM c LEFT JOIN px USING (instrument)""",
)
def asof_universe_reasons(spark, sf_dir):
    """Why each name is out of the universe, or null: no size, no price at all (customers have none), or none by an early date."""
    s, c = T.table(spark, sf_dir, "supplier"), T.table(spark, sf_dir, "customer")
    caps = s.select(F.col("s_suppkey").cast("string").alias("instrument"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("cap"))
    caps = caps.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("instrument"), F.col("c_acctbal").alias("cap")))
    return U.asof_universe(caps, T.bars(spark, sf_dir), dt.date(1992, 2, 1), 20)[1]


_KIND = r"CASE WHEN regexp_matches(p_name, '(?i)\brings?\b') THEN 'ring' WHEN regexp_matches(p_name, '(?i)\b(red|blue)\b') THEN 'colour' ELSE 'common' END"


@query("security_classify", "p_partkey:i kind:s reason:s", f"SELECT p_partkey, {_KIND} AS kind, CASE WHEN {_KIND} = 'ring' THEN 'excluded_kind' WHEN p_size < 5 THEN 'too_small' END AS reason FROM part")
def security_classify(spark, sf_dir):
    df = T.table(spark, sf_dir, "part")
    kind = U.classify(F.col("p_name"), (("ring", r"(?i)\brings?\b"), ("colour", r"(?i)\b(red|blue)\b")))
    return df.select("p_partkey", kind.alias("kind"), "p_size").withColumn("reason", F.when(F.col("kind") == "ring", "excluded_kind").when(F.col("p_size") < 5, "too_small"))


@query(
    "liquidity_profile",
    "instrument:s mean20:f2 mean60:f2 median20:f2 median60:f2 zero_share:f last_close:f",
    f"""WITH {T.PANEL}, l AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY datetime DESC) AS rn FROM panel QUALIFY rn <= 60)
    SELECT instrument, avg(close * volume) FILTER (WHERE rn <= 20) AS mean20, avg(close * volume) AS mean60, quantile_cont(close * volume, 0.5) FILTER (WHERE rn <= 20) AS median20, quantile_cont(close * volume, 0.5) AS median60,
    avg(CASE WHEN coalesce(volume, 0) <= 0 THEN 1 ELSE 0 END) AS zero_share, arg_max(close, datetime) FILTER (WHERE close IS NOT NULL) AS last_close FROM l GROUP BY 1 HAVING mean20 >= 1000 AND zero_share <= 0.9""",
)
def liquidity_profile(spark, sf_dir):
    return U.liquidity_profile(T.panel(spark, sf_dir), 1000.0, 0.9)


@query("history_bucket", "instrument:s rows:i first:d last:d bucket:s", f"WITH {T.BARS} SELECT instrument, count(*) AS rows, min(datetime) AS first, max(datetime) AS last, CASE WHEN count(*) <= 280 THEN 'new' WHEN count(*) <= 290 THEN 'short' WHEN count(*) <= 300 THEN 'medium' ELSE 'long' END AS bucket FROM bars GROUP BY 1")
def history_bucket(spark, sf_dir):
    return U.history_bucket(T.bars(spark, sf_dir), ((280, "new"), (290, "short"), (300, "medium")))
