"""Point-in-time operators, filings and fundamentals."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.operators import pit as B
from tidepanel.operators import universe as U
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query

KEY = "instrument:s datetime:d "
_Q = f"{T.PIT}, pq AS (SELECT instrument, date, period // 100 * 4 + period % 100 - 1 AS q, period, value, seq FROM pit)"
_DAYS = f"{T.CALENDAR}, grid AS (SELECT DISTINCT instrument, c.datetime FROM pit CROSS JOIN calendar c)"


def _grid(spark, sf_dir):
    """25 nations x the weekly calendar."""
    names = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("instrument"))
    return names.crossJoin(T.calendar(spark, sf_dir).select("datetime"))


_GRID = f"{T.CALENDAR}, grid AS (SELECT CAST(n_nationkey AS VARCHAR) AS instrument, c.datetime FROM nation CROSS JOIN calendar c)"


@query("pfeature", KEY + "value:f2", f"WITH {_Q}, {_GRID}, v AS (SELECT instrument, datetime, arg_max(value, row(q, date, seq)) AS value FROM (SELECT g.*, q, date, seq, value FROM grid g JOIN pq USING (instrument) WHERE date <= datetime) GROUP BY 1, 2) SELECT g.instrument, g.datetime, v.value FROM grid g LEFT JOIN v USING (instrument, datetime)")
def pfeature(spark, sf_dir):
    """A period column on its own: the newest visible period."""
    return B.on_calendar(B.collapse(T.pit(spark, sf_dir), 1, lambda a: F.element_at(a, -1)), _grid(spark, sf_dir))


@query(
    "pit_collapse",
    KEY + "value:f2",
    f"""WITH {_Q}, {_GRID}, k AS (SELECT g.instrument, g.datetime, q, arg_max(value, row(date, seq)) AS v FROM grid g JOIN pq USING (instrument) WHERE date <= datetime GROUP BY 1, 2, 3),
    t AS (SELECT *, max(q) OVER (PARTITION BY instrument, datetime) AS top FROM k), m AS (SELECT instrument, datetime, avg(v) AS value FROM t WHERE q > top - 4 GROUP BY 1, 2)
    SELECT g.instrument, g.datetime, m.value FROM grid g LEFT JOIN m USING (instrument, datetime)""",
)
def pit_collapse(spark, sf_dir):
    """P(Mean(field, 4)): mean of the last four periods as known on each date."""
    total = lambda a: F.aggregate(F.filter(a, lambda v: v.isNotNull()), F.lit(0.0), lambda x, v: x + v)
    mean = lambda a: total(a) / F.when(F.size(F.filter(a, lambda v: v.isNotNull())) > 0, F.size(F.filter(a, lambda v: v.isNotNull())))
    return B.on_calendar(B.collapse(T.pit(spark, sf_dir), 4, mean), _grid(spark, sf_dir))


@query(
    "pit_fixed_period",
    KEY + "value:f2",
    f"""WITH {T.PIT}, {_GRID}, v AS (SELECT g.instrument, g.datetime, arg_max(value, row(date, seq)) AS value FROM grid g JOIN pit p USING (instrument) WHERE period = 199702 AND date <= datetime GROUP BY 1, 2) SELECT g.instrument, g.datetime, v.value FROM grid g LEFT JOIN v USING (instrument, datetime)""",
)
def pit_fixed_period(spark, sf_dir):
    return B.on_calendar(B.fixed_period(T.pit(spark, sf_dir), 199702), _grid(spark, sf_dir))


@query("pit_periods", "instrument:s field:s period:i", f"WITH {_Q} SELECT instrument, 'total_q' AS field, q // 4 * 100 + q % 4 + 1 AS period FROM (SELECT instrument, unnest(generate_series(min(q), max(q))) AS q FROM pq GROUP BY 1)")
def pit_periods(spark, sf_dir):
    return B.dense_periods(T.pit(spark, sf_dir))


@query("pit_revision_pick", "instrument:s period:i date:d seq:i value:f2", f"WITH {T.PIT} SELECT instrument, period, date, seq, value FROM pit WHERE date <= DATE '1999-06-30' QUALIFY row_number() OVER (PARTITION BY instrument, field, period ORDER BY date DESC, seq DESC) = 1")
def pit_revision_pick(spark, sf_dir):
    return B.revision_pick(T.pit(spark, sf_dir), dt.date(1999, 6, 30))


_OBS = f"{T.PIT}, obs AS (SELECT instrument AS series, date AS visible, CAST(o_orderdate AS DATE) AS obs_date, value, seq FROM pit JOIN orders ON o_orderkey = seq)"


def _obs(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("obs_date"))
    return T.pit(spark, sf_dir).join(o, "seq").select(F.col("instrument").alias("series"), F.col("date").alias("visible"), "obs_date", "value", "seq")


_MACRO = f"""{_OBS}, {_GRID}, b AS (SELECT g.instrument, g.datetime, obs_date, visible, value, seq FROM grid g JOIN obs ON series = instrument AND visible <= datetime QUALIFY row_number() OVER (PARTITION BY g.instrument, g.datetime ORDER BY obs_date DESC, visible DESC, seq DESC) = 1),
 macro AS (SELECT g.instrument, g.datetime, b.value, g.datetime - obs_date AS obs_age, g.datetime - visible AS revision_age FROM grid g LEFT JOIN b USING (instrument, datetime))"""


@query("macro_asof", KEY + "value:f2 obs_age:i revision_age:i", f"WITH {_MACRO} SELECT * FROM macro")
def macro_asof(spark, sf_dir):
    return B.macro_asof(_obs(spark, sf_dir), _grid(spark, sf_dir))


@query(
    "macro_transforms",
    KEY + "level:f change:f pct_change:f yoy:f zscore:f",
    f"""WITH {_MACRO}, l AS (SELECT *, CASE WHEN obs_age <= 60 THEN value END AS level FROM macro)
    SELECT instrument, datetime, level, level - lag(level, 4) OVER p AS change, level / lag(level, 4) OVER p - 1 AS pct_change, level / lag(level, 52) OVER p - 1 AS yoy,
    CASE WHEN count(level) OVER w = 12 THEN (level - avg(level) OVER w) / stddev_samp(level) OVER w END AS zscore FROM l WINDOW p AS (PARTITION BY instrument ORDER BY datetime), w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def macro_transforms(spark, sf_dir):
    return B.macro_transforms(B.macro_asof(_obs(spark, sf_dir), _grid(spark, sf_dir)), 4, 52, 12, 60)


@query("feature_interactions", KEY + "product:f4 flagged:f4", f"WITH {T.PRED}, {T.GROUPS}, d AS (SELECT datetime, avg(f_vol) AS m FROM pred GROUP BY 1) SELECT p.instrument, p.datetime, score * m AS product, CASE WHEN sector = 'ASIA' THEN m ELSE 0 END AS flagged FROM pred p JOIN d USING (datetime) JOIN groups USING (instrument)")
def feature_interactions(spark, sf_dir):
    p, b = T.pred(spark, sf_dir), T.bounds(spark, sf_dir)
    d = p.groupBy("datetime").agg(F.avg("f_vol").alias("m"))
    j = p.join(T.bounded(d, b.dates), "datetime").join(T.bounded(T.groups(spark, sf_dir), b.names), "instrument")
    return j.withColumns({"product": F.col("score") * F.col("m"), "flagged": F.when(F.col("sector") == "ASIA", F.col("m")).otherwise(0.0)})


def _filing_json(spark, sf_dir):
    """One JSON document per user with parallel arrays, built from the events."""
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), "event_type")
    arr = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "d")))
    doc = e.groupBy("user_id").agg(arr.alias("a"))
    body = F.struct(F.struct(F.transform("a", lambda x: x["event_id"].cast("string")).alias("accession"), F.transform("a", lambda x: x["event_type"]).alias("form"), F.transform("a", lambda x: x["d"]).alias("filed")).alias("recent"))
    return doc.select("user_id", F.to_json(F.struct(body.alias("filings"))).alias("doc"))


@query("filings_flatten", "user_id:i accession:s form:s filed:s", "SELECT user_id, CAST(event_id AS VARCHAR) AS accession, event_type AS form, strftime(ts, '%Y-%m-%d') AS filed FROM events WHERE event_type IN ('purchase', 'signup')")
def filings_flatten(spark, sf_dir):
    schema = "filings STRUCT<recent STRUCT<accession ARRAY<STRING>, form ARRAY<STRING>, filed ARRAY<STRING>>>"
    d = _filing_json(spark, sf_dir).select("user_id", F.from_json("doc", schema).alias("j"))
    rows = d.select("user_id", F.explode(F.arrays_zip("j.filings.recent.accession", "j.filings.recent.form", "j.filings.recent.filed")).alias("r"))
    return rows.select("user_id", "r.accession", "r.form", "r.filed").where(F.col("form").isin("purchase", "signup"))


_REPORTS = """reports AS (SELECT user_id AS company, event_type AS concept, CASE WHEN event_id % 3 = 0 THEN 'EUR' ELSE 'USD' END AS unit, 'A' || (event_id % 4) AS accn,
 strftime(ts, '%Y-%m-%d') AS "end", strftime(CAST(ts AS DATE) + CAST(event_id % 30 AS INTEGER), '%Y-%m-%d') AS filed, value AS val, event_id FROM events)"""


def company_facts(spark, sf_dir):
    """One company-facts document per user, written from all events: concept -> units -> unit -> reports."""
    e = T.table(spark, sf_dir, "events")
    day = F.to_date("ts")
    report = F.struct(
        "event_id", F.concat(F.lit("A"), F.col("event_id") % 4).alias("accn"), F.date_format(day, "yyyy-MM-dd").alias("end"),
        F.date_format(F.date_add(day, (F.col("event_id") % 30).cast("int")), "yyyy-MM-dd").alias("filed"), F.col("value").alias("val"),
    )
    unit = F.when(F.col("event_id") % 3 == 0, "EUR").otherwise("USD")
    by_unit = e.groupBy(F.col("user_id").alias("company"), F.col("event_type").alias("concept"), unit.alias("unit")).agg(F.array_sort(F.collect_list(report)).alias("r"))
    plain = F.transform("r", lambda x: F.struct(x["accn"].alias("accn"), x["end"].alias("end"), x["filed"].alias("filed"), x["val"].alias("val")))
    by_concept = by_unit.groupBy("company", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", plain))).alias("units"))
    by_company = by_concept.groupBy("company").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("us-gaap"))
    return by_company.select("company", F.to_json(F.struct(F.struct("us-gaap").alias("facts"))).alias("json"))


@query(
    "facts_extract",
    "company:i accession:s concept:s unit:s val:f end:s filed:s",
    f"""WITH {_REPORTS}, r AS (SELECT *, CASE concept WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 END AS c, CASE unit WHEN 'USD' THEN 0 ELSE 1 END AS u FROM reports WHERE concept IN ('purchase', 'click') AND val IS NOT NULL)
    SELECT company, accn AS accession, concept, unit, val, "end", filed FROM r QUALIFY row_number() OVER (PARTITION BY company, accn ORDER BY c, u, "end" DESC, filed DESC, event_id DESC) = 1""",
)
def facts_extract(spark, sf_dir):
    """Every accession of every company out of its JSON document, by concept and unit preference."""
    wanted = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("company"), F.concat(F.lit("A"), F.col("event_id") % 4).alias("accession"))
    return B.facts_extract(company_facts(spark, sf_dir), wanted, ["purchase", "click"], ["USD", "EUR"])


@query(
    "ticker_cik_map",
    "p_partkey:i id:s confidence:f",
    """WITH c AS (SELECT p_partkey, p_name, CASE WHEN p_size % 4 = 0 THEN 'ID' || p_size END AS direct, list_filter([upper(split_part(p_name, ' ', 1)), upper(split_part(p_name, ' ', 2))], lambda t : t <> '') AS cand FROM part),
    m AS (SELECT upper(split_part(p_name, ' ', 2)) AS t, 'M' || min(p_partkey) AS id FROM part WHERE p_size > 25 GROUP BY 1),
    x AS (SELECT p_partkey, direct, i, m.id FROM (SELECT p_partkey, direct, unnest(cand) AS t, generate_subscripts(cand, 1) AS i FROM c) LEFT JOIN m USING (t))
    SELECT p_partkey, coalesce(max(direct), arg_min(id, i) FILTER (WHERE id IS NOT NULL)) AS id, CASE WHEN max(direct) IS NOT NULL THEN 1.0 WHEN count(id) > 0 THEN 0.75 END AS confidence FROM x GROUP BY 1""",
)
def ticker_cik_map(spark, sf_dir):
    """A direct id first, else the first candidate that is in the map."""
    p = T.table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    c = p.select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("ID"), "p_size")).alias("direct"), F.posexplode(F.filter(F.array(F.upper(F.get(words, 0)), F.upper(F.get(words, 1))), lambda t: t != "")).alias("i", "t"))
    m = p.where("p_size > 25").groupBy(F.upper(F.get(words, 1)).alias("t")).agg(F.concat(F.lit("M"), F.min("p_partkey")).alias("id"))
    g = c.join(m, "t", "left").groupBy("p_partkey").agg(F.max("direct").alias("direct"), F.min_by("id", F.when(F.col("id").isNotNull(), F.col("i"))).alias("found"))
    return g.select("p_partkey", F.coalesce("direct", "found").alias("id"), F.when(F.col("direct").isNotNull(), 1.0).when(F.col("found").isNotNull(), 0.75).alias("confidence"))


_EV = f"{T.PIT}, ev AS (SELECT instrument, period, sum(value) AS revenue, sum(CASE WHEN seq % 3 = 0 THEN value ELSE -value / 4 END) AS income, max(date) AS date FROM pit GROUP BY 1, 2)"


def _events(spark, sf_dir):
    v = F.when(F.col("seq") % 3 == 0, F.col("value")).otherwise(-F.col("value") / 4)
    return T.pit(spark, sf_dir).groupBy("instrument", "period").agg(F.sum("value").alias("revenue"), F.sum(v).alias("income"), F.max("date").alias("date"))


@query("event_ratios", "instrument:s period:i revenue_ttm:f2 margin:f yoy:f", f"WITH {_EV} SELECT instrument, period, CASE WHEN count(revenue) OVER f = 4 THEN sum(revenue) OVER f END AS revenue_ttm, income / nullif(revenue, 0) AS margin, revenue / nullif(lag(revenue, 4) OVER p, 0) - 1 AS yoy FROM ev WINDOW p AS (PARTITION BY instrument ORDER BY period), f AS (PARTITION BY instrument ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def event_ratios(spark, sf_dir):
    return B.event_ratios(_events(spark, sf_dir))


@query(
    "field_asof_fill",
    KEY + "close:f close_days:i",
    f"""WITH {T.PANEL}, a AS (SELECT instrument, datetime, last_value(close IGNORE NULLS) OVER w AS v, datetime - last_value(CASE WHEN close IS NOT NULL THEN datetime END IGNORE NULLS) OVER w AS age FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT instrument, datetime, CASE WHEN age <= 14 THEN v END AS close, age AS close_days FROM a""",
)
def field_asof_fill(spark, sf_dir):
    return B.field_asof_fill(T.panel(spark, sf_dir).select("instrument", "datetime", "close"), ["close"], 14)


_FORMS = f"{T.PIT}, filings AS (SELECT instrument, date, CASE WHEN period % 100 = 4 THEN 'K' ELSE 'Q' END AS form FROM pit)"


@query(
    "last_form_dates",
    KEY + "last_q:d last_k:d days_q:i days_k:i recent:b",
    f"""WITH {_FORMS}, {_GRID}, l AS (SELECT g.instrument, g.datetime, max(date) FILTER (WHERE form = 'Q') AS last_q, max(date) FILTER (WHERE form = 'K') AS last_k FROM grid g LEFT JOIN filings f ON f.instrument = g.instrument AND f.date <= g.datetime GROUP BY 1, 2)
    SELECT *, datetime - last_q AS days_q, datetime - last_k AS days_k, coalesce(datetime - greatest(last_q, last_k) <= 5, false) AS recent FROM l""",
)
def last_form_dates(spark, sf_dir):
    f = T.pit(spark, sf_dir).withColumn("form", F.when(F.col("period") % 100 == 4, "K").otherwise("Q"))
    return B.last_form_dates(_grid(spark, sf_dir), f, {"q": "Q", "k": "K"}, 5)


@query("valuation", KEY + "cap:f2 price_to_balance:f", f"WITH {T.BARS} SELECT instrument, datetime, close * volume AS cap, close * volume / nullif(s_acctbal, 0) AS price_to_balance FROM bars JOIN supplier ON CAST(s_suppkey AS VARCHAR) = instrument")
def valuation(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("instrument"), "s_acctbal")
    cap = F.col("close") * F.col("volume")
    return T.bars(spark, sf_dir).join(T.bounded(s, T.bounds(spark, sf_dir).names), "instrument").withColumns({"cap": cap, "price_to_balance": cap / F.when(F.col("s_acctbal") != 0, F.col("s_acctbal"))})


@query("coverage_flags", KEY + "has_price:b has_factor:b", f"WITH {T.PRED} SELECT instrument, datetime, f_vol IS NOT NULL AS has_price, coalesce(score, f_std) IS NOT NULL AS has_factor FROM pred")
def coverage_flags(spark, sf_dir):
    return T.pred(spark, sf_dir).withColumns({"has_price": F.col("f_vol").isNotNull(), "has_factor": F.coalesce("score", "f_std").isNotNull()})


_CC = f"{_EV}, e AS (SELECT instrument, period, income, revenue / 1000 AS rev FROM ev)"


@query("clean_clip", "instrument:s period:i income:f2 rev:f", f"WITH {_CC} SELECT instrument, period, CASE WHEN income >= 0 THEN income END AS income, greatest(1000, least(6000, rev)) AS rev FROM e")
def clean_clip(spark, sf_dir):
    e = _events(spark, sf_dir).select("instrument", "period", "income", (F.col("revenue") / 1000).alias("rev"))
    return B.clean_clip(e, ["income"], {"rev": (1000.0, 6000.0)})[0]


@query("clean_clip_counts", "income_negative:i rev_clipped:i", f"WITH {_CC} SELECT count(CASE WHEN income < 0 THEN 1 END) AS income_negative, count(CASE WHEN rev < 1000 OR rev > 6000 THEN 1 END) AS rev_clipped FROM e")
def clean_clip_counts(spark, sf_dir):
    e = _events(spark, sf_dir).select("instrument", "period", "income", (F.col("revenue") / 1000).alias("rev"))
    return B.clean_clip(e, ["income"], {"rev": (1000.0, 6000.0)})[1]


@query(
    "industry_master",
    "p_partkey:i code:s confidence:f",
    r"""SELECT p_partkey, coalesce(lpad(nullif(regexp_extract(p_brand, '(\d+)', 1), ''), 4, '0'), p_type) AS code, CASE WHEN regexp_matches(p_brand, '\d') THEN 1.0 ELSE 0.5 END AS confidence FROM part""",
)
def industry_master(spark, sf_dir):
    digits = F.regexp_extract("p_brand", r"(\d+)", 1)
    code = F.when(digits != "", F.lpad(digits, 4, "0"))
    return T.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(code, "p_type").alias("code"), F.when(code.isNotNull(), 1.0).otherwise(0.5).alias("confidence"))


_SOURCES = ["registry", "filing", "guess"]
_SPANS = """spans AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) AS "start", CASE WHEN l_orderkey % 50 <> 0 THEN CAST(l_shipdate AS DATE) + CAST(l_quantity * 3 AS INTEGER) END AS "end",
 lpad(CAST(l_partkey % 40 AS VARCHAR), 4, '0') AS code, ['registry', 'filing', 'guess', 'rumour'][CAST(l_linenumber % 4 + 1 AS INTEGER)] AS source FROM lineitem)"""


@query(
    "industry_intervals",
    "instrument:s start:d end:d code:s source:s",
    f"""WITH {_SPANS}, k AS (SELECT DISTINCT instrument, "start" AS a, coalesce("end" + 1, DATE '9999-12-31') AS b, list_position(['registry', 'filing', 'guess'], source) AS r, source AS s, code AS v FROM spans WHERE source <> 'rumour'),
    e AS (SELECT DISTINCT instrument, unnest([a, b]) AS a FROM k), p AS (SELECT instrument, a, lead(a) OVER (PARTITION BY instrument ORDER BY a) AS b FROM e),
    c AS (SELECT p.instrument, p.a, p.b, k.v, k.s FROM p JOIN k ON k.instrument = p.instrument AND p.a >= k.a AND p.a < k.b WHERE p.b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p.instrument, p.a ORDER BY k.r, k.a DESC, k.v) = 1),
    n AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(v) OVER w = v AND lag(s) OVER w = s THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY instrument ORDER BY a)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY instrument ORDER BY a) AS i FROM n)
    SELECT instrument, min(a) AS "start", CASE WHEN max(b) < DATE '9999-12-31' THEN max(b) - 1 END AS "end", any_value(v) AS code, any_value(s) AS source FROM i GROUP BY instrument, i""",
)
def industry_intervals(spark, sf_dir):
    """Industry codes of three sources with overlapping spans, resolved by priority into disjoint intervals; a fourth source has no rank."""
    li = T.table(spark, sf_dir, "lineitem")
    start = F.to_date("l_shipdate")
    until = F.when(F.col("l_orderkey") % 50 != 0, F.date_add(start, (F.col("l_quantity") * 3).cast("int")))
    source = F.element_at(F.array(*[F.lit(x) for x in [*_SOURCES, "rumour"]]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    spans = li.select(F.col("l_suppkey").cast("string").alias("instrument"), start.alias("start"), until.alias("end"), F.lpad((F.col("l_partkey") % 40).cast("string"), 4, "0").alias("code"), source.alias("source"))
    return B.disjoint_intervals(spans, _SOURCES)
