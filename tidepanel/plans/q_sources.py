"""Scans, sources, sinks and panel maintenance."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from tidepanel.functions import expr as X
from tidepanel.plans import fixtures as T
from tidepanel.plans.registry import query
from tidepanel.session import checkpoint_dir
from tidepanel.sources import panel as P

A, B = dt.date(1997, 1, 1), dt.date(1998, 12, 31)
RANGE = "datetime BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"
BAR = "instrument:s datetime:d open:f high:f low:f close:f vwap:f volume:f"


def scratch(spark, name):
    """A new folder in the shared checkpoint area."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@query("scan_panel", "instrument:s datetime:d close:f volume:f", f"WITH {T.BARS} SELECT instrument, datetime, close, volume FROM bars WHERE {RANGE}")
def scan_panel(spark, sf_dir):
    path = scratch(spark, "panel")
    P.write_panel(T.bars(spark, sf_dir), path)
    return P.scan_panel(spark, f"{path}/values", ["close", "volume"], start=A, end=B)


@query("scan_csv_parquet", "instrument:s datetime:d close:f volume:f", f"WITH {T.BARS} SELECT instrument, datetime, close, volume FROM bars")
def scan_csv_parquet(spark, sf_dir):
    """Bars of even instruments through CSV files, of the others through Parquet files, both typed and with their symbol column."""
    b = T.bars(spark, sf_dir).select(F.col("instrument").alias("symbol"), F.col("datetime").alias("date"), "close", "volume")
    even, csv, parquet = F.col("symbol").cast("int") % 2 == 0, scratch(spark, "csv"), scratch(spark, "parquet")
    b.where(even).write.option("header", True).csv(csv)
    b.where(~even).write.parquet(parquet)
    text = P.scan_files(spark, csv, "csv", schema="symbol string, date string, close double, volume double", symbol_from_name=False)
    return text.unionByName(P.scan_files(spark, parquet, "parquet", symbol_from_name=False)).withColumnRenamed("symbol", "instrument")


@query(
    "scan_static",
    "datetime:d instrument:s score:f ret:f",
    f"""WITH {T.PRED}, a AS (SELECT instrument, datetime, score FROM pred WHERE score IS NOT NULL AND cal_ix % 3 <> 0), b AS (SELECT instrument, datetime, label AS ret FROM pred WHERE label IS NOT NULL AND cal_ix % 3 <> 1)
    SELECT * FROM (SELECT coalesce(a.datetime, b.datetime) AS datetime, coalesce(a.instrument, b.instrument) AS instrument, score, ret FROM a FULL JOIN b ON a.instrument = b.instrument AND a.datetime = b.datetime) WHERE {RANGE}""",
)
def scan_static(spark, sf_dir):
    p = T.pred(spark, sf_dir)
    df = P.scan_static({"feature": p.where("score IS NOT NULL AND cal_ix % 3 <> 0").select("instrument", "datetime", "score"), "label": p.where("label IS NOT NULL AND cal_ix % 3 <> 1").select("instrument", "datetime", F.col("label").alias("ret"))})
    return df.where(F.col("datetime").between(F.lit(A), F.lit(B))).select("datetime", "instrument", F.col("`feature.score`").alias("score"), F.col("`label.ret`").alias("ret"))


@query("scan_irregular", "event_id:i instrument:s ts:t price:f size:f", f"WITH {T.TICKS} SELECT event_id, instrument, ts, price, size FROM ticks")
def scan_irregular(spark, sf_dir):
    return T.ticks(spark, sf_dir)


@query("build_calendar", "datetime:d cal_ix:i", f"WITH {T.DAYS} SELECT * FROM days")
def build_calendar(spark, sf_dir):
    return T.days(spark, sf_dir)


@query("build_instruments", "instrument:s start:d end:d", f"WITH {T.BARS}, {T.SPANS} SELECT * FROM spans")
def build_instruments(spark, sf_dir):
    return P.build_instruments(T.bars(spark, sf_dir))


@query("align_calendar", BAR + " cal_ix:i", f"WITH {T.PANEL} SELECT * FROM panel")
def align_calendar(spark, sf_dir):
    return T.panel(spark, sf_dir)


def _trades(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("instrument"), F.to_date("l_shipdate").alias("datetime"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "dedupe_by_date",
    "instrument:s datetime:d price:f",
    "SELECT CAST(l_suppkey AS VARCHAR) AS instrument, CAST(l_shipdate AS DATE) AS datetime, l_extendedprice / l_quantity AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey) = 1",
)
def dedupe_by_date(spark, sf_dir):
    return P.dedupe_by_date(_trades(spark, sf_dir), ["l_orderkey", "l_linenumber", "l_partkey"])


@query("select_dump_fields", "instrument:s datetime:d open:f close:f", f"WITH {T.BARS} SELECT instrument, datetime, open, close FROM bars")
def select_dump_fields(spark, sf_dir):
    return P.select_fields(T.bars(spark, sf_dir), ["open", "close", "volume"], ["volume"])


_STORED = f"WITH {T.BARS} SELECT instrument, datetime, open, high, low, close, vwap, volume FROM bars"


@query("write_panel", BAR, _STORED)
def write_panel(spark, sf_dir):
    return P.write_panel(T.bars(spark, sf_dir), scratch(spark, "panel"))


@query("partitioned_export", BAR, _STORED)
def partitioned_export(spark, sf_dir):
    """Instruments of even number by day, the others by instrument; the two exports together are the table."""
    b = T.bars(spark, sf_dir)
    even = F.col("instrument").cast("int") % 2 == 0
    by_day = P.export_partitioned(b.where(even), scratch(spark, "export"), "day").drop("day")
    by_name = P.export_partitioned(b.where(~even), scratch(spark, "export"), "instrument")
    return by_day.unionByName(by_name.withColumn("instrument", F.col("instrument").cast("string")))


def _old(df):
    """A stored state: up to 1999 and without the instruments that start with 9."""
    return df.where((F.col("datetime") < F.lit(dt.date(2000, 1, 1))) & ~F.col("instrument").startswith("9"))


@query("append_panel", BAR, f"WITH {T.BARS} SELECT * FROM bars")
def append_panel(spark, sf_dir):
    path, bars = scratch(spark, "append"), T.bars(spark, sf_dir)
    P.write_panel(_old(bars), path)
    return P.append_panel(bars, path)


@query("fix_panel", "instrument:s datetime:d close:f", f"WITH {T.BARS} SELECT instrument, datetime, close FROM bars WHERE starts_with(instrument, '9')")
def fix_panel(spark, sf_dir):
    bars = T.bars(spark, sf_dir)
    return P.missing_instruments(bars, _old(bars))


@query(
    "reconcile_panel",
    "instrument:s diff_close:i diff_volume:i",
    f"""WITH {T.BARS} SELECT instrument, sum(CASE WHEN volume > 60 THEN 1 ELSE 0 END) AS diff_close, 0 AS diff_volume FROM bars GROUP BY 1""",
)
def reconcile_panel(spark, sf_dir):
    bars = T.bars(spark, sf_dir)
    stored = bars.withColumn("close", F.when(F.col("volume") > 60, F.col("close") * 1.001).otherwise(F.col("close")))
    return P.reconcile(stored, bars, ["close", "volume"])


@query(
    "replace_range",
    "instrument:s datetime:d close:f",
    f"WITH {T.BARS} SELECT instrument, datetime, CASE WHEN {RANGE} THEN close * 2 ELSE close END AS close FROM bars WHERE NOT ({RANGE} AND volume <= 20)",
)
def replace_range(spark, sf_dir):
    bars = T.bars(spark, sf_dir).select("instrument", "datetime", "close", "volume")
    new = bars.where(F.col("datetime").between(F.lit(A), F.lit(B)) & (F.col("volume") > 20)).withColumn("close", F.col("close") * 2)
    return P.replace_range(bars, new)


@query(
    "range_write_overlap",
    "instrument:s datetime:d close:f",
    f"""WITH {T.PANEL}, o AS (SELECT instrument, datetime, close FROM bars WHERE datetime < DATE '1998-01-01'), n AS (SELECT instrument, datetime, close * 2 AS close FROM bars WHERE datetime >= DATE '1997-06-01' AND volume > 60),
    u AS (SELECT coalesce(n.instrument, o.instrument) AS instrument, coalesce(n.datetime, o.datetime) AS datetime, coalesce(n.close, o.close) AS close FROM o FULL JOIN n ON o.instrument = n.instrument AND o.datetime = n.datetime),
    s AS (SELECT instrument, min(datetime) AS a, max(datetime) AS b FROM u GROUP BY 1)
    SELECT s.instrument, c.datetime, u.close FROM s JOIN calendar c ON c.datetime BETWEEN a AND b LEFT JOIN u ON u.instrument = s.instrument AND u.datetime = c.datetime""",
)
def range_write_overlap(spark, sf_dir):
    bars = T.bars(spark, sf_dir).select("instrument", "datetime", "close", "volume")
    old = bars.where(F.col("datetime") < F.lit(dt.date(1998, 1, 1))).drop("volume")
    new = bars.where((F.col("datetime") >= F.lit(dt.date(1997, 6, 1))) & (F.col("volume") > 60)).withColumn("close", F.col("close") * 2).drop("volume")
    return P.write_at(old, new, T.calendar(spark, sf_dir), T.bounds(spark, sf_dir).dates)


@query("hash_by_instrument", "instrument:s rows:i volume:f", f"WITH {T.BARS} SELECT instrument, count(*) AS rows, sum(volume) AS volume FROM bars GROUP BY instrument")
def hash_by_instrument(spark, sf_dir):
    """The bucketed table, aggregated by its bucket key without a shuffle."""
    stored = P.hash_by_instrument(T.bars(spark, sf_dir), f"bars_{uuid.uuid4().hex[:12]}", path=scratch(spark, "bucketed"))
    return stored.groupBy("instrument").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))


_MADE = f"WITH {T.PANEL} SELECT instrument, datetime, close / lag(close, 5) OVER w - 1 AS mom, stddev_samp(close) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / close AS vol FROM panel WINDOW w AS (PARTITION BY instrument ORDER BY datetime)"


@query("materialize_factors", "instrument:s datetime:d mom:f vol:f", _MADE)
def materialize_factors(spark, sf_dir):
    """Factor columns kept as a table and read back by name."""
    path = scratch(spark, "factors")
    X.features(T.panel(spark, sf_dir), {"mom": "$close/Ref($close,5)-1", "vol": "Std($close,10)/$close"}).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "pit_ingest",
    "instrument:s field:s date:d period:i value:f2 seq:i",
    f"""WITH {T.PIT}, old AS (SELECT * FROM pit WHERE date < DATE '1998-01-01'), l AS (SELECT instrument, field, max(date) AS last FROM old GROUP BY 1, 2)
    SELECT * FROM old UNION ALL SELECT p.* FROM pit p LEFT JOIN l USING (instrument, field) WHERE last IS NULL OR date > last""",
)
def pit_ingest(spark, sf_dir):
    pit = T.pit(spark, sf_dir)
    old = pit.where(F.col("date") < F.lit(dt.date(1998, 1, 1)))
    return old.unionByName(P.pit_ingest(pit, old))
