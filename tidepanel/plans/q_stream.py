"""Streaming forms, run to the end of the available input."""

from pyspark.sql import functions as F

from tidepanel.plans import fixtures as T
from tidepanel.plans.q_sources import scratch
from tidepanel.plans.registry import query
from tidepanel.streaming import live as L


def _ticks(spark, sf_dir):
    s = L.tick_stream(spark, sf_dir, "events.parquet", T.table(spark, sf_dir, "events").schema)
    return s.select(
        F.pmod("user_id", F.lit(10)).cast("string").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        (F.pmod("event_id", F.lit(100)) + 1).cast("double").alias("size"), F.col("event_type").alias("code"), "event_id", "user_id",
    )


def _run(spark, df, name):
    return L.run_to_table(df, scratch(spark, name), scratch(spark, name + "-check"))


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)"


@query("stream_tresample", "instrument:s bin:t total:f high:f low:f", f"WITH {T.TICKS} SELECT instrument, date_trunc('hour', ts) AS bin, sum(size) AS total, max(price) AS high, min(price) AS low FROM ticks GROUP BY 1, 2 HAVING bin + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_tresample(spark, sf_dir):
    return _run(spark, L.tumbling(_ticks(spark, sf_dir)), "tumbling")


@query("stream_sliding", "instrument:s bin:t n:i", f"WITH {T.TICKS}, w AS (SELECT instrument, time_bucket(INTERVAL 15 MINUTE, ts) - unnest([0, 15, 30, 45]) * INTERVAL 1 MINUTE AS bin FROM ticks) SELECT instrument, bin, count(*) AS n FROM w GROUP BY 1, 2 HAVING bin + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_sliding(spark, sf_dir):
    return _run(spark, L.sliding(_ticks(spark, sf_dir)), "sliding")


@query("stream_session", "instrument:s begin:t n:i", f"WITH {T.TICKS}, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY instrument ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM ticks), r AS (SELECT *, sum(b) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM m) SELECT instrument, min(ts) AS \"begin\", count(*) AS n FROM r GROUP BY instrument, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}")
def stream_session(spark, sf_dir):
    return _run(spark, L.sessions(_ticks(spark, sf_dir)), "sessions")


@query("stream_dedupe", "instrument:s minute:t", "WITH x AS (SELECT DISTINCT CAST(user_id % 10 AS VARCHAR) AS instrument, date_trunc('minute', ts) AS minute FROM events) SELECT * FROM x")
def stream_dedupe(spark, sf_dir):
    t = _ticks(spark, sf_dir).withColumn("minute", F.date_trunc("minute", "ts"))
    return _run(spark, L.dedupe(t, ["instrument", "minute"]).select("instrument", "minute"), "dedupe")


@query("stream_ema", "instrument:s at:f value:f", f"WITH {T.TICKS}, m AS (SELECT instrument, max(epoch_us(ts)) / 1e6 AS upto FROM ticks GROUP BY 1) SELECT t.instrument, any_value(upto) AS \"at\", sum(price * pow(0.5, (upto - epoch_us(ts) / 1e6) / 86400)) / sum(pow(0.5, (upto - epoch_us(ts) / 1e6) / 86400)) AS value FROM ticks t JOIN m USING (instrument) GROUP BY 1")
def stream_ema(spark, sf_dir):
    return _run(spark, L.decayed_mean(_ticks(spark, sf_dir).select("instrument", "ts", "price"), 86400.0), "decayed")


@query("stream_append", "instrument:s bin:t total:f", f"WITH {T.TICKS} SELECT instrument, date_trunc('hour', ts) AS bin, sum(size) AS total FROM ticks GROUP BY 1, 2")
def stream_append(spark, sf_dir):
    fold = lambda b: b.groupBy("instrument", F.date_trunc("hour", "ts").alias("bin")).agg(F.sum("size").alias("total"))
    parts = L.append_batches(_ticks(spark, sf_dir), fold, scratch(spark, "batches"), scratch(spark, "batches-check"))
    return parts.groupBy("instrument", "bin").agg(F.sum("total").alias("total"))


@query("stream_static_join", "event_id:i segment:s price:f", "SELECT event_id, c_mktsegment AS segment, value AS price FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return _run(spark, _ticks(spark, sf_dir).join(c, "user_id").select("event_id", "segment", "price"), "static")
