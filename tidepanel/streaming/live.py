"""Structured Streaming forms of the tick jobs. Sinks are idempotent per micro-batch; output mode is append."""

import math

from pyspark.sql import functions as F


def tick_stream(spark, folder, name, schema):
    """A folder of tick files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def tumbling(ticks, size="60 minutes", delay="10 minutes"):
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("instrument", F.window("ts", size))
        .agg(F.sum("size").alias("total"), F.max("price").alias("high"), F.min("price").alias("low"))
        .select("instrument", F.col("window.start").alias("bin"), "total", "high", "low")
    )


def sliding(ticks, size="60 minutes", step="15 minutes", delay="10 minutes"):
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("instrument", F.window("ts", size, step))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("instrument", F.col("window.start").alias("bin"), "n")
    )


def sessions(ticks, gap="30 minutes", delay="10 minutes"):
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("instrument", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("instrument", F.col("session_window.start").alias("begin"), "n")
    )


def dedupe(ticks, keys, delay="10 minutes"):
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def decayed_mean(ticks, half_life):
    """Mean per instrument with weights that halve every ``half_life`` seconds.

    The state is a pair of decayed sums and their reference time, so the order of rows inside a batch does not matter.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    rate = math.log(2) / half_life

    def update(key, batches, state):
        import numpy as np
        import pandas as pd

        num, den, at = state.get if state.exists else (0.0, 0.0, -math.inf)
        for pdf in batches:
            t = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            top = max(at, float(t.max()))
            keep = math.exp(-rate * (top - at)) if at > -math.inf else 0.0
            w = np.exp(-rate * (top - t))
            num, den, at = num * keep + float((w * pdf["price"]).sum()), den * keep + float(w.sum()), top
        state.update((num, den, at))
        yield pd.DataFrame({"instrument": [key[0]], "at": [at], "value": [num / den]})

    return ticks.groupBy("instrument").applyInPandasWithState(
        update, "instrument string, at double, value double", "num double, den double, at double", "append", GroupStateTimeout.NoTimeout
    )


def run_to_table(stream, path, checkpoint):
    """Work off what is there, then read the sink."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def append_batches(stream, fold, path, checkpoint):
    """foreachBatch sink: every batch owns one folder, so a repeated batch overwrites itself; readers take the newest batch per key."""

    def sink(batch, batch_id):
        fold(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.option("basePath", path).parquet(f"{path}/batch=*")
