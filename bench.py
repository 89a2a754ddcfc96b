"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import time

from tidepanel.plans.catalog import QUERIES
from tidepanel.session import build_session

HEADLINE = [
    "dataset_build",
    "flagship_ic",
    "align_calendar",
    "roll_mean",
    "roll_quantile",
    "ema",
    "change_instrument",
    "cs_rank_norm",
    "cs_zscore",
    "robust_zscore_norm",
    "label_forward",
    "f158_kbar",
    "f158_rolling",
    "ic_summary",
    "group_return",
    "asof_join",
    "pit_collapse",
    "tresample",
    "topk_periods",
    "brinson",
    "covariance",
    "stream_tresample",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", cpus)
    # start-up cost of the JVM is not part of any query
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
