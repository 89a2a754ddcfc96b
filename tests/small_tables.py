"""A few months of trades of some suppliers as Parquet tables."""

import datetime as dt


def write(spark, path, days=120, names=4):
    rows = [(i * names + s, 1 + (i + s) % 3, s, 1, float(5 + (i * 7 + s) % 11), float(100 + (i * 13 + s * 29) % 97), dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(days) for s in range(names)]
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, cols).write.parquet(f"{path}/lineitem.parquet")
    spark.range(names).selectExpr("id AS s_suppkey").write.parquet(f"{path}/supplier.parquet")
    return str(path)
