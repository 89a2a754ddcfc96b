"""Panel sources and sinks: long tables keyed by (instrument, datetime)."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.scale import bounded, dealt


def clean_floats(df):
    """NaN becomes null in every floating column; all other operators rely on that."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name).cast("double")
            out[f.name] = F.when(~F.isnan(c), c)
    return df.withColumns(out) if out else df


def bars_from_trades(trades, instrument, bucket, price, size, order, by_instrument=0):
    """Open / high / low / close / vwap / volume bars. Map-side partial aggregates absorb hot instruments.

    Where no instrument has many trades, these save nothing, and sort and write each trade with two keys: ``by_instrument`` is
    a number of tasks to which trades then go as they are. Bars stay dealt by instrument."""
    key = F.struct(*order)
    rows = trades.select(instrument.alias("instrument"), bucket.alias("datetime"), price.alias("p"), size.alias("s"), key.alias("k"))
    return (
        (rows.repartition(by_instrument, "instrument") if by_instrument else rows)
        .groupBy("instrument", "datetime")
        .agg(
            F.min(F.struct("k", "p")).alias("first"),
            F.max(F.struct("k", "p")).alias("final"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            (F.sum(F.col("p") * F.col("s")) / F.sum("s")).alias("vwap"),
            F.sum("s").alias("volume"),
        )
        .select("instrument", "datetime", F.col("first.p").alias("open"), "high", "low", F.col("final.p").alias("close"), "vwap", "volume")
    )


def build_calendar(df, time="datetime"):
    """Distinct trade times with a dense index. The index window sees the calendar only, never the rows."""
    days = df.select(time).distinct()
    return days.withColumn("cal_ix", (F.row_number().over(Window.orderBy(time)) - 1).cast("int"))


def build_instruments(df, time="datetime"):
    return df.groupBy("instrument").agg(F.min(time).alias("start"), F.max(time).alias("end"))


def align_calendar(df, calendar, calendar_rows=None, panel_rows=None):
    """Every instrument gets one row per calendar slot between its own first and last one.

    A gap is filled by expanding each row up to the slot before the next row, so one shuffle by
    instrument is all: no range join and no second join for the values. ``panel_rows`` is a proven limit of the rows
    that come out; it bounds the rows of a task, whatever later windows hold of them.
    """
    cal = bounded(calendar, calendar_rows)
    values = [c for c in df.columns if c not in ("instrument", "datetime")]
    w = Window.partitionBy("instrument").orderBy("cal_ix")
    spaced = dealt(df.join(cal, "datetime"), panel_rows, "instrument").withColumn("__next", F.lead("cal_ix").over(w))
    last = F.coalesce(F.col("__next") - 1, F.col("cal_ix"))
    slots = spaced.select(
        "instrument",
        F.explode(F.sequence("cal_ix", last)).alias("__slot"),
        F.col("cal_ix").alias("__own"),
        *values,
    )
    filled = slots.select(
        "instrument",
        F.col("__slot").alias("cal_ix"),
        *[F.when(F.col("__slot") == F.col("__own"), F.col(c)).alias(c) for c in values],
    )
    return filled.join(cal, "cal_ix").select("instrument", "datetime", "cal_ix", *values)


def dedupe_by_date(df, source_order, time="datetime", keep="first"):
    """One row per (instrument, time). A min/max over a struct merges map-side, so copies of one key never pile up."""
    values = [c for c in df.columns if c not in ("instrument", time)]
    packed = F.struct(*source_order, F.struct(*values).alias("__row"))
    best = F.min(packed) if keep == "first" else F.max(packed)
    return df.groupBy("instrument", time).agg(best.alias("__b")).select("instrument", time, "__b.__row.*")


def select_fields(df, include=None, exclude=()):
    keep = [c for c in df.columns if c not in ("instrument", "datetime")]
    keep = [c for c in keep if (include is None or c in include) and c not in exclude]
    return df.select("instrument", "datetime", *keep)


def scan_panel(spark, path, fields=None, instruments=None, start=None, end=None):
    df = spark.read.parquet(path)
    by_year = "year" in df.columns
    # the store is cut by year: the filter on it prunes folders before any file is read
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            if by_year:
                df = df.where(getattr(F.col("year"), op)(F.year(F.lit(bound))))
            df = df.where(getattr(F.col("datetime"), op)(F.lit(bound)))
    if instruments is not None:
        df = df.where(F.col("instrument").isin(list(instruments)))
    if fields:
        df = df.select("instrument", "datetime", *fields)
    return clean_floats(df)


def scan_files(spark, paths, fmt="csv", date_field="date", symbol_from_name=True, schema=None):
    """One table from per-instrument files; the symbol is the upper-cased file name."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("header", True).csv(paths) if fmt == "csv" else reader.parquet(paths)
    df = df.withColumn("datetime", F.to_timestamp(F.col(date_field).cast("string")))
    if date_field != "datetime":
        df = df.drop(date_field)
    if symbol_from_name:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.(csv|snappy\.parquet|parquet)$", 1)
        df = df.withColumn("instrument", F.upper(name))
    return clean_floats(df)


def scan_static(groups, how="outer"):
    """Ready tables joined on the panel key; columns are named ``group.column``."""
    out = None
    for name, df in groups.items():
        values = [c for c in df.columns if c not in ("instrument", "datetime")]
        part = df.select("datetime", "instrument", *[F.col(c).alias(f"{name}.{c}") for c in values])
        out = part if out is None else out.join(part, ["datetime", "instrument"], how)
    return out


def write_panel(df, path, calendar=None):
    """Full write: values by year, plus calendar and member spans."""
    df = df.withColumn("year", F.year("datetime"))
    # the number of writers of a year follows its size
    df.hint("rebalance", "year").sortWithinPartitions("instrument", "datetime").write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "static").partitionBy("year").parquet(f"{path}/values")
    stored = df.sparkSession.read.parquet(f"{path}/values")
    (calendar if calendar is not None else build_calendar(stored)).write.mode("overwrite").parquet(f"{path}/calendar")
    build_instruments(stored).write.mode("overwrite").parquet(f"{path}/instruments")
    return stored


def export_partitioned(df, path, by="day"):
    """One file set per day or per instrument; the number of writers of each follows its size."""
    df, key = (df.withColumn("day", F.to_date("datetime")), "day") if by == "day" else (df, "instrument")
    df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(key).parquet(path)
    return df.sparkSession.read.parquet(path)


def new_rows(source, stored_spans):
    """Rows after the stored end of their instrument; unknown instruments in full."""
    ends = stored_spans.select("instrument", F.col("end").alias("__end"))
    return (
        source.join(ends, "instrument", "left")
        .where(F.col("__end").isNull() | (F.col("datetime") > F.col("__end")))
        .drop("__end")
    )


def append_panel(source, path):
    """Incremental write next to the stored values; spans and calendar are derived again from the stored keys."""
    spark = source.sparkSession
    spans = build_instruments(spark.read.parquet(f"{path}/values"))
    new_rows(source, spans).withColumn("year", F.year("datetime")).write.mode("append").partitionBy("year").parquet(f"{path}/values")
    stored = spark.read.parquet(f"{path}/values")
    build_calendar(stored).write.mode("overwrite").parquet(f"{path}/calendar")
    build_instruments(stored).write.mode("overwrite").parquet(f"{path}/instruments")
    return stored


def missing_instruments(source, stored):
    return source.join(stored.select("instrument").distinct(), "instrument", "left_anti")


def reconcile(stored, source, fields, absolute=1e-8, relative=1e-5):
    """Rows per instrument where the stored value differs from the source beyond the tolerance."""
    s = source.select("instrument", "datetime", *[F.col(f).alias(f"__src_{f}") for f in fields])
    joined = stored.join(s, ["instrument", "datetime"], "left")

    def differs(f):
        a, b = F.col(f), F.col(f"__src_{f}")
        return F.when(
            (a.isNull() != b.isNull()) | (F.abs(a - b) > absolute + relative * F.abs(b)), F.lit(1)
        ).otherwise(F.lit(0))

    return joined.groupBy("instrument").agg(*[F.sum(differs(f)).alias(f"diff_{f}") for f in fields])


def replace_range(old, new, keys=("instrument", "datetime"), order="datetime"):
    """Old rows inside the time range of the new ones are dropped, then both are united (last one wins)."""
    span = new.agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    kept = old.join(F.broadcast(span), ~F.col(order).between(F.col("__lo"), F.col("__hi")) | F.col("__lo").isNull())
    merged = kept.drop("__lo", "__hi").withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    values = [c for c in old.columns if c not in keys]
    return (
        merged.groupBy(*keys)
        .agg(F.max(F.struct("__gen", F.struct(*values).alias("__row"))).alias("__b"))
        .select(*keys, "__b.__row.*")
    )


def write_at(old, new, calendar, calendar_rows=None):
    """Overwrite the overlap by position; a gap between the two becomes null rows."""
    return align_calendar(union_keep_last([old, new]), calendar, calendar_rows)


def union_keep_last(frames, keys=("instrument", "datetime")):
    """Later frames win on an equal key. The winner is a max over a struct, which merges map-side."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn("__gen", F.lit(i))
        out = df if out is None else out.unionByName(df)
    values = [c for c in frames[0].columns if c not in keys]
    return (
        out.groupBy(*keys)
        .agg(F.max(F.struct("__gen", F.struct(*values).alias("__row"))).alias("__b"))
        .select(*keys, "__b.__row.*")
    )


def hash_by_instrument(df, table, buckets=64, path=None):
    """Bucketed table: point lookups and later instrument windows read without a shuffle. Rows are dealt to the buckets before the
    write, so each bucket is one file; ``path`` keeps the files outside the warehouse folder."""
    writer = df.repartition(buckets, "instrument").write.mode("overwrite").bucketBy(buckets, "instrument").sortBy("instrument", "datetime")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def pit_ingest(records, stored=None):
    """Point-in-time records; only dates after the last stored one per (instrument, field) are new."""
    if stored is None:
        return records
    last = stored.groupBy("instrument", "field").agg(F.max("date").alias("__last"))
    return (
        records.join(last, ["instrument", "field"], "left")
        .where(F.col("__last").isNull() | (F.col("date") > F.col("__last")))
        .drop("__last")
    )
