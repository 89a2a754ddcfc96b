"""Model tables on Spark ML: fit, score, rolling tasks, weights from loss curves."""

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.operators.scale import Bounds, bounded, xs_order


def assemble(df, features):
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def linear_fit(df, features, label="label", ridge=0.0, lasso=0.0, weight=None, intercept=False):
    """Least squares without an intercept unless asked for, on the features as they are.

    ``ridge`` weighs the squared coefficients against the sum of squared errors, ``lasso`` the absolute ones against half the mean
    squared error. Spark's objective is half the mean, and it measures the squared penalty in label deviations, so the ridge weight
    is divided by the number of rows and multiplied by the deviation.
    """
    rows = assemble(df.where(F.col(label).isNotNull()), features)
    lr = LinearRegression(labelCol=label, predictionCol="pred", fitIntercept=intercept, standardization=False)
    if ridge and lasso:
        raise ValueError("either ridge or lasso")
    if lasso:
        lr = lr.setRegParam(lasso).setElasticNetParam(1.0)
    if ridge:
        w = F.col(weight) if weight else F.lit(1.0)
        total, first, second = rows.agg(F.sum(w), F.sum(w * F.col(label)), F.sum(w * F.col(label) ** 2)).first()
        deviation = (second / total - (first / total) ** 2) ** 0.5
        lr = lr.setRegParam(ridge / total * deviation)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(rows)


def gbt_fit(df, features, label="label", trees=10, depth=3, seed=7):
    gbt = GBTRegressor(labelCol=label, predictionCol="pred", maxIter=trees, maxDepth=depth, seed=seed)
    return gbt.fit(assemble(df.where(F.col(label).isNotNull()), features))


def predict(model, df, features):
    return model.transform(assemble(df, features)).drop("features")


def rolling_tasks(calendar, first, step, train=None, gap=0):
    """Train and test segments by calendar arithmetic; ``train`` None grows from the start, else slides with that length."""
    top = calendar.agg(F.max("cal_ix").alias("hi"))
    t = top.select("hi", F.explode(F.sequence(F.lit(first), F.col("hi"), F.lit(step))).alias("a")).withColumn("task", ((F.col("a") - first) / step).cast("int"))
    low = F.lit(0) if train is None else F.greatest(F.col("a") - gap - train, F.lit(0))
    seg = F.explode(
        F.array(
            F.struct(F.lit("train").alias("segment"), low.cast("int").alias("x"), (F.col("a") - gap - 1).cast("int").alias("y")),
            F.struct(F.lit("test").alias("segment"), F.col("a").cast("int").alias("x"), F.least(F.col("a") + step - 1, F.col("hi")).cast("int").alias("y")),
        )
    )
    s = t.select("task", seg.alias("s")).select("task", "s.*")
    day = calendar.select("datetime", "cal_ix")
    start, end = day.withColumnsRenamed({"datetime": "start", "cal_ix": "x"}), day.withColumnsRenamed({"datetime": "end", "cal_ix": "y"})
    return s.join(start, "x").join(end, "y").select("task", "segment", "start", "end")


def _products(features, label):
    """Products whose sums make up the normal equations: the upper triangle of X'X, then X'y."""
    x = [F.col(f) for f in features]
    return [x[a] * x[b] for a in range(len(x)) for b in range(a, len(x))] + [e * F.col(label) for e in x]


def _solve(sums, k, ridge):
    """(task, beta) from (task, sums) by the normal equations; without a full rank the shortest solution."""

    def run(batches):
        for b in batches:
            betas = []
            for v in b.column("sums").to_pylist():
                gram = np.zeros((k, k))
                gram[np.triu_indices(k)] = v[:-k]
                gram = gram + np.triu(gram, 1).T + ridge * np.eye(k)
                betas.append(np.linalg.lstsq(gram, np.array(v[-k:]), rcond=None)[0])
            yield pa.RecordBatch.from_arrays([b.column("task"), pa.array(betas, pa.list_(pa.float64()))], names=["task", "beta"])

    return sums.mapInArrow(run, "task int, beta array<double>")


def walk_forward(df, tasks, features, label="label", ridge=0.0, bounds=Bounds()):
    """datetime, instrument, score, ``label``, task: least squares per rolling task, applied to its test segment, all in one job.

    A date gives one row of sums of products. Running totals over the dates make every training segment a difference of two rows, so
    overlapping segments read the panel once. ``ridge`` weighs the squared coefficients against the squared errors.
    """
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*features, label]))
    products = _products(features, label)
    n = len(products)
    dates = known.groupBy("datetime").agg(*[F.sum(p).alias(f"p{i}") for i, p in enumerate(products)])
    # segments may start or end on a date without rows
    ends = tasks.select(F.explode(F.array("start", "end")).alias("datetime")).distinct()
    dates = dates.join(ends, "datetime", "full")
    # one row per date of the calendar from here on
    upto = Window.orderBy("datetime").rowsBetween(Window.unboundedPreceding, 0)
    own = [F.coalesce(f"p{i}", F.lit(0.0)) for i in range(n)]
    totals = dates.select("datetime", F.array(*own).alias("own"), F.array(*[F.sum(p).over(upto) for p in own]).alias("upto"))
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    first = totals.select(F.col("datetime").alias("start"), minus("upto", "own").alias("before"))
    last = totals.select(F.col("datetime").alias("end"), F.col("upto").alias("through"))
    train = tasks.where("segment = 'train'").join(bounded(first, bounds.dates), "start").join(bounded(last, bounds.dates), "end")
    fitted = _solve(train.select("task", minus("through", "before").alias("sums")), len(features), ridge)
    test = tasks.where("segment = 'test'").join(fitted, "task").select("task", "start", "end", "beta")
    by_date = totals.select("datetime").join(bounded(test, bounds.dates), F.col("datetime").between(F.col("start"), F.col("end"))).select("datetime", "task", "beta")
    score = sum((F.col("beta")[i] * F.col(f) for i, f in enumerate(features)), F.lit(0.0))
    scored = df.join(bounded(by_date, bounds.dates), "datetime").where(" AND ".join(f"`{c}` IS NOT NULL" for c in features))
    return scored.select("datetime", "instrument", score.alias("score"), label, "task")


def loss_reweight(losses, last, part=1, bins=10, decay=0.5, k=1, bounds=Bounds()):
    """Row weights from loss curves. ``losses``: (instrument, iteration, loss); ``last`` is the final iteration number."""
    r = xs_order(losses, ["iteration"], "loss", "instrument", "__l", Bounds(last, bounds.names), number=False)
    r = r.withColumn("norm", F.col("__l_avg") / F.col("__l_n"))
    per = r.groupBy("instrument").agg(
        F.avg(F.when(F.col("iteration") <= part, F.col("norm"))).alias("begin"),
        F.avg(F.when(F.col("iteration") > last - part, F.col("norm"))).alias("finish"),
        F.max(F.when(F.col("iteration") == last, -F.col("loss"))).alias("value"),
    )
    per = per.withColumns({"ratio": F.col("finish") / F.col("begin"), "__g": F.lit(0)})
    one = Bounds(1, bounds.names)
    per = xs_order(per, ["__g"], "value", "instrument", "__v", one, number=False)
    per = xs_order(per, ["__g"], "ratio", "instrument", "__r", one, number=False)
    per = per.withColumn("h", F.col("__v_avg") / F.col("__v_n") + F.col("__r_avg") / F.col("__r_n"))
    span = per.agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    per = per.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col("h") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    mean = per.groupBy("bin").agg(F.avg("h").alias("m"))
    return per.join(F.broadcast(mean), "bin").select("instrument", "bin", (1.0 / (decay**k * F.col("m") + 0.1)).alias("weight"))


def random_index(df, key, seed, rows, name):
    """A random order of the ``rows`` rows of ``df``: ``name`` counts them from 0 in the order of a digest of key and seed.

    Leading digits of the digest cut the rows into parts of about 100,000; a part's rows are numbered by themselves and start after
    the rows of the parts before. ``key`` identifies a row.
    """
    digits = 0
    while rows > 100_000 * 16**digits:
        digits += 1
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    d = df.withColumn("__digest", digest).withColumn("__part", F.substring("__digest", 1, digits))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__part").orderBy("__digest", *key)
    return d.withColumn("__own", F.row_number().over(inside) - 1).join(parts, "__part").withColumn(name, F.col("__first") + F.col("__own")).drop("__digest", "__part", "__own", "__first")


def permutation_importance(model, df, features, label="label", key=("instrument", "datetime"), bins=5, ratios=(0.8, 0.7, 0.6, 0.5, 0.4), seed=1):
    """feature, importance, bin, chosen: how much the loss grows when a column is permuted over all rows, and a sample of features.

    Importance is the mean change of the squared error over its standard deviation. The range of importances is cut into ``bins``;
    of the highest bin that holds any feature the first share of ``ratios`` is chosen at random, of the next the second, and so on.
    """
    rows = df.count()
    d = random_index(df.select(*key, label, *features), key, seed, rows, "__at")
    for i, f in enumerate(features):
        other = random_index(df.select(*key, F.col(f).alias(f"__p{i}")), key, seed + 1 + i, rows, "__at").select("__at", f"__p{i}")
        d = d.join(other, "__at")
    losses = []
    for i in range(-1, len(features)):
        inputs = [f if j != i else f"__p{i}" for j, f in enumerate(features)]
        d = VectorAssembler(inputCols=inputs, outputCol="__v", handleInvalid="keep").transform(d)
        d = model.transform(d, {model.featuresCol: "__v", model.predictionCol: f"__l{i + 1}"}).drop("__v")
        losses.append(F.pow(F.col(f"__l{i + 1}") - F.col(label), 2))
    change = [c - losses[0] for c in losses[1:]]
    one = d.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"c{i}") for i, c in enumerate(change)])
    # a row per feature from here on
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c{i}.m").alias("m"), F.col(f"c{i}.s").alias("s")) for i, f in enumerate(features)]))
    g = one.select(each.alias("e")).select("e.feature", F.coalesce(F.nanvl(F.col("e.m") / (F.col("e.s") + 1e-7), F.lit(0.0)), F.lit(0.0)).alias("importance"))
    span = g.agg(F.min("importance").alias("lo"), F.max("importance").alias("hi"))
    place = F.ceil((F.col("importance") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) - 1
    g = g.crossJoin(F.broadcast(span)).withColumn("bin", F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)).cast("int"))
    share = F.element_at(F.array(*[F.lit(float(r)) for r in ratios]), F.dense_rank().over(Window.orderBy(F.desc("bin"))))
    drawn = F.row_number().over(Window.partitionBy("bin").orderBy(F.md5(F.concat_ws("|", "feature", F.lit(str(seed)))), "feature"))
    size = F.count(F.lit(1)).over(Window.partitionBy("bin"))
    return g.withColumns({"__share": share, "__drawn": drawn, "__size": size}).select("feature", "importance", "bin", (F.col("__drawn") <= F.ceil(F.col("__share") * F.col("__size"))).alias("chosen"))
