"""Window aggregates as Columns. ``w`` is an ordered window spec, ``n`` the row count (0 = expanding)."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def frame(w, n):
    return w.rowsBetween(Window.unboundedPreceding if n == 0 else -(n - 1), 0)


def _null_nan(c):
    return F.when(~F.isnan(c), c)


def highest(x, w, n):
    return F.max(x).over(frame(w, n))


def lowest(x, w, n):
    return F.min(x).over(frame(w, n))


def skew(x, w, n):
    """Bias-corrected skewness, three values at least."""
    f = frame(w, n)
    k = F.count(x).over(f)
    s = _null_nan(F.skewness(x).over(f))
    return F.when((k >= 3) & (F.var_samp(x).over(f) > 1e-14), s * F.sqrt(k * (k - 1)) / F.when(k > 2, k - 2))


def kurt(x, w, n):
    """Bias-corrected excess kurtosis, four values at least."""
    f = frame(w, n)
    k = F.count(x).over(f).cast("double")
    g = _null_nan(F.kurtosis(x).over(f))
    scale = (k - 1) / F.when(k > 3, (k - 2) * (k - 3))
    return F.when((k >= 4) & (F.var_samp(x).over(f) > 1e-14), scale * ((k + 1) * g + 6))


def mad(x, w, n):
    """Mean absolute distance from the mean of the window."""
    f = frame(w, n)
    m = F.avg(x).over(f)
    values = F.collect_list(x).over(f)
    far = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.abs(v - m))
    return far / F.when(F.size(values) > 0, F.size(values))


def rank_in_list(x, values):
    """Percentile rank of the current value in its window, ties averaged."""
    below = F.aggregate(
        values, F.lit(0.0), lambda acc, v: acc + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0)
    )
    return F.when(x.isNotNull(), (below + 0.5) / F.size(values))


def quantile_of_list(ordered, q):
    at = (F.size(ordered) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.ceil(at).cast("int"))
    return a + (b - a) * (at - low)


def idx_max(x, w, n, pos):
    """1-based place of the first maximum, counted from the oldest row; a missing row takes precedence."""
    f = frame(w, n)
    best = F.max(F.struct(x.isNull().alias("m"), x.alias("v"), (-pos).alias("p"))).over(f)
    return (-best["p"] - (pos - F.count(F.lit(1)).over(f))).cast("double")


def idx_min(x, w, n, pos):
    f = frame(w, n)
    best = F.min(F.struct(x.isNotNull().alias("m"), x.alias("v"), pos.alias("p"))).over(f)
    return (best["p"] - (pos - F.count(F.lit(1)).over(f))).cast("double")


def wma_of_sums(k, s, sp, rows, place):
    """Linear weights scaled to one and then averaged once more over the non-null rows, as the reference defines it."""
    return (sp - (place - rows) * s) / (rows * (rows + 1) / 2.0) / F.when(k > 0, k)


def corr_of_vars(cov, px, py, vx, vy):
    """Pairwise complete; null when one of the two windows is flat (standard deviation within 2e-5 of zero)."""
    flat = F.coalesce(vx <= 4e-10, F.lit(False)) | F.coalesce(vy <= 4e-10, F.lit(False))
    return F.when(~flat & (px > 0) & (py > 0), cov / F.sqrt(px * py))


def last_valid(x, w):
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def next_valid(x, w):
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
