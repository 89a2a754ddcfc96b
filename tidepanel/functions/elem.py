"""Element-wise Column functions under one missing-value policy.

Missing is null (never NaN), infinity is a value, comparisons are never null.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def lift(x):
    return x if isinstance(x, Column) else F.lit(float(x) if isinstance(x, int) and not isinstance(x, bool) else x)


def no_nan(c):
    return F.when(~F.isnan(c), c)


def finite(c):
    """Infinity and NaN become null: rolling statistics leave them out."""
    return F.when(F.abs(c) < INF, c)


def power(a, b):
    return no_nan(F.pow(lift(a), lift(b)))


def div(a, b):
    """x/0 is signed infinity, 0/0 is missing."""
    a, b = lift(a), lift(b)
    return F.when(b != 0, a / b).otherwise(F.when((b == 0) & (a != 0), a * INF))


def quotient(a, b):
    """Division of floating-point numbers by their own rules: x/0 is signed infinity, 0/0 is NaN."""
    return F.when(b == 0, a * INF).otherwise(a / F.when(b != 0, b))


def log(a):
    return F.when(a > 0, F.ln(a)).when(a == 0, F.lit(-INF))


def sign(a):
    return F.signum(a.cast("double"))


def greater(a, b):
    a, b = lift(a), lift(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def less(a, b):
    a, b = lift(a), lift(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def _compare(op, missing):
    def fn(a, b):
        return F.coalesce(op(lift(a), lift(b)), F.lit(missing))

    return fn


gt = _compare(lambda a, b: a > b, False)
ge = _compare(lambda a, b: a >= b, False)
lt = _compare(lambda a, b: a < b, False)
le = _compare(lambda a, b: a <= b, False)
eq = _compare(lambda a, b: a == b, False)
ne = _compare(lambda a, b: a != b, True)


def if_else(cond, a, b):
    """A missing condition counts as true."""
    return F.when(F.coalesce(cond, F.lit(True)), lift(a)).otherwise(lift(b))


def is_null(a):
    return F.isnull(a) | F.coalesce(F.isnan(a), F.lit(False))


def is_inf(a):
    return F.coalesce(F.abs(a) == INF, F.lit(False))


def try_ratio(a, b):
    """Null on a zero or missing denominator (report tables)."""
    return lift(a) / F.when(lift(b) != 0, lift(b))
