"""Many moving windows over the same rows, taken together from arrays.

A window aggregate reads its frame again for every row and every aggregate. A wide factor set holds a hundred of them; here the frames of
a block of rows are laid out once per window length, and all aggregates are taken from them. A value still depends on the rows of its own
frame only. Spark deals and sorts the rows; a task streams them in batches and carries the last rows of a batch over to the next.
"""

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers in the frames of a block of rows.
BLOCK = 65_536


def _deviations(v, given, k):
    """Distances from the mean (0 where missing), and the mean. A flat window has distances of exactly 0."""
    top = np.fmax.reduce(v, axis=1)
    d = np.where(given, v - top[:, None], 0.0)
    mean = d.sum(axis=1) / k
    return np.where(given, d - mean[:, None], 0.0), top + mean


def _dot(a, b):
    return np.einsum("ij,ij->i", a, b)


class _Frames:
    """The frames of one window length over a block of rows. ``x`` starts n - 1 rows before the block; ``at`` counts the rows of its own group
    before each row. What several aggregates read is made once."""

    def __init__(self, x, at, n):
        self.x, self.n, self.made = x, n, {}
        self.early = np.flatnonzero(at < n - 1)
        self.outside = np.arange(n - 1, -1, -1) > at[self.early, None]

    def _once(self, key, make):
        if key not in self.made:
            self.made[key] = make()
        return self.made[key]

    def _laid(self, i):
        f = sliding_window_view(self.x[i], self.n).copy()
        f[self.early] = np.where(self.outside, np.nan, f[self.early])
        return f

    def values(self, i):
        return self._once(("values", i), lambda: self._laid(i))

    def given(self, i):
        return self._once(("given", i), lambda: ~np.isnan(self.values(i)))

    def _rows(self, i):
        return self._once(("rows", i), lambda: self.given(i).sum(axis=1).astype(float))

    def _sum(self, i):
        return self._once(("sum", i), lambda: np.where(self.given(i), self.values(i), 0.0).sum(axis=1))

    def _apart(self, i):
        return self._once(("apart", i), lambda: _deviations(self.values(i), self.given(i), self._rows(i)))

    def _sorted(self, i):
        return self._once(("sorted", i), lambda: np.sort(self.values(i), axis=1))

    def _line(self, i, p):
        """Slope, mean place, and the sums of squares of places and of values."""

        def make():
            y, _ = self._apart(i)
            x, mean = _deviations(np.where(self.given(i), self.values(p), np.nan), self.given(i), self._rows(i))
            xx, xy = _dot(x, x), _dot(x, y)
            return np.where(xx > 0, xy / xx, np.nan), mean, xx, xy

        return self._once(("line", i, p), make)

    def count(self, i):
        return self._rows(i)

    def sum(self, i):
        return np.where(self._rows(i) > 0, self._sum(i), np.nan)

    def mean(self, i):
        return self._sum(i) / self._rows(i)

    def var(self, i):
        k, (d, _) = self._rows(i), self._apart(i)
        return np.where(k > 1, _dot(d, d) / (k - 1), np.nan)

    def std(self, i):
        return np.sqrt(self.var(i))

    def max(self, i):
        return np.fmax.reduce(self.values(i), axis=1)

    def min(self, i):
        return np.fmin.reduce(self.values(i), axis=1)

    def slope(self, i, p):
        return self._line(i, p)[0]

    def intercept(self, i, p):
        slope, place, *_ = self._line(i, p)
        return self._apart(i)[1] - slope * place

    def r2(self, i, p):
        _, _, xx, xy = self._line(i, p)
        y, _ = self._apart(i)
        yy = _dot(y, y)
        return np.where(xx > 0, np.where(yy > 0, xy * xy / (xx * yy), 1.0), np.nan)

    def rsquare(self, i, p):
        return np.where(self.var(i) > 4e-10, self.r2(i, p), np.nan)

    def resi(self, i, p):
        return self.values(i)[:, -1] - self.intercept(i, p) - self.slope(i, p) * self.values(p)[:, -1]

    def weighted(self, i, p):
        total = np.where(self.given(i), self.values(i) * self.values(p), 0.0).sum(axis=1)
        return np.where(self._rows(i) > 0, total, np.nan)

    def _both(self, i, j):
        """Rows with both values, and the distances of either from its mean over them."""
        both = self.given(i) & self.given(j)
        k = both.sum(axis=1)
        return k, *(_deviations(np.where(both, self.values(c), np.nan), both, k)[0] for c in (i, j))

    def cov(self, i, j):
        k, a, b = self._both(i, j)
        return np.where(k > 1, _dot(a, b) / (k - 1), np.nan)

    def corr(self, i, j):
        k, a, b = self._both(i, j)
        aa, bb, ab = (_dot(c, d) / (k - 1) for c, d in ((a, a), (b, b), (a, b)))
        flat = (self.var(i) <= 4e-10) | (self.var(j) <= 4e-10)
        return np.where(~flat & (aa > 0) & (bb > 0), ab / np.sqrt(aa * bb), np.nan)

    def quantile(self, i, q):
        place = np.maximum(self._rows(i) - 1, 0) * q
        low = np.floor(place)
        a, b = (np.take_along_axis(self._sorted(i), at.astype(int)[:, None], axis=1)[:, 0] for at in (low, np.ceil(place)))
        return a + (b - a) * (place - low)

    def rank(self, i):
        v = self.values(i)
        here = v[:, -1:]
        below = (v < here).sum(axis=1) + 0.5 * (v == here).sum(axis=1)
        return np.where(np.isnan(here[:, 0]), np.nan, (below + 0.5) / self._rows(i))


def _answers(x, at, wanted, reach):
    """A column per wanted aggregate; ``x`` has ``reach`` rows before those of ``at``."""
    out = np.empty((len(wanted), len(at)))
    with np.errstate(all="ignore"):
        for n in {n for _, _, n, _, _ in wanted}:
            rows = max(64, BLOCK // n)
            for start in range(0, len(at), rows):
                end = min(start + rows, len(at))
                frames = _Frames(x[:, reach + start - n + 1 : reach + end], at[start:end], n)
                for k, (_, kind, length, inputs, extra) in enumerate(wanted):
                    if length == n:
                        out[k, start:end] = getattr(frames, kind)(*inputs, *extra)
    return out


def attach(df, keys, w, inputs, wanted):
    """Add a column per entry (name, kind, rows of the window, places of its inputs, more arguments) of ``wanted`` to the rows of ``df``.

    ``inputs`` are columns of doubles without infinity and NaN; ``w`` orders the rows of ``keys`` by cal_ix.
    """
    reach = max(n for _, _, n, _, _ in wanted) - 1
    kept, names = list(df.columns), [f"__x{k}" for k in range(len(inputs))]
    schema = T.StructType([*df.schema.fields, *[T.StructField(w[0], T.DoubleType()) for w in wanted]])
    placed = df.withColumns({**dict(zip(names, inputs)), "__at": F.row_number().over(w)}).sortWithinPartitions(*keys, "cal_ix")

    def run(batches):
        before, last = np.full((len(names), reach), np.nan), 0
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column("__at").to_numpy()
            # a row starts a group or follows the row before it
            if not np.all((at == 1) | (at == np.append(last, at[:-1]) + 1)):
                raise ValueError("rows are not in the order of their groups")
            last = at[-1]
            x = np.hstack([before, np.vstack([b.column(c).to_numpy(zero_copy_only=False) for c in names])])
            made = _answers(x, at - 1, wanted, reach)
            before = x[:, x.shape[1] - reach :]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(v, from_pandas=True) for v in made]], names=schema.names)

    return placed.mapInArrow(run, schema)
