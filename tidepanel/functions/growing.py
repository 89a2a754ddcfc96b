"""Order statistics of all rows so far, without a list of the history.

The values of an instrument are ranked once over its whole life. Written in digits of base ``FAN``, a rank is a path through
a tree whose nodes hold ``FAN`` children each. Running counts per node say how many of the values up to a row lie under every
child, so a path is followed digit by digit. An instrument, which the calendar bounds, is walked once in time order with the
counts of its tree; nothing is made per row but the answer. The work is rows times levels, and levels grow with the logarithm of
the rows.

Each function returns a table (instrument, cal_ix, ``out``) to join to the panel; rows without an answer are missing from it.
"""

from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Children of a node: two levels reach 1,024 rows of an instrument, three 32,768.
FAN = 32


class _Tree:
    """Counts (or, started with 0.0, sums) of the ranks below ``size`` that were added so far, per node."""

    def __init__(self, size, fan, zero=0):
        self.fan, self.levels = fan, [[zero] * fan * -(-size // fan)]
        while len(self.levels[-1]) > fan:
            nodes = len(self.levels[-1]) // fan
            self.levels.append([zero] * fan * -(-nodes // fan))

    def add(self, rank, what):
        for counts in self.levels:
            counts[rank] += what
            rank //= self.fan

    def below(self, place):
        """What was added at ranks below ``place``."""
        total = 0
        for counts in self.levels:
            total += sum(counts[place - place % self.fan : place])
            place //= self.fan
        return total

    def find(self, k):
        """The rank at which the k-th of the added ones stands, from 0."""
        at = 0
        for counts in reversed(self.levels):
            at *= self.fan
            while k >= counts[at]:
                k -= counts[at]
                at += 1
        return at


def _walked(df, column, out, walk):
    """The table of ``walk(x, order)``, which gives an answer or None for every row of an instrument in time order; ``order`` are the places
    of its values (missing ones left out) by size and time."""

    def run(t):
        t = t.sort_by("cal_ix")
        values = t.column("x").combine_chunks()
        known = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
        order = known[np.argsort(values.drop_null().to_numpy(), kind="stable")]
        answers = pa.array(walk(values.to_pylist(), order.tolist()), pa.float64())
        made = pa.table([t.column("instrument"), t.column("cal_ix"), answers], names=["instrument", "cal_ix", out])
        return made.filter(answers.is_valid())

    rows = df.select("instrument", "cal_ix", F.col(column).cast("double").alias("x"))
    kinds = dict(rows.dtypes)
    return rows.groupBy("instrument").applyInArrow(run, f"instrument {kinds['instrument']}, cal_ix {kinds['cal_ix']}, {out} double")


def quantile(df, column, out, q):
    """Linear-interpolated quantile of the values so far."""
    fan, q = FAN, float(q)

    def walk(x, order):
        tree, rank, n, answers = _Tree(len(order) or 1, fan), dict(zip(order, range(len(order)))), 0, []
        for k, v in enumerate(x):
            if v is not None:
                tree.add(rank[k], 1)
                n += 1
            if not n:
                answers.append(None)
                continue
            at = (n - 1) * q
            low, high = floor(at), ceil(at)
            a = x[order[tree.find(low)]]
            b = a if high == low else x[order[tree.find(high)]]
            answers.append(a + (b - a) * (at - low))
        return answers

    return _walked(df, column, out, walk)


def rank(df, column, out):
    """Percentile rank of the current value among those so far, ties averaged."""
    fan = FAN

    def walk(x, order):
        tree, first, same, answers = _Tree(len(order) or 1, fan), {}, {}, []
        # equal values share the rank of the first of them
        for r, k in enumerate(order):
            first.setdefault(x[k], r)
        n = 0
        for v in x:
            if v is None:
                answers.append(None)
                continue
            tree.add(first[v], 1)
            n, same[v] = n + 1, same.get(v, 0) + 1
            answers.append((tree.below(first[v]) + (same[v] + 1) / 2) / n)
        return answers

    return _walked(df, column, out, walk)


def mean_distance(df, column, out):
    """Mean absolute distance of the values so far from their mean: values below the mean are counted and summed."""
    fan = FAN

    def walk(x, order):
        size = len(order) or 1
        counts, sums, rank = _Tree(size + 1, fan), _Tree(size + 1, fan, 0.0), dict(zip(order, range(len(order))))
        totals = np.cumsum([0.0 if v is None else v for v in x])
        numbers = np.cumsum([v is not None for v in x])
        means = totals / np.maximum(numbers, 1)
        # the place of a mean among all values of the instrument
        places = np.searchsorted(np.array([x[k] for k in order], float), means, side="left").tolist()
        answers = []
        for k, (v, n, mean, place) in enumerate(zip(x, numbers.tolist(), means.tolist(), places)):
            if v is not None:
                counts.add(rank[k], 1)
                sums.add(rank[k], v)
            # distances above and below the mean are equal
            answers.append(2 * (mean * counts.below(place) - sums.below(place)) / n if n else None)
        return answers

    return _walked(df, column, out, walk)
