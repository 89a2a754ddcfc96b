import random

import numpy as np
import pytest

from tidepanel.llm import maxscore


def brute(rows, k):
    good = {(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    queries = {}
    for i, v in sorted(good):
        if i % 50 == 0:
            queries.setdefault(i, v)
    out = []
    for q, v in queries.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != q)[:k]
        out += [(q, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.0, 1.0, 0.013]) for _ in range(6)]) for i in range(400)]
    rows += rows[:60] + [(50, [9.0] * 6), (7, [1.0]), (8, []), (100, [0.0] * 6), (None, [1.0] * 6), (150, None), (200, [1.0, None]), (250, [float("nan")] * 6), (9, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, shard string, score int")
    for shard, block in ((4096, 512), (37, 3)):
        got = maxscore.top_k(df, lambda i: i % 50 == 0, 5, shard=shard, block=block).collect()
        assert sorted(map(tuple, got)) == brute(rows, 5)
    few = df.where("vec_id IN (0, 1, 2)")
    assert maxscore.top_k(few, lambda i: i % 50 == 0).count() == 2
    assert maxscore.top_k(df.where("false"), lambda i: i % 50 == 0).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_shard_against_all_scores(seed):
    rng = np.random.default_rng(seed)
    n, d, k = int(rng.integers(1, 300)), int(rng.integers(1, 20)), int(rng.integers(1, 9))
    x, q = rng.integers(-40, 40, (n, d)), rng.integers(-40, 40, (10, d))
    if seed % 2:
        x[:, 0], q[:, -1] = 7, 0
    ids, own = rng.permutation(n), rng.integers(0, n, 10)
    got = list(zip(*maxscore.shard_top_k(x, ids, q, own, k)))
    want = []
    for v, o in zip(q, own):
        want += [(o, j, -s) for s, j in sorted((-int(v @ w), j) for w, j in zip(x, ids) if j != o)[:k]]
    assert got == want
