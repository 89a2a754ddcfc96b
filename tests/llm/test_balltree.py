import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from samples import TEXTS

from tidepanel.llm import balltree

T = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return T.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    """(item, rank, doc, score) by scoring every document for every item."""
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c, sum(c.values())) for i, c in tfs if c]
    n_docs, n_terms = len(tfs), sum(n for _, _, n in tfs)
    df = Counter(t for _, c, _ in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in tfs:
            m = 10 + 90 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def got(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def random_docs(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("leaf,shard,block", [(1, 7, 50), (4, 100, 16_384), (32, 8192, 300)])
def test_against_all_scores(spark, leaf, shard, block):
    docs, items = random_docs(leaf, 500)
    docs += docs[:40]  # repeated rows: ties under one id
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert got(balltree.ranked(d, q, shard=shard, leaf=leaf, block_terms=block)) == brute(docs, items)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(balltree.op12_ball_tree(spark, sf)) == brute(docs, items)


def test_odd_rows(spark, odd, none):
    items = [(1, "One WORD; tail über straße"), (2, None), (3, "!!"), (None, "one"), (4, "same"), (4, "same"), (5, "two"), (5, "one"), (6, "x"), (7, "endoftext é")]
    q = spark.createDataFrame([(*i, 0, 0) for i in items], "item_id long, text string, doc_id int, score int")
    want = brute(TEXTS, [(1, items[0][1]), (4, "same"), (5, "one"), (6, "x"), (7, items[-1][1])])
    assert got(balltree.ranked(odd, q)) == want
    assert got(balltree.ranked(none, q)) == got(balltree.ranked(odd, q.where("false"))) == []


def test_bounds_hold_and_prune():
    """No row scores above a bound of a node that holds it; clustered rows are mostly not scored."""
    rng = np.random.default_rng(4)
    width, queries = 300, [np.arange(10 * k, 10 * k + 10) for k in range(30)]
    rows = []
    for r in range(3000):
        own = rng.choice(queries[r % 30], 8, replace=False) if r < 600 else np.zeros(0, int)
        rows.append(np.unique(np.concatenate([own, rng.integers(0, width, 5)])))
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    index, values = np.concatenate(rows), rng.integers(1, 10**9, ptr[-1])
    group, groups = balltree.groups_of(queries, width)
    tree = balltree.BallTree(ptr, index, values, group, groups)
    assert sorted(tree.order) == list(range(3000))
    bounds, scored = tree.bounds(queries), 0
    for q, b in zip(queries, bounds):
        exact = np.array([values[ptr[r] : ptr[r + 1]][np.isin(index[ptr[r] : ptr[r + 1]], q)].sum() for r in range(3000)])
        for (lo, hi, _), x in zip(tree.nodes, b):
            assert exact[tree.order[lo:hi]].max() <= x
        best = []
        scored += tree.search(q, b, best, 10, np.arange(3000))
        assert sorted(best, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(exact) if s), reverse=True)[:10]
    assert scored < 0.5 * 30 * 3000
