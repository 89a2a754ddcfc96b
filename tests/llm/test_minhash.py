import random
import re

import numpy as np
import pytest
from samples import TEXTS

from tidepanel.llm import minhash

W = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text, k):
    w = W.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k):
    """Components over all pairs that share a shingle."""
    sets, root = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i in sorted(texts):
        near = {}
        for s in sets[i]:
            for j in where.get(s, ()):
                near[j] = near.get(j, 0) + 1
            where.setdefault(s, []).append(i)
        for j, n in near.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(spark):
    for sf in ("0.001", "0.01"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert got(minhash.op7_near_duplicates(spark, f"/root/testdata/sf{sf}")) == brute(texts, 2)


def test_hard_groups(spark):
    """Groups around the threshold, chains, and a bucket that a common passage fills."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts, n = {}, 0
    for size, edits in ((60, 7), (400, 4), (400, 9), (3, 5), (40, 12)):
        seed = [word() for _ in range(110)]
        for _ in range(size):
            w = list(seed)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(len(w))] = word()
            texts[n] = " ".join(w)
            n += 1
    w = [word() for _ in range(100)]
    for _ in range(60):  # a chain: each differs a little from the one before
        w = [word(), *w[:-1]] if rng.random() < 0.5 else [*w[3:], word(), word(), word()]
        texts[n] = " ".join(w)
        n += 1
    passage = " ".join(word() for _ in range(70))
    for _ in range(700):
        texts[n] = passage + " " + " ".join(word() for _ in range(40))
        n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    for k in (2, 5):
        assert got(minhash.near_duplicates(df, k=k)) == brute(texts, k)


def test_odd_rows(spark, odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(TEXTS)
    want = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 12}
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300, 3000])
def test_sketch_is_filled_and_concentrated(n):
    t, rng = 112, np.random.default_rng(n)
    seeds = minhash.round_seeds(t)
    errors = []
    for _ in range(20):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: max(1, int(0.8 * n))], rng.integers(0, 2**63, n // 10, dtype=np.uint64)])
        x, y = minhash.sketch(np.unique(a), t, seeds), minhash.sketch(np.unique(b), t, seeds)
        assert (x != minhash._EMPTY).all()
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((x == y).mean() - j)
    assert abs(np.mean(errors)) < 0.04 and np.max(np.abs(errors)) < 0.25


def test_texts_are_dealt_once_and_only_where_sketches_leave_a_pair_open(spark, monkeypatch):
    """A large bucket of texts that share a passage and nothing else, and one pair: what is dealt with a text does not grow with the buckets."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(70))
    texts = {n: passage + " " + " ".join(word() for _ in range(60)) for n in range(300)}
    texts[300] = texts[7] + " " + word()
    rows, write = {}, minhash.materialize

    def counted(df, tag):
        out = write(df, tag)
        rows.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert got(minhash.near_duplicates(df)) == brute(texts, 2)
    assert len(rows["texts"]) == 1 and rows["texts"][0] <= len(texts)
    assert 4 * sum(rows["candidates"]) < sum(rows["open"])


def test_a_bucket_is_dealt_in_proportion_to_its_members(spark):
    n = 2 * minhash.MINORS
    members = spark.range(n).selectExpr("1L AS key", "0 AS last", "unhex(hex(id)) AS node", "unhex(hex(id % 2 * id)) AS root", "9L AS n_shingles", "unhex('') AS sketch")
    dealt = minhash._dealt(members.selectExpr("*", f"{n}L AS n", "unhex(hex(0L)) AS main", f"{n // 2}L AS minors")).groupBy("block", "chunk").count().collect()
    assert sum(r["count"] for r in dealt) <= n + n // 2 * n // minhash.BLOCK and len(dealt) == n // minhash.BLOCK


def test_every_pair_of_a_bucket_is_looked_at_however_large_it_is(spark, monkeypatch):
    """A pair that shares one band only, in a bucket of many different texts."""
    texts = {n: " ".join(f"w{n}x{i}" for i in range(30)) for n in range(40)}
    texts[9] = texts[8] + " more"
    marks = np.arange(40 * 112, dtype=np.uint32).reshape(40, 28, 4)
    marks[:, 0] = 7
    marks[9, 1:, :3] = marks[8, 1:, :3]
    made = spark.createDataFrame([(n, bytearray(m.tobytes())) for n, m in enumerate(marks)], "id long, sketch binary")
    real = minhash.sketches
    monkeypatch.setattr(minhash, "sketches", lambda *args: real(*args).drop("sketch").join(made, "id"))
    monkeypatch.setattr(minhash, "MINORS", 8)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    hashes = sorted((minhash.set_digest(minhash.shingle_set(t, 2)), n) for n, t in texts.items())
    assert {hashes[0][1], hashes[-1][1]}.isdisjoint({8, 9})  # neither is a hub
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert got(minhash.near_duplicates(df)) == brute(texts, 2)


def test_sketches_rule_out_no_pair(spark):
    """Two sets alike whose sketches have next to nothing in common are left for the full sets, two that differ are not."""
    a = minhash.shingle_set(" ".join(f"w{i}" for i in range(100)), 2)
    rows = [(bytearray(bytes([n])), len(s), bytearray(np.arange(n * 112, n * 112 + 112, dtype=np.uint32).tobytes()), bytearray(minhash.counts(s).tobytes())) for n, s in ((1, a), (2, a[5:]), (3, a[:60]))]
    reps = spark.createDataFrame(rows, "set_hash binary, n_shingles long, sketch binary, counts binary")
    pairs = spark.createDataFrame([(rows[0][0], r[0], 3) for r in rows[1:]], "hub binary, node binary, n long")
    assert [(bytes(r.hub), bytes(r.node)) for r in minhash.alike(pairs, reps, 28, 4, 80).collect()] == [(b"\x01", b"\x02")]


def test_counts_bound_what_two_sets_share():
    rng = np.random.default_rng(1)
    for n in (1, 5, 90, 2000, 90_000):
        for share in (0.3, 0.75, 0.8, 0.9, 1.0):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[: max(1, int(share * n))], rng.integers(0, 2**63, n // 8, dtype=np.uint64)])
            x, y = minhash.counts(a), minhash.counts(b)
            both = max(1, int(share * n))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert minhash.may_reach(x, y, len(a), len(b), 80)
    assert not minhash.may_reach(minhash.counts(a[:90]), minhash.counts(a[45:135]), 90, 90, 80)
