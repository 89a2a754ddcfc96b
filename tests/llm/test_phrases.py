import random
import re
from collections import Counter

import numpy as np
import pytest
from samples import TEXTS

from tidepanel.llm import phrases


def brute(docs, least, absorbed=80, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from counts of all phrases in memory."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    inside = {(lang, p[i : i + k]) for (lang, p), b in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= absorbed * f[lang, p[i : i + k]]}
    rows = []
    for (lang, p), a in candidates.items():
        if (lang, p) not in inside:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return out


def got(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def random_docs(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "é", "Ωmega", "\U0001f600", *(f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(4))])
    runs = ["new York city", "the united nations council", "Aa bb Cc dd ee"]
    text = lambda: "".join(rng.choice([word(), word(), rng.choice(runs)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(50)))
    return [(rng.choice(["en", "de", None]), text()) for _ in range(n)]


@pytest.mark.parametrize("least,place_phrases,block_words", [(3, 4_000_000, 2_000_000), (2, 50, 300), (30, 700, 40)])
def test_against_counts_in_memory(spark, monkeypatch, least, place_phrases, block_words):
    docs = random_docs(least, 300)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    # the size of a block reaches the workers with the function that reads it
    monkeypatch.setattr(phrases, "BLOCK_WORDS", block_words)
    assert got(phrases.collocations(df, least=least, place_phrases=place_phrases)) == sorted(brute(docs, least))
    assert got(phrases.collocations(df, least=least, top=5, place_phrases=place_phrases)) == sorted(brute(docs, least, top=5))


def test_odd_rows(spark, odd, none):
    docs = [("z", t) for _, t in TEXTS]
    assert got(phrases.collocations(odd, least=2)) == sorted(brute(docs, 2))
    assert got(phrases.collocations(odd)) == sorted(brute(docs, 30))
    assert phrases.collocations(none).count() == phrases.collocations(odd, least=10**9).count() == 0
    tied = [(None, " ".join(p) + ".") for p in ("ab", "ba", "éb", "zz", "\U0001f600b") for _ in range(30)]
    df = spark.createDataFrame(tied * 2, "lang string, text string")
    assert got(phrases.collocations(df)) == sorted(brute(tied * 2, 30))
    assert got(phrases.collocations(df, top=2)) == sorted(brute(tied * 2, 30, top=2))


@pytest.mark.parametrize("n", [2, 3, 4])
@pytest.mark.parametrize("bits", [2, 6, 16, 22, 30])
def test_permutation_can_be_undone_and_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(bits)
    layout = phrases.Layout(n, bits)
    columns = [rng.integers(0, 1 << min(bits, 20), 3000, dtype=np.uint64) for _ in range(n)]
    want = Counter(zip(*(c.tolist() for c in columns)))
    left, right = layout.permute(*layout.pack(columns))
    assert int(max(left.max(), right.max())) < 1 << layout.width
    back = layout.unpack(*layout.undo(left, right))
    assert all((a == b).all() for a, b in zip(columns, back))
    left, right, counts = layout.count(left, right)
    assert dict(zip(zip(*(c.tolist() for c in layout.unpack(*layout.undo(left, right)))), counts.tolist())) == want
    counts = counts * rng.choice([1, 1, 200, 255, 256, 257, 10**10], len(counts))
    data = phrases.write_filter(left, right, counts, layout.width, layout.width)
    for x, y in zip(phrases.read_filter(data, layout.width), (left, right, counts)):
        assert (x == y).all()
    empty = phrases.write_filter(left[:0], right[:0], counts[:0], layout.width, layout.width)
    assert all(len(x) == 0 for x in phrases.read_filter(empty, layout.width))


@pytest.mark.parametrize("places", [1, 8, 1024])
def test_merged_filters_of_streams(places):
    rng = np.random.default_rng(places)
    streams = [np.concatenate([rng.zipf(1.5, 2000) % 40, [0], np.full(500, 7)]) for _ in range(3)]
    pieces = {}
    for s in streams:
        for place, n, data in phrases.filters(s, 6, places):
            pieces.setdefault((place, n), []).append(data)
    found = {}
    for (place, n), datas in pieces.items():
        columns, counts = phrases.merge_filters(datas, n, 6, places, place, 3)
        found.update(zip(zip(*(c.tolist() for c in columns)), counts.tolist()))
    want = Counter(tuple(s[i : i + n].tolist()) for s in streams for n in (2, 3, 4) for i in range(len(s) - n + 1))
    assert found == {k: v for k, v in want.items() if v >= 3 and 0 not in k}


def test_entries_are_compact():
    """At most the remainder, a few bits of quotient and a bit of counter per entry."""
    rng = np.random.default_rng(1)
    layout = phrases.Layout(4, 16)
    left, right, counts = layout.count(*layout.permute(*layout.pack([rng.integers(1, 60_000, 200_000, dtype=np.uint64) for _ in range(4)])))
    assert len(phrases.write_filter(left, right, counts, layout.width, layout.width)) < 6.8 * len(left)
