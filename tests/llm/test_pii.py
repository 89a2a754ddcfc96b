import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import TEXTS

from tidepanel.llm import pii

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute(text):
    """The contract's patterns, taken as they stand."""
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text("a.Z@-+ 0123459()é\n%_", max_size=60))
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["a@b@c.d@e.f", "x.@a.b..c@d.e", "@a.b", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (234) 555-1234 +44", "9999.1.1.1 0001.2.3.4", "a" * 200_000, "1" * 50_000, "1." * 30_000, "+1" * 30_000, "a@" * 20_000])
def test_patterns_on_hard_texts(text):
    got = pii.base_spans(text)
    if len(text) < 100:
        assert got == brute(text)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    transitions, first = rng.normal(size=(4, 4)), rng.normal(size=4)
    seqs = [[rng.normal(size=4) for _ in range(n)] for n in (1, 5, 3, 5, 2, 1)]
    for e, path in zip(seqs, pii.viterbi(seqs, transitions, first)):
        total = lambda p: first[p[0]] + sum(e[i][y] for i, y in enumerate(p)) + sum(transitions[a, b] for a, b in zip(p, p[1:]))
        assert tuple(path) == max(itertools.product(range(4), repeat=len(e)), key=total)


FOUND = [("please call (617) 555-0100 tomorrow", "phone:12:26"), ("or to kim [at] example [dot] com now", "email:6:32"), ("my phone 617-555-0100.", "phone:9:21"), ("mail kim @ example.com ok", "email:5:22")]
CLEAN = ["at 10:30 on 2021-03-04 the 3 men", "look at the dot com", "order 4845168114407329 was sent", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" with', "version 1.2.3 of 2020", "pages 3-7, 12 and 1999"]


def test_field_on_unseen_texts():
    """Held-out lines: what the patterns miss is found, clean lines stay clean."""
    texts = [t for t, _ in FOUND] + CLEAN
    bases = [brute(t) for t in texts]
    found = [pii.written(x) for x in pii.tagger().extra_spans(texts, bases)]
    assert found == [s for _, s in FOUND] + [""] * len(CLEAN) and not pii.written(bases[0])


def test_query_rows(spark, odd, none):
    rows = pii.find_pii(odd, keep=["lang", "n_chars"], mask=True).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = next(t for i, t in TEXTS if i == r.doc_id) or ""
        want = brute(text)
        assert r.base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k in range(4)] and r.lang == "z"
    assert [r.masked for r in rows if r.doc_id is None] == ["a text without an id, mail <email>"]
    assert pii.find_pii(none).count() == 0


def test_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in pii.op10_pii(spark, "/root/testdata/sf0.001").collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert set(pii.written(want).split(",")) <= set(r.spans.split(","))


@pytest.mark.parametrize("text, want", [("mail bob AT example DOT org please", "email:5:27"), ("contact sales [AT] example [DOT] com for prices", "email:8:36"), ("write to jane Dot doe At example Dot com soon", "email:9:40")])
def test_capitals_are_decoded(text, want):
    assert pii.written(pii.tagger().extra_spans([text], [pii.base_spans(text)])[0]) == want


def test_a_long_numeric_text_beside_many_short_ones():
    """Memory follows the words, not the longest text times the number of texts; paths do not depend on the company."""
    import tracemalloc

    rng = np.random.default_rng(2)
    emissions = [rng.standard_normal((n, 9)) for n in [40_000, *rng.integers(1, 12, 1500).tolist()]]
    transitions, first = rng.standard_normal((9, 9)), rng.standard_normal(9)
    tracemalloc.start()
    paths = pii.viterbi(emissions, transitions, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert all(paths[i] == pii.viterbi([emissions[i]], transitions, first)[0] for i in range(0, len(emissions), 50))
    digits = " ".join(str(n) for n in rng.integers(0, 10**6, 300_000).tolist())
    found = pii.tagger().extra_spans([digits, FOUND[0][0]], [brute(digits), brute(FOUND[0][0])])
    assert pii.written(found[1]) == FOUND[0][1]
