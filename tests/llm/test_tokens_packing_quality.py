import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import TEXTS
from tokenizers import Tokenizer

from tidepanel.llm import packing, quality, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ALPHABET = "aZé ßÀΣ́  \x1c\n\r\t '.,!12<|>世\U0001f600"


def key(x):
    return tuple((v is None, v) for v in x)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def test_counts_equal_the_library(spark, odd, library):
    got = sorted(map(tuple, tokens.token_counts(odd, BYTE).select("doc_id", "n_bytes", "n_tokens").collect()), key=key)
    want = [(i, len((t or "").encode()), len(library[0].encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS]
    assert got == sorted(want, key=key)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.op2_token_counts(spark, SF).collect():
        n = len(library[0].encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit) == (n, n > 1024)


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=400), st.integers(40, 90))
def test_spliced_chunks_equal_one_encoding(text, chunk):
    t = tokens.tokenizer(BYTE)
    encode = lambda s: t.encode(s, add_special_tokens=False)
    assert tokens.count_huge(encode, text, chunk, 4, 32)[0] == len(encode(text).ids)


def test_splicing_special_strings_and_widening():
    t = tokens.tokenizer(BYTE)
    encode = lambda s: t.encode(s, add_special_tokens=False)
    for text in ("<|endoftext|>" * 200, "a <|endoftext|>'re " * 100, "x" * 5000 + " y" * 500, "they're  we'll   'll " * 200):
        for chunk in (50, 64, 333):
            n, widened = tokens.count_huge(encode, text, chunk, 8, 32)
            assert n == len(encode(text).ids)
    assert tokens.count_huge(encode, "x" * 5000 + " y" * 500, 64, 8, 32)[1] > 0


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=200))
def test_piece_counts_and_word_ids_equal_the_library(text):
    known = tokens.piece_lookup(BYTE).many(set(tokens._cut(text)))
    assert sum(known[p] for p in tokens._cut(text)) == len(tokens.tokenizer(BYTE).encode(text, add_special_tokens=False).ids)
    ids = np.frombuffer(packing.document_ids([text], WORD)[0], "<u4").tolist()
    assert ids == tokens.tokenizer(WORD).encode(text, add_special_tokens=False).ids + [2]


def check_pieces(rows, texts, library):
    want = sorted(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t in texts)
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        assert r.length * 4 == len(r.ids) and r.length > 0
    if len(docs) == len(texts):
        got = []
        for ps in docs.values():
            ps.sort(key=lambda r: r.start)
            assert [p.start for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
            got.append(b"".join(bytes(p.ids) for p in ps))
            assert {p.doc_tokens for p in ps} == {len(got[-1]) // 4}
        assert sorted(got) == want
    assert sum(r.length for r in rows) == sum(len(w) // 4 for w in want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for ps in seqs.values():
        ps.sort(key=lambda r: r.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert sum(p.length for p in ps) <= 4096
    return len(seqs)


def test_packing(spark, odd, none, library):
    check_pieces(packing.pack(odd, WORD).collect(), TEXTS, library[1])
    assert packing.pack(none, WORD).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = packing.pack(docs, WORD).collect()
    n = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], library[1])
    assert n * 4096 < 1.02 * sum(r.length for r in rows)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pieces_with_crc(packing.pack(odd, WORD)).where("doc_id = 9").collect()}
    assert crc == {(9, 0): zlib.crc32(packing.document_ids([TEXTS[9][1]], WORD)[0])}


W = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = W.findall(text or "")
    triples = list(zip(w, w[1:], w[2:]))
    seen, cov = Counter(triples), set()
    for j, a in enumerate(triples):
        if seen[a] > 1:
            cov |= {j, j + 1, j + 2}
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cov), failed


def test_quality_base(spark, odd, none):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = sorted(map(tuple, quality.line_quality(odd).select(*names).collect()), key=key)
    assert got == sorted([(i, *base(t)) for i, t in TEXTS], key=key)
    assert quality.line_quality(none).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in quality.op1_line_quality(spark, SF).collect():
        assert tuple(r)[1:7] == base(texts[r.doc_id])


def test_line_rules(spark):
    good = [f"Line{k} is{k} a{k} sentence{k} that has{k} some{k} words{k}, and ends{k} well{k}." for k in range(8)]
    bad = ["Home | About | Contact | News", "BUY!! NOW!! CHEAP!!", "a### b$$$ c%%% d&&&", "All rights reserved.", "one two three four five six seven eight nine ten eleven twelve thirteen"]
    junk = [f"Home{k} | About{k} | Contact{k} | News{k}" for k in range(30)]
    texts = [(1, "\n".join(good + bad)), (2, "\n".join(junk + good[:1])), (3, "\n".join(bad[3:4] + good))]
    got = {r.doc_id: r for r in quality.line_quality(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in (1, 2, 3)] == [True, False, True]
    assert [got[k].clean_text for k in (1, 2, 3)] == ["\n".join(good), good[0], "\n".join(good)]
