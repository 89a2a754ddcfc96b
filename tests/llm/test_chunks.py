import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from samples import TEXTS
from tokenizers import Tokenizer

from tidepanel.llm import chunks, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(np.array(i, "<u4").tobytes(), t.decode(i, skip_special_tokens=False)) for i in ids]


def cut(texts, **sizes):
    data, offsets = chunks._texts(pa.array(texts, pa.string()))
    raw = data.tobytes()
    return [[raw[a:b] for a, b in zip(x, x[1:])] for x in chunks.cut(data, offsets, **sizes)]


def test_whole_tables_against_the_library(spark):
    for sf in ("0.001", "0.01"):
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()}
        want = dict(zip(docs, library(docs.values())))
        rows = chunks.op13_bpe_chunks(spark, f"/root/testdata/sf{sf}").collect()
        assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {
            k: (len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for k, (i, d) in want.items()
        }


def test_odd_rows(spark, odd, none):
    rows = chunks.encode(odd, PATH).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids), r.decoded) for r in rows)
    assert got == sorted((i is None, i or 0, *x) for (i, _), x in zip(TEXTS, library([t for _, t in TEXTS])))
    assert chunks.encode(none, PATH).count() == 0


def test_small_chunks_and_joins_inside_words():
    """Chunks of a few bytes: every join falls into words, marks, combining characters or special strings."""
    rng = random.Random(2)
    alphabet = ["a", "é", "é", "İ", "ΑΣ ", " ", "  ", "\n", "\xa0", "\x1c", "'s", "'re", "12", "中", "\U0001f600", "<|endoftext|>", "<|start", "the ", "Ing "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(300)]
    for least in (1, 7, 40):
        lists = cut(texts, average=16, least=least)
        assert [b"".join(x).decode() for x in lists] == texts
        assert list(chunks.Codec(PATH).encode(lists)) == library(texts)


def test_shared_passages_fall_into_equal_chunks():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(3000))
    texts = [" ".join(word() for _ in range(50 + n)) + " " + passage + " " + word() for n in range(20)]
    codec = chunks.Codec(PATH)
    assert list(codec.encode(cut(texts))) == library(texts)
    assert codec.encoded < 3 * len(passage) / chunks.AVERAGE + 6 * len(texts)


def test_a_guard_that_disagrees_joins_neighbours():
    class Wrong(chunks.Codec):
        def repair(self, joins):
            super().repair(joins)
            if len(self.joins) > 20:  # every join but the last ones is refused once
                self.joins = {j: None if j[0] and j[2] else v for j, v in self.joins.items()}

    texts = [" ".join(f"word{n} Other{n}" for n in range(600))]
    assert list(Wrong(PATH).encode(cut(texts, average=64, least=16))) == library(texts)


def test_memory_of_chunks_is_bounded():
    codec = chunks.Codec(PATH, limit=10_000)
    for n in range(20):
        text = " ".join(f"w{n}x{i}" for i in range(2000))
        list(codec.encode(cut([text])))
        assert codec.held <= 10_000 + len(text)


def test_special_strings_keep_their_case():
    """Only the exact string is a special token, here and where words are packed."""
    texts = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "Über <|StartOfText|>x Y"]
    want = [i for i, _ in library(texts)]
    assert [i for i, _ in chunks.Codec(PATH).encode(cut(texts))] == want
    assert [i[:-4] for i in packing.document_ids(texts, PATH)] == want
