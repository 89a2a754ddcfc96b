import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from samples import TEXTS

from tidepanel.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(field, body):
    return varint(field << 3 | 2) + varint(len(body)) + body


@pytest.fixture(scope="module")
def library():
    """The library in its unigram mode: the same pieces with the Zipf scores."""
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    scores, out = pieces.zipf_scores(sp.get_piece_size()), b""
    for i, s in enumerate(scores):
        kind = 2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 6 if sp.is_byte(i) else 1
        out += message(1, message(1, sp.id_to_piece(i).encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(kind))
    out += message(2, varint(3 << 3) + b"\x01" + varint(35 << 3) + b"\x01")
    out += message(3, message(1, b"identity") + varint(3 << 3) + b"\x01" + varint(4 << 3) + b"\x00" + varint(5 << 3) + b"\x01")
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_equals_library_unigram(spark, library):
    encoder, decoder = pieces.load(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = sorted({w for t in texts for w in t.split()})[::3] + ["", " ", "  a", "a  b ", "\U0001f600é\n\tx", "日本語 テスト", "\x00́", "  \n  x"]
    mine = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(words)]
    theirs = library.encode(words, num_threads=1)
    total = lambda ids: sum(encoder.scores[i] if i not in encoder.byte_ids else 0 for i in ids)
    different = [w for w, a, b in zip(words, mine, theirs) if a != b]
    # sums of equal scores in another order may round to either side
    assert len(different) < 0.005 * len(words)
    assert all(abs(total(a) - total(b)) < 1e-4 and sorted(a) == sorted(b) for a, b in zip(mine, theirs) if a != b)
    for w, x in zip(words, encoder.encode(words)):
        assert decoder.decode(x) == w == (library.decode(np.frombuffer(x, "<u4").tolist()) if w else w)


def test_best_path_equals_enumeration():
    rng = random.Random(1)
    for _ in range(200):
        parts = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 3))) for _ in range(6)} | {"▁a"}
        ids = {p: i for i, p in enumerate(sorted(parts))}
        scores = [-rng.random() * 5 for _ in ids] + [0.0] * 256
        u = pieces.Unigram(ids, scores, list(range(len(ids), len(ids) + 256)))
        text = "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))

        def value(cut):
            return sum(scores[ids[p]] if p in ids else u.unknown if len(p) == 1 else -1e9 for p in cut)

        best = max(value([text[a:b] for a, b in zip((0, *c), (*c, len(text)))]) for n in range(len(text)) for c in itertools.combinations(range(1, len(text)), n))
        back = {i: p for p, i in ids.items()}
        got, raw = 0.0, b""
        for i in u.best_path(text):
            if i in back:
                got += scores[i]
                raw += back[i].encode()
            else:
                raw += bytes([i - len(ids)])
                got += u.unknown if (i - len(ids)) & 0xC0 != 0x80 else 0.0
        assert raw.decode() == text and abs(got - best) < 1e-9


def test_rows(spark, odd, none):
    rows = pieces.decode_pieces(pieces.encode_pieces(odd, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == sorted((str(i), t or "") for i, t in TEXTS)
    assert pieces.encode_pieces(none, PATH).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encoder, _ = pieces.load(PATH)
    for r in pieces.op3_pieces(spark, "/root/testdata/sf0.001").collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        ids = encoder.encode([texts[r.doc_id]])[0]
        assert (r.n_pieces, r.ids_crc32) == (len(ids) // 4, zlib.crc32(ids))
