"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores, with byte fallback.

The vocabulary file is of the merge kind and holds ranks, no probabilities. The log score of a piece is therefore that of its rank
under Zipf's law; nothing is trained. Against the library's own unigram mode with these scores, the results are the same.
"""

import math
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from tidepanel.llm.common import Lookup, slices, table, text_or_empty

MARK = "▁"
#: What an unknown character costs more than the rarest piece.
UNKNOWN_PENALTY = 10.0
#: Segments whose ids a worker keeps.
KEPT_SEGMENTS = 250_000
# marks, then other characters: no piece reaches over the border before a mark that follows another character
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def zipf_scores(n):
    """Log scores of ranks 1 to n."""
    total = math.log(sum(1 / r for r in range(1, n + 1)))
    return [-math.log(r) - total for r in range(1, n + 1)]


class DoubleArray:
    """A trie over bytes: the child of ``node`` by byte c is ``base[node] + c + 1``, if ``check`` says that it is its child."""

    def __init__(self, keys):
        """``keys``: byte string -> value of at least 0."""
        size = (1 << (2 * sum(map(len, keys))).bit_length()) + 16_384
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        low = 1
        level = [(0, sorted(keys), 0)]
        while level:
            node, words, depth = level.pop()
            if len(words[0]) == depth:
                value[node] = keys[words[0]]
                words = words[1:]
            groups = {}
            for w in words:
                groups.setdefault(w[depth], []).append(w)
            if not groups:
                continue
            codes = np.array(sorted(groups)) + 1
            at = low
            while True:
                free = np.flatnonzero(check[at : at + 4096] < 0) + at - codes[0]
                free = free[free >= 0]
                fits = free[(check[free[:, None] + codes] < 0).all(axis=1)] if len(free) else free
                if len(fits):
                    base[node] = fits[0]
                    break
                at += 4096
            check[base[node] + codes] = node
            while check[low] >= 0:
                low += 1
            level += [(int(base[node]) + c + 1, g, depth + 1) for c, g in groups.items()]
        used = int(np.flatnonzero(check >= 0).max()) + 258
        self.base, self.check, self.value = (x[:used].tolist() for x in (base, check, value))


class Unigram:
    def __init__(self, pieces, scores, byte_ids):
        """``pieces``: text -> id of the pieces that texts are cut into; ``scores`` by id; ``byte_ids``: the id of each byte."""
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece reaches over a word border")
        self.trie = DoubleArray({p.encode(): i for p, i in pieces.items()})
        self.scores, self.byte_ids = scores, byte_ids
        self.unknown = min(scores[i] for i in pieces.values()) - UNKNOWN_PENALTY
        self.lookup = Lookup(lambda keys: [array("I", self.best_path(k)).tobytes() for k in keys], KEPT_SEGMENTS)

    def best_path(self, segment):
        """Ids of the cut of ``segment`` with the largest sum of scores; of equal ones, that with the longer piece first."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        data = segment.encode()
        n = len(data)
        best, back = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = data[i]
            width = 1 if c < 128 else 2 if c < 224 else 3 if c < 240 else 4
            node, single, so_far = 0, False, best[i]
            for j in range(i, n):
                t = base[node] + data[j] + 1
                if check[t] != node:
                    break
                node = t
                v = value[t]
                if v >= 0:
                    if so_far + scores[v] > best[j + 1]:
                        best[j + 1], back[j + 1] = so_far + scores[v], (i, v)
                    single = single or j + 1 - i == width
            if not single and so_far + self.unknown > best[i + width]:
                best[i + width], back[i + width] = so_far + self.unknown, (i, -1)
            i += width
        ids = []
        while n:
            i, v = back[n]
            # from right to left: the bytes of an unknown character as well
            ids += [v] if v >= 0 else [self.byte_ids[b] for b in reversed(data[i:n])]
            n = i
        return ids[::-1]

    def encode(self, texts):
        """Little-endian ids of each text. A mark is put before it, every space becomes a mark; an empty text has no ids."""
        cut = [_SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.lookup.many(set().union(*cut))
        return [b"".join(map(known.__getitem__, c)) for c in cut]


class Decoder:
    def __init__(self, by_id, byte_ids):
        self.raw = [p.encode() for p in by_id]
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])

    def decode(self, ids):
        """The text of little-endian ids: marks become spaces, but for the first one; byte pieces are joined before they are read."""
        raw = b"".join(map(self.raw.__getitem__, array("I", ids)))
        return raw.decode(errors="replace").replace(MARK, " ").removeprefix(" ")


@lru_cache(maxsize=2)
def load(path):
    """(encoder, decoder) of a vocabulary file."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    by_id = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    normal = {p: i for i, p in enumerate(by_id) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    return Unigram(normal, zipf_scores(n), byte_ids), Decoder(by_id, byte_ids)


def encode_pieces(docs, path, id_column="doc_id", text_column="text"):
    """Per row: ``id_column``, n_pieces, n_byte_pieces, ids (little-endian unsigned 32 bit).

    Null texts count as empty and have no pieces; repeated rows each give a row; null ids stay; other columns are not carried.
    Nothing is shuffled. A word is decoded once per worker while it is kept there.
    """

    def run(batches):
        encoder, _ = load(path)
        is_byte = np.zeros(len(encoder.scores), bool)
        is_byte[encoder.byte_ids] = True
        for ids, texts in slices(batches):
            out = encoder.encode(texts)
            fallback = [int(is_byte[np.frombuffer(x, "<u4")].sum()) for x in out]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(fallback, pa.int64()), pa.array(out, pa.binary())], names=["id", "n_pieces", "n_byte_pieces", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, "id long, n_pieces long, n_byte_pieces long, ids binary").withColumnRenamed("id", id_column)


def decode_pieces(encoded, path, id_column="doc_id"):
    """The columns of ``encode_pieces`` with ids replaced by ids_crc32 and the decoded text."""

    def run(batches):
        _, decoder = load(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = part.column("ids").to_pylist()
                columns = [part.column(x) for x in (id_column, "n_pieces", "n_byte_pieces")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(list(map(decoder.decode, ids)), pa.string())], names=[id_column, "n_pieces", "n_byte_pieces", "ids_crc32", "text"])

    return encoded.mapInArrow(run, f"{id_column} long, n_pieces long, n_byte_pieces long, ids_crc32 long, text string")


def op3_pieces(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
