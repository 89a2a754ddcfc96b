"""Encoding and decoding by a byte-pair vocabulary with reuse of content-defined chunks.

A rolling hash over the bytes of a text says where a chunk ends, so passages that documents share fall into equal chunks
wherever they stand. A worker encodes a chunk once. At a join the two chunks may cut a word: the text around it, with the words
next to it as guards, is encoded again, and taken once the guards come out as the chunks have them; until then neighbouring
chunks are joined and encoded again.
"""

import re
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tidepanel.llm.common import table, text_or_empty
from tidepanel.llm.packing import word_lookup
from tidepanel.llm.tokens import tokenizer

#: Bytes of a chunk on average (a power of two) and at least; bytes that the rolling hash sees.
AVERAGE, LEAST, SEEN = 1024, 128, 32
#: Bytes of text whose chunks a worker keeps.
KEPT_BYTES = 24 << 20

# White space that no normal form, lower case or token reaches over, so a text encodes as the parts between it do.
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
# One random-looking value a byte: the golden ratio's multiples, mixed.
_GEAR = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_GEAR = ((_GEAR ^ (_GEAR >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)


def rolling_hash(data):
    """Per byte, a hash of the ``SEEN`` bytes that end there: each doubling adds the hash of the half before."""
    h = _GEAR[data]
    s = 1
    while s < SEEN:
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
        s *= 2
    return h


def cut(data, offsets, average=AVERAGE, least=LEAST):
    """Chunk borders of each text of ``data`` (bytes, as numbers), which reaches from ``offsets[i]`` to ``offsets[i + 1]``."""
    at = np.flatnonzero(rolling_hash(data) < np.uint32((1 << 32) // average)) + 1
    at = at[at < len(data)]
    at = at[(data[at] & 0xC0) != 0x80]  # never inside a character
    out = []
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        borders = [lo]
        for p in at[np.searchsorted(at, lo + SEEN) : np.searchsorted(at, hi)].tolist():
            if p - borders[-1] >= least:
                borders.append(p)
        out.append([*borders, hi])
    return out


class Codec:
    """Encodes texts chunk by chunk and keeps the chunks of ``limit`` bytes. ``encoded`` counts those that were not known."""

    def __init__(self, path, limit=KEPT_BYTES, average=AVERAGE, least=LEAST):
        self.full, self.words, self.limit, self.average, self.least = tokenizer(path), word_lookup(path), limit, average, least
        size = max(self.full.get_vocab().values()) + 1
        self.tokens = [self.full.id_to_token(i) or "" for i in range(size)]
        self.known, self.joins, self.held, self.encoded = {}, {}, 0, 0

    def spell(self, ids):
        """What the library decodes: without a decoder of its own, the vocabulary's tokens with a space between them."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _ids(self, word):
        return self.words.many({word})[word]

    def learn(self, chunks):
        """Encode the chunks that are not known, each alone: (head, words, ids of the words, their spelling, tail). Head and tail may
        be parts of words; a chunk with fewer than two whole words has nothing to hold on to and is None."""
        fresh = [c for c in dict.fromkeys(chunks) if c not in self.known]
        parts = [_SPACE.split(c.decode()) for c in fresh]
        known = self.words.many({w for p in parts for w in p[1:-1]})
        for c, p in zip(fresh, parts):
            body = p[1:-1]
            if len(body) < 2:
                self.known[c] = None
            else:
                ids = b"".join(map(known.__getitem__, body))
                self.known[c] = p[0], ((body[0], known[body[0]]), (body[-1], known[body[-1]])), ids, self.spell(ids), p[-1]
            self.held += len(c)
        self.encoded += len(fresh)

    def repair(self, joins):
        """Ids of each middle of (left guard, middle, right guard), guards being (text, ids) or None at the ends of a text."""
        fresh = [j for j in dict.fromkeys(joins) if j not in self.joins]
        windows = [" ".join([*([a[0]] if a else []), m, *([b[0]] if b else [])]) for a, m, b in fresh]
        for j, e in zip(fresh, self.full.encode_batch_fast(windows, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4").tobytes()
            left, right = j[0][1] if j[0] else b"", j[2][1] if j[2] else b""
            agreed = len(ids) >= len(left) + len(right) and ids.startswith(left) and ids.endswith(right)
            ids = ids[len(left) : len(ids) - len(right)] if agreed else None
            self.joins[j] = None if ids is None else (ids, self.spell(ids))

    def encode(self, chunk_lists):
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text, given as its chunks."""
        if self.held > self.limit:
            self.known, self.joins, self.held = {}, {}, 0
        self.learn([c for chunks in chunk_lists for c in chunks])
        plans = []
        for chunks in chunk_lists:
            plan, guard, pending = [], None, ""
            for c in chunks:
                entry = self.known[c]
                if entry is None:
                    pending += c.decode()
                    continue
                head, (first, last), ids, spelling, tail = entry
                plan += [(guard, pending + head, first), (ids, spelling)]
                guard, pending = last, tail
            plans.append([*plan, (guard, pending, None)])
        self.repair([p for plan in plans for p in plan if len(p) == 3])
        for chunks, plan in zip(chunk_lists, plans):
            parts = [self.joins[p] if len(p) == 3 else p for p in plan]
            if None in parts:
                # a guard came out differently: with neighbours joined there are half as many joins, at last none
                if len(chunks) > 1:
                    yield from self.encode([[a + b for a, b in zip_longest(chunks[::2], chunks[1::2], fillvalue=b"")]])
                    continue
                ids = np.array(self.full.encode(b"".join(chunks).decode(), add_special_tokens=False).ids, "<u4").tobytes()
                parts = [(ids, self.spell(ids))]
            yield b"".join(p[0] for p in parts), " ".join(p[1] for p in parts if p[0])


@lru_cache(maxsize=2)
def codec(path):
    return Codec(path)


def _texts(column):
    """The bytes of an Arrow string column and the offsets of its texts."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]).tolist()


def encode(docs, path, id_column="doc_id", text_column="text", rows=128):
    """``id_column``, ids (little-endian unsigned 32-bit integers), decoded text of each row.

    Ids are the library's, without begin and end tokens, truncation or padding; the decoded text keeps special tokens. Null and
    empty texts have no ids and decode to the empty text. Repeated rows each give a row, a null id stays null. Other columns,
    whatever their names, are not carried. Nothing is shuffled; a worker holds ``rows`` texts and the chunks of ``KEPT_BYTES``.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                data, offsets = _texts(part.column("text"))
                raw = data.tobytes()
                lists = [[raw[x:y] for x, y in zip(borders, borders[1:])] for borders in cut(data, offsets)]
                ids, decoded = zip(*codec(path).encode(lists))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    rows_in = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    return rows_in.mapInArrow(run, "id long, ids binary, decoded string").withColumnRenamed("id", id_column)


def op13_bpe_chunks(spark, sf_dir):
    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
