"""Packing of token ids into fixed windows: bounded-space online best fit, leftovers merged at the end."""

import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from tidepanel.llm.common import Lookup, materialize, slices, table, text_or_empty
from tidepanel.llm.tokens import tokenizer

#: Tokens of a sequence, windows a partition keeps open, smallest piece worth cutting off to fill a window.
WINDOW, OPEN, SMALLEST_CUT = 4096, 64, 16
#: Partitions whose leftovers one task of the final merge takes: at most ``MERGED * OPEN`` windows.
MERGED = 16
#: The id after each document, and the words whose ids a worker keeps.
END_ID, KEPT_WORDS = 2, 250_000

_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FIELDS = [pa.field(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in _PIECE.split(", ")]
_SPLIT = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: Latin-1 lower-case letters, then ASCII marks but the apostrophe: one pre-token each, and alike in every normal form.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: The byte alphabet of byte-level vocabularies, for the bytes of such words that are no printable Latin-1 characters.
_BYTES = np.arange(256, dtype="<u4")
_BYTES[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)
_BYTES[32] = 32
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0]")


@lru_cache(maxsize=4)
def word_lookup(path):
    """Ids of a text between white space, as little-endian bytes.

    The tokenizer drops white space after splitting at it, and neither its normal form nor its lower case reaches over ASCII
    white space, so the ids of a text are those of its words, one after the other.
    """
    full = tokenizer(path)
    model = Tokenizer(full.model)
    model.pre_tokenizer = WhitespaceSplit()
    vocabulary = model.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def letter_ids(words):
        # many words go through the model at a time, in its byte alphabet; the token that ends a word says so
        for lo in range(0, len(words), 500):
            text = " ".join(words[lo : lo + 500])
            if not text.isascii():
                text = _BYTES[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cut, data = [0, *((np.flatnonzero(ends[ids]) + 1) * 4).tolist()], ids.tobytes()
            yield from (data[a:b] for a, b in zip(cut, cut[1:]))

    def words(keys):
        plain = {k: m.groups() for k in keys if (m := _PLAIN.fullmatch(k))}
        known, kept = {}, lookup.known
        fresh = list({stem for stem, _ in plain.values()}.difference(kept))
        known.update(zip(fresh, letter_ids(fresh)))
        rest = list({*keys, *(marks for _, marks in plain.values() if marks)}.difference(plain).difference(kept))
        known.update((k, array("I", e.ids).tobytes()) for k, e in zip(rest, full.encode_batch_fast(rest, add_special_tokens=False)))
        for k, (stem, marks) in plain.items():
            if marks:
                known[k] = (known.get(stem) or kept[stem]) + (known.get(marks) or kept[marks])
        return [known[k] for k in keys]

    lookup = Lookup(words, KEPT_WORDS)
    return lookup


def _words(text):
    """Parts of a text that are encoded each for itself. Latin-1 texts are lower-cased here, as the tokenizer does it, so that fewer
    words differ; a text that may hold special strings is not, as these are told apart by case."""
    if "<|" in text:
        return [w for w in _SPLIT.split(text) if w]
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return [w for w in _SPLIT.split(text) if w]
    text = text.lower()
    # str.split() also cuts at white space that only the tokenizer may judge
    return [w for w in _SPLIT.split(text) if w] if _ODD.search(text) else text.split()


def document_ids(texts, path, end_id=END_ID):
    """Little-endian ids of each text, with ``end_id`` after it."""
    tail = array("I", [end_id]).tobytes()
    words = [_words(t) for t in texts]
    known = word_lookup(path).many(set().union(*words))
    return [b"".join(map(known.__getitem__, ws)) + tail for ws in words]


class Packer:
    """Windows of ``window`` tokens, at most ``keep`` of them open. A window is [tokens, pieces]."""

    def __init__(self, window, keep, smallest):
        self.window, self.keep, self.smallest, self.open = window, keep, smallest, []

    def add(self, doc, start, ids, total):
        """Place a document or a piece of one; yields the windows that are emitted."""
        while len(ids) // 4 >= self.window:
            yield [self.window, [(doc, start, ids[: 4 * self.window], total, 0)]]
            ids, start = ids[4 * self.window :], start + self.window
        n = len(ids) // 4
        if not n:
            return
        gaps = [(self.window - w[0], k) for k, w in enumerate(self.open) if self.window - w[0] >= n]
        if not gaps and len(self.open) < self.keep:
            self.open.append([n, [(doc, start, ids, total, 0)]])
            return
        if gaps:
            gap, k = min(gaps)
            self._put(self.open[k], doc, start, ids, total)
            if gap == n:
                yield self.open.pop(k)
            return
        # none fits: the fullest goes out, filled up with the head of the piece where that is worth a cut
        k = max(range(len(self.open)), key=lambda k: self.open[k][0])
        fullest = self.open.pop(k)
        gap = self.window - fullest[0]
        if gap >= self.smallest and n - gap >= self.smallest:
            self._put(fullest, doc, start, ids[: 4 * gap], total)
            ids, start = ids[4 * gap :], start + gap
        yield fullest
        yield from self.add(doc, start, ids, total)

    @staticmethod
    def _put(window, doc, start, ids, total):
        window[1].append((doc, start, ids, total, window[0]))
        window[0] += len(ids) // 4


def _columns(windows, first):
    """The pieces of ``windows`` as arrays in the order of the piece columns; the windows are numbered from ``first``."""
    rows = [(d, s, len(i) // 4, i, t, first + k, o) for k, (_, pieces) in enumerate(windows) for d, s, i, t, o in pieces]
    return [pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)]


def pack(docs, path, window=WINDOW, keep=OPEN, smallest=SMALLEST_CUT, id_column="doc_id", text_column="text"):
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    Every id of every document, its end id included, lies in exactly one piece; offsets of a sequence are gapless from 0; a
    sequence holds at most ``window`` ids. Null and empty texts are one end id. Repeated rows are packed each for itself; a
    null id stays null. Other columns are not carried. A task keeps ``keep`` windows open. What it leaves is packed once more,
    the leavings of ``MERGED`` partitions in one task, so no task grows with the data. ``sequence_id`` is the partition or
    group number times 2^32 plus a running number; the pieces are written once, so a lost executor cannot renumber them.
    """
    from pyspark import TaskContext

    def run(batches):
        part, number, packer = TaskContext.get().partitionId(), 0, Packer(window, keep, smallest)
        schema = pa.schema([*_FIELDS, pa.field("closed", pa.bool_()), pa.field("part", pa.int64())])

        def batch(windows, closed):
            columns = _columns(windows, (part << 32) + number)
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([*columns, pa.array([closed] * n), pa.array([part] * n, pa.int64())], schema=schema)

        for ids, texts in slices(batches):
            out = []
            for doc, tokens in zip(ids.to_pylist(), document_ids(texts, path)):
                out += packer.add(doc, 0, tokens, len(tokens) // 4)
            if out:
                yield batch(out, True)
                number += len(out)
        if packer.open:
            yield batch(packer.open, False)

    def merge(group, f):
        packer, out = Packer(window, max(keep, 1), smallest), []
        # longest first, so that the small ones fill what is left
        f = f.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]).to_pylist()
        for r in f:
            out += packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        # the open windows of a group are full but for the last few: fill the fullest from the emptiest
        rest = sorted(packer.open, key=lambda w: -w[0])
        while len(rest) > 1:
            fullest, emptiest = rest[0], rest[-1]
            d, s, i, t, o = emptiest[1].pop()
            gap, n = window - fullest[0], len(i) // 4
            if n > gap:
                emptiest[1].append((d, s, i[: 4 * (n - gap)], t, o))
                s, i, n = s + n - gap, i[4 * (n - gap) :], gap
            emptiest[0] -= n
            if n:
                Packer._put(fullest, d, s, i, t)
            if fullest[0] == window:
                out.append(rest.pop(0))
            if not emptiest[1]:
                rest.pop()
        return pa.Table.from_arrays(_columns(out + rest, -((group[0].as_py() + 1) << 32)), schema=pa.schema(_FIELDS))

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    packed = materialize(rows.mapInArrow(run, f"{_PIECE}, closed boolean, part long"), "packed")
    left = packed.where("NOT closed").drop("closed")
    merged = left.groupBy(F.floor(F.col("part") / MERGED).alias("group")).applyInArrow(merge, _PIECE)
    return packed.where("closed").select(*[f.name for f in _FIELDS]).unionByName(merged)


def pieces_with_crc(pieces):
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_pack(spark, sf_dir):
    return pieces_with_crc(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
