"""Token counts of whole texts, exact to the tokenizer library.

Huge texts are encoded in overlapping chunks with offsets. Two neighbours are spliced at an offset where both start a
pre-token; where the overlap holds no such offset, it is widened. Shorter texts are cut where the splitting pattern always
starts a new pre-token (before a lone space), and the counts of the pieces are kept per worker.
"""

import os
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm.common import Lookup, slices, table, text_or_empty

#: Code points of a chunk, of the overlap of two chunks, and of the margin at a chunk's end that is never trusted. The margin
#: must exceed what the splitting pattern looks ahead (2) and the longest added token (13).
CHUNK, OVERLAP, MARGIN = 32_768, 512, 32
#: Pieces of text whose counts a worker keeps.
KEPT_PIECES = 250_000

# A space between two characters that are no white space always starts a pre-token: no class of the pattern goes over it.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile(r"( ?[A-Za-z]+)([.,;:!?]*)")


@lru_cache(maxsize=4)
def tokenizer(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def bare(path):
    """The model alone, for pre-tokens of ASCII letters and marks, which its byte alphabet writes as themselves."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer(tokenizer(path).model)


def _piece_counts(path):
    full, model = tokenizer(path), bare(path)

    def words(keys):
        # in the byte alphabet of the model a space is written as U+0120
        return [len(e.ids) for e in model.encode_batch_fast([k.replace(" ", "Ġ") for k in keys], add_special_tokens=False)]

    parts = Lookup(words, KEPT_PIECES)

    def pieces(keys):
        plain = [_PLAIN.fullmatch(k) for k in keys]
        known = parts.many({g for m in plain if m for g in m.groups() if g})
        rest = iter(full.encode_batch_fast([k for k, m in zip(keys, plain) if not m], add_special_tokens=False))
        return [sum(known[g] for g in m.groups() if g) if m else len(next(rest).ids) for m in plain]

    return Lookup(pieces, KEPT_PIECES)


@lru_cache(maxsize=4)
def piece_lookup(path):
    return _piece_counts(path)


def _cut(text):
    at = [m.start() for m in _LONE_SPACE.finditer(text)]
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def starts(encode, text, at, end):
    """Offsets in the whole text at which a pre-token of ``text[at:end]`` starts, with the tokens before each of them."""
    e = encode(text[at:end])
    found, last = {}, None
    for n, (word, (a, b)) in enumerate(zip(e.word_ids, e.offsets)):
        # added tokens have no word number of their own: each of them is a start
        if word is None or word != last:
            found.setdefault(at + a, n)
        last = word
    return found, len(e.ids)


def count_huge(encode, text, chunk=CHUNK, overlap=OVERLAP, margin=MARGIN):
    """Tokens of ``text``, from overlapping chunks; and how often an overlap had to be widened.

    ``begin`` is an offset where the whole text starts a pre-token. The chunk from there has the whole text's pre-tokens up to
    ``end - margin``: the splitting pattern reads left to right and looks two characters ahead. If the next chunk, which starts
    somewhere inside, also starts a pre-token at such an offset, both go on alike from it, so the splice is exact.
    """
    total = widened = 0
    begin, size = 0, chunk
    left, n_left = starts(encode, text, begin, begin + size)
    while begin + size < len(text):
        end = begin + size
        back = overlap
        while True:
            at = max(begin, end - margin - back)
            if at == begin:
                # no start in the whole chunk, as one pre-token fills it: take twice as much from its start
                size *= 2
                left, n_left = starts(encode, text, begin, begin + size)
                widened += 1
                break
            reach = at + chunk + back
            right, n_right = starts(encode, text, at, reach)
            common = [p for p in right if at < p <= end - margin and p in left]
            if common:
                p = max(common)
                total += left[p]
                n_before = right[p]
                left = {q: n - n_before for q, n in right.items() if q >= p}
                n_left = n_right - n_before
                begin, size = p, reach - p
                break
            back *= 2
            widened += 1
    return total + n_left, widened


def token_counts(docs, path, id_column="doc_id", text_column="text", chunk=CHUNK):
    """``id_column``, n_bytes, n_tokens and n_widened per row.

    Null texts count as empty (0 tokens). Repeated rows each give a row. Other columns are not carried. Nothing is shuffled;
    a task holds one batch of texts and the counts of at most ``KEPT_PIECES`` pieces.
    """

    def run(batches):
        encode = lambda s: tokenizer(path).encode(s, add_special_tokens=False)
        lookup = piece_lookup(path)
        for ids, texts in slices(batches):
            pieces = [_cut(t) if len(t) <= chunk else [] for t in texts]
            known = lookup.many(set().union(*pieces))
            n = [(sum(map(known.__getitem__, ps)), 0) if len(t) <= chunk else count_huge(encode, t, chunk) for t, ps in zip(texts, pieces)]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (size, *zip(*n)))], names=["id", "n_bytes", "n_tokens", "n_widened"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, n_widened long").withColumnRenamed("id", id_column)


def op2_token_counts(spark, sf_dir):
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
