"""Phrases of words that stand together more often than their parts do, counted exactly in counting quotient filters.

Words become numbers, a phrase the packed numbers of its words. A permutation of these bit strings that can be undone spreads
them evenly; its leading bits are the quotient, the others the remainder, which is kept in full, so the filter is a lossless
table: quotients in unary, remainders, counters. All filters use one permutation, so they are sorted alike: those of the shards
are cut at the same places and merged place by place. No place depends on how often a phrase occurs.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.llm.common import materialize, table, text_or_empty

#: Words of a block, of whose phrases a filter is made; phrase occurrences of a place, on average; places at most.
BLOCK_WORDS, PLACE_PHRASES, MOST_PLACES = 2_000_000, 4_000_000, 1 << 20
#: Contract: words of a phrase, occurrences of a candidate, percent of a longer candidate that absorbs it, rows per language.
LONGEST, LEAST, ABSORBED, TOP = 4, 30, 80, 2000
_ONE = np.uint64(1)
_ROUNDS = [np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(1, 5)]
# all marks and line ends become the mark that stands for the end of a piece; A-Z become small
_FOLD = bytes(46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b"."


def words_of(text):
    """Words of a text in UTF-8, with ``_END``, which is no word, at the ends of pieces."""
    return text.translate(_FOLD).replace(_END, b" . ").split()


def _mask(bits):
    return np.uint64((1 << bits) - 1)


def _shift(bits):
    return np.uint64(bits)


class Layout:
    """How phrases of ``n`` word numbers of ``bits`` bits (even, at most 40) become two halves of ``width`` bits."""

    def __init__(self, n, bits):
        self.n, self.bits, self.width = n, bits, n * bits // 2

    def pack(self, columns):
        b = _shift(self.bits)
        if self.n == 2:
            return columns[0], columns[1]
        if self.n == 3:
            h = _shift(self.bits // 2)
            return columns[0] << h | columns[1] >> h, (columns[1] & _mask(self.bits // 2)) << b | columns[2]
        return columns[0] << b | columns[1], columns[2] << b | columns[3]

    def unpack(self, left, right):
        b, m = _shift(self.bits), _mask(self.bits)
        if self.n == 2:
            return [left, right]
        if self.n == 3:
            h = _shift(self.bits // 2)
            return [left >> h, (left & _mask(self.bits // 2)) << h | right >> b, right & m]
        return [left >> b, left & m, right >> b, right & m]

    def _mix(self, half, key):
        x = (half + key) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0x94D049BB133111EB) >> _shift(64 - self.width)

    def permute(self, left, right):
        for key in _ROUNDS:
            left, right = right, left ^ self._mix(right, key)
        return left, right

    def undo(self, left, right):
        for key in _ROUNDS[::-1]:
            left, right = right ^ self._mix(left, key), left
        return left, right

    def count(self, left, right, counts=None):
        """Sorted distinct halves with their counts (or with the sums of ``counts``)."""
        if not len(left):
            return left, right, np.zeros(0, np.int64)
        if 2 * self.width <= 64:
            whole = left << _shift(self.width) | right
            if counts is None:
                whole, counts = np.unique(whole, return_counts=True)
            else:
                order = np.argsort(whole, kind="stable")
                whole, counts = whole[order], counts[order]
                first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
                whole, counts = whole[first], np.add.reduceat(counts, first)
            return whole >> _shift(self.width), whole & _mask(self.width), counts
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        sums = np.diff([*first, len(left)]) if counts is None else np.add.reduceat(counts[order], first)
        return left[first], right[first], sums


def _bytes(values, n):
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _values(data, n):
    out = np.zeros((len(data) // n, 8), np.uint8) if n else None
    if n:
        out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
        return out.reshape(-1).view("<u8").astype(np.uint64)


def write_filter(left, right, counts, bits, width):
    """A filter of sorted distinct entries: ``bits`` bits of the left half (those above are the place's) and ``width`` of the right.

    A quotient takes one bit and its entry another, a remainder whole bytes, a counter of one a bit, of up to 256 a byte more.
    """
    n = len(left)
    spare = -(-max(0, bits - max(1, n).bit_length()) // 8)  # bytes of the left half that go to the remainder
    q = max(0, bits - 8 * spare)
    rest = min(bits, 8 * spare)
    unary = np.zeros(n + (1 << q), np.uint8)
    unary[(left >> _shift(rest)).astype(np.int64) + np.arange(n)] = 1
    more = counts > 1
    small = np.minimum(counts[more] - 2, 255).astype(np.uint8)
    large = counts[counts > 256].astype("<i8")
    head = np.array([n, q, rest, len(small)], "<u4").tobytes()
    parts = [np.packbits(unary).tobytes(), _bytes(left & _mask(rest), spare), _bytes(right, -(-width // 8)), np.packbits(more).tobytes(), small.tobytes(), large.tobytes()]
    return head + b"".join(parts)


def read_filter(data, width):
    """(left, right, counts) of a filter, sorted."""
    n, q, rest, n_small = np.frombuffer(data, "<u4", 4).tolist()
    at, spare, size = 16, -(-rest // 8), -(-width // 8)

    def take(k):
        nonlocal at
        at += k
        return data[at - k : at]

    unary = np.unpackbits(np.frombuffer(take(-(-(n + (1 << q)) // 8)), np.uint8))
    left = (np.flatnonzero(unary) - np.arange(n)).astype(np.uint64) << _shift(rest)
    low = take(n * spare)
    if spare:
        left |= _values(low, spare)
    right = _values(take(n * size), size)
    more = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8))[:n].astype(bool)
    counts, small = np.ones(n, np.int64), np.frombuffer(take(n_small), np.uint8).astype(np.int64) + 2
    small[small == 257] = np.frombuffer(data[at:], "<i8")
    counts[more] = small
    return left, right, counts


def filters(stream, bits, places):
    """(place, length, filter) of the phrases of a stream of word numbers, 0 where no phrase reaches over. ``places`` is a power of two."""
    stream = stream.astype(np.uint64)
    r = places.bit_length() - 1
    for n in range(2, LONGEST + 1):
        at = np.ones(max(0, len(stream) - n + 1), bool)
        for j in range(n):
            at &= stream[j : len(stream) - n + 1 + j] != 0
        at = np.flatnonzero(at)
        layout = Layout(n, bits)
        left, right, counts = layout.count(*layout.permute(*layout.pack([stream[at + j] for j in range(n)])))
        low = max(0, layout.width - r)
        place = (left >> _shift(low)).astype(np.int64)
        borders = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else [0]
        for a, b in zip(borders[:-1], borders[1:]):
            yield int(place[a]), n, write_filter(left[a:b] & _mask(low), right[a:b], counts[a:b], low, layout.width)


def merge_filters(datas, n, bits, places, place, least):
    """Word numbers and counts of the phrases that the filters of one place hold at least ``least`` times together."""
    layout = Layout(n, bits)
    low = max(0, layout.width - (places.bit_length() - 1))
    left, right, counts = layout.count(*(np.concatenate(x) for x in zip(*(read_filter(d, layout.width) for d in datas))))
    kept = counts >= least
    left = left[kept] | np.uint64(place) << _shift(low)
    return layout.unpack(*layout.undo(left, right[kept])), counts[kept]


def blocks(docs):
    """block, lang, words, counts, stream: word numbers within the block, 0 at the ends of pieces, as unsigned 32-bit integers."""
    from pyspark import TaskContext

    class Numbers(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    def run(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        numbers, streams, size = {}, {}, 0

        def rows():
            nonlocal number
            for lang, known in numbers.items():
                stream = np.concatenate(streams[lang])
                counts = np.bincount(stream, minlength=len(known))
                yield pa.RecordBatch.from_pydict({"block": [part + number], "lang": [lang], "words": [list(known)[1:]], "counts": [counts[1:]], "stream": [stream.astype("<u4").tobytes()]}, schema=schema)
                number += 1

        schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                piece = b.slice(lo, 128)
                for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist()):
                    known = numbers.get(lang)
                    if known is None:
                        known, streams[lang] = numbers.setdefault(lang, Numbers({_END: 0})), []
                    words = words_of(text)
                    streams[lang].append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                    streams[lang].append(np.zeros(1, np.uint32))
                    size += len(words) + 1
                    if size >= BLOCK_WORDS:
                        yield from rows()
                        numbers, streams, size = {}, {}, 0
        yield from rows()

    return docs.mapInArrow(run, "block long, lang string, words array<binary>, counts array<long>, stream binary")


def vocabulary(blocks, least):
    """lang, word, n, id: the words of a language that occur at least ``least`` times, numbered from 1 over all languages without gaps."""
    seen = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    # each partition numbers its own; what goes to the driver is a number of rows per partition
    known = materialize(seen.where(F.col("n") >= least).withColumn("part", F.spark_partition_id()), "words")
    sizes = known.groupBy("part").count().orderBy("part").collect()
    first, total = {}, 0
    for r in sizes:
        first[r.part] = total
        total += r["count"]
    own = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    if not first:
        return known.select("lang", "word", "n", F.lit(0).cast("long").alias("id")), 0
    offsets = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return materialize(known.select("lang", "word", "n", (own + offsets[F.col("part")]).cast("long").alias("id")), "vocabulary"), total


def counted_phrases(docs, least=LEAST, lang_column="lang", text_column="text", place_phrases=PLACE_PHRASES):
    """(words: lang, word, n, id; phrases: ids, a; totals: lang, n): all words and all phrases of 2 to 4 words that occur at least
    ``least`` times in a language, with their exact numbers, and the words of each language."""
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_column).alias("text"))
    cut = materialize(blocks(rows), "blocks")
    totals = cut.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).where("n > 0")
    words, total = vocabulary(cut, least)
    spark = docs.sparkSession
    if not total:
        return words, spark.createDataFrame([], "ids array<long>, a long"), totals
    bits = total.bit_length() + (total.bit_length() & 1)
    occurrences = (LONGEST - 1) * int(words.agg(F.sum("n")).first()[0])
    places = 1 << min(MOST_PLACES.bit_length() - 1, max(0, math.ceil(math.log2(max(1, occurrences / place_phrases)))))
    local = cut.select("block", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), (F.col("at") + 1).alias("at"), "id")

    def build(left, right):
        names = ["place", "length", "filter"]
        found = []
        if left.num_rows and right.num_rows:
            stream = np.frombuffer(left.column("stream")[0].as_py(), "<u4")
            number = np.zeros(int(stream.max()) + 1, np.int64)
            number[right.column("at").to_numpy()] = right.column("id").to_numpy()
            stream = number[stream]
            stream = stream[(stream != 0) | np.concatenate([[True], stream[:-1] != 0])]
            found = list(filters(stream, bits, places))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], names=names)

    def merge(key, group):
        place, n = key[0].as_py(), key[1].as_py()
        columns, counts = merge_filters((x.as_py() for x in group.column("filter")), n, bits, places, place, least)
        ids = pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * n, np.array(columns, np.int64).T.ravel())
        return pa.table([ids, pa.array(counts, pa.int64())], names=["ids", "a"])

    pieces = cut.select("block", "stream").groupBy("block").cogroup(local.groupBy("of")).applyInArrow(build, "place long, length int, filter binary")
    phrases = pieces.groupBy("place", "length").applyInArrow(merge, "ids array<long>, a long")
    return words, materialize(phrases, "phrases"), totals


def collocations(docs, least=LEAST, absorbed=ABSORBED, top=TOP, lang_column="lang", text_column="text", place_phrases=PLACE_PHRASES):
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases.

    A null language is ``und``, a null text empty; repeated rows count each; ids and other columns take no part. Of the ways to
    cut a phrase in two the one with the lowest score counts, ties to the shorter first part. A phrase inside a longer one that
    has at least ``absorbed`` percent of its occurrences is left out. Ties in score and number are in the byte order of the phrases.
    """
    words, phrases, totals = counted_phrases(docs, least, lang_column, text_column, place_phrases)
    size = F.size("ids")
    parts = words.select(F.array("id").alias("part"), F.col("n").alias("f"), "lang").union(phrases.select("ids", "a", F.lit(None).cast("string")))
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), (F.slice("ids", 1, k) if s == "l" else F.slice("ids", k + 1, LONGEST)).alias("part")) for k in range(1, LONGEST) for s in "lr"])
    cuts = phrases.select("ids", "a", F.explode(F.filter(sides, lambda x: x.k < size)).alias("c")).select("ids", "a", "c.*")
    found = cuts.join(parts, "part").groupBy("ids", "a").agg(F.max("lang").alias("lang"), *[F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}") for k in range(1, LONGEST) for s in "lr"])
    scores = [F.expr(f"CASE WHEN l{k} IS NOT NULL THEN named_struct('score', (2000000 * CAST(a AS DECIMAL(27, 0))) div CAST(l{k} + r{k} AS DECIMAL(27, 0)), 'k', {k}, 'l', l{k}, 'r', r{k}) END") for k in range(1, LONGEST)]
    scored = found.select("ids", "a", "lang", F.least(*scores).alias("s")).select("ids", "a", "lang", "s.l", "s.r", "s.score")

    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("ids", i, n))))
    longer = phrases.where(size > 2).select(F.explode(inside).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a")))

    # words are put back for the best ones only, ties at the end included
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = materialize(kept.withColumn("rank", F.rank().over(by_score)).where(F.col("rank") <= top).select("lang", "ids", "a", "l", "r", "score"), "best")
    spelled = best.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("ids")
    spelled = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))), lambda x: x.word), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.join(spelled, "ids").join(totals, "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i : list_slice(ws, i, i + {n - 1}))) AS g FROM p" for n in range(1, LONGEST + 1))
STATEMENT = rf"""
    WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
         p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
         f AS (SELECT lang, g, count(*) AS f FROM ({_GRAMS}) GROUP BY lang, g HAVING count(*) >= 30),
         c AS (SELECT lang, g, f AS a, len(g) AS size FROM f WHERE len(g) > 1),
         k AS (SELECT c.lang, c.g, c.a, k, list_slice(c.g, 1, k) AS x, list_slice(c.g, k + 1, c.size) AS y FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < c.size),
         s AS (SELECT k.lang, k.g, k.a, k.k, fx.f AS l, fy.f AS r, CAST((2000000 * CAST(k.a AS HUGEINT)) // (fx.f + fy.f) AS BIGINT) AS score
               FROM k JOIN f AS fx ON fx.lang = k.lang AND fx.g = k.x JOIN f AS fy ON fy.lang = k.lang AND fy.g = k.y),
         b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
         i AS (SELECT lang, a AS longer, unnest(list_transform(range(1, size - n + 2), lambda i : list_slice(g, i, i + n - 1))) AS g
               FROM c, (SELECT unnest([2, 3]) AS n) WHERE n < size),
         m AS (SELECT lang, g, max(longer) AS longer FROM i GROUP BY lang, g),
         n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
         o AS (SELECT lang, list_aggregate(g, 'string_agg', ' ') AS phrase, a, l, r, n, score FROM b JOIN n USING (lang) LEFT JOIN m USING (lang, g)
               WHERE longer IS NULL OR 100 * longer < 80 * a)
    SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
    FROM o QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
