"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of a learned lexicon, their closeness to the second person, capitals, punctuation and obfuscation.
Trees and calibration are fitted by Spark ML on a bounded sample of labelled rows; every text is scored.
"""

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tidepanel.llm.common import Lookup, materialize, table, text_or_empty

#: Labelled rows that the models are fitted on, about; chosen by a hash of their id.
TRAINING_ROWS = 20_000
#: The lexicon holds beginnings of words, so that a stem counts with every ending: of these lengths, and whole words. It takes those
#: that at least so many toxic texts and so large a share of them hold, so many times as often as clean ones; the most telling ones.
STEMS = (4, 5, 6, 7)
LEAST_TEXTS, LEAST_SHARE, LEAST_RATIO, LEXICON_WORDS = 5, 0.02, 6.0, 400
#: Weight of the fixed words, as a logarithm of that ratio.
FIXED_WEIGHT = 6.0
#: Words on either side within which a second person counts as near.
NEAR = 5
#: Common insults.
INSULTS = "idiot moron stupid dumb loser trash garbage scum pathetic worthless clown disgusting ugly fool imbecile retard bitch bastard asshole".split()
#: Second-person words of the four languages, and digits and marks written in place of letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos usted tú ti tus vosotros".split())
LOOKALIKES = str.maketrans("013457@$", "oieastas")

FEATURES = ["lexicon", "weighted", "weighted_sum", "strongest", "lexicon_log", "lexicon_kinds", "obfuscated", "mixed", "near_you", "second_person", "capitals", "shouted", "exclaimed", "asked", "marks", "words_log"]
_EDGE = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")
_REPEAT = re.compile(r"(.)\1{2,}")


def weight_of(word, lexicon):
    """The weight of the longest beginning of ``word`` that the lexicon holds, or 0."""
    for n in (len(word), *STEMS[::-1]):
        if n <= len(word) and word[:n] in lexicon:
            return lexicon[word[:n]]
    return 0.0


def _kind(word, lexicon):
    """1 a lexicon word, 2 an obfuscated one, 3 second person, 4 letters mixed with digits or marks, 0 any other; the word meant, its
    weight."""
    w = _EDGE.sub("", word)
    if w in SECOND_PERSON:
        return 3, w, 0.0
    if not w or w.isalpha() and not _REPEAT.search(w):
        weight = weight_of(w, lexicon)
        return int(weight > 0), w, weight
    plain = _INNER.sub("", w.translate(LOOKALIKES))
    for p in (plain, _REPEAT.sub(r"\1", plain), _REPEAT.sub(r"\1\1", plain)):
        if weight := weight_of(p, lexicon):
            return 2, p, weight
    return (4 if any(c.isalpha() for c in w) and not w.isalpha() else 0), w, 0.0


@lru_cache(maxsize=2)
def word_kinds(lexicon):
    weights = dict(lexicon)
    return Lookup(lambda words: [_kind(w, weights) for w in words], 250_000)


_CLASS = np.zeros(256, np.uint8)
for _chars, _n in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("!", 3), ("?", 4), ("\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~", 5)):
    _CLASS[[ord(c) for c in _chars]] = _n


def features_of(text, lexicon):
    """The feature values of one whole text; all zero for an empty one."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    known = word_kinds(lexicon).many(set(words))
    kinds = np.fromiter((known[w][0] for w in words), np.uint8, n)
    counts = np.bincount(kinds, minlength=5)
    hits, you = np.flatnonzero((kinds == 1) | (kinds == 2)), np.flatnonzero(kinds == 3)
    near = 0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(you[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    raw = np.bincount(_CLASS[np.frombuffer(text.encode(), np.uint8)], minlength=6)
    letters, size = max(1, raw[1] + raw[2]), len(text)
    shouted = sum(w.isupper() for w in text.split()) / n if raw[1] else 0.0
    distinct, weights = len({known[words[i]][1] for i in hits}), [known[words[i]][2] for i in hits]
    return [len(hits) / n, sum(weights) / n, sum(weights), max(weights, default=0.0), np.log1p(len(hits)), distinct, counts[2] / n, counts[4] / n, near / n, counts[3] / n, raw[1] / letters, shouted, raw[3] / size, raw[4] / size, raw[5] / size, np.log1p(n)]


def features(docs, lexicon, keep=()):
    """id, the features and the columns of ``keep`` of each row of ``docs``, which has id and text."""
    types = dict(docs.dtypes)
    ddl = ", ".join(["id long", *(f"{f} double" for f in FEATURES), *(f"{k} {types[k]}" for k in keep)])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                columns = zip(*(features_of(t, lexicon) for t in part.column("text").to_pylist()))
                arrays = [part.column("id"), *(pa.array(list(c), pa.float64()) for c in columns), *(part.column(k) for k in keep)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", *FEATURES, *keep])

    return docs.mapInArrow(run, ddl)


def labelled_sample(docs, labels, limit=TRAINING_ROWS):
    """id, text, toxic and part (1 to 4) of about ``limit`` labelled rows that are not held out. A row's id alone decides."""
    part = F.crc32(F.col("id").cast("string")) % 5
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic")).where(part != 0)
    n = known.count()
    share = min(1.0, limit / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.join(known, "id").withColumn("part", part)


def learn_lexicon(sample):
    """(beginning of a word, weight) that tell toxic from clean texts, by the share of texts that hold them. What goes to the driver is
    at most ``LEXICON_WORDS`` rows."""
    totals = sample.groupBy("toxic").count().collect()
    bad, good = (sum(r["count"] for r in totals if r["toxic"] == k) for k in (1, 0))
    words = F.array_distinct(F.split(F.translate(F.lower("text"), "013457@$", "oieastas"), r"[^\p{L}]+"))
    units = F.array_distinct(F.flatten(F.array(words, *(F.transform(words, lambda w, n=n: F.substring(w, 1, n)) for n in STEMS))))
    by_unit = sample.select("toxic", F.explode(units).alias("w")).where("length(w) > 3").groupBy("w")
    seen = by_unit.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where((F.col("a") >= LEAST_TEXTS) & (F.col("a") >= LEAST_SHARE * bad))
    ratio = ((F.col("a") + 0.5) / (bad + 1)) / ((F.col("b") + 0.5) / (good + 1))
    best = seen.withColumn("r", ratio).where(F.col("r") >= LEAST_RATIO).orderBy(F.desc(F.col("a") * F.log("r")), "w").limit(LEXICON_WORDS)
    return tuple(sorted({**dict.fromkeys(INSULTS, FIXED_WEIGHT), **{r.w: math.log(r.r) for r in best.collect()}}.items()))


def fit(sample):
    """(lexicon, trees, calibration) from labelled rows: parts 2 to 4 grow the trees, part 1 calibrates them. None without both
    classes in either."""
    classes = {(r.c, r.toxic) for r in sample.select((F.col("part") == 1).alias("c"), "toxic").distinct().collect()}
    if len(classes) < 4:
        return None
    lexicon = learn_lexicon(sample.where("part <> 1"))
    # repeated rows have one label
    rows = materialize(features(sample.select("id", "text"), lexicon).join(sample.select("id", "toxic", "part").distinct(), "id"), "features")
    # draws of the trees follow the order of rows: one partition of a bounded sample, sorted, gives every run the same trees
    rows = rows.coalesce(1).sortWithinPartitions("id", *FEATURES)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows).select("vector", "part", F.col("toxic").cast("double").alias("label"))
    trees = GBTClassifier(featuresCol="vector", maxIter=20, maxDepth=4, stepSize=0.3, minInstancesPerNode=10, subsamplingRate=0.8, seed=7).fit(rows.where("part <> 1"))
    raw = trees.transform(rows.where("part = 1")).select(vector_to_array("probability")[1].alias("raw"), "label")
    return lexicon, trees, IsotonicRegression(featuresCol="raw").fit(raw)


def score(docs, labels, id_column="doc_id", text_column="text", limit=TRAINING_ROWS, keep=()):
    """Per row: ``id_column``, held_out, score, predicted, and the columns of ``keep``.

    Null texts count as empty; empty texts have all features zero and the score that the trees give them. Repeated rows each give a
    row. A row with a null id is scored and not held out. Without labelled rows of both classes every score is 0. Other columns,
    whatever their names, are not carried and are no input.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    sample = materialize(labelled_sample(rows, labels, limit), "sample")
    kept = [f"__keep{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, kept)))
    model = fit(sample)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    if model is None:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        lexicon, trees, calibration = model
        at = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(features(rows, lexicon, kept))
        at = calibration.transform(trees.transform(at).select("id", vector_to_array("probability")[1].alias("raw"), *kept))
        # calibration has plateaus; a thousandth of the raw score keeps the order inside them
        scored = at.select("id", *kept, F.least(F.greatest(0.999 * F.col("prediction") + 0.001 * F.col("raw"), F.lit(0.0)), F.lit(1.0)).alias("score"))
    return scored.select(F.col("id").alias(id_column), held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(F.col(k).alias(c) for c, k in zip(keep, kept)))


def op6_toxicity(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
