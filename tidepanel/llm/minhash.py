"""Near-duplicate documents: fast similarity sketches, banding, confirmation on full shingle sets, connected components.

Texts with equal shingle sets are one class from the start, so a group of copies costs one row. In a large band bucket every
member is compared with two hubs first, which is linear. Set sizes and counts of shingles by bin bound what a pair can have in common,
which rules out most pairs and none that reaches the threshold; of the others only those that tie different components together are
confirmed. Large buckets that still hold members of different components, of which two may be alike while neither is like a hub, have
those outside the largest one compared with all others, in blocks: every pair that shares a band is looked at.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tidepanel.llm.common import materialize, table, text_or_empty

#: Words of a shingle, and the least similarity in percent. The contract of the query takes two words, the pipeline five.
SHINGLE, PERCENT = 2, 80
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**28 = 4e-7.
BANDS, ROWS = 28, 4
#: Up to so many members of a bucket are compared with each other; in a larger one each with two hubs.
SMALL = 16
#: Members of a block of a larger bucket, and members outside its largest root, that a task compares.
BLOCK, MINORS = 1024, 2048
#: Bins in which the shingles of a set are counted, a byte each. A set with a count of ``FULL`` has that in all of them.
BINS, FULL = 256, 255
#: Hubs of buckets with more members are dealt over so many keys.
HOT, SALTS = 64, 16

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(n) for n in (30, 27, 31, 32))


def mix(x):
    """A 64-bit finalizer (splitmix64) over an array."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shingle_set(text, k):
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle; without words, none."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and cut at the six ASCII white-space characters
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    out = np.full(n, np.uint64(min(k, len(h))))
    with np.errstate(over="ignore"):
        for j in range(min(k, len(h))):
            out = mix(out * _M2 + h[j : j + n])
    return np.unique(out)


def round_seeds(t):
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(shingles, t, seeds):
    """Fast similarity sketch: ``t`` coordinates from rounds of hashed bin placement.

    In round i < t every shingle goes to one hashed bin; in round t + i every shingle goes to bin i. A bin takes the smallest
    value of the first round that reaches it, so after 2t rounds every bin is filled. Mostly a few rounds do.
    """
    out = np.full(t, _EMPTY)
    with np.errstate(over="ignore"):
        # small sets need many rounds: several at a time
        step = max(1, min(t, 2048 // len(shingles)))
        for lo in range(0, t, step):
            x = mix(shingles[None, :] ^ seeds[lo : lo + step, None])
            n = x.shape[0]
            at = ((x >> _S32) * np.uint64(t)) >> _S32
            found = np.full(n * t, _EMPTY)
            np.minimum.at(found, (at + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(t)).ravel().astype(np.intp), mix(x).ravel())
            for row in found.reshape(n, t):
                out = np.where(out == _EMPTY, row, out)
            if (out != _EMPTY).all():
                return out
        for i in np.flatnonzero(out == _EMPTY):
            out[i] = mix(shingles ^ seeds[t + i]).min()
    return out


def counts(shingles):
    """Shingles of each bin."""
    n = np.bincount((shingles & np.uint64(BINS - 1)).astype(np.intp), minlength=BINS)
    return (n if n.max() < FULL else np.full(BINS, FULL)).astype(np.uint8)


def may_reach(x, y, n, m, percent):
    """Whether sets of ``n`` and ``m`` shingles with the counts ``x`` and ``y`` (rows of arrays) may reach ``percent``. They have no more in
    common than the smaller count of each bin, so that no pair which does is left out."""
    both = np.where((x[..., 0] == FULL) & (y[..., 0] == FULL), np.minimum(n, m), np.minimum(x, y).sum(axis=-1, dtype=np.int64))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * both >= percent * (n + m))


def sketches(docs, k=SHINGLE, bands=BANDS, rows=ROWS):
    """id, n_shingles, set_hash (null for an empty set), the sketch as unsigned 32-bit coordinates and the counts of the set, per row of
    ``id, text``; a column ``digest`` is carried along."""
    t = bands * rows
    carried = ["digest"] if "digest" in docs.columns else []

    def run(batches):
        seeds = round_seeds(t)
        for b in batches:
            n, hashes, sk, bins = [], [], [], []
            for text in b["text"]:
                s = shingle_set(text, k)
                n.append(len(s))
                hashes.append(set_digest(s) if len(s) else None)
                sk.append(sketch(s, t, seeds).astype(np.uint32).tobytes() if len(s) else None)
                bins.append(counts(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"id": b["id"], "n_shingles": n, "set_hash": hashes, "sketch": sk, "counts": bins, **{c: b[c] for c in carried}})

    return docs.mapInPandas(run, "id long, n_shingles long, set_hash binary, sketch binary, counts binary" + ", digest string" * len(carried))


def set_digest(shingles):
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def with_ends(pairs, values, column, how="inner"):
    """``pairs`` (hub, node, n, ...) with ``column`` of both ends as ``hub_<column>`` and ``node_<column>``; ``values``: set_hash, ``column``.

    A node stands in few pairs, a hub in as many as its bucket has members: hubs of large buckets are dealt over ``SALTS`` keys.
    """
    hot = F.col("n") > HOT
    hubs = pairs.groupBy("hub").agg(F.max("n").alias("n")).join(values.withColumnRenamed("set_hash", "hub"), "hub", how)
    hubs = hubs.select("hub", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), F.col(column).alias(f"hub_{column}"))
    salted = pairs.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0))
    nodes = values.select(F.col("set_hash").alias("node"), F.col(column).alias(f"node_{column}"))
    return salted.join(nodes, "node", how).join(hubs, ["hub", "salt"]).drop("salt")


def confirmed(pairs, texts, k, percent):
    """The pairs (hub, node, n) of set hashes whose full shingle sets reach ``percent``, as (a, b).

    ``texts``: set_hash, text. An id may stand on several rows: a text counts for a set only if it has that very set.
    """

    def run(batches):
        known = {}
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch["hub"], batch["node"], batch["hub_text"], batch["node_text"]):
                # pairs are sorted by their hub, which heads many of them
                if (a, x) not in known:
                    known = {(a, x): shingle_set(x, k)}
                p, q = known[a, x], shingle_set(y, k)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both) and set_digest(p) == a and set_digest(q) == b)
            yield batch.loc[keep, ["hub", "node"]].rename(columns={"hub": "a", "node": "b"})

    ends = pairs.select(F.col("hub").alias("set_hash")).union(pairs.select(F.col("node").alias("set_hash"))).distinct()
    used = texts.join(ends, "set_hash", "left_semi")
    both = with_ends(pairs, used, "text").select("hub", "node", "hub_text", "node_text")
    return both.sortWithinPartitions("hub").mapInPandas(run, "a binary, b binary").distinct()


def components(edges):
    """node -> root, the smallest node reachable, for the nodes of ``edges`` (a, b). Large-star and small-star rounds until every node
    hangs on a root; what goes to the driver is one row of totals a round."""
    e = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    while True:
        # done when every node has one edge and no root is a node
        ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        open_ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
        if open_ends.isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        # large star: neighbours above a node are tied to the smallest of its neighbourhood
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node, are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small, "edges")


def _with_stats(members, stats, columns):
    """``members`` of the keys that ``stats`` holds, with its ``columns``. A key may hold many members: it is dealt over ``SALTS`` keys."""
    spread = stats.select("key", *columns, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(spread, ["key", "salt"]).drop("salt")


def _buckets(members):
    """``members`` (key, last, node) of the buckets of several members, with the number of members and two hubs, the first and the last,
    which are mostly the same in all buckets of a group. Linear in a bucket."""
    stats = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("h0"), F.max("node").alias("h1"))
    return _with_stats(members, stats.where("n > 1"), ["n", "h0", "h1"])


def _pairs(buckets):
    """Pairs (hub, node, n) to look at: in a bucket of up to ``SMALL`` members all of them, in a larger one each member with the hubs."""
    stars = buckets.where(f"n > {SMALL} OR n < 4").select(F.explode(F.array("h0", "h1")).alias("hub"), "node", "n").where("hub <> node")
    held = F.array_sort(F.collect_list(F.struct("node")))
    few = buckets.where(f"n BETWEEN 4 AND {SMALL}").groupBy("key").agg(held.alias("m"), F.max("n").alias("n"))
    later = lambda x, i: F.transform(F.slice("m", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))
    few = few.select("n", F.explode(F.flatten(F.transform("m", later))).alias("p")).select(F.col("p.a.node").alias("hub"), F.col("p.b.node").alias("node"), "n")
    return stars.union(few).groupBy("hub", "node").agg(F.max("n").alias("n"))


def _open(members):
    """``members`` (key, last, node, root and more) of the larger buckets of several roots; n, and minors: members outside the largest root (``main``)."""
    stats = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
    stats = stats.agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top")).select("key", "n", F.col("top.root").alias("main"), (F.col("n") - F.col("top.c")).alias("minors"))
    return _with_stats(members, stats.where(f"minors > 0 AND n > {SMALL}"), ["n", "main", "minors"])


def _texts_of(sets, reps, texts):
    """set_hash, text of the sets ``sets`` (set_hash). An id may stand on several rows: its other texts come along."""
    used = reps.join(sets, "set_hash", "left_semi").select("set_hash", F.col("rep").alias("id"))
    return texts.select("id", "text").join(used, "id").select("set_hash", "text").distinct()


def _likely(f, bands, rows, percent):
    """For each row j of ``f`` with ``minor`` 1 that may be alike to rows with ``minor`` 0 and another root: j, those rows and their numbers
    of equal coordinates. Sizes and counts decide; a pair is looked at in the first band that it shares only. What the caller writes
    into ``root`` counts for the rows that follow."""
    minor, size = f.column("minor").to_numpy(), f.column("n_shingles").to_numpy()
    sk, bins = (np.frombuffer(b"".join(f.column(c).to_pylist()), d).reshape(f.num_rows, n) for c, d, n in (("sketch", np.uint32, bands * rows), ("counts", np.uint8, BINS)))
    root = f.column("root").combine_chunks().dictionary_encode().indices.to_numpy().copy()
    band, ones = f.column("last")[0].as_py(), np.flatnonzero(minor == 0)
    for j in np.flatnonzero(minor == 1):
        i = ones[(root[ones] != root[j]) & (100 * np.minimum(size[ones], size[j]) >= percent * np.maximum(size[ones], size[j]))]
        same = sk[i] == sk[j]
        here = same.reshape(len(i), bands, rows).all(axis=2).argmax(axis=1) == band
        i, equal = i[here], same[here].sum(axis=1)
        take = may_reach(bins[i], bins[j], size[i], size[j], percent)
        if take.any():
            yield root, j, i[take], equal[take]


def _dealt(members):
    """``members`` of open buckets as tasks (key, block, chunk) of ``BLOCK`` members (``minor`` 0) and ``MINORS`` of those outside the largest
    root (``minor`` 1). A bucket of up to ``MINORS`` of these makes at most its members, once more for each ``BLOCK`` of ``MINORS``, and
    ``MINORS`` rows; no row is copied for each other one."""
    columns = ["key", "last", "node", "root", *(c for c in ("n_shingles", "sketch", "counts") if c in members.columns)]
    blocks, chunks = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("minors") / MINORS).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    left = members.select(*columns, F.lit(0).alias("minor"), one(blocks).alias("block"), every(chunks).alias("chunk"))
    return left.union(members.where("root <> main").select(*columns, F.lit(1).alias("minor"), every(blocks).alias("block"), one(chunks).alias("chunk")))


def _candidates(members, bands, rows, percent):
    """The rows of ``_dealt`` that have a pair which sizes and counts leave open. No text is moved for the others, and a pair brings its
    ends here once, not once for each band that it shares."""

    def run(f):
        used = np.zeros(f.num_rows, bool)
        for _, j, i, _ in _likely(f, bands, rows, percent):
            used[j] = True
            used[i] = True
        return f.filter(pa.array(used))

    dealt = _dealt(members)
    return dealt.groupBy("key", "block", "chunk").applyInArrow(run, dealt.schema)


def _across(candidates, texts, k, bands, rows, percent):
    """Links (a, b) across the roots of a bucket: the full shingle sets decide the pairs that ``_candidates`` left open; pairs that links of
    the task have joined are passed over."""
    ends = candidates.select(F.col("node").alias("set_hash")).distinct()
    used = texts.join(ends, "set_hash", "left_semi").withColumnRenamed("set_hash", "node")

    def run(f):
        sets = [shingle_set(x, k) for x in f.column("text").to_pylist()]
        nodes, found = f.column("node").to_pylist(), []
        # an id may stand on several rows: its other texts are not of this set
        true = np.array([set_digest(s) == node for s, node in zip(sets, nodes)], bool)
        f, sets, nodes = f.filter(pa.array(true)), [s for s, x in zip(sets, true) if x], [n for n, x in zip(nodes, true) if x]
        for root, j, i, equal in _likely(f, bands, rows, percent) if f.num_rows else ():
            for x in i[np.argsort(-equal, kind="stable")]:
                if root[x] != root[j]:
                    both = len(np.intersect1d(sets[x], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[x]) + len(sets[j]) - both):
                        found.append((nodes[x], nodes[j]))
                        root[root == root[x]] = root[j]
        columns = list(zip(*found)) or [[]] * 2
        return pa.table([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

    return candidates.join(used, "node").groupBy("key", "block", "chunk").applyInArrow(run, "a binary, b binary").distinct()


def alike(pairs, reps, bands, rows, percent):
    """hub, node, n, equal: the pairs whose set sizes and counts leave it open that they reach ``percent``, with the number of equal
    coordinates of their sketches."""

    def run(batches):
        for b in batches:
            of = lambda c, d, n: [np.frombuffer(b"".join(b.column(f"{e}_{c}").to_pylist()), d).reshape(b.num_rows, n) for e in ("hub", "node")]  # noqa: B023, E731
            (x, y), (p, q) = of("sketch", np.uint32, bands * rows), of("counts", np.uint8, BINS)
            n, m = b.column("hub_size").to_numpy(), b.column("node_size").to_numpy()
            equal, keep = (x == y).sum(axis=1), np.flatnonzero(may_reach(p, q, n, m, percent))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(keep)) for c in ("hub", "node", "n")), pa.array(equal[keep], pa.int64())], names=["hub", "node", "n", "equal"])

    ends = with_ends(pairs, reps.select("set_hash", F.struct("n_shingles", "sketch", "counts").alias("v")), "v")
    ends = ends.select("hub", "node", "n", *[F.col(f"{e}_v.{f}").alias(f"{e}_{c}") for e in ("hub", "node") for f, c in (("sketch", "sketch"), ("counts", "counts"), ("n_shingles", "size"))])
    return ends.mapInArrow(run, "hub binary, node binary, n long, equal long")


def _picks(open_pairs, sure):
    """Of the pairs (hub, node, n, equal, hub_root, node_root) one for each root: of those that are sure to be alike the one with the
    smallest partner, so that a group gathers at few hubs; else the likeliest."""
    pair = [F.col("equal") < sure, F.when(F.col("equal") >= sure, F.col("other")), -F.col("equal"), F.col("hub"), F.col("node"), F.col("n")]
    sides = [open_pairs.withColumn("end", F.col(f"{x}_root")).withColumn("other", F.col(f"{y}_root")) for x, y in (("hub", "node"), ("node", "hub"))]
    best = F.min(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(pair)]))
    return sides[0].union(sides[1]).groupBy("end").agg(best.alias("p")).select(F.col("p.c3").alias("hub"), F.col("p.c4").alias("node"), F.col("p.c5").alias("n")).distinct()


def near_duplicates(docs, k=SHINGLE, percent=PERCENT, bands=BANDS, rows=ROWS, id_column="doc_id", text_column="text", detail=False):
    """Per row: ``id_column``, n_shingles, component_id, kept, and with ``detail`` also root, which tells apart components that have the
    same smallest id (null for an empty set), and digest, the SHA-256 of the text.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased. Links join texts whose sets of k-word shingles have at least
    ``percent`` percent in common. component_id is the smallest id reachable, kept says that it is the row's own. Null, empty and
    wordless texts have an empty set and are their own component. Repeated rows each give a row; rows with the same id and
    different texts are different nodes, each in the component of its own text. A row with a null id is linked with nothing: it
    comes back with a null component_id and kept true. Other columns are not carried.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"))
    more = ["digest"] if detail else []
    texts = texts.withColumn("digest", F.sha2("text", 256)) if detail else texts
    spark = docs.sparkSession
    sk = materialize(sketches(texts.where("id IS NOT NULL"), k, bands, rows), "sketches")
    reps = materialize(sk.where("set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("counts").alias("counts")), "classes")
    width, sure = 4 * rows, bands * rows * (percent + 100) / 200
    coordinates = lambda i: F.substring("sketch", 1 + width * i, width)
    parts = F.array(*[F.struct(F.lit(i).alias("last"), F.xxhash64(F.lit(i), coordinates(i)).alias("key")) for i in range(bands)])
    members = reps.select(F.col("set_hash").alias("node"), F.explode(parts).alias("p")).select("p.key", "p.last", "node")
    links, roots = None, spark.createDataFrame([], "node binary, root binary")

    def join(new, name_roots):
        nonlocal links, roots
        links = new if links is None else links.union(new)
        if name_roots:
            roots = components(links)

    def tie(found, first):
        """Confirm pairs that join different roots, with ``first`` one for each root, else all; what is left of them."""
        still = found.withColumn("hub_root", F.col("hub")).withColumn("node_root", F.col("node"))
        if links is not None:
            still = with_ends(found, roots.select(F.col("node").alias("set_hash"), "root"), "root", "left")
            still = still.withColumn("hub_root", F.coalesce("hub_root", "hub")).withColumn("node_root", F.coalesce("node_root", "node")).where("hub_root <> node_root")
        chosen = materialize(_picks(still, sure) if first else still.select("hub", "node", "n"), "chosen")
        join(materialize(confirmed(chosen, used, k, percent), "links"), True)
        return found.join(chosen, ["hub", "node"], "left_anti") if first else None

    buckets = materialize(_buckets(members), "buckets")
    # all texts are dealt once; later steps look at members of these buckets only
    used = materialize(_texts_of(buckets.select(F.col("node").alias("set_hash")).distinct(), reps, texts), "texts")
    found = tie(materialize(alike(_pairs(buckets), reps, bands, rows, percent), "alike"), True)
    # a large bucket may still hold several roots: what is outside its largest one is compared with all
    inside = buckets.where(F.col("n") > SMALL).select("node").distinct()
    named = inside.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = reps.select(F.col("set_hash").alias("node"), "n_shingles", "sketch", "counts").join(named, "node")
    large = materialize(_open(named.withColumn("p", F.explode(parts)).select("p.*", "node", "root", "n_shingles", "sketch", "counts")), "open")
    candidates = materialize(_candidates(large, bands, rows, percent), "candidates")
    join(materialize(_across(candidates, used, k, bands, rows, percent), "across"), False)
    tie(found, False)

    named = reps.select("set_hash", "rep").join(roots.withColumnRenamed("node", "set_hash"), "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_set = named.join(smallest, "root").select("set_hash", "component_id", "root")
    linked = sk.where("set_hash IS NOT NULL").join(by_set, "set_hash").select("id", "n_shingles", "component_id", "root", *more)
    alone = sk.where("set_hash IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("root"), *more)
    nameless = sketches(texts.where("id IS NULL"), k, bands, rows).select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("root"), *more)
    out = linked.union(alone).union(nameless)
    return out.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), *["root"] * detail, *more)


def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
