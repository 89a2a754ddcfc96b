"""Exact ranked lexical search: ball trees over sparse term vectors of documents, one per shard.

A document's component for a term is its weighted share of the score, so the score of an item is the sum of the components of its
terms. A node of a tree knows the centroid of its documents and, for groups of terms, the radius around it; by the Cauchy-Schwarz
inequality in each group no document below scores more. Subtrees are searched best first and left once their bound, rounded up,
is below the k-th best score found so far. Leaves are scored in 64-bit integers.
"""

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.llm.common import materialize, table

#: Documents and components of a tree at most, documents of a leaf at most.
SHARD, COMPONENTS, LEAF = 8192, 4_000_000, 32
#: Terms of a block of items, on average: a block is searched in one pass over the documents.
BLOCK_TERMS = 16_384
#: Terms that more than this share of a block's items hold are one group of their own.
COMMON = 0.1
#: What bounds are rounded up by: far more than sums of doubles lose.
SLACK = 1e-9

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# every byte of a longer character belongs to a term, so terms can be cut from UTF-8
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text):
    """Terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split()


class BallTree:
    """Rows are sparse vectors: ``values[ptr[i]:ptr[i + 1]]`` at the columns ``index[...]``; every row holds at least one value.

    ``group`` gives the group of each column. Nodes: lo, hi (rows in tree order), two children or none.
    """

    def __init__(self, ptr, index, values, group, groups, leaf=LEAF):
        self.ptr, self.index, self.values = ptr, index, values
        self.group, self.groups, self.width, self.leaf = group, groups, len(group), leaf
        self.order = np.arange(len(ptr) - 1)
        self.nodes, self.centroids, self.radii = [], [], []
        self._grow(0, len(self.order))
        self.centroids, self.radii = np.array(self.centroids), np.array(self.radii)

    def _take(self, rows):
        """(start of each row, columns, values) of ``rows`` alone."""
        n = self.ptr[rows + 1] - self.ptr[rows]
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        at = np.arange(n.sum()) + np.repeat(self.ptr[rows] - starts, n)
        return starts, self.index[at], self.values[at]

    def _grow(self, lo, hi):
        me, rows = len(self.nodes), self.order[lo:hi]
        starts, cols, vals = self._take(rows)
        vals = vals.astype(np.float64)
        center = np.bincount(cols, vals, self.width) / len(rows)
        # |x - c|^2 in a group: the part of c there, corrected where x has components
        here = np.bincount(self.group, center**2, self.groups)
        row = np.repeat(np.arange(len(rows)), np.diff([*starts, len(cols)]))
        cell = row * self.groups + self.group[cols]
        size = len(rows) * self.groups
        square = np.bincount(cell, vals * (vals - 2 * center[cols]), size).reshape(-1, self.groups) + here
        total = np.bincount(cell, vals**2, size).reshape(-1, self.groups) + here
        self.centroids.append(center)
        self.radii.append(np.sqrt(np.maximum(square, 0).max(axis=0) + SLACK * 1e-2 * total.max(axis=0)))
        self.nodes.append((lo, hi, None))
        if hi - lo <= self.leaf:
            return me
        # two far ends: the row farthest from the centroid, and the one farthest from it; rows are halved along the line between
        norms = np.add.reduceat(vals**2, starts)
        dense = np.zeros(self.width)

        def along(r):
            dense[:] = 0
            a, b = starts[r], (starts[r + 1] if r + 1 < len(starts) else len(cols))
            dense[cols[a:b]] = vals[a:b]
            return np.add.reduceat(vals * dense[cols], starts)

        a = int(square.sum(axis=1).argmax())
        to_a = along(a)
        b = int((norms - 2 * to_a).argmax())
        half = (hi - lo) // 2
        rank = np.argsort(to_a - along(b), kind="stable")
        self.order[lo:hi] = rows[rank]
        left = self._grow(lo, lo + half)
        self.nodes[me] = (lo, hi, (left, self._grow(lo + half, hi)))
        return me

    def bounds(self, queries):
        """Upper bound of the score below each node, per query (columns of ``queries`` that count)."""
        out = np.empty((len(queries), len(self.nodes)))
        for k, q in enumerate(queries):
            weight = np.sqrt(np.bincount(self.group[q], minlength=self.groups))
            used = np.flatnonzero(weight)
            out[k] = self.centroids[:, q].sum(axis=1) + self.radii[:, used] @ weight[used]
        return out * (1 + SLACK) + 1

    def search(self, query, bounds, best, k, ids):
        """Put better rows into ``best``, a heap of (score, -id) with at most ``k`` entries; returns the number of rows scored."""
        mark = np.zeros(self.width, np.int64)
        mark[query] = 1
        queue, scored = [(-bounds[0], 0)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                break
            lo, hi, children = self.nodes[node]
            if children:
                for c in children:
                    heapq.heappush(queue, (max(bound, -bounds[c]), c))
                continue
            rows = self.order[lo:hi]
            starts, cols, vals = self._take(rows)
            scores = np.add.reduceat(vals * mark[cols], starts)
            scored += len(rows)
            for r in np.flatnonzero(scores >= (best[0][0] if len(best) == k else 1)):
                entry = (int(scores[r]), -int(ids[rows[r]]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def groups_of(queries, width):
    """A group per term: 0 for terms of many queries, else that of the first query that holds it; and the number of groups."""
    held = np.bincount(np.concatenate(queries), minlength=width)
    group = np.zeros(width, np.int64)
    for k in range(len(queries) - 1, -1, -1):
        group[queries[k]] = k + 1
    group[held > max(1, COMMON * len(queries))] = 0
    return group, len(queries) + 1


def _vectors(docs, vocabulary):
    """id, n (terms of the text), terms (numbers in ``vocabulary``) and tf of each document with a term."""

    def run(batches):
        number = {t: i for i, t in enumerate(vocabulary)}
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                n, terms, tfs = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    words = terms_of(text)
                    known, tf = np.unique(np.array([i for i in map(number.get, words) if i is not None], np.int32), return_counts=True)
                    n.append(len(words))
                    terms.append(known)
                    tfs.append(tf)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, tf array<long>").where("n > 0")


def _document_frequencies(vectors, width):
    """How many rows of ``vectors`` hold each term: a task adds up its own, so ``width`` numbers a task are shuffled."""

    def run(batches):
        total = np.zeros(width, np.int64)
        for b in batches:
            total += np.bincount(b.column("terms").flatten().to_numpy(), minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "df"])

    counted = vectors.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(width, np.int64)
    for r in counted.collect():  # at most one row a term of the block
        df[r.term] = r.df
    return df


def _search_block(docs, items, k, shard, leaf):
    """Best ``k`` of every task of the documents for the items of one block: item_id, doc_id, score, scored (rows whose score was
    computed for the item in the task), rows (of the task)."""
    items = [(i, sorted(set(terms_of(t.encode())))) for i, t in items]
    items = [(i, t) for i, t in items if t]
    if not items:
        return None
    vocabulary = sorted({t for _, ts in items for t in ts})
    number = {t: i for i, t in enumerate(vocabulary)}
    queries = [np.array([number[t] for t in ts]) for _, ts in items]
    names, width = [i for i, _ in items], len(vocabulary)
    vectors = materialize(_vectors(docs, vocabulary), "vectors")
    totals = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    if not totals.n:
        return None
    n_docs, n_terms = int(totals.n), int(totals.l)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in _document_frequencies(vectors, width).tolist()], np.int64)
    group, groups = groups_of(queries, width)

    def run(batches):
        best, scored, rows = [[] for _ in queries], np.zeros(len(queries), np.int64), 0

        def search(parts):
            ids, length, n, terms, tf = (np.concatenate(x) for x in zip(*parts))
            m = 10 + 90 * n * n_docs // n_terms
            values = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, length)))
            tree = BallTree(np.concatenate([[0], np.cumsum(length)]), terms, values, group, groups, leaf)
            for j, (q, bounds) in enumerate(zip(queries, tree.bounds(queries))):
                scored[j] += tree.search(q, bounds, best[j], k, ids)

        held, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                terms, tf = part.column("terms"), part.column("tf")
                held.append((part.column("id").to_numpy(), terms.value_lengths().to_numpy(), part.column("n").to_numpy(), terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()))
                size += len(held[-1][3])
                rows += part.num_rows
                if sum(len(h[0]) for h in held) >= shard or size >= COMPONENTS:
                    search(held)
                    held, size = [], 0
        if held:
            search(held)
        found = [(names[j], -i, s, int(scored[j]), rows) for j, heap in enumerate(best) for s, i in heap]
        columns = list(zip(*found)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score", "scored", "rows"])

    # documents without a term of the block score 0 for all of its items
    known = vectors.where("id IS NOT NULL AND size(terms) > 0")
    return known.mapInArrow(run, "item_id long, doc_id long, score long, scored long, rows long")


def ranked(docs, items, k=10, id_column="doc_id", text_column="text", item_column="item_id", item_text="text", shard=SHARD, leaf=LEAF, block_terms=BLOCK_TERMS, detail=False):
    """item_id, rank, doc_id, score of each item's ``k`` best documents with a score above 0; equal scores by doc_id. With ``detail``
    also scored and rows: for how many of the documents of its task the score was computed.

    Null and empty texts have no terms. Documents that repeat an id, or whole rows, are documents each for itself; documents with a
    null id count for the statistics and are not ranked. Items with a null id are left out; of different texts under one item id
    the one that sorts first counts. Other columns are not carried. Items are searched in blocks of about ``block_terms`` terms,
    each in one pass over all documents; what a task returns is ``k`` rows an item, whatever it read.
    """
    asked = items.select(F.col(item_column).cast("long").alias("id"), F.col(item_text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    asked = materialize(asked.groupBy("id").agg(F.min("t").alias("t")), "items")
    size = asked.agg(F.sum(F.size(F.split("t", "[^0-9A-Za-z\\x80-\\x{10FFFF}]+")))).first()[0] or 0
    blocks = max(1, -(-size // block_terms))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("text IS NOT NULL")
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        part = _search_block(rows, [(r.id, r.t) for r in block], k, shard, leaf)
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long, scored long, rows long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", *["scored", "rows"] * detail)


def op12_ball_tree(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')"
STATEMENT = f"""
    WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents WHERE text IS NOT NULL),
         s AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
         b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
         f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
               WHERE term IN (SELECT term FROM b) GROUP BY ALL),
         w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
         x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
               FROM f JOIN w USING (term) JOIN b USING (term), s GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
