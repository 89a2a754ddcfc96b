"""Exact top-k by integer inner product: MaxScore over the components as terms.

Vectors are dealt into shards of bounded size, queries into blocks of bounded size; each task scores one block against one
shard and returns k rows a query, and a last step merges the shards.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.llm.common import materialize, table

#: Vectors of a shard and queries of a block, on average.
SHARD, BLOCK = 4096, 512
SCALE = 256


def shard_top_k(vectors, ids, queries, query_ids, k):
    """(query, vector, score) of each query's best ``k`` vectors of a shard, the query's own id excepted; ties to smaller ids.

    ``vectors`` must be in the order of ``ids``. A term is a component; its contribution to a score is counted from the least that
    any vector of the shard gives it, so no contribution is negative and the largest one bounds it. Terms are taken by falling
    bound. The essential ones, without which no vector can reach the k-th best score so far, are traversed for all vectors; the
    others are probed one by one for the vectors that can still reach it.
    """
    # sums of products below 2^53 are exact in doubles, whose products are much faster
    most = max(1, int(np.abs(vectors).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, vectors.shape[1])
    kind = np.float64 if most < 2**53 else np.int64
    vectors, queries = np.ascontiguousarray(vectors, kind), np.ascontiguousarray(queries, kind)
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    columns = np.ascontiguousarray(vectors.T)
    plans, essentials = [], np.zeros_like(queries)
    for r, (q, own) in enumerate(zip(queries, query_ids)):
        least = np.where(q >= 0, q * low, q * high)
        bound = np.abs(q) * (high - low)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what the terms from here on can add at most
        # a first threshold: the k-th best full score of the vectors that the strongest term favours
        strongest = columns[order[0] if len(order) else 0] * q[order[0] if len(order) else 0]
        head = np.argpartition(-strongest, min(8 * k, len(ids) - 1))[: 8 * k]
        sure = np.sort(vectors[head[ids[head] != own]] @ q)[::-1]
        threshold = (sure[k - 1] if len(sure) >= k else -np.inf) - least.sum()
        # the essential terms: the shortest run of strong ones after which the others alone stay below the threshold
        below = rest < threshold
        essential = int(np.argmax(below)) if below.any() else len(order)
        essentials[r, order[:essential]] = q[order[:essential]]
        plans.append((least, order, rest, threshold, essential))
    out_q, out_v, out_s = [], [], []
    # the essential terms of all queries are traversed together
    for partial, q, own, (least, order, rest, threshold, essential) in zip(essentials @ columns, queries, query_ids, plans):
        partial = partial - least[order[:essential]].sum()
        alive = np.flatnonzero((partial + rest[essential] >= threshold) & (ids != own))
        partial = partial[alive]
        for n in range(essential, len(order)):
            t = order[n]
            partial = partial + columns[t][alive] * q[t] - least[t]
            fits = partial + rest[n + 1] >= threshold
            alive, partial = alive[fits], partial[fits]
        # terms without spread give every vector the same
        best = np.lexsort((ids[alive], -partial))[:k]
        out_q += [own] * len(best)
        out_v += ids[alive[best]].tolist()
        out_s += [int(x) for x in partial[best] + least.sum()]
    return out_q, out_v, out_s


def _matrix(column):
    """Lists of integers as the rows of a matrix; shorter ones are filled with zeros."""
    lists = column.to_pylist()
    width = max(map(len, lists), default=0)
    out = np.zeros((len(lists), max(width, 1)), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def top_k(vectors, is_query, k=5, id_column="vec_id", vector_column="embedding", shard=SHARD, block=BLOCK):
    """query_id, rank, vec_id, score of each query's ``k`` best rows.

    Components become floor(256 * x). Rows with a null id, a null vector or one with null or non-finite components take no part.
    Components that a vector lacks count as 0. Rows that repeat id and vector count once; rows with the same id and different
    vectors are different candidates, and each query excludes every row of its own id; a query id takes the vector that sorts
    first. Candidates are copied once for each block of queries, queries once for each shard.
    """
    x = F.col("v")
    good = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    good = good.where("id IS NOT NULL AND v IS NOT NULL").where(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))))
    ints = good.select("id", F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e)).alias("v")).distinct()
    ints = materialize(ints, "vectors")
    asked = ints.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    n, m = ints.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = ints.select("id", "v", spread(shards).alias("shard"), every(blocks).alias("block"))
    q = asked.select("id", "v", spread(blocks).alias("block")).select("id", "v", every(shards).alias("shard"), "block")

    def run(left, right):
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({x: pa.array([], pa.int64()) for x in names})
        a, b = _matrix(left.column("v")), _matrix(right.column("v"))
        width = max(a.shape[1], b.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        found = shard_top_k(wide(a), left.column("id").to_numpy(), wide(b), right.column("id").to_numpy(), k)
        return pa.table({x: pa.array(y, pa.int64()) for x, y in zip(names, found)})

    best = c.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


STATEMENT = """
    WITH g AS (SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
               FROM g AS q, g AS c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
