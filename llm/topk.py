"""Exact top-k inner-product search by MaxScore over sharded postings.

Components are terms. A query's weight times the component is its contribution, shifted by the least there is in the
shard, so that it lies between 0 and the term's bound. With a threshold t (the k-th best score known), each term gets a
share of the slack of the bounds; a vector all of whose contributions are within these shares cannot reach t. So the
postings beyond a term's share are essential and are traversed, in order of value, and give the candidates; the other
terms are probed, largest bound first, as long as a candidate's bound is still competitive. Shards give their
own top k, which are merged.

Vectors are indexed in shards of bounded size, queries come in blocks of bounded size, and each (block, shard) pair is
one row of work.

Defined cases: vectors that are null or hold null or non-finite components (before or after scaling) take no part,
neither as queries nor as candidates. Shorter vectors count as filled with zeros, and empty ones score 0. Scores beyond
64 bits are the nearest 64-bit integer, and ties then. Where sums of products could leave what doubles hold exactly, a
shard is scored in whole by integers of any length. Ties go to the smaller vec_id. Of repeated rows each is a
candidate, except for a query of the same vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

SHARD = 8192
BLOCK = 128
K = 10
#: Terms that are probed between two looks at the bounds.
STEP = 8


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """key and x array<double>: floor(scale * component), of vectors that take part."""
    c = F.col(column)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(F.col(key).isNotNull() & c.isNotNull() & F.forall(c, fine)).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(c, lambda x: _floor(x.cast("double") * F.lit(scale))).alias("x")
    ).where(F.forall("x", lambda x: F.abs(x) < F.lit(float("inf"))))


def _floor(x: Column) -> Column:
    """floor() makes longs; from 2**53 on doubles are whole as they are."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of at most size vectors: block, ids, dims, x as bytes of doubles."""

    def run(batches):
        part, k, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def block():
            dims = max(map(len, rows))
            x = np.zeros((len(rows), dims))
            for i, r in enumerate(rows):
                x[i, : len(r)] = r
            return pd.DataFrame({"block": [part << 32 | k], "ids": [np.array(ids, np.int64).tobytes()], "dims": [dims], "x": [x.tobytes()]})

        for pdf in batches:
            for i, r in zip(pdf["vec_id"], pdf["x"], strict=True):
                ids.append(i)
                rows.append(r)
                if len(ids) == size:
                    yield block()
                    k, ids, rows = k + 1, [], []
        if ids:
            yield block()

    return vectors.mapInPandas(run, "block long, ids binary, dims int, x binary")


def unpack(ids: bytes, dims: int, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(x, np.float64).reshape(len(own), dims)


class Shard:
    """Postings of a shard: for each term the vectors in order of value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(x, self.order.T, axis=0).T.copy()
        self.size = np.abs(x).max(initial=0) * max(1, x.shape[1])

    def fits(self, q: np.ndarray) -> bool:
        """Whether sums of products stay exact in doubles."""
        return self.size * np.abs(q).max(initial=0) < 2.0**53

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.fits(q):
            return (self.x[rows] @ q).astype(np.int64)
        whole = [int(v) for v in q]
        most = (1 << 63) - 1
        return np.array([max(-most - 1, min(most, sum(int(a) * b for a, b in zip(r, whole, strict=True)))) for r in self.x[rows]], np.int64)

    def best(self, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but the query's own."""
        dims = min(len(q), self.x.shape[1])
        q, n = q[:dims], len(self.ids)
        others = int((self.ids != query).sum())
        if not dims or others <= k or not self.fits(q):
            rows = np.flatnonzero(self.ids != query)
            return self._top(rows, np.zeros(len(rows), np.int64) if not dims else self._scores(rows, q), k)
        low = np.minimum(q * self.sorted[:dims, 0], q * self.sorted[:dims, -1])
        bound = np.maximum(q * self.sorted[:dims, 0], q * self.sorted[:dims, -1]) - low
        terms = np.argsort(-bound, kind="stable")
        base = low.sum()
        # a first threshold: the best postings of the strongest terms
        seeds = np.unique(np.concatenate([self.order[d, -k - 1 :] if q[d] > 0 else self.order[d, : k + 1] for d in terms[:4]]))
        seeds = seeds[self.ids[seeds] != query]
        known = np.sort(self._scores(seeds, q))[::-1]
        threshold = float(known[k - 1]) if len(known) >= k else -np.inf
        slack = threshold - base - 1
        total = bound.sum()
        if slack <= 0 or not total:
            rows = np.arange(n)
        else:
            share = min(1.0, slack / total) * bound
            chosen = np.zeros(n, bool)
            for d in terms:
                if not q[d]:
                    continue
                cut = (share[d] + low[d]) / q[d]
                if q[d] > 0:
                    chosen[self.order[d, np.searchsorted(self.sorted[d], cut, side="right") :]] = True
                else:
                    chosen[self.order[d, : np.searchsorted(self.sorted[d], cut, side="left")]] = True
            chosen[seeds] = True
            rows = np.flatnonzero(chosen)
        rows = rows[self.ids[rows] != query]
        part, rest = np.full(len(rows), base), total
        for at in range(0, dims, STEP):
            own = terms[at : at + STEP]
            part = part + self.x[np.ix_(rows, own)] @ q[own] - low[own].sum()
            rest -= bound[own].sum()
            if len(part) > k:
                threshold = max(threshold, float(np.partition(part, len(part) - k)[len(part) - k]))
            keep = part + rest >= threshold - 0.5
            rows, part = rows[keep], part[keep]
        return self._top(rows, self._scores(rows, q), k)

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if len(q) < self.x.shape[1]:
            q = np.concatenate([q, np.zeros(self.x.shape[1] - len(q))])
        return self.exact(rows, q)

    def _top(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][first], scores[first]


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs as integers() gives them."""
    shards = saved(packed(vectors, SHARD))
    blocks = saved(packed(queries, BLOCK))
    names = [r["block"] for r in shards.select("block").orderBy("block").collect()]
    work = blocks.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("x").alias("q_x"))
    work = work.withColumn("block", F.explode(F.lit(names).cast("array<long>"))).join(shards, "block")

    def run(batches):
        last, shard = None, None
        for pdf in batches:
            for r in pdf.itertuples():
                if r.block != last:
                    last, shard = r.block, Shard(*unpack(r.ids, r.dims, r.x))
                found = []
                for query, q in zip(*unpack(r.q_ids, r.q_dims, r.q_x), strict=True):
                    ids, scores = shard.best(int(query), q, k)
                    found.append(pd.DataFrame({"query_id": query, "vec_id": ids, "score": scores}))
                yield pd.concat(found)

    near = work.mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"))
    return search(vectors.where(F.col("vec_id") % 100 == 0), vectors)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
