"""Approximate nearest neighbours by collision counting (query-aware, with virtual rehashing).

Vectors are dealt into blocks of bounded size, queries into blocks of their own, and each pair of blocks is one task
group. In a block every one of `projections` random lines has the vectors' projections in a sorted array. A query's
window on each line is centred on the query; widening all windows by the growth factor is rehashing to a larger
radius without building anything. A vector inside a query's windows on at least `share` of the lines has collided
enough and is verified by its exact distance. A query is done in a block when its k-th verified distance is within
the radius of the present windows, or when nothing is left. The exact distances of all blocks are merged.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
another length than the query's are no candidates; repeated vectors are candidates each, ties go to the smaller
vec_id; a null vec_id takes no part; rows of the same vec_id as the query are its own. Each row of the queries has its
own k neighbours, so repeated queries repeat their list and a vec_id with two vectors has two. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import settle


@dataclass(frozen=True)
class Settings:
    projections: int = 48
    #: Share of the lines on which a vector must collide.
    share: float = 0.75
    growth: float = 1.3
    block_rows: int = 8_192
    query_rows: int = 1_024
    seed: int = 11


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.coalesce(good, F.lit(False))).where(F.exists("v", lambda x: x != 0))


class Index:
    """Sorted projections of one block."""

    def __init__(self, x: np.ndarray, s: Settings):
        self.s, self.x = s, x
        lines = np.random.default_rng(s.seed).standard_normal((x.shape[1], s.projections))
        self.lines = lines
        p = x @ lines
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(p.T, self.order, axis=1)
        # a radius at which a window holds a few vectors: from the spacing of the sorted arrays
        n = len(x)
        span = float(np.median(self.sorted[:, -1] - self.sorted[:, 0])) if n > 1 else 1.0
        self.start = max(span / 64, 1e-12)

    def search(self, q: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of verified vectors, at least the k nearest found; skip marks rows that aren't candidates."""
        s, n = self.s, len(self.x)
        need = math.ceil(s.share * s.projections)
        at = q @ self.lines
        count = np.zeros(n, np.int32)
        dist = np.full(n, np.inf)
        seen = skip.copy()
        low = np.array([np.searchsorted(row, a) for row, a in zip(self.sorted, at, strict=True)])
        high = low.copy()
        # on a line, a vector at distance width / z collides with the probability of |N(0, 1)| <= z: 0.87, well above share
        width, z = self.start, 1.5
        while True:
            for j in range(s.projections):
                a, b = np.searchsorted(self.sorted[j], (at[j] - width, at[j] + width), side="left")
                b = max(b, high[j])
                while b < n and self.sorted[j, b] <= at[j] + width:
                    b += 1
                a = min(a, low[j])
                count[self.order[j, a : low[j]]] += 1
                count[self.order[j, high[j] : b]] += 1
                low[j], high[j] = a, b
            fresh = np.flatnonzero((count >= need) & ~seen)
            if len(fresh):
                seen[fresh] = True
                d = self.x[fresh] - q
                dist[fresh] = np.sqrt((d * d).sum(axis=1))
            got = np.flatnonzero(np.isfinite(dist))
            if len(got) >= k and np.partition(dist[got], k - 1)[k - 1] <= width / z:
                return got, dist[got]
            if seen.all() or (low == 0).all() and (high == n).all():
                rest = np.flatnonzero(~seen)
                d = self.x[rest] - q
                dist[rest] = np.sqrt((d * d).sum(axis=1))
                got = np.flatnonzero(np.isfinite(dist))
                return got, dist[got]
            width *= s.growth


def _search_block(rows: pa.Table, asked: pa.Table, k: int, s: Settings) -> pa.Table:
    """The k nearest rows of the block for each query q, by (distance, vec_id)."""
    ids = rows.column("vec_id").to_numpy()
    x = np.array(rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    qid = asked.column("vec_id").to_numpy()
    qs = np.array(asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(qid), -1)
    index = Index(x, s)
    out: tuple[list, list, list] = ([], [], [])
    for at, (i, q) in enumerate(zip(qid, qs, strict=True)):
        got, d = index.search(q, k, ids == i)
        best = np.lexsort((ids[got], d))[:k]
        out[0].extend([at] * len(best))
        out[1].extend(ids[got[best]])
        out[2].extend(d[best])
    mine = asked.select(["q", "n", "vec_id"]).take(pa.array(out[0], pa.int64()))
    return pa.table({"q": mine.column("q"), "n": mine.column("n"), "query_id": mine.column("vec_id"), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of all vectors for each row of queries (embedding, vec_id)."""
    rows = usable(vectors).withColumn("dim", F.size("v"))
    # q: a query, which stands in n rows
    asked = settle(usable(queries).groupBy("vec_id", "v").agg(F.count("*").alias("n")).withColumn("q", F.monotonically_increasing_id())).withColumn("dim", F.size("v"))
    dims = settle(rows.groupBy("dim").agg(F.count("*").alias("n")))
    blocks = dims.select("dim", F.ceil(F.col("n") / settings.block_rows).cast("int").alias("blocks"))
    n_asked = max(1, -(-asked.count() // settings.query_rows))
    salt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), n).cast("int")
    blocks = F.broadcast(blocks)  # a row for each vector length
    # each block of vectors meets each block of queries of its length
    left = rows.join(blocks, "dim").withColumn("b", salt(F.col("blocks"), 3)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(int(n_asked) - 1)))).select("dim", "b", "qb", "vec_id", "v")
    right = asked.join(blocks, "dim").withColumn("qb", salt(F.lit(int(n_asked)), 5)).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "b", "qb", "vec_id", "v", "q", "n")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in ("q", "n", "query_id", "vec_id", "score")})
        return _search_block(a, b, k, settings)

    keys = ["dim", "b", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "q long, n long, query_id long, vec_id long, score double")
    w = Window.partitionBy("q").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).select("query_id", "rank", "vec_id", "score")


def nearest_of_own(vectors: DataFrame, every: int = 100, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`."""
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0), k, settings)
