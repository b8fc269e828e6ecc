"""Operator 3: exact top-k inner products, score at a time over an impact-ordered index.

Vectors are dealt into blocks by their id. A block's index holds, for each dimension, its vectors sorted by component
and cut into posting segments of one quantised component (component >> STEP_BITS). A query takes the segments of all
dimensions by descending quantised impact, a round of them at a time, and adds what each member contributes over the
least that the dimension can give. What a vector can still gain is at most the sum, over dimensions, of the next
segment's impact. A query stops once that proves all but a SHARE-th of the block's vectors, or all but k, to be out;
the others are scored exactly. Where no proof comes, all segments are taken. Blocks of every size go this way.

Queries and blocks meet in a grid of (block, query block) groups of bounded size; each gives k rows for each query. A
group builds the index of its block anew, which takes as long as a dozen of its queries do.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; only vectors of equal
length are compared; of rows that share an id the one of the smallest vector counts; rows with a null id take no part;
ties go to the smaller id; queries with no candidate have no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import load

K = 10
SCALE = 1024
#: Bytes of a block's vectors, and queries of a query block, about.
BLOCK_BYTES, QUERIES = 8 << 20, 4_096
STEP_BITS = 7
#: A query stops when so small a part of a block is left for exact scoring; it looks after each of so many rounds.
SHARE, ROUNDS = 8, 12


class Index:
    """Impact-ordered posting segments of a block of integer vectors."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        order = np.argsort(x, axis=0, kind="stable").T
        values = np.take_along_axis(np.ascontiguousarray(x.T), order, 1)
        d, n = values.shape
        self.members, self.values = order.ravel(), values.ravel().astype(np.float64)
        begin = np.ones((d, n), bool)
        begin[:, 1:] = values[:, 1:] >> STEP_BITS != values[:, :-1] >> STEP_BITS
        self.begin = np.flatnonzero(begin)
        self.end = np.append(self.begin[1:], d * n)
        self.dims = self.begin // n
        self.least, self.most = self.values[self.begin], self.values[self.end - 1]
        # what a member gives over the least of its dimension, for a weight of 1 and of -1
        rows = self.values.reshape(d, n)
        self.over = (rows - rows[:, :1]).ravel(), (rows[:, -1:] - rows).ravel()
        self.looked_at = 0

    def best(self, q: np.ndarray, k: int, never: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of all that can be among the k best, without the positions in never."""
        n, d = self.x.shape
        k = min(k, n - len(never))
        if not k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        weight = q.astype(np.float64)
        ends = weight[self.dims] * self.most, weight[self.dims] * self.least
        low = np.full(d, np.inf)
        np.minimum.at(low, self.dims, np.minimum(*ends))
        gain = np.maximum(*ends) - low[self.dims]
        order = np.argsort(-gain, kind="stable")
        dims, begin, end = self.dims[order], self.begin[order], self.end[order]
        # what each dimension can still give after each step: the gain of its next segment in this order
        following = np.zeros(len(order))
        by_dim = np.argsort(dims, kind="stable")
        g = gain[order][by_dim]
        following[by_dim[:-1]] = np.where(dims[by_dim][1:] == dims[by_dim][:-1], g[1:], 0)
        first = np.zeros(d)
        np.maximum.at(first, self.dims, gain)
        remaining = first.sum() + np.cumsum(following - gain[order])
        # sums of such numbers in floating point are off by less than this
        slack = 2.0**-48 * (np.abs(low).sum() + first.sum())
        score = np.zeros(n)
        score[never] = -np.inf
        rounds = np.flatnonzero(np.diff(np.cumsum(end - begin) * ROUNDS // (n * d), append=-1))
        done = 0
        for last in rounds:
            own = slice(done, last + 1)
            size = end[own] - begin[own]
            # segments of one dimension lie side by side: as few ranges as dimensions
            side = np.lexsort((begin[own], dims[own]))
            b, e, m = begin[own][side], end[own][side], dims[own][side]
            joint = np.append(True, (b[1:] != e[:-1]) | (m[1:] != m[:-1]))
            lo, hi, m = b[joint], e[np.append(joint[1:], True)], m[joint]
            ranges = list(zip(lo.tolist(), hi.tolist(), strict=True))
            members = np.concatenate([self.members[i:j] for i, j in ranges])
            value = np.concatenate([self.over[below][i:j] for (i, j), below in zip(ranges, (weight[m] < 0).tolist(), strict=True)])
            value *= np.repeat(np.abs(weight[m]), hi - lo)
            score += np.bincount(members, value, n)
            self.looked_at += int(size.sum())
            done = last + 1
            if n == k:
                break
            bound = np.partition(score, n - k)[n - k] - remaining[last] - slack
            left = np.flatnonzero(score >= bound)
            if len(left) <= max(k, n // SHARE):
                break
        else:
            left = np.flatnonzero(score >= np.partition(score, n - k)[n - k] - slack)
        if n == k:
            left = np.arange(n)
        left = left[~np.isin(left, never)]
        return left, self.x[left] @ q


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids ascending, vectors), each id once, with its smallest vector."""
    ids = table.column("id").to_numpy()
    x = np.array(table.column("vector").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    first = np.append(True, ids[1:] != ids[:-1])
    return ids[first], x[first]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors for each of queries, but for the query's own id.

    Both are (id long, vector array<long>), without nulls; scores must fit a long.
    """
    size, m = vectors.agg(F.sum(F.size("vector") * 8)).first()[0] or 0, queries.count()
    blocks, groups = max(1, -(-size // block_bytes)), max(1, -(-m // QUERIES))
    deal = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(parts)).cast("int")
    size = F.size("vector").alias("size")
    left = vectors.select("id", "vector", size, deal("block", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("queries"))
    right = queries.select("id", "vector", size, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal("queries", groups).alias("queries"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(here: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(here) or not len(asked):
            return schema.empty_table()
        ids, x = _vectors(here)
        query_ids, q = _vectors(asked)
        index = Index(x)
        out = []
        for query, row in zip(query_ids, q, strict=True):
            own = np.searchsorted(ids, query)
            never = np.array([own]) if own < len(ids) and ids[own] == query else np.zeros(0, np.int64)
            at, score = index.best(row, k, never)
            best = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(best), query), ids[at[best]], score[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    keys = ("size", "block", "queries")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, vector): floor(scale * component) of the vectors that take part."""
    usable = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size("vector") > 0) & F.col("id").isNotNull()
    vectors = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return vectors.where(usable).withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x)))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(load(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("id % 100 = 0"))


ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores
) WHERE rank <= 10
"""
