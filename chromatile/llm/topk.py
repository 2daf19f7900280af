"""Exact top-k inner products by pivot-table elimination.

Vectors are turned into integers.  With one more coordinate that gives every candidate
the same length, and zero for queries, the inner product falls as the distance grows,
so the triangle inequality bounds it: distances of all rows to some pivots are computed
once, and for a query and a candidate the largest difference of their distances to a
pivot bounds their distance from below.  A query evaluates the candidates of a block in
the order of their bounds and stops when no bound left can reach its k-th score.

Queries and candidates meet in blocks of fixed size, so a task holds one block of each;
every query meets every block, and its best of all blocks are ranked at the end.
Pivots are spread by farthest-first choice over a sample of ``PIVOT_SAMPLE`` rows.

Results: vectors that are null, hold a null or non-finite component, or differ in
length from the most frequent length (ties: the shorter) take no part, nor do null ids;
candidates with the query's id are its own row; equal repeated rows count once; equal
scores go to the smaller id; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from chromatile.session import materialize

K, SCALE, QUERY_STEP = 20, 64, 20
PIVOTS, PIVOT_SAMPLE = 32, 1024
CANDIDATE_BLOCK, QUERY_BLOCK = 16384, 2048
STEP = 256


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v, sq)``: usable vectors as whole numbers, and their squared length."""
    v = F.transform(F.col("embedding"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    out = materialize(out.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct(), "vectors")
    top = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    same = out.filter(F.size("v") == (top["d"] if top else 0))
    return same.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice, beginning at the longest row."""
    if not len(sample):
        return sample
    chosen = [int((sample**2).sum(1).argmax())]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _search(candidates: pd.DataFrame, queries: pd.DataFrame, k: int, longest: float) -> pd.DataFrame:
    """Best ``k`` of one block for each query of another.

    The candidates with the best bounds are evaluated first; those that can still reach
    the k-th score follow in the order of their bounds, or, when they are a large part
    of the block, in one product.
    """
    ids, x = candidates["vec_id"].to_numpy(np.int64), np.stack(candidates["v"].to_numpy())
    far = np.ascontiguousarray(np.stack(candidates["far"].to_numpy()).T.astype(np.float32))
    slack = 1e-5 * np.sqrt(longest + 1) + 1e-3
    n, out = len(ids), []
    bound, gap = np.empty(n, np.float32), np.empty(n, np.float32)

    def evaluate(part: np.ndarray, q: np.ndarray, q_id: int) -> np.ndarray:
        got = x[part] @ q
        got[ids[part] == q_id] = -np.inf
        return got

    def least(scores: np.ndarray) -> float:
        return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf

    for q_id, key, q, sq, near in zip(queries["vec_id"], queries["key"], queries["v"], queries["sq"], queries["near"]):
        bound.fill(0)
        for row, d in zip(far, near):
            np.subtract(row, np.float32(d), out=gap)
            np.abs(gap, out=gap)
            np.maximum(bound, gap, out=bound)
        most = np.floor((sq + longest - np.maximum(bound - slack, 0).astype(np.float64) ** 2) / 2 + 1e-6)
        seen = np.argpartition(most, n - STEP)[n - STEP :] if n > STEP else np.arange(n)
        scores = evaluate(seen, q, q_id)
        kth = least(scores)
        rest = most >= kth
        rest[seen] = False
        rest = np.flatnonzero(rest)
        if len(rest) > n // 4:
            scores, seen = x @ q, np.arange(n)
            scores[ids == q_id] = -np.inf
            kth = least(scores)
        else:
            rest, at = rest[np.argsort(-most[rest])], 0
            while at < len(rest) and most[rest[at]] >= kth:
                part = rest[at : at + STEP]
                scores, seen = np.concatenate([scores, evaluate(part, q, q_id)]), np.concatenate([seen, part])
                at, kth = at + STEP, least(scores)
        good = np.flatnonzero((scores >= kth) & (scores > -np.inf))
        best = good[np.lexsort((ids[seen[good]], -scores[good]))][:k]
        out.append(pd.DataFrame({"query_id": q_id, "key": key, "vec_id": ids[seen[best]], "score": scores[best].astype(np.int64)}))
    return pd.concat(out, ignore_index=True)


def top_inner_products(rows: DataFrame, is_query: Column | None = None, k: int = K, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` highest integer inner products of each query row."""
    spark = rows.sparkSession
    is_query = F.col("vec_id") % QUERY_STEP == 0 if is_query is None else is_query
    vectors = integer_vectors(rows, scale)
    n, longest = vectors.agg(F.count("*"), F.max("sq")).first()
    longest = float(longest or 0.0)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).select("v").collect()
    shared = spark.sparkContext.broadcast(choose_pivots(np.array([r["v"] for r in sample], float).reshape(len(sample), -1), pivots) if sample else np.zeros((0, 0)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        p_sq = (p**2).sum(1)
        for part in batches:
            x, sq = np.stack(part["v"].to_numpy()), part["sq"].to_numpy()[:, None]
            dot = x @ p.T
            lift = np.sqrt(np.maximum(longest - sq, 0)) - np.sqrt(np.maximum(longest - p_sq, 0))
            far = np.sqrt(np.maximum(sq + p_sq - 2 * dot, 0) + lift**2)
            near = np.sqrt(np.maximum(sq + longest - 2 * dot, 0))
            yield part.assign(far=list(far), near=list(near))

    table = vectors.mapInPandas(measure, "vec_id long, v array<double>, sq double, far array<double>, near array<double>")
    table = materialize(table, "pivot_table")
    queries = table.filter(is_query).select("vec_id", "v", "sq", "near").withColumn("key", F.xxhash64("v"))
    across, down = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    spot = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    left = table.select("vec_id", "v", "far", spot("vec_id", across).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("qb"))
    right = queries.select("*", spot("vec_id", down).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("cb"))

    def block(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "key", "vec_id", "score")})
        return _search(candidates, queries, k, longest)

    schema = "query_id long, key long, vec_id long, score long"
    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(block, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
