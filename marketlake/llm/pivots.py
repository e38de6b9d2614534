"""Exact top-k search by inner product with a pivot table.

Vectors become points of one more dimension such that all have the norm of the longest; a query gets a zero there.
Then the squared distance of a query and a point is a constant less twice their inner product, and distances obey
the triangle inequality: for every pivot, the difference of the two distances to it is a lower bound of the
distance. The table holds each vector's distances to all pivots. A query takes the largest of its lower bounds for each
candidate, evaluates candidates in the order of their bounds, and stops when the next bound is beyond its k-th best.

Vectors are dealt into blocks by a hash of their id, queries too; a block of queries meets each block of vectors in a
task of bounded size, which gives k rows for each query. Where bounds leave most of a block to a query, what is left is
evaluated as one product for many queries. Components are whole numbers and so are scores: doubles hold their sums up to a
norm of 2**52 (no partial sum is above the longest vector's squared norm), 64-bit numbers up to 2**62, Python's beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake.session import stored

PIVOTS = 24
SAMPLE = 1_000  # vectors that pivots are chosen from; the choice changes the work, not the result
BLOCK = 16_384  # vectors of a task
QUERIES = 2_048  # queries of a task
TOGETHER = 32  # queries whose bounds are worked out at a time


def scaled(vectors: DataFrame, factor: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: each component x as ``floor(factor * x)``. Vectors null or with null or non-finite parts go."""
    x = F.col(vector_col)
    fine = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * factor).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of one width, short ones filled with zeros."""
    out = np.zeros((len(column), width), np.int64)
    lengths = column.value_lengths().to_numpy()
    values = column.flatten().to_numpy()
    if (lengths == width).all():
        return values.reshape(-1, width)
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths])] = values
    return out


def choose_pivots(sample: np.ndarray, longest: float, n: int = PIVOTS) -> np.ndarray:
    """Points far from each other: each is the farthest from those before it. The last column is the added dimension."""
    points = np.column_stack([sample, np.sqrt(np.maximum(0, longest - (sample**2).sum(axis=1)))])
    if not len(points):
        return points
    chosen = [0]
    far = ((points - points[0])**2).sum(axis=1)
    while len(chosen) < min(n, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]])**2).sum(axis=1))
    return points[chosen]


def _distances(points: np.ndarray, added: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = ((points**2).sum(axis=1) + added**2)[:, None] + (pivots**2).sum(axis=1) - 2 * (points @ pivots[:, :-1].T + np.outer(added, pivots[:, -1]))
    return np.sqrt(np.maximum(square, 0))


def _exact(points: np.ndarray, longest: float) -> np.ndarray:
    """Whole numbers of a kind that holds every inner product of vectors no longer than this."""
    return points.astype(float) if longest < 2**52 else points if longest < 2**62 else points.astype(object)


def _ranked(scores: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of some candidates: highest score, then smallest id."""
    if len(scores) > 4 * k and scores.dtype != object:
        good = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, at = scores[good], at[good]
    order = sorted(range(len(at)), key=lambda i: (-scores[i], ids[at[i]])) if scores.dtype == object else np.lexsort((ids[at], -scores))
    return scores[order[:k]], at[order[:k]]


def _bests(queries: np.ndarray, above: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int):
    """The k best candidates of one block for each query. ``above``: no score is higher, minus infinity for its own row.

    Candidates are evaluated in the order of their bounds, in growing steps, until none that is left can win. If
    those left are over a quarter of the block they are evaluated together with those of other such queries.
    """
    n, found, dense = len(points), {}, {}
    for i, limits in enumerate(above):
        open_, scores, at, step = np.flatnonzero(limits > -np.inf), queries[:0, 0], np.empty(0, np.int64), 4 * k
        while len(open_):
            if len(at) >= k:
                open_ = open_[limits[open_] >= float(scores[k - 1])]
                if 4 * len(open_) > n:
                    dense[i] = open_
                    break
            if len(open_) > step:
                nearest = np.argpartition(-limits[open_], step)
                some, open_ = open_[nearest[:step]], open_[nearest[step:]]
            else:
                some, open_ = open_, open_[:0]
            scores, at = _ranked(np.concatenate((scores, points[some] @ queries[i])), np.concatenate((at, some)), ids, k)
            step *= 2
        found[i] = (scores, at)
    if dense:
        some = np.unique(np.concatenate(list(dense.values())))
        products = queries[list(dense)] @ points[some].T
        for (i, open_), row in zip(dense.items(), products):
            scores, at = found[i]
            found[i] = _ranked(np.concatenate((scores, row[np.searchsorted(some, open_)])), np.concatenate((at, open_)), ids, k)
    return [found[i] for i in range(len(queries))]


def _above(bounds: np.ndarray, most: np.ndarray) -> np.ndarray:
    """No score is higher, for least distances and a query's squared norm plus the longest one; a little is added for rounding."""
    return (most[:, None] - bounds**2) / 2 + 1e-6 * (1 + most[:, None])


def _best(query: np.ndarray, own: int, bounds: np.ndarray, points: np.ndarray, ids: np.ndarray, most: float, k: int):
    """The k best candidates of one block for one query. ``bounds``: least squared distances."""
    above = _above(np.sqrt(bounds)[None], np.array([most]))
    above[0, ids == own] = -np.inf
    return _bests(query[None], above, points, ids, k)[0]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for the rows of ``vectors(vec_id, v)`` that ``queries`` marks, the best others.

    A row with the query's own id is not its candidate. Ranks count from 1, ties go to the smaller id, null ids come last
    and are no queries. With fewer than k others all are given; shorter vectors count as filled with zeros. Repeated rows
    are rows of their own. Components may have any size; a score in the answer that is no 64-bit number raises.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select("vec_id", "v", F.coalesce(queries, F.lit(False)).alias("asks")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, width, longest, n_queries = rows.agg(
        F.count("*"), F.max(F.size("v")), F.max(square), F.count_if("asks")).first()
    width, longest = width or 0, float(longest or 0)
    # SAMPLE rows of ``width`` numbers come to the driver.
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    table = choose_pivots(_matrix(some, width).astype(float) if len(some) else np.zeros((0, width)), longest, pivots)
    shipped = spark.sparkContext.broadcast(table)
    n, m = max(1, -(-total // block)), max(1, -(-n_queries // QUERIES))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch["v"], width).astype(float)
            added = np.sqrt(np.maximum(0, longest - (points**2).sum(axis=1)))
            # As a query the added dimension is zero.
            for name, extra in (("near", added), ("asked", np.zeros(len(points)))):
                d = _distances(points, extra, shipped.value)
                batch = batch.append_column(name, pa.array(list(d), pa.list_(pa.float64())))
            yield batch

    measured = rows.mapInArrow(measure, "vec_id long, v array<long>, asks boolean, near array<double>, asked array<double>")
    measured = stored(measured, "pivot_table")
    h = F.xxhash64("vec_id", "v")
    points = measured.select("vec_id", "v", F.col("near").alias("d"), F.lit(False).alias("asks"), F.pmod(h, F.lit(n)).alias("block"),
                             F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("of"))
    asking = measured.filter("asks").select(
        "vec_id", "v", F.col("asked").alias("d"), F.lit(True).alias("asks"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"), F.pmod(h, F.lit(m)).alias("of"))

    def meet(rows):
        asks = rows["asks"].combine_chunks()
        mine, theirs = rows.filter(asks).combine_chunks(), rows.filter(pc.invert(asks)).combine_chunks()
        found = []
        if mine.num_rows and theirs.num_rows:
            q, x = (_exact(_matrix(t["v"].chunk(0), width), longest) for t in (mine, theirs))
            dq, dx = (np.stack(t["d"].chunk(0).to_numpy(zero_copy_only=False)) for t in (mine, theirs))
            names, own = theirs["vec_id"].to_pylist(), mine["vec_id"].to_pylist()
            ids = np.array([2**63 - 1 if i is None else i for i in names], np.int64)
            most = (q.astype(float)**2).sum(axis=1) + longest
            dx = np.ascontiguousarray(dx.T)
            for start in range(0, len(q), TOGETHER):
                some = slice(start, start + TOGETHER)
                bounds, gap = np.zeros((len(dq[some]), len(x))), np.empty((len(dq[some]), len(x)))
                for p in range(len(dx)):
                    np.subtract(dx[p], dq[some, p, None], out=gap)
                    np.maximum(bounds, np.abs(gap, out=gap), out=bounds)
                above = _above(bounds, most[some])
                above[np.array(own[some])[:, None] == ids] = -np.inf
                for i, (scores, at) in zip(own[some], _bests(q[some], above, x, ids, k)):
                    found += [(i, names[j], int(v)) for v, j in zip(scores, at)]
        columns = zip(*found) if found else ((),) * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    best = points.unionByName(asking).groupBy("block", "of").applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
