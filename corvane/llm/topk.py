"""Exact top-k inner-product search with a pivot-distance index.

With M the largest norm, (v, sqrt(M^2 - |v|^2)) and (q, 0) turn inner products into
distances: d^2 = |q|^2 + M^2 - 2 q.v. Every vector is keyed by its nearest pivot and
the distance to it; a pivot's vectors, sorted by distance, form annuli. A query looks
first at the annulus it falls in, which gives a k-th score; by the triangle inequality
only annuli that can hold as good a score are then expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, parallelism, table
from corvane.llm.vectors import is_sound, matrix, runs, spread_pivots

#: Vectors from which pivots are drawn, pivots per dimension, and annuli of a pivot: so
#: many bounds at most does a query compare itself with.
SAMPLE, PIVOTS, ANNULI = 4096, 64, 64
#: Vectors that an annulus aims at, and that a task holds at once; a larger annulus is
#: cut into slices.
RING, SLICE = 512, 4096


def _dot(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all sums stay below 2^53."""
    if len(q) and len(v) and float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] >= 2.0**52:
        exact = q.astype(object) @ v.astype(object).T
        return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
    return (q @ v.T).astype(np.int64)


def _top(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places) of the k best of each query but for its own row, ties to the least id."""
    for i in range(len(scores)):
        s, other = scores[i], rows != own[i]
        if len(s) > k + 64:  # all that reach the k-th best but for the query itself
            least = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
            keep = np.flatnonzero((s >= least) & other)
        else:
            keep = np.flatnonzero(other)
        yield i, keep[np.lexsort((ids[keep], -s[keep]))[:k]]


def top_k(spark: SparkSession, vectors: DataFrame, queries: Column | DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best rows of `vectors` by the
    inner product of floor(scale * x), ties to the smaller id.

    Queries are the rows of `vectors` for which a condition holds, each compared with
    every row but itself, or the rows of another frame, compared with all. Vectors of
    another length are no candidates. Cases: vectors that are null, empty or hold null or
    non-finite components take no part; fewer than k candidates give fewer rows; repeated
    rows and rows that share an id are candidates each, and queries each, with a result of
    its own; a null id is a candidate like any other, the last of equal scores, and as a
    query has a result of its own; a score that 64 bits cannot hold is clipped to their
    range; no rows, no result; other columns are ignored.
    """
    ws = Workspace(spark)
    numbers = lambda df, *more: df.filter(is_sound(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), F.monotonically_increasing_id().alias("row"), *more)
    inside = isinstance(queries, Column)
    # A row goes by its number, which the saved table fixes: rows may share an id.
    data = ws.save(numbers(vectors, F.coalesce(queries, F.lit(False)).alias("asks") if inside else F.lit(False).alias("asks")), "rows")
    outside = None if inside else ws.save(numbers(queries), "outside").withColumn("own", F.lit(-1).cast("long"))
    data = data.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    largest = {r[0]: r[1] for r in data.groupBy("dim").agg(F.max("norm2")).collect()}  # a row a vector length
    sample = data.select("id", "dim", "v").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()
    pivots, bound = {}, {}
    for dim, m2 in largest.items():
        x = np.array([r[2] for r in sample if r[1] == dim]).reshape(-1, dim)
        x = np.hstack([x, np.sqrt(np.maximum(0, m2 - (x * x).sum(1)))[:, None]])
        if not len(x):
            x = np.zeros((1, dim + 1))
        pivots[dim] = spread_pivots(x, PIVOTS, 0.05 * np.sqrt(m2))
        bound[dim] = m2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), rows in runs(batches, 1):
            v = np.array(rows.column(2).flatten()).reshape(-1, dim)
            p = pivots[dim]
            lifted = np.hstack([v, np.sqrt(np.maximum(0, bound[dim] - (v * v).sum(1)))[:, None]])
            d2 = np.maximum(0, (lifted * lifted).sum(1)[:, None] + (p * p).sum(1) - 2 * lifted @ p.T)
            cell = d2.argmin(1)
            dist = np.sqrt(((lifted - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cell.astype(np.int32)), pa.array(dist), rows.column(1), rows.column(3), pa.array([r.tobytes() for r in v], pa.binary())], names=["dim", "cell", "dist", "id", "row", "v"])

    index = ws.save(data.select("dim", "id", "v", "row").sortWithinPartitions("dim").mapInArrow(place, "dim int, cell int, dist double, id long, row long, v binary"), "index")
    cells = {(r[0], r[1]): r[2:] for r in index.groupBy("dim", "cell").agg(F.count(F.lit(1)), F.min("dist"), F.max("dist")).collect()}  # PIVOTS rows a length at most
    ring = {key: (lo, max((hi - lo) / n, 1e-9), n) for key, (count, lo, hi) in cells.items() for n in [int(min(ANNULI, max(1, -(-count // RING))))]}
    shape = spark.createDataFrame([(d, c, float(lo), float(w), n) for (d, c), (lo, w, n) in ring.items()], "dim int, cell int, lo double, width double, rings int")
    keyed = index.join(F.broadcast(shape), ["dim", "cell"]).withColumn("ring", F.least(F.col("rings") - 1, F.floor((F.col("dist") - F.col("lo")) / F.col("width")).cast("int"))).drop("lo", "width", "rings")
    rings = keyed.groupBy("dim", "cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")).collect()  # PIVOTS * ANNULI rows a length at most
    slices = spark.createDataFrame([(r.dim, r.cell, r.ring, -(-r.n // SLICE)) for r in rings], "dim int, cell int, ring int, slices long")
    at = {d: [(r.cell, r.ring, r.near, r.far, r.n) for r in rings if r.dim == d] for d in pivots}
    resident = keyed.join(F.broadcast(slices), ["dim", "cell", "ring"]).select("dim", "cell", "ring", F.pmod(F.xxhash64("row"), "slices").alias("slice"), F.lit(0).alias("kind"), "id", "v", F.col("row").alias("asker"), F.lit(0).cast("long").alias("own"))

    # A query is its asker's number; its own row is one that none has if it comes from outside.
    asked = (data.filter("asks").withColumn("own", F.col("row")) if inside else outside).select("dim", "id", "v", F.col("row").alias("asker"), "own").withColumn("floor", F.lit(None).cast("long"))

    def expand(nearest: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (dim,), rows in runs(batches, 1):
                if dim not in pivots:
                    continue
                q = np.array(rows.column(2).flatten()).reshape(-1, dim)
                p, found = pivots[dim], at[dim]
                cell, annulus, near, far, n = (np.array(x) for x in zip(*found, strict=True))
                q2 = (q * q).sum(1)
                d = np.sqrt(np.maximum(0, q2[:, None] + (p * p).sum(1) - 2 * q @ p[:, :-1].T))[:, cell]
                gap = np.maximum(0, np.maximum(near - d, d - far))
                best = (q2[:, None] + bound[dim] - gap**2) / 2  # no score of the annulus is higher
                slack = 1e-6 * (q2[:, None] + bound[dim]) + 1
                if nearest:
                    wide = n > k  # an annulus with enough others, if there is one
                    pick = np.where(wide, gap + 1e-6 * d, np.inf).argmin(1) if wide.any() else gap.argmin(1)
                    hit = np.zeros(best.shape, dtype=bool)
                    hit[np.arange(len(q)), pick] = True
                else:
                    least = rows.column(5).to_numpy(zero_copy_only=False).astype(np.float64)
                    hit = np.isnan(least)[:, None] | (best + slack >= np.nan_to_num(least)[:, None])
                a, b = np.nonzero(hit)
                vec = [x.tobytes() for x in q]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), dim, dtype=np.int32)), pa.array(cell[b].astype(np.int32)), pa.array(annulus[b].astype(np.int32)), rows.column(1).take(pa.array(a)), pa.array([vec[i] for i in a], pa.binary()), pa.array(rows.column(3).to_numpy()[a]), pa.array(rows.column(4).to_numpy()[a])], names=["dim", "cell", "ring", "id", "v", "asker", "own"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        ids = nulls = numbers = v = None
        for (dim, cell, annulus, part, kind), rows in runs(batches, 5):
            if now != (dim, cell, annulus, part):
                now, held, v = (dim, cell, annulus, part), [], None
            if kind == 0:
                given = rows.column(5)
                held.append((given.fill_null(2**63 - 1).to_numpy(), np.array(given.is_null()), rows.column(7).to_numpy(), matrix(rows.column(6), dim, "f8")))
                continue
            if v is None:
                ids, nulls, numbers, v = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64), np.zeros((0, dim)))
            query, asker, own = rows.column(5), rows.column(7).to_numpy(), rows.column(8).to_numpy()
            scores = _dot(matrix(rows.column(6), dim, "f8"), v)
            who, what = [], []
            for i, best in _top(scores, ids, numbers, own, k):
                who.append(np.full(len(best), i))
                what.append(best)
            who, what = np.concatenate(who).astype(np.int64), np.concatenate(what).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(asker[who]), query.take(pa.array(who)), pa.array(ids[what], mask=nulls[what]), pa.array(scores[who, what])], names=["asker", "query_id", "vec_id", "score"])

    def look(asked: DataFrame, nearest: bool) -> DataFrame:
        probes = asked.select("dim", "id", "v", "asker", "own", "floor").sortWithinPartitions("dim").mapInArrow(expand(nearest), "dim int, cell int, ring int, id long, v binary, asker long, own long")
        probes = probes.join(F.broadcast(slices), ["dim", "cell", "ring"]).select("dim", "cell", "ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("kind"), "id", "v", "asker", "own")
        both = resident.unionByName(probes).repartition(parallelism(spark), "dim", "cell", "ring", "slice").sortWithinPartitions("dim", "cell", "ring", "slice", "kind")
        found = both.mapInArrow(compare, "asker long, query_id long, vec_id long, score long")
        order = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = look(asked, True).filter(F.col("rank") == k).select("asker", F.col("score").alias("floor"))
    bounded = ws.save(asked.drop("floor").join(first, "asker", "left").select("dim", "id", "v", "asker", "own", "floor"), "bounded")
    return look(bounded, False).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every fiftieth vector among all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(spark, vectors, F.col("vec_id") % 50 == 0)


_SQL = """
WITH ok AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.r <> c.r AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES = {"op10_top_k": op10_top_k}
ORACLE_SQL = {"op10_top_k": _SQL}
