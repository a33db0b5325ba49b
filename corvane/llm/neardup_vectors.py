"""Embedding near-duplicates by an exact metric range join.

On unit vectors, cosine >= t means an angle of at most arccos(t). Pivots partition the
vectors into cells of the nearest pivot. A vector is replicated to a lower-numbered
cell only if a vector within that angle can lie there: by the triangle inequality, if
its distance to the plane between the two pivots is at most sin(arccos(t)). Each linked
pair then meets in exactly one cell, the lower of its two, and cells join on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, parallelism, table
from corvane.llm.graph import components
from corvane.llm.vectors import is_sound, matrix, runs, spread_pivots

THRESHOLD = 0.9
#: Vectors from which pivots are drawn, least and most pivots, and vectors a cell aims at.
SAMPLE, FEW, PIVOTS, CELL = 4096, 4, 256, 8192
#: Vectors that a task holds at once; a larger cell is cut into slices.
SLICE = 2048


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_links(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= threshold; component_id is the least
    id reachable by links; kept marks it. Equal vectors are joined once, as a class
    with its number of rows; all counts are exact and no pair is emitted: tasks return
    counts, and edges that span what they linked. Cases: vectors that are null, empty,
    zero or hold null or non-finite components link with nothing; vectors of different
    lengths do not link; repeated rows and rows that share an id are rows of their own;
    a null id is kept as it is, links like any other and is nobody's component, which is
    null if it has null ids only; no rows, no result; other columns are ignored.
    """
    ws = Workspace(spark)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    sound = is_sound("v") & F.exists("v", lambda x: x != 0)
    keyed = ws.save(raw.select("vec_id", F.when(sound, F.xxhash64("v")).alias("k1"), F.when(sound, F.xxhash64(F.lit(1), F.reverse("v"))).alias("k2"), F.when(sound, F.col("v")).alias("v")), "keyed")
    classes = ws.save(keyed.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).withColumn("dim", F.size("v")), "classes")
    sample = classes.select("k1", "k2", "dim", "v").orderBy("k1", "k2").limit(SAMPLE).collect()
    sizes = {r[0]: r[1] for r in classes.groupBy("dim").count().collect()}  # a row a vector length
    sine = float(np.sqrt(1 - threshold * threshold))
    pivots = {}
    for dim, n in sizes.items():
        x = [r[3] for r in sample if r[2] == dim]
        x = _unit(np.array(x, dtype=np.float64)) if x else np.eye(1, dim)
        pivots[dim] = spread_pivots(x, int(min(PIVOTS, max(FEW, -(-n // CELL)))), 2 * sine)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), rows in runs(batches, 1):
            x = _unit(np.array(rows.column(3).flatten(), dtype=np.float64).reshape(-1, dim))
            p = pivots[dim]
            c = x @ p.T
            home = c.argmax(1)
            apart = np.sqrt(np.maximum(1e-12, 2 - 2 * p @ p.T))
            near = (c[np.arange(len(x)), home][:, None] - c) / apart[home] <= sine + 1e-9
            near &= np.arange(len(p)) <= home[:, None]
            near[np.arange(len(x)), home] = True
            a, b = np.nonzero(near)
            raw = [r.tobytes() for r in x]
            take = pa.array(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), dim, dtype=np.int32)), pa.array(b.astype(np.int32)), pa.array((home[a] != b).astype(np.int32)), *(rows.column(i).take(take) for i in (1, 2)), pa.array([raw[i] for i in a], pa.binary())], names=["dim", "cell", "guest", "slot", "copies", "v"])

    # A class goes by one number, not by an id, which several classes may share.
    dealt = classes.select("dim", F.xxhash64("k1", "k2").alias("slot"), "copies", "v").sortWithinPartitions("dim")
    dealt = ws.save(dealt.mapInArrow(deal, "dim int, cell int, guest int, slot long, copies long, v binary"), "dealt")
    cells = dealt.filter("guest = 0").groupBy("dim", "cell").count().collect()  # PIVOTS rows a length at most
    shape = F.broadcast(spark.createDataFrame([(r[0], r[1], -(-r[2] // SLICE)) for r in cells], "dim int, cell int, slices long"))
    sliced = dealt.join(shape, ["dim", "cell"]).withColumn("own", F.when(F.col("guest") == 0, F.pmod("slot", "slices")))
    residents = sliced.filter("guest = 0").select("dim", "cell", F.col("own").alias("slice"), F.lit(0).alias("kind"), "slot", "copies", "v")
    # A resident of a slice also visits the slices before its own; a guest visits all.
    visits = sliced.withColumn("last", F.when(F.col("guest") == 0, F.col("own") - 1).otherwise(F.col("slices") - 1)).filter("last >= 0")
    visits = visits.select("dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("slice"), F.lit(1).alias("kind"), "slot", "copies", "v")

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosine >= threshold in double precision; single precision where it is clear."""
        s = a.astype(np.float32) @ b.astype(np.float32).T
        hit = s >= threshold
        i, j = np.nonzero(np.abs(s - threshold) < 1e-4)
        if len(i):
            hit[i, j] = (a[i] * b[j]).sum(1) >= threshold
        return hit

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close():
            """Counts of the residents, and their links with each other."""
            if not held:
                return None
            ids, copies, x = (np.concatenate(c) for c in zip(*held, strict=True))
            return ids, copies, x, np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

        def meet(slice_, ids, copies, x, itself):
            """Counts of the visitors, added counts of the residents, spanning edges."""
            own_ids, own_copies, own_x, counts, label = slice_
            edges = []
            seen = np.zeros(len(ids), dtype=np.int64)
            for lo in range(0, len(ids), 512):
                hit = linked(x[lo : lo + 512], own_x)
                if itself:
                    n = len(hit)
                    hit[np.arange(n), np.arange(lo, lo + n)] = False
                seen[lo : lo + 512] = hit @ own_copies
                if not itself:
                    counts += copies[lo : lo + 512] @ hit
                for i in np.flatnonzero(hit.any(1)):
                    j = np.flatnonzero(hit[i])
                    labels = np.unique(label[np.append(j, lo + i)] if itself else label[j])
                    if itself:
                        edges += [(own_ids[labels[0]], own_ids[m]) for m in labels[1:]]
                    else:
                        edges += [(ids[lo + i], own_ids[m]) for m in labels]
                    if len(labels) > 1:
                        label[np.isin(label, labels)] = labels[0]
            if itself:
                counts += seen
            return seen, edges

        def rows(ids, counts, edges):
            some = counts > 0
            a = np.array([e[0] for e in edges], dtype=np.int64)
            b = np.array([e[1] for e in edges], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], a])), pa.array(np.concatenate([counts[some], np.zeros(len(a), dtype=np.int64)])), pa.array(np.concatenate([ids[some], b]))], names=["a", "n", "b"])

        now, held, slice_ = None, [], None
        for (dim, cell, part, kind), batch in runs(batches, 4):
            if now != (dim, cell, part):
                if now is not None:
                    if slice_ is None and (slice_ := close()):
                        _, edges = meet(slice_, *slice_[:3], True)
                        yield rows(slice_[0], np.zeros(len(slice_[0]), dtype=np.int64), edges)
                    if slice_ is not None:
                        yield rows(slice_[0], slice_[3], [])
                now, held, slice_ = (dim, cell, part), [], None
            ids, copies, x = batch.column(4).to_numpy(), batch.column(5).to_numpy(), matrix(batch.column(6), dim, "f8")
            if kind == 0:
                held.append((ids, copies, x))
                continue
            if slice_ is None:
                slice_ = close()
                _, edges = meet(slice_, *slice_[:3], True)
                yield rows(slice_[0], np.zeros(len(slice_[0]), dtype=np.int64), edges)
            seen, edges = meet(slice_, ids, copies, x, False)
            yield rows(ids, seen, edges)
        if now is not None:
            if slice_ is None and (slice_ := close()):
                _, edges = meet(slice_, *slice_[:3], True)
                yield rows(slice_[0], np.zeros(len(slice_[0]), dtype=np.int64), edges)
            if slice_ is not None:
                yield rows(slice_[0], slice_[3], [])

    met = residents.unionByName(visits).repartition(parallelism(spark), "dim", "cell", "slice").sortWithinPartitions("dim", "cell", "slice", "kind")
    found = ws.save(met.mapInArrow(join, "a long, n long, b long"), "found")
    counts = found.filter("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    group = components(found.filter("n = 0").select("a", "b"), ws)
    named = classes.select("k1", "k2", "least", "copies", F.xxhash64("k1", "k2").alias("slot"))
    named = named.join(counts, F.col("slot") == F.col("a"), "left").join(group, F.col("slot") == F.col("node"), "left")
    named = ws.save(named.select("k1", "k2", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "slot").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = ws.save(named.join(least, "component").select("k1", "k2", "n_links", "component_id"), "labelled")
    ws.keep("keyed", "labelled")
    k, c = keyed.drop("v").alias("k"), labelled.alias("c")
    out = k.join(c, (F.col("k.k1") == F.col("c.k1")) & (F.col("k.k2") == F.col("c.k2")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links among all embeddings."""
    return near_links(spark, table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_near_vectors": op3_near_vectors}
_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding, embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM v WHERE ok),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN least ON v.vec_id = least.vec_id LEFT JOIN n ON v.vec_id = n.vec_id
"""
ORACLE_SQL = {"op3_near_vectors": _SQL}
