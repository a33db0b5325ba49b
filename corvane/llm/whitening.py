"""Embedding whitening by hierarchical merging of singular value decompositions.

Every partition decomposes its centred vectors and keeps all singular values and right
vectors, its count and its sums. Two such parts merge by decomposing their rows s * V
stacked on a row that corrects for the difference of their means, which loses nothing:
the merged part has the covariance of all rows of both. Parts merge a few at a time, so
no task holds more than some square matrices of the vectors' length.

Entries are integers, so counts, sums and n * x - S are exact; an entry is centred
before it becomes a double, and nothing is lost to means far from zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, table
from corvane.llm.vectors import is_sound, runs

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Rows that a task decomposes at once, and parts that merge in a task.
BLOCK, FAN = 4096, 8
#: Variance beside the largest one under which a direction counts as constant.
FLAT = 1e-18
_PART = "dim int, part long, n long, sums array<string>, rows binary"
_SPREAD = "dim int, n long, mean binary, cross binary"


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) + SHIFT as integers; beyond 62 bits the nearest ones."""
    return np.clip(np.floor(SCALE * x), -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where all fit, else Python's."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if most < 2**61:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(c: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; null beyond 64 bits."""
    if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * c.shape[1] < 2.0**62:
        return (c * c).sum(1).tolist()
    totals = (sum(v * v for v in row) for row in c.astype(object).tolist())
    return [t if t < 2**63 else None for t in totals]


def _reduced(rows: np.ndarray) -> np.ndarray:
    """The singular values times the right vectors: a square at most, of equal covariance."""
    if not rows.any():
        return rows[:0]
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def decompose(x: np.ndarray) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, singular values times right vectors) of integer rows."""
    sums = [int(s) for s in (x.astype(object) if np.abs(x).max(initial=0) > 2**62 // max(1, len(x)) else x).sum(0)]
    return len(x), sums, _reduced((_centred(x, len(x), sums) / len(x)).astype(np.float64))


def merge(a: tuple, b: tuple) -> tuple[int, list[int], np.ndarray]:
    """The part of all rows of two parts. The further row holds the means' difference."""
    (n, s, x), (m, t, y) = a, b
    apart = np.array([u * m - v * n for u, v in zip(s, t, strict=True)], dtype=object) / math.sqrt(n * m * (n + m))
    return n + m, [u + v for u, v in zip(s, t, strict=True)], _reduced(np.vstack([x, y, apart.astype(np.float64)[None]]))


def _merged(parts: list[tuple]) -> tuple:
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _row(dim: int, part: int, found: tuple) -> dict:
    return {"dim": dim, "part": part, "n": found[0], "sums": [str(s) for s in found[1]], "rows": found[2].tobytes()}


def _found(row) -> tuple:
    return int(row["n"]), [int(s) for s in row["sums"]], np.frombuffer(row["rows"]).reshape(-1, len(row["sums"]))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(-1, dim)


def _as_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector) to (vec_id, dim, x), x the bytes of its integers, null if unsound."""
    for b in batches:
        x = [None if v is None else _whole(np.array(v, dtype=np.float64)).tobytes() for v in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else len(v) // 8 for v in x], pa.int32()), pa.array(x, pa.binary())], names=["vec_id", "dim", "x"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, x) to a part a vector length, block by block."""
    from pyspark import TaskContext

    held: dict[int, tuple] = {}
    for (dim,), b in runs(batches, 1):
        for lo in range(0, b.num_rows, BLOCK):
            found = decompose(_matrix(b.column(1).slice(lo, BLOCK), dim))
            held[dim] = merge(held[dim], found) if dim in held else found
    if held:
        rows = [_row(dim, TaskContext.get().partitionId(), found) for dim, found in held.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("rows", pa.binary())]))


def fit(spark: SparkSession, fit_list: DataFrame, components: int = COMPONENTS, ws: Workspace | None = None) -> dict[int, dict]:
    """For each length of vectors the model of fit_list(dim, x): n, sums, eigenvalues and
    unit eigenvectors of the largest, the total variance. The driver gets `components`
    vectors of each length; all dimensions are kept up to the last merge."""
    ws = ws or Workspace(spark)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        found = _merged([_found(r) for r in pdf.to_dict("records")])
        return pd.DataFrame([_row(int(pdf["dim"].iloc[0]), int(pdf["part"].iloc[0]) // FAN, found)])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n, sums, rows = _found(pdf.iloc[0])
        _, s, v = np.linalg.svd(rows, full_matrices=False) if len(rows) else (None, np.zeros(0), np.zeros((0, len(sums))))
        wide = min(components, len(sums))
        e = np.zeros(max(wide, len(s)))
        e[: len(s)] = s * s / n
        axes = np.zeros((wide, len(sums)))
        axes[: min(wide, len(s))] = v[:wide]
        return pd.DataFrame([{"dim": pdf["dim"].iloc[0], "n": n, "sums": [str(x) for x in sums], "values": e[:wide].tobytes(), "axes": axes.tobytes(), "trace": float((s * s).sum() / n)}])

    parts = ws.save(fit_list.select("dim", "x").sortWithinPartitions("dim").mapInArrow(_parts, _PART), "parts-0")
    most, turn = parts.agg(F.max("part")).first()[0], 0
    while most:  # FAN neighbours merge a turn
        turn += 1
        parts = ws.save(parts.groupBy("dim", F.floor(F.col("part") / FAN).alias("__at")).applyInPandas(join, _PART), f"parts-{turn}")
        most //= FAN
    rows = parts.groupBy("dim").applyInPandas(finish, "dim int, n long, sums array<string>, values binary, axes binary, trace double").collect()  # a row a vector length
    return {r.dim: {"n": r.n, "sums": [int(s) for s in r.sums], "values": np.frombuffer(r["values"]), "axes": np.frombuffer(r.axes).reshape(-1, r.dim), "trace": r.trace} for r in rows}


def _project(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n * x - S, whitened) of integer rows; whitened is NaN along constant directions."""
    c = _centred(x, model["n"], model["sums"])
    e = model["values"]
    live = e > FLAT * max(e.max(initial=0), np.finfo(float).tiny)
    root = np.sqrt(np.where(live, e, 1.0))
    w = (c / model["n"]).astype(np.float64) @ model["axes"].T / root
    w[:, ~live] = np.nan
    return c, w


def _spread(a: tuple | None, b: tuple) -> tuple:
    """(n, mean, centred cross products) of the rows of both."""
    if a is None:
        return b
    (n, u, p), (m, v, q) = a, b
    d = v - u
    return n + m, u + d * (m / (n + m)), p + q + np.outer(d, d) * (n * m / (n + m))


def identity_errors(fit_list: DataFrame, models: dict[int, dict]) -> dict[int, float | None]:
    """Largest entry of the whitened covariance of fit_list less the identity, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for (dim,), b in runs(batches, 1):
            for lo in range(0, b.num_rows, BLOCK):
                _, w = _project(models[dim], _matrix(b.column(1).slice(lo, BLOCK), dim))
                w = w[:, ~np.isnan(w).any(0)]
                mean = w.mean(0)
                held[dim] = _spread(held.get(dim), (len(w), mean, (w - mean).T @ (w - mean)))
        if held:
            yield pa.RecordBatch.from_pylist([{"dim": d, "n": n, "mean": u.tobytes(), "cross": p.tobytes()} for d, (n, u, p) in held.items()], schema=pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("cross", pa.binary())]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        found = None
        for r in pdf.to_dict("records"):
            mean = np.frombuffer(r["mean"])
            found = _spread(found, (r["n"], mean, np.frombuffer(r["cross"]).reshape(len(mean), len(mean))))
        gap = np.abs(found[2] / found[0] - np.eye(len(found[1])))
        return pd.DataFrame({"dim": pdf["dim"][:1], "error": [float(gap.max()) if gap.size else None]})

    each = fit_list.select("dim", "x").sortWithinPartitions("dim").mapInArrow(run, _SPREAD)  # a small square a task
    return {r.dim: r.error for r in each.groupBy("dim").applyInPandas(add, "dim int, error double").collect()}


def whiten(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per sound row of `vectors`: vec_id, n, deviation, whitened (array),
    explained (array), identity_error.

    The model is fitted on every distinct integer vector once; components go by falling
    variance, `components` or the vectors' length at most. Cases: vectors that are null,
    empty or hold null or non-finite entries are dropped; repeated rows and shared or
    null ids are rows of their own, which weigh nothing more; vectors of another length
    have a model of their own; an entry that 62 bits cannot hold is clipped, a deviation
    that 63 bits cannot hold is null; along a direction in which all vectors are equal,
    as for a single vector, whitened is null, and explained is null if there is no
    variance at all; identity_error is over the others; no rows, no result; other columns
    are ignored.
    """
    ws = Workspace(spark)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(is_sound(vec_col), F.transform(vec_col, lambda c: c.cast("double"))).alias("v"))
    keyed = ws.save(raw.filter("v IS NOT NULL").mapInArrow(_as_integers, "vec_id long, dim int, x binary"), "keyed")
    fit_list = ws.save(keyed.select("dim", "x").distinct(), "fit")
    models = fit(spark, fit_list, components, ws)
    errors = identity_errors(fit_list, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim,), b in runs(batches, 1):
            model = models[dim]
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                c, w = _project(model, _matrix(part.column(2), dim))
                k, n = len(w), w.shape[1]
                at = pa.array(np.arange(0, k * n + 1, max(1, n), dtype=np.int32)[: k + 1])
                share = model["values"] / model["trace"] if model["trace"] > 0 else np.full(n, np.nan)
                lists = [pa.ListArray.from_arrays(at, pa.array(v.ravel(), from_pandas=True)) for v in (w, np.tile(share, (k, 1)))]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.full(k, model["n"])), pa.array(_squares(c), pa.int64()), *lists, pa.array([errors[dim]] * k, pa.float64())], names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = keyed.select("dim", "vec_id", "x").sortWithinPartitions("dim")
    return rows.mapInArrow(run, "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, a row a component."""
    each = whiten(spark, table(spark, sf_dir, "embeddings")).select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def moments_of_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of the whitening: counts and exact deviations."""
    return op12_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), f AS (SELECT DISTINCT x FROM v),
s AS (SELECT dim, list(total ORDER BY i) AS sums, any_value(n) AS n FROM (SELECT len(x) AS dim, i, sum(x[i]) AS total, count(*) AS n FROM (SELECT x, unnest(range(1, len(x) + 1)) AS i FROM f) GROUP BY 1, 2) GROUP BY dim)
SELECT vec_id, n, CAST(list_sum(list_transform(list_zip(x, sums), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2]))) AS BIGINT) AS deviation FROM v JOIN s ON len(x) = dim
"""

QUERIES = {"op12_whitening": op12_whitening, "moments_of_op12": moments_of_op12}
ORACLE_SQL = {"moments_of_op12": _SQL}
