"""Linear classifiers, one for each class against the rest, on sparse features.

For each class the weights w minimise |w|^2 / 2 + c * sum(u_i * loss(y_i * x_i.w)) with
y_i = 1 for the class and -1 for the rest. The constant term is a feature of value 1,
whose weight counts like any other. Losses are the squared hinge and the logistic loss.

All classes are fitted at once by L-BFGS: an iteration is one pass over the rows, in
blocks that stay packed between passes; the driver holds the weights and a few
directions, whose size is features x classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type of feature columns: places of the entries that are not 0, ascending, and these.
FEATURES = "struct<indices:array<int>,values:array<double>>"
SLICES = 32
MEMORY = 8
LOSSES = {
    # margin -> (loss, derivative)
    "squared_hinge": lambda m: (np.maximum(0, 1 - m) ** 2, -2 * np.maximum(0, 1 - m)),
    "logistic": lambda m: (np.logaddexp(0, -m), -1 / (1 + np.exp(np.minimum(m, 700)))),
}


def rows_of(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, places, values) of a column of FEATURES; a null is a row of zeros."""
    lists = column.field("indices")
    sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64)
    if column.null_count:
        sizes[np.array(column.is_null())] = 0
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), flat(lists).astype(np.int64), flat(column.field("values")).astype(np.float64)


def products(offsets: np.ndarray, places: np.ndarray, values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows times w; the last row of w is that of the constant."""
    return _products(offsets, places, values, np.ascontiguousarray(w.T))


def _products(offsets: np.ndarray, places: np.ndarray, values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Rows times the classes' weights, each class's side by side in memory."""
    out = np.zeros((len(offsets) - 1, len(columns)))
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        for k, column in enumerate(columns):
            out[some, k] = np.add.reduceat(values * column[places], offsets[:-1][some])
    return out + columns[:, -1]


def _spread(lengths: np.ndarray, places: np.ndarray, values: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows times d by place. Rows where d is 0, as the squared hinge has it
    beyond the margin, are left out."""
    own = np.repeat(d, lengths)
    if 2 * np.count_nonzero(own) < len(own):
        some = own != 0
        return np.bincount(places[some], values[some] * own[some], size)
    return np.bincount(places, values * own, size)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            offsets, places, values = rows_of(b.column(0))
            parts = [offsets, places.astype(np.int32), values, *(c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[1:3])]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])] + [pa.array([p.tobytes()], pa.binary()) for p in parts], names=["n", "offsets", "places", "values", "y", "u"])


class Objective:
    """Value and gradient of all classes over rows(features, y array, u array)."""

    def __init__(self, rows: DataFrame, features: int, classes: int, loss: str, c: float):
        self.shape, self.loss, self.c = (features + 1, classes), loss, c
        self.blocks = rows.mapInArrow(_pack, "n long, offsets binary, places binary, values binary, y binary, u binary").cache()

    def close(self) -> None:
        self.blocks.unpersist()

    def __call__(self, w: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of all classes, or of the wanted ones; the others' are zeros."""
        some = np.arange(self.shape[1]) if wanted is None else np.flatnonzero(wanted)
        size, classes, loss, c, own_w = self.shape[0], len(some), LOSSES[self.loss], self.c, np.ascontiguousarray(w[:, some])
        step = max(1, -(-size * classes // SLICES))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, gradient, any_ = np.zeros(classes), np.zeros((classes, size)), False
            columns = np.ascontiguousarray(own_w.T)
            for b in batches:
                for n, *raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    offsets, places = np.frombuffer(raw[0], dtype=np.int64), np.frombuffer(raw[1], dtype=np.int32).astype(np.int64)
                    values, y, u = (np.frombuffer(x) for x in raw[2:])
                    y, u = y.reshape(n, -1)[:, some], u.reshape(n, -1)[:, some]
                    f, d = loss(y * _products(offsets, places, values, columns))
                    value += c * (u * f).sum(0)
                    d = c * u * y * d
                    lengths = np.diff(offsets)
                    for k in range(classes):
                        gradient[k, :-1] += _spread(lengths, places, values, d[:, k], size - 1)
                    gradient[:, -1] += d.sum(0)
                    any_ = True
            if any_:
                flat = gradient.ravel()
                cut = [flat[i : i + step].tobytes() for i in range(0, len(flat), step)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut) + 1, dtype=np.int32)), pa.array([*cut, value.tobytes()], pa.binary())], names=["part", "raw"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf[:1].assign(raw=[sum(np.frombuffer(x) for x in pdf["raw"]).tobytes()])

        # A task gives a gradient as large as w, so there are as many tasks as cores and not as blocks' partitions.
        dealt = self.blocks.coalesce(max(1, self.blocks.sparkSession.sparkContext.defaultParallelism))
        parts = dealt.mapInArrow(run, "part int, raw binary").groupBy("part").applyInPandas(add, "part int, raw binary").collect()  # the size of w
        found = [np.frombuffer(r[1]) for r in sorted(parts, key=lambda r: r[0])]
        value, gradient = np.zeros(self.shape[1]), np.zeros(self.shape)
        value[some], gradient[:, some] = (own_w * own_w).sum(0) / 2, own_w
        if found:
            value[some] += found[-1]
            gradient[:, some] += np.concatenate(found[:-1]).reshape(classes, size).T
        return value, gradient


def minimise(objective, shape: tuple[int, int], iterations: int, tolerance: float, dot=lambda a, b: (a * b).sum(0)) -> np.ndarray:
    """L-BFGS on every column at once, each with its own step, until all gradients are
    at most `tolerance` times their first norm. Columns' inner
    products can be given, and gradients as functions, called for the places stayed at."""
    w = np.zeros(shape)
    f, g = objective(w)
    g = g() if callable(g) else g
    norm = lambda x: np.sqrt(np.maximum(dot(x, x), 0))
    first = np.maximum(norm(g), 1e-30)
    steps: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    for _ in range(iterations):
        active = norm(g) > tolerance * first
        if not active.any():
            break
        q, used = g.copy(), []
        for s, t in zip(reversed(steps), reversed(turns), strict=True):
            st = dot(s, t)
            rho = np.where(st > 1e-14, 1 / np.maximum(st, 1e-14), 0.0)
            a = rho * dot(s, q)
            q -= a * t
            used.append((rho, a))
        if steps:
            tt = dot(turns[-1], turns[-1])
            q *= np.where(tt > 0, np.maximum(dot(steps[-1], turns[-1]), 1e-14) / np.maximum(tt, 1e-30), 1.0)
        else:
            q /= np.maximum(1.0, first)
        for (s, t), (rho, a) in zip(zip(steps, turns, strict=True), reversed(used), strict=True):
            q += s * (a - rho * dot(t, q))
        slope = dot(g, q)
        q = np.where(slope > 0, q, g)
        slope = np.where(slope > 0, slope, dot(g, g))
        t = np.where(active, 1.0, 0.0)
        value, gradient, bad = f, g, active
        for _ in range(20):
            new = w - t * q
            some = objective(new, bad)  # the others are where they were
            value = np.where(bad, some[0], value)
            gradient = gradient if callable(some[1]) else np.where(bad, some[1], gradient)
            bad = bad & (value > f - 1e-4 * t * slope)
            if not bad.any():
                break
            t = np.where(bad, t / 2, t)
        t = np.where(active & (value > f), 0.0, t)
        if not t.any():
            break
        same = t == 0
        if callable(some[1]):
            gradient = objective(new, ~same)[1]()
        new, value, gradient = np.where(same, w, new), np.where(same, f, value), np.where(same, g, gradient)
        steps, turns = [*steps, new - w][-MEMORY:], [*turns, gradient - g][-MEMORY:]
        w, f, g = new, value, gradient
    return w


def fit(rows: DataFrame, features: int, classes: int, loss: str = "squared_hinge", c: float = 1.0, iterations: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """Weights, features + 1 by classes, of rows(features, y, u): y and u are arrays with
    1 or -1 and the weight of the row for each class. No rows: zeros."""
    objective = Objective(rows.select("features", "y", "u"), features, classes, loss, c)
    try:
        return minimise(objective, objective.shape, iterations, tolerance)
    finally:
        objective.close()


def margins(df: DataFrame, w: np.ndarray, out: str, features: str = "features") -> DataFrame:
    """df with the array of its rows' products with w."""
    at = df.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = products(*rows_of(b.column(at)), w)
            lists = pa.ListArray.from_arrays(np.arange(0, m.size + 1, max(1, w.shape[1]), dtype=np.int32)[: b.num_rows + 1], pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` array<double>"
    return df.mapInArrow(run, schema)


def dense(column: Column) -> Column:
    """An array of numbers as FEATURES."""
    return F.struct(F.sequence(F.lit(0), F.size(column) - 1).cast("array<int>").alias("indices"), F.transform(column, lambda x: x.cast("double")).alias("values"))
