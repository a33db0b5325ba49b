"""Linear classifiers with more weights than rows.

The weights of `linear` stay in the span of the rows: they are X'a, with a number for each
row, and so are gradients and directions. L-BFGS then runs on pairs (a, XX'a), whose inner
products are those of the weights, so no machine holds weights. Entries are dealt out by
feature; an evaluation is one job of products X'd, then X(X'd), that add up by row. The
rows to be scored are rows like others, with a weight of 0 in the loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.linear import LOSSES, SLICES, minimise, rows_of

#: Entries that a shard and a block aim at.
SHARD, BLOCK = 1 << 21, 1 << 19
#: Of frames that are parts of one saved table: its monotonically_increasing_id.
ROW = "__row"
_IDS = 33  # bits of a number within its partition, as monotonically_increasing_id has it


class Rows:
    """Consecutive numbers of a saved table's rows by their monotonically_increasing_id."""

    def __init__(self, table: DataFrame, row: str = ROW):
        part = F.shiftrightunsigned(row, _IDS)
        counts = sorted((r[0], r[1]) for r in table.groupBy(part).count().collect())  # a row a partition
        self.parts = np.array([p for p, _ in counts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(np.int64)
        self.n = int(self.starts[-1])

    def __call__(self, ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
        x = np.asarray(ids, dtype=np.int64)
        return self.starts[np.searchsorted(self.parts, x >> _IDS)] + (x & ((1 << _IDS) - 1))


def _dealt(number: Rows, shards: int):
    """(row, features) to (shard, places, rows, values): a batch's entries of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, places, values = rows_of(b.column(1))
            rows, shard = np.repeat(number(b.column(0)), np.diff(offsets)).astype(np.int32), places % shards
            order, ends = np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
            some = np.flatnonzero(np.diff(ends))
            raw = [pa.array([x[order[ends[s] : ends[s + 1]]].tobytes() for s in some], pa.binary()) for x in (places.astype(np.int32), rows, values)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *raw], names=["shard", "places", "rows", "values"])

    return run


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's entries as blocks of whole features: where each starts, rows and values."""
    places, rows, values = (np.concatenate([np.frombuffer(x, dtype=t) for x in pdf[c]]) for c, t in (("places", np.int32), ("rows", np.int32), ("values", np.float64)))
    order = np.argsort(places, kind="stable")
    places, rows, values = places[order], rows[order], values[order]
    starts = np.flatnonzero(np.diff(places, prepend=-1))
    out, lo = [], 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK)))
        end = starts[hi] if hi < len(starts) else len(places)
        out.append(((starts[lo:hi] - starts[lo]).tobytes(), rows[starts[lo] : end].tobytes(), values[starts[lo] : end].tobytes()))
        lo = hi
    return pd.DataFrame(out, columns=["starts", "rows", "vals"])


class Kernel:
    """The inner products of all pairs of rows of df(ROW, features), and 1 for the constant."""

    def __init__(self, df: DataFrame, number: Rows, features: str = "features"):
        spark, self.n = df.sparkSession, number.n
        entries = df.agg(F.sum(F.size(f"{features}.indices").cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // SHARD))
        cut = df.select(ROW, features).mapInArrow(_dealt(number, shards), "shard int, places binary, rows binary, values binary")
        blocks = cut.repartition(shards, "shard").groupBy("shard").applyInPandas(_sorted, "starts binary, rows binary, vals binary")
        self.blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.blocks.unpersist()

    def __call__(self, d: np.ndarray) -> np.ndarray:
        """Products with d, whose columns are classes."""
        n, classes = d.shape
        step = max(1, -(-n * classes // SLICES))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, vectors = np.zeros((classes, n)), np.ascontiguousarray(d.T)
            for b in batches:
                for raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    starts, rows, w = (np.frombuffer(x, dtype=t) for x, t in zip(raw, (np.int64, np.int32, np.float64), strict=True))
                    rows = rows.astype(np.int64)
                    lengths = np.diff(starts, append=len(rows))
                    for k in range(classes):
                        x = np.add.reduceat(w * vectors[k][rows], starts)  # of each feature
                        total[k] += np.bincount(rows, w * np.repeat(x, lengths), n)
            flat = total.ravel()
            cut = [flat[i : i + step].tobytes() for i in range(0, len(flat), step)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(cut, pa.binary())], names=["part", "raw"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf[:1].assign(raw=[sum(np.frombuffer(x) for x in pdf["raw"]).tobytes()])

        # A task gives a vector of all rows, so there are as many tasks as cores and not as shards.
        dealt = self.blocks.coalesce(max(1, self.blocks.sparkSession.sparkContext.defaultParallelism))
        parts = dealt.mapInArrow(run, "part int, raw binary").groupBy("part").applyInPandas(add, "part int, raw binary").collect()  # a number a row and class
        found = [np.frombuffer(r[1]) for r in sorted(parts, key=lambda r: r[0])]
        return np.concatenate(found).reshape(classes, n).T + d.sum(0) if found else np.zeros((n, classes)) + d.sum(0)


def fit(kernel: Kernel, y: np.ndarray, u: np.ndarray, loss: str = "squared_hinge", c: float = 1.0, iterations: int = 60, tolerance: float = 1e-3) -> np.ndarray:
    """The products of all rows with the weights of `linear.fit`; y and u are a row's
    1 or -1 and its weight for each class."""
    n, at = len(y), LOSSES[loss]

    def value(x: np.ndarray, wanted: np.ndarray | None = None):
        """The value, and the gradient if it is asked for: a step's lengths need no job."""
        some = np.arange(y.shape[1]) if wanted is None else np.flatnonzero(wanted)
        out, steps = np.zeros(y.shape[1]), np.zeros((n, len(some)))
        for i, k in enumerate(some):
            f, d = at(y[:, k] * x[n:, k])
            out[k] = (x[:n, k] * x[n:, k]).sum() / 2 + c * (u[:, k] * f).sum()
            steps[:, i] = c * u[:, k] * y[:, k] * d

        def gradient() -> np.ndarray:
            g = x.copy()
            g[:n, some] += steps
            g[n:, some] += kernel(steps)
            return g

        return out, gradient

    return minimise(value, (2 * n, y.shape[1]), iterations, tolerance, lambda p, q: np.einsum("ik,ik->k", p[:n], q[n:]))[n:]


def with_products(df: DataFrame, number: Rows, m: np.ndarray, out: str, row: str = ROW) -> DataFrame:
    """df with the array of its rows of m."""
    at = df.columns.index(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mine = m[number(b.column(at))]
            lists = pa.ListArray.from_arrays(np.arange(0, mine.size + 1, m.shape[1], dtype=np.int32), pa.array(mine.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` array<double>")
