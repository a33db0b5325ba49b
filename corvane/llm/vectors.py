"""What the operators on vectors share: validity, blocks of rows, pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_sound(name: str) -> Column:
    """True for vectors with components, none of them null, NaN or infinite."""
    v = F.col(name)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """A binary column of equally long vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim) if len(column) else np.zeros((0, dim), dtype=kind)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of sorted batches in which the first `keys` columns are constant."""
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for i in range(keys):
            c = batch.column(i).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change)
        for a, b in zip(at, np.append(at[1:], batch.num_rows), strict=True):
            yield tuple(batch.column(i)[int(a)].as_py() for i in range(keys)), batch.slice(int(a), int(b - a))


def spread_pivots(sample: np.ndarray, most: int, least_apart: float) -> np.ndarray:
    """Up to `most` rows of `sample` in order, each farther than least_apart from all
    before it, so that a dense group gets one pivot and not many."""
    picked: list[int] = []
    for i in range(len(sample)):
        if len(picked) == most:
            break
        if not picked or ((sample[picked] - sample[i]) ** 2).sum(1).min() > least_apart**2:
            picked.append(i)
    return sample[picked]
