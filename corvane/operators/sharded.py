"""Linear classifiers whose weights no machine holds whole.

The objective is that of `linear`; weights, gradients and the directions of L-BFGS are
tables of shards, features dealt out by their number. Rows are cut by shard as well: a
cell holds some rows' entries of one shard. An evaluation multiplies cells by their shard
of the weights, adds the products up by rows, and sends the losses' derivatives back to
the cells, whose products add up to the shards of the gradient.

L-BFGS needs only inner products: those of its few directions are added up over the
shards, the recursion runs on them, and a step is a combination of the shards (as
published by Chen, Wang and Zhou, 2014). The driver gets inner products and losses, of a
size that neither rows nor features change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.folder import Folder
from corvane.operators.linear import LOSSES, MEMORY, rows_of

#: Rows of a block, blocks of a cell, and features that a shard aims at.
ROWS, BLOCKS, SPAN = 1024, 16, 1 << 16
_VECTOR = "shard int, raw binary"


def _cells(shards: int, features: int):
    """rows(features, y, u) to blocks: for each shard its entries, local numbers and rows,
    and for shard -1 y and u. The constant is the entry of number `features`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        names = ["shard", "block", "n", "rows", "places", "values"]
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                cut = b.slice(lo, ROWS)
                offsets, places, values = rows_of(cut.column(0))
                own = np.concatenate([np.repeat(np.arange(cut.num_rows), np.diff(offsets)), np.arange(cut.num_rows)])
                places, values = np.append(places, np.full(cut.num_rows, features)), np.append(values, np.ones(cut.num_rows))
                block, out = part * (1 << 32) + k, []
                for s in np.unique(places % shards):
                    at = np.flatnonzero(places % shards == s)
                    out.append((int(s), block, cut.num_rows, own[at].astype(np.int32).tobytes(), (places[at] // shards).tobytes(), values[at].tobytes()))
                y, u = (c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in cut.columns[1:3])
                out.append((-1, block, cut.num_rows, y.tobytes(), u.tobytes(), b""))
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    return run


def _widths(features: int, shards: int):
    """How many features a shard has, the constant among them."""
    return lambda shard: -(-(features + 1 - shard) // shards)


class Sharded:
    """The objective over rows(features, y array, u array) and the vectors of its search."""

    def __init__(self, rows: DataFrame, features: int, classes: int, loss: str, c: float, folder: Folder, span: int = SPAN):
        self.features, self.classes, self.loss, self.c, self.folder = features, classes, loss, c, folder
        self.shards = max(1, -(-(features + 1) // span))
        self.n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        schema = "shard int, block long, n long, rows binary, places binary, values binary"
        cut = folder.table("cells", lambda: rows.select("features", "y", "u").mapInArrow(_cells(self.shards, features), schema))
        group = F.pmod(F.xxhash64("block"), F.lit(max(1, -(-cut.filter("shard < 0").count() // BLOCKS)))).cast("long")
        # Both stay dealt out and sorted as every evaluation reads them.
        self.cells = cut.filter("shard >= 0").withColumn("group", group).repartition(self.n, "shard", "group").sortWithinPartitions("shard", "group").persist(StorageLevel.MEMORY_AND_DISK)
        self.labels = cut.filter("shard < 0").select("block", "n", F.col("rows").alias("y"), F.col("places").alias("u")).repartition(self.n, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)
        self.at = folder.table("at", lambda: cut.filter("shard >= 0").select("shard", group.alias("group"), "block").distinct())
        self.vectors: dict[str, DataFrame] = {}

    def close(self) -> None:
        self.cells.unpersist()
        self.labels.unpersist()

    def put(self, name: str, df: DataFrame) -> str:
        self.vectors[name] = self.folder.table(name, lambda: df)
        return name

    def drop(self, name: str) -> None:
        if self.vectors.pop(name, None) is not None:
            self.folder.drop(name)

    def zeros(self, name: str) -> str:
        spark, classes, width = self.folder.spark, self.classes, _widths(self.features, self.shards)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shards = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.zeros((width(s), classes)).tobytes() for s in shards], pa.binary())], names=["shard", "raw"])

        return self.put(name, spark.range(self.shards).select(F.col("id").cast("int").alias("shard")).mapInArrow(run, _VECTOR))

    def combine(self, name: str, parts: list[tuple[str, np.ndarray]]) -> str:
        """The sum of vectors, each times a number for each class."""
        classes, factors = self.classes, [f for _, f in parts]

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(r).reshape(-1, classes) * factors[k] for k, r in zip(pdf["k"], pdf["raw"], strict=True))
            return pd.DataFrame({"shard": pdf["shard"][:1], "raw": [total.tobytes()]})

        return self.put(name, self._stacked([v for v, _ in parts]).groupBy("shard").applyInPandas(add, _VECTOR))

    def _stacked(self, names: list[str]) -> DataFrame:
        out = None
        for k, name in enumerate(names):
            v = self.vectors[name].withColumn("k", F.lit(k))
            out = v if out is None else out.unionByName(v)
        return out

    def products(self, names: list[str]) -> np.ndarray:
        """Inner products of all pairs of vectors, for each class."""
        classes, n = self.classes, len(names)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack([np.frombuffer(r).reshape(-1, classes) for r in pdf.sort_values("k")["raw"]])
            return pd.DataFrame([np.einsum("ifc,jfc->ijc", x, x).ravel()], columns=names_of)

        names_of = [f"p{i}" for i in range(n * n * classes)]
        found = self._stacked(names).groupBy("shard").applyInPandas(run, ", ".join(f"{x} double" for x in names_of))
        return np.array(found.agg(*[F.sum(x) for x in names_of]).first(), dtype=np.float64).reshape(n, n, classes)

    def evaluate(self, w: str, gradient: str) -> np.ndarray:
        """The value for each class at w; the gradient becomes the vector of that name."""
        classes, c, loss = self.classes, self.c, LOSSES[self.loss]
        to_group = self.at.select("shard", "group").distinct()
        shared = self.vectors[w].join(to_group, "shard").select("shard", "group", "raw")  # a copy for every BLOCKS blocks

        def times(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            x = np.frombuffer(right["raw"].iloc[0]).reshape(-1, classes) if len(right) else None
            out = []
            for block, n, own, places, values in zip(left["block"], left["n"], left["rows"], left["places"], left["values"], strict=True):
                own, v = np.frombuffer(own, dtype=np.int32), np.frombuffer(values)[:, None] * x[np.frombuffer(places, dtype=np.int64)]
                out.append((block, np.stack([np.bincount(own, v[:, k], n) for k in range(classes)], 1).tobytes()))
            return pd.DataFrame(out, columns=["block", "raw"])

        part = self.cells.groupBy("shard", "group").cogroup(shared.groupBy("shard", "group")).applyInPandas(times, "block long, raw binary")

        def derive(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            y, u = (np.frombuffer(left[k].iloc[0]).reshape(-1, classes) for k in "yu")
            f, d = loss(y * sum(np.frombuffer(r).reshape(-1, classes) for r in right["raw"]))
            return pd.DataFrame([[int(key[0]), (c * u * y * d).tobytes(), (c * (u * f).sum(0)).tolist()]], columns=["block", "raw", "value"])

        steps = self.folder.table(f"{gradient}-steps", lambda: self.labels.groupBy("block").cogroup(part.groupBy("block")).applyInPandas(derive, "block long, raw binary, value array<double>"))

        def back(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            step, total = dict(zip(right["block"], right["raw"], strict=True)), np.zeros((width(int(key[0])), classes))
            for block, own, places, values in zip(left["block"], left["rows"], left["places"], left["values"], strict=True):
                d = np.frombuffer(step[block]).reshape(-1, classes)[np.frombuffer(own, dtype=np.int32)] * np.frombuffer(values)[:, None]
                at = np.frombuffer(places, dtype=np.int64)
                total += np.stack([np.bincount(at, d[:, k], len(total)) for k in range(classes)], 1)
            return pd.DataFrame([[int(key[0]), total.tobytes()]], columns=["shard", "raw"])

        width = _widths(self.features, self.shards)
        sent = steps.join(self.at, "block").select("shard", "group", "block", "raw")
        sums = self.cells.groupBy("shard", "group").cogroup(sent.groupBy("shard", "group")).applyInPandas(back, _VECTOR)

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": pdf["shard"][:1], "raw": [sum(np.frombuffer(r) for r in pdf["raw"]).tobytes()]})

        self.put(gradient, sums.unionByName(self.vectors[w]).groupBy("shard").applyInPandas(add, _VECTOR))
        data = np.array(steps.agg(*[F.sum(F.col("value")[k]) for k in range(classes)]).first(), dtype=np.float64)
        self.folder.drop(f"{gradient}-steps")
        return np.nan_to_num(data)


def fit(rows: DataFrame, features: int, classes: int, folder: Folder, loss: str = "squared_hinge", c: float = 1.0, iterations: int = 60, tolerance: float = 1e-3, span: int = SPAN) -> Sharded:
    """The search, with the weights of `linear.fit` as the shards of its `weights`."""
    o = Sharded(rows, features, classes, loss, c, folder, span)
    points = [(o.zeros("w0"), "g0")]  # the last places and their gradients; their differences
    f, first, turn = o.evaluate(*points[0]), None, 0  # are what L-BFGS calls steps and turns
    while True:
        m = len(points) - 1
        w, g = points[-1]
        raw = o.products([*[v for v, _ in points], *[v for _, v in points]])
        # Rows of `basis` say what each step, turn, the gradient and the place are made of.
        ws, gs = np.eye(2 * m + 2)[: m + 1], np.eye(2 * m + 2)[m + 1 :]
        basis = np.concatenate([ws[1:] - ws[:-1], gs[1:] - gs[:-1], gs[-1:], ws[-1:]])
        p = np.einsum("ia,abc,jb->ijc", basis, raw, basis)
        gg, ww = p[2 * m, 2 * m], p[2 * m + 1, 2 * m + 1]
        first = np.maximum(np.sqrt(gg), 1e-30) if first is None else first
        active = np.sqrt(gg) > tolerance * first
        if turn == iterations or not active.any():
            break
        q = np.zeros((2 * m + 1, classes))  # a combination of steps, turns and the gradient
        q[2 * m] = 1
        dot = lambda i, q, p=p: (q * p[i, : len(q)]).sum(0)
        used = {}
        for i in reversed(range(m)):
            st = p[i, m + i]
            rho = np.where(st > 1e-14, 1 / np.maximum(st, 1e-14), 0.0)
            a = rho * dot(i, q)
            q[m + i] -= a
            used[i] = rho, a
        if m:
            tt = p[2 * m - 1, 2 * m - 1]
            q *= np.where(tt > 0, np.maximum(p[m - 1, 2 * m - 1], 1e-14) / np.maximum(tt, 1e-30), 1.0)
        else:
            q /= np.maximum(1.0, first)
        for i in range(m):
            rho, a = used[i]
            q[i] += a - rho * dot(m + i, q)
        slope = dot(2 * m, q)
        plain = np.zeros_like(q)
        plain[2 * m] = 1
        q = np.where(slope > 0, q, plain)
        slope = np.where(slope > 0, slope, gg)
        qq, wq = np.einsum("ic,jc,ijc->c", q, q, p[: len(q), : len(q)]), dot(2 * m + 1, q)
        parts = np.einsum("ic,ia->ac", q, basis[: len(q)])
        t, turn = np.where(active, 1.0, 0.0), turn + 1
        for tries in range(20):
            new, grown = f"w{turn}-{tries}", f"g{turn}-{tries}"
            names = [*[v for v, _ in points], *[v for _, v in points]]
            o.combine(new, [(v, (v == w) - t * parts[i]) for i, v in enumerate(names)])
            value = o.evaluate(new, grown) + (ww - 2 * t * wq + t * t * qq) / 2
            bad = active & (value > f - 1e-4 * t * slope)
            if not bad.any():
                break
            t = np.where(bad, t / 2, t)
            if tries < 19:
                o.drop(new)
                o.drop(grown)
        moved = active & (value <= f)
        if not moved.any():
            break
        if (active & ~moved).any():  # classes that found no better point stay where they were
            o.combine(f"{new}-held", [(w, 1.0 * ~moved), (new, 1.0 * moved)])
            o.combine(f"{grown}-held", [(g, 1.0 * ~moved), (grown, 1.0 * moved)])
            o.drop(new)
            o.drop(grown)
            new, grown = f"{new}-held", f"{grown}-held"
        points.append((new, grown))
        f = np.where(moved, value, f)
        if len(points) > MEMORY + 1:
            for name in points.pop(0):
                o.drop(name)
    o.weights = o.vectors[w]
    o.close()
    return o


def margins(df: DataFrame, search: Sharded, row: str = "row", features: str = "features", out: str = "margins") -> DataFrame:
    """(row, out) of df(row, features): its products with the weights, which are read as
    a long table of features; rows without features have the constant's."""
    shards, classes = search.shards, search.classes

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw).reshape(-1, classes)
                yield pa.RecordBatch.from_arrays([pa.array(shard + shards * np.arange(len(x))), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "w"])

    weights = search.weights.mapInArrow(long, "id long, w array<double>")
    constant = weights.filter(F.col("id") == search.features).select("w").first().w  # a number a class
    each = df.select(row, F.explode(F.arrays_zip(F.col(f"{features}.indices").alias("i"), F.col(f"{features}.values").alias("v"))).alias("e")).select(row, F.col("e.i").cast("long").alias("id"), F.col("e.v").alias("v"))
    sums = each.join(weights, "id").groupBy(row).agg(*[F.sum(F.col("v") * F.col("w")[k]).alias(f"m{k}") for k in range(classes)])
    parts = F.array(*[F.coalesce(F.col(f"m{k}"), F.lit(0.0)) + F.lit(constant[k]) for k in range(classes)])
    return df.select(row).join(sums, row, "left").select(row, parts.alias(out))
