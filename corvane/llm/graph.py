"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Workspace

#: Edges of which a task makes stars at once (2 MB). A list of no more needs no rounds.
LOT = 1 << 17


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition, in lots of about LOT, as stars around the least node of
    each component: a smaller list with the same components."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        nodes, ids = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = ids[: len(u)], ids[len(u) :]
        label = np.arange(len(nodes))
        while True:  # least label over edges, then over labels of labels
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            new = new[new]
            if (new == label).all():
                break
            label = new
        other = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        if held and size + batch.num_rows > LOT:
            yield close(held)
            held, size = [], 0
        held.append(batch)
        size += batch.num_rows
    if held:
        yield close(held)


def components(edges: DataFrame, ws: Workspace, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node.

    Each task makes stars of its own edges. If at most LOT edges are left, they are one
    lot of one task: rounds would be plans that cost the driver more than the edges do. A
    longer list alternates large-star and small-star steps (Kiveris and others, 2014)
    until the edges are stars. Both are a grouped minimum, which combines before the
    shuffle, and a join, so a node with very many neighbours meets in no single task.
    Every round is written to the shared folder, which cuts the lineage.
    """
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u != v")
    e = ws.save(e.mapInArrow(_stars, "u long, v long").distinct(), f"{name}-0")
    mark, turn, short = None, 0, e.count() <= LOT
    if short:
        e = ws.save(e.coalesce(1).mapInArrow(_stars, "u long, v long"), f"{name}-1")
    while not short:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        turn += 1
        new = ws.save(small, f"{name}-{turn}")
        now = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if turn > 1:
            ws.drop(f"{name}-{turn - 1}")
        e = new
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
