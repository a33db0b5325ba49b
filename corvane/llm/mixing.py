"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words. Whole repeats of all its documents fill
most of it; the rest is a subset-sum problem over the source's histogram of exact
document lengths, solved by bounded-knapsack dynamic programming; the documents of
each length are then picked in the order of a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, ordinal, parallelism, table, word_count

#: Largest number of times that a document may be taken.
MAX_REPEATS = 3
#: Weights that the sources get in turn.
WEIGHTS = (1.0, 2.0, 3.0)


def fill_targets(totals: DataFrame, weights: tuple[float, ...], repeats: int, ws: Workspace) -> DataFrame:
    """source, source_size, target of totals(source, source_size): the sum of all sizes
    is shared by weight; a target stops at repeats * size, and its excess is shared again
    among the others by weight until none is above.

    Sources get their weights in turn, by code point, null last, without meeting in one
    task: they are range-partitioned, and counts of the parts give each part's first
    place. A source stops when what a unit of weight gets reaches repeats * size /
    weight, so each turn is one sum over those that stop and those that do not.
    """
    parts = parallelism(totals.sparkSession)
    order = [F.col("source").asc_nulls_last()]
    dealt = ws.save(totals.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "dealt")
    before = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))  # a row a part
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.array(*[F.lit(w) for w in weights])
    known = dealt.join(F.broadcast(before.select("part", "before")), "part").withColumn("weight", F.get(weight, (place % len(weights)).cast("int")))
    known = ws.save(known.select("source", "source_size", "weight", (repeats * F.col("source_size")).cast("double").alias("most")), "known")
    total = float(known.agg(F.sum("source_size")).first()[0] or 0)
    unit, turn = 0.0, 0
    while True:
        stopped = F.col("most") <= F.col("weight") * unit if turn else F.lit(False)
        full, free, n = known.agg(F.sum(F.when(stopped, F.col("most"))), F.sum(F.when(~stopped, F.col("weight"))), F.count_if(stopped)).first()
        if turn and n == held or not free:
            break
        unit, held, turn = (total - (full or 0.0)) / free, n, turn + 1
    return known.select("source", "source_size", F.least(F.col("most"), F.col("weight") * unit).alias("target"))


#: Budgets up to this many words are fitted by the knapsack alone.
EXACT_BUDGET = 1 << 18


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float, exact: int | None = EXACT_BUDGET) -> np.ndarray:
    """How many documents of each length to take, so that the sum of their lengths is
    nearest `budget` (ties: below).

    Over half of all, the documents to leave out are chosen instead. Of a budget above
    `exact`, an even share of every length is taken first, which keeps the mix of
    lengths, then one more of each length in turn; the bounded knapsack over reachable
    sums then fits what is left exactly, with the documents still on offer. Without a
    bound (None) the knapsack alone fits any budget, in memory of a bit and a number a word.
    """
    lengths, counts = lengths.astype("int64"), counts.astype("int64")
    total = int((lengths * counts).sum())
    goal = int(min(max(0, np.ceil(budget - 0.5)), total))
    if 2 * goal > total:
        return counts - fit_budget(lengths, counts, total - goal, exact)
    take = np.zeros(len(lengths), dtype="int64")
    if exact is not None and goal > exact:
        take = (counts * ((goal - exact) / total)).astype("int64")
        left = goal - int((take * lengths).sum())
        longest = np.argsort(-lengths, kind="stable")
        while left > exact + int(lengths.max()):
            for i in longest:
                if left > exact + lengths[i] and take[i] < counts[i]:
                    take[i] += 1
                    left -= int(lengths[i])
        goal = left
    return take + _knapsack(lengths, counts - take, goal)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """Bounded knapsack: counts whose sum is nearest `goal` (ties: below). Reachable
    sums are the bits of one number; each piece is a power-of-two lot of one length,
    and `first` holds the piece that first reached a sum, so lots are used once."""
    out = np.zeros(len(lengths), dtype="int64")
    if goal <= 0 or not len(lengths):
        return out
    span = goal + int(lengths.max()) + 1
    mask = (1 << span) - 1
    bits = lambda x: np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((span + 7) // 8, "little"), dtype="uint8"), bitorder="little")[:span])
    reach, first, pieces = 1, np.full(span, -1, dtype="int64"), []
    for i in range(len(lengths)):
        size = int(lengths[i])
        n, lot = int(min(counts[i], goal // size + 1)), 1
        while n > 0 and not (reach >> goal) & 1:
            k = min(lot, n)
            n, lot = n - k, lot * 2
            fresh = (reach << (k * size)) & mask & ~reach
            if fresh:
                first[bits(fresh)] = len(pieces)
                reach |= fresh
            pieces.append((i, k))
    found = bits(reach)
    at = int(found[np.argmin(np.abs(found - goal))])
    while at:
        i, k = pieces[first[at]]
        out[i] += k
        at -= k * int(lengths[i])
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, seed: int = 7, repeats: int = MAX_REPEATS, exact: int | None = EXACT_BUDGET) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of `docs`.

    docs needs id_col, text and source; other columns are ignored. Sources are ordered
    by code point, null last, and get `weights` in turn; budgets above `exact` words are
    fitted as fit_budget() says. Rows that agree in all they
    show (id, text length, source) may trade places. Cases: null and empty texts have
    size 0 and are taken 0 times; a null source is a source; no rows, no result; a
    source without words has target 0. Two runs agree.
    """
    ws = Workspace(spark)
    sized = ws.save(docs.select(F.col(id_col).alias("doc_id"), "source", word_count("text").alias("size")), "sized")
    histogram = ws.save(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    weights = tuple(float(w) for w in weights)

    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    target = ws.save(fill_targets(totals, weights, repeats, ws), "target")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, budget = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(repeats, int(budget // size)) if size else 0
        rest = budget - whole * size if whole < repeats else 0.0
        n = pdf["n"].to_numpy("int64")
        lengths = pdf["size"].to_numpy("int64")
        more = np.zeros(len(n), dtype="int64")
        real = lengths > 0
        if real.any():
            more[real] = fit_budget(lengths[real], n[real], rest, exact)
        return pd.DataFrame({"source": pdf["source"], "size": lengths, "n": n, "whole": whole, "more": more, "source_size": size, "target": budget})

    h, t = histogram.alias("h"), target.alias("t")
    joined = h.join(t, F.col("h.source").eqNullSafe(F.col("t.source"))).select("h.*", "t.source_size", "t.target")
    plan = ws.save(joined.groupBy("source").applyInPandas(fit, "source string, size long, n long, whole int, more long, source_size long, target double"), "plan")

    d, p = sized.alias("d"), plan.alias("p")
    rows = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))).select("d.*", "p.n", "p.whole", "p.more", "p.source_size", "p.target")
    # Only lengths of which some documents are taken once more than others need an order.
    rows = rows.withColumn("split", (F.col("more") > 0) & (F.col("more") < F.col("n")))
    chosen = rows.filter("split").withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
    placed = ordinal(chosen, ["source", "size"], "order", "place", ws, ["doc_id"])
    once = placed.withColumn("extra", (F.col("place") < F.col("more")).cast("int")).drop("order", "place")
    flat = rows.filter("NOT split").withColumn("extra", (F.col("more") > 0).cast("int"))
    return flat.unionByName(once).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long").alias("taken"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production mix of all documents."""
    return mix_sources(spark, table(spark, sf_dir, "documents")).drop("source")


def targets_of_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op9_mix_sources, which SQL can state."""
    return op9_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


#: Sources in the order in which they stop: what a unit of weight gets is settled by the
#: first that does not.
_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([1.0, 2.0, 3.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, CAST(3 * source_size AS DOUBLE) AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / w, source) AS k FROM w),
u AS (SELECT k, most / w AS stop, ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(most) FROM o b WHERE b.k < a.k), 0)) / (SELECT sum(b.w) FROM o b WHERE b.k >= a.k) AS unit FROM o a),
unit AS (SELECT coalesce(min_by(unit, k) FILTER (stop >= unit), 1e300) AS unit FROM u)
SELECT doc_id, size, source_size, round(least(most, w * unit), 4) AS target FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, unit
"""

QUERIES = {"op9_mix_sources": op9_mix_sources, "targets_of_op9": targets_of_op9}
ORACLE_SQL = {"targets_of_op9": _SQL}
