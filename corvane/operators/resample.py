"""Bootstrap intervals as one distributed aggregation.

Replicate r of a group of n rows draws, for each draw d < n, the row whose place is a
hash of (seed, r, d) modulo n. All groups and replicates are one plan; metrics of each
replicate come from its own label set, so a rare label may be absent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.corpus import ranks
from corvane.operators.folder import Folder
from corvane.operators.metrics import _zero, row_statistics, single_label


def hash_index(key: Column, n: Column | int) -> Column:
    """The first 32 bits of the MD5 of key, modulo n: the same in other engines."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % (F.lit(n) if isinstance(n, int) else n)


#: Draws of a run, which one row of a task makes.
DRAWS = 1 << 14


def draws(df: DataFrame, order: str, replicates: int, seed: int, by: list[str] = ()) -> DataFrame:
    """The rows of `replicates` resamples of each group, with the column rep. Places are
    given by `order`, which must be unique in the group. Every group is replicated in
    full, so this is for tables of labels of moderate size; resample_counts() is the
    form for large ones."""
    placed = ranks(df, [*[F.col(c) for c in by], F.col(order)], "__at")
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    if by:  # places in the group are ranks over all rows less those of the groups before
        a, b = placed.alias("a"), sizes.alias("b")
        same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
        placed = a.join(b, same).select(*[f"a.{c}" for c in df.columns], (F.col("a.__at") - F.col("b.__first")).alias("__at"))
    else:
        placed = placed.withColumn("__at", F.col("__at") - 1)
    starts = (
        sizes.filter("__n > 0").select(*by, "__n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
        .select(*by, "__n", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(DRAWS))).alias("__from"))
    )
    # Draws are dealt out by runs; what explode makes of some sizes looks small to Spark,
    # which would broadcast all draws.
    picks = (
        starts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "rep", "__from")
        .select(*by, "__n", "rep", F.explode(F.sequence("__from", F.least(F.col("__from") + DRAWS, F.col("__n")) - 1)).alias("__d"))
        .select(*by, "rep", hash_index(F.concat_ws("-", F.lit(seed), "rep", "__d"), F.col("__n")).alias("__at"))
    )
    if not by:
        return picks.hint("merge").join(placed, "__at").drop("__at")
    a, b = picks.hint("merge").alias("a"), placed.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__at"]])
    return a.join(b, same).select(*[f"b.{c}" for c in df.columns], "a.rep")


def interval(df: DataFrame, metrics: list[str], by: list[str] = (), level: float = 0.95) -> DataFrame:
    """Linear-interpolation percentiles of each metric over replicates."""
    low, high = (1 - level) / 2, (1 + level) / 2
    return df.groupBy(*by).agg(*[F.percentile(m, F.lit(q)).alias(f"{m}_{n}") for m in metrics for n, q in (("low", low), ("high", high))])


def bootstrap_single(df: DataFrame, gold: str, pred: str, order: str, replicates: int = 1000, seed: int = 17, by: list[str] = ()) -> DataFrame:
    """(by, accuracy_low, accuracy_high, macro_f1_..., weighted_f1_...)."""
    drawn = draws(df.select(*by, gold, pred, order), order, replicates, seed, by)
    counts = drawn.groupBy(*by, "rep", F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return interval(single_label(counts, [*by, "rep"]), ["accuracy", "macro_f1", "weighted_f1"], by)


def bootstrap_multi(df: DataFrame, gold: str, pred: str, order: str, replicates: int = 1000, seed: int = 17) -> DataFrame:
    """Intervals of the six multi-label metrics. The label space is the union of the
    labels of all rows."""
    none = F.array().cast("array<string>")
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), none)))
    folder = Folder(df.sparkSession, None)
    sets = folder.table("sets", lambda: df.select(as_set(gold).alias("gold"), as_set(pred).alias("pred"), order))
    space = F.broadcast(sets.select(F.explode(F.array_union("gold", "pred")).alias("l")).agg(F.count_distinct("l").alias("__labels")))
    # Equal rows are one cell of a replicate, so draws are made once and go no further.
    cells = draws(sets, order, replicates, seed).groupBy("rep", "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    cells = row_statistics(folder.table("cells", lambda: cells), "gold", "pred")
    both, n = F.col("n_gold") + F.col("n_pred"), F.col("n")
    mean = lambda c: F.sum(n * c) / F.sum(n)
    rows = cells.groupBy("rep").agg(
        F.sum(n).alias("n"), mean(((F.col("hits") == F.col("n_gold")) & (F.col("hits") == F.col("n_pred"))).cast("double")).alias("subset_accuracy"),
        mean(_zero(2 * F.col("hits"), both)).alias("samples_f1"), mean(_zero(F.col("hits"), both - F.col("hits"))).alias("samples_jaccard"),
        F.sum(n * F.col("hits")).alias("tp"), F.sum(n * both).alias("both"),
    )
    each = cells.select("rep", "n", "gold", "pred", F.explode(F.array_union("gold", "pred")).alias("l"))
    count = lambda c: F.sum(F.when(c, n).otherwise(0))
    in_gold, in_pred = F.array_contains("gold", F.col("l")), F.array_contains("pred", F.col("l"))
    labels = each.groupBy("rep", "l").agg(count(in_gold).alias("support"), count(in_pred).alias("predicted"), count(in_gold & in_pred).alias("hit"))
    macro = labels.groupBy("rep").agg(F.sum(_zero(2 * F.col("hit"), F.col("support") + F.col("predicted"))).alias("f1_sum"))
    out = rows.join(macro, "rep", "left").crossJoin(space)  # space is one row
    out = out.select("rep", "subset_accuracy", "samples_f1", "samples_jaccard", _zero(2 * F.col("tp"), F.col("both")).alias("micro_f1"), _zero(F.coalesce("f1_sum", F.lit(0.0)), F.col("__labels")).alias("macro_f1"), _zero(F.col("both") - 2 * F.col("tp"), F.col("n") * F.col("__labels")).alias("hamming_loss"))
    return interval(out, ["subset_accuracy", "micro_f1", "macro_f1", "samples_f1", "samples_jaccard", "hamming_loss"])


def resample_counts(counts: DataFrame, replicates: int = 1000, seed: int = 17, by: list[str] = ()) -> DataFrame:
    """(by, rep, gold, pred, n): resampled confusion counts for tables of any size.

    Drawing rows with replacement and counting cells has the same law as one
    multinomial draw over the cells, so only the cells of each group are needed.
    """
    schema = ", ".join([*(f"`{n}` {t}" for n, t in counts.select(*by).dtypes), "rep int", *(f"{n} {t}" for n, t in counts.select("gold", "pred").dtypes), "n long"])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gold", "pred"], na_position="last").reset_index(drop=True)
        rng = np.random.default_rng(seed)
        n = int(pdf["n"].sum())
        got = rng.multinomial(n, pdf["n"] / n, size=replicates)
        rep, cell = np.nonzero(got)
        out = pdf.iloc[cell][[*by, "gold", "pred"]].reset_index(drop=True)
        out.insert(len(by), "rep", rep.astype("int32"))
        return out.assign(n=got[rep, cell].astype("int64"))

    keys = list(by) or [F.lit(0).alias("all")]
    return counts.groupBy(*keys).applyInPandas(draw, schema)


#: Bytes of sums that a task holds before it hands them on.
HELD = 64 << 20


def poisson_multi(df: DataFrame, gold: str, pred: str, replicates: int = 1000, seed: int = 17, by: list[str] = (), level: float = 0.95) -> DataFrame:
    """(by, interval of each of the six multi-label metrics) in one pass over the rows.

    Every row counts a Poisson(1) number of times in a replicate, the limit of drawing
    with replacement. Rows with equal label sets are one cell, which counts Poisson(n)
    times: a cell's numbers for all replicates are one array, from a generator that the
    cell and the seed alone determine, and tasks add the arrays up. What shuffles are sums
    of each label and group, whatever the number of rows. A group's label space is the
    union of its labels; nulls are empty sets; no rows, no result.
    """
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    kinds = dict(df.dtypes)
    keys = [f"__k{i}" for i in range(len(by))]  # groups go by their own columns under other names
    cells = df.groupBy(*[F.col(c).alias(k) for k, c in zip(keys, by, strict=True)], as_set(gold).alias("g"), as_set(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("hash", F.xxhash64(*keys, "g", "p"))
    schema = "".join(f"{k} {kinds[c]}, " for k, c in zip(keys, by, strict=True)) + "label string, raw binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types = None

        def give():
            columns = [pa.array([k[i] for k in held], types[i]) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k[-1] for k in held], pa.string()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=[*keys, "label", "raw"])

        for b in batches:
            types = [f.type for f in b.schema][: len(keys)]
            for r in b.to_pylist():
                group, g, p = tuple(r[k] for k in keys), set(r["g"]), set(r["p"])
                w = np.random.Generator(np.random.Philox(key=[seed, r["hash"] % 2**64])).poisson(r["n"], replicates).astype(np.float64)
                hits, both = len(g & p), len(g) + len(p)
                given = {None: (1, g == p, 2 * hits / both if both else 0, hits / (both - hits) if both else 0, hits, both)} | {x: (x in g and x in p, x in g, x in p) for x in g | p}
                for label, values in given.items():
                    at = (*group, label)
                    if at not in held:
                        held[at] = np.zeros((len(values), replicates))
                    for i, v in enumerate(values):
                        if v:
                            held[at][i] += v * w
                if len(held) * replicates * 24 > HELD:
                    yield from give()
                    held.clear()
        if held:
            yield from give()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        x = sum(np.frombuffer(r) for r in pdf["raw"]).reshape(-1, replicates)
        out = pdf[:1][[*keys, "label"]].loc[lambda d: d.index.repeat(replicates)].reset_index(drop=True)
        return out.assign(rep=np.arange(replicates, dtype=np.int32), v=list(x.T))

    sums = cells.mapInArrow(add, schema).groupBy(*keys, "label").applyInPandas(total, schema.replace("raw binary", "rep int, v array<double>"))
    # Labels fold into their group's replicates: the sum of their F1 scores and their number.
    at = lambda i: F.col("v")[i]
    own = F.col("label").isNull()
    f1 = F.when(~own, _zero(2 * at(0), at(1) + at(2)))
    names = ("n", "subset", "sf1", "sj", "hits", "both")
    each = sums.groupBy(*keys, "rep").agg(*[F.max(F.when(own, at(i))).alias(c) for i, c in enumerate(names)], F.coalesce(F.sum(f1), F.lit(0.0)).alias("f1"), F.count_if(~own).alias("labels"))
    each = each.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], _zero(F.col("subset"), F.col("n")).alias("subset_accuracy"), _zero(2 * F.col("hits"), F.col("both")).alias("micro_f1"), _zero(F.col("f1"), F.col("labels")).alias("macro_f1"),
        _zero(F.col("sf1"), F.col("n")).alias("samples_f1"), _zero(F.col("sj"), F.col("n")).alias("samples_jaccard"), _zero(F.col("both") - 2 * F.col("hits"), F.col("n") * F.col("labels")).alias("hamming_loss"),
    )
    return interval(each, ["subset_accuracy", "micro_f1", "macro_f1", "samples_f1", "samples_jaccard", "hamming_loss"], by, level)
