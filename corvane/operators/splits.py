"""Stratified group splits and leakage checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.corpus import MissingRows, ranks, seeded
from corvane.operators.folder import Folder

SPLITS = ("train", "dev", "test")
TRAIN, DEV = 0.7, 0.15


def targets(n: int) -> dict[str, int]:
    """Rows of each split: halves round to even, the rest is for test."""
    train, dev = round(n * TRAIN), round(n * DEV)
    return {"train": train, "dev": dev, "test": n - train - dev}


def hash_split(df: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """df with split: in each stratum the rows in seeded order are cut at the targets.
    Declarative, for rows whose groups are single rows. The first digits of the seeded
    hash cut a stratum into 4,096 bins; ranks are made within bins, after the counts of
    those before, so no task holds a stratum."""
    binned = df.withColumn("__h", seeded(key, seed)).withColumn("__bin", F.substring("__h", 1, 3))
    of = Window.partitionBy("__s")
    sizes = binned.groupBy(F.col(stratum).alias("__s"), F.col("__bin").alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    sizes = sizes.withColumns({"__n": F.sum("__c").over(of), "__before": F.sum("__c").over(of.orderBy("__b")) - F.col("__c")})  # 4,096 rows a stratum
    ranked = binned.withColumn("__r", F.row_number().over(Window.partitionBy(stratum, "__bin").orderBy("__h", key)))
    out = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b"))).withColumn("__r", F.col("__r") + F.col("__before"))
    train, dev = F.rint(F.col("__n") * TRAIN), F.rint(F.col("__n") * DEV)
    split = F.when(F.col("__r") <= train, "train").when(F.col("__r") <= train + dev, "dev").otherwise("test")
    return out.withColumn("split", split).drop("__h", "__bin", "__s", "__b", "__c", "__n", "__before", "__r")


def dealt(lack: list[int], size: int, groups: int) -> list[int]:
    """How many of `groups` groups of one size each split gets if every next one goes to
    the split that lacks most rows, ties to the first.

    A split's lacks along its groups are a falling progression in steps of `size`, and the
    groups go to the `groups` largest terms of all of them: a threshold is halved for.
    """
    reach = lambda v: [max(0, (x - v) // size + 1) for x in lack]
    low, high = min(lack) - groups * size, max(lack)
    while low < high:  # the largest value that enough terms reach
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(reach(middle)) >= groups else (low, middle - 1)
    out = reach(low + 1)
    for i, n in enumerate(reach(low)):
        if n > out[i] and sum(out) < groups:
            out[i] += 1
    return out


def group_split(df: DataFrame, group: str, stratum: str, seed: int) -> DataFrame:
    """df with split (replaced, if there): groups stay whole and strata keep their shares.

    A group belongs to the stratum of its least row, so that it cannot straddle splits
    even if its rows differ in stratum. The groups of a stratum are dealt by falling size,
    those of one size in seeded order, each to the split that lacks most of its target,
    ties to train, then dev. What decides is the number of groups of each size, a table of
    a few rows a stratum; groups are ranked, so no task holds a stratum's.
    """
    folder = Folder(df.sparkSession, None)
    counted = df.groupBy(group).agg(F.min(stratum).alias("__s"), F.count(F.lit(1)).alias("__n")).withColumn("__h", seeded(group, seed))
    sizes = folder.table("groups", lambda: counted)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n", ascending=False)
        goal = targets(int((pdf["__n"] * pdf["__k"]).sum()))
        lack, out = [goal[s] for s in SPLITS], []
        for size, groups in zip(pdf["__n"].tolist(), pdf["__k"].tolist(), strict=True):
            got = dealt(lack, size, groups)
            lack = [x - n * size for x, n in zip(lack, got, strict=True)]
            out.append(got)
        return pd.DataFrame({"__s2": pdf["__s"], "__n2": pdf["__n"], "__train": [g[0] for g in out], "__dev": [g[1] for g in out]})

    histogram = sizes.groupBy("__s", "__n").agg(F.count(F.lit(1)).alias("__k"))
    cuts = histogram.groupBy("__s").applyInPandas(deal, f"__s2 {dict(sizes.dtypes)['__s']}, __n2 long, __train long, __dev long")
    ranked = ranks(sizes, [F.col("__s"), F.col("__n"), F.col("__h"), F.col(group)], "__r")
    first = ranked.groupBy("__s", "__n").agg(F.min("__r").alias("__first"))
    cuts = cuts.join(first, F.col("__s2").eqNullSafe(F.col("__s")) & (F.col("__n2") == F.col("__n"))).select("__s2", "__n2", "__train", "__dev", "__first")
    placed = ranked.join(cuts, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__n") == F.col("__n2"))).withColumn("__at", F.col("__r") - F.col("__first"))
    placed = placed.select(group, F.when(F.col("__at") < F.col("__train"), "train").when(F.col("__at") < F.col("__train") + F.col("__dev"), "dev").otherwise("test").alias("split"))
    a, b = df.drop("split").alias("a"), folder.table("placed", lambda: placed).alias("b")
    return a.join(b, F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}"))).select("a.*", "b.split")


def extend_split(rows: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """rows with split: seed rows keep theirs, all others train. A seed row without a
    split is an error."""
    bad = seeds.filter("split IS NULL OR split = ''").limit(1).collect()
    if bad:
        raise MissingRows(f"a seed row has no split: {bad[0]}")
    return rows.join(seeds.select(key, F.col("split").alias("__s")), key, "left").withColumn("split", F.coalesce("__s", F.lit("train"))).drop("__s")


def leaks(df: DataFrame, group: str) -> DataFrame:
    """(group, splits) of the groups found in several splits."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
