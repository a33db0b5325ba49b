"""Frequency tables. Ties are broken by the value, as row order means nothing here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n), the most frequent first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def multi_frequency(df: DataFrame, column: str, *keys: str, name: str = "value") -> DataFrame:
    """Counts of the parts between semicolons; a row counts once for each part."""
    return frequency(df.select(*keys, F.explode(F.split(F.coalesce(column, F.lit("")), ";")).alias(name)), *keys, name)


def pivoted(df: DataFrame, key: str, by: str, values: list[str]) -> DataFrame:
    """A row for each key with a column of counts for each given value of `by`."""
    return df.groupBy(key).pivot(by, values).count().na.fill(0)


def top_errors(df: DataFrame, gold: str, pred: str, by: str, k: int = 12) -> DataFrame:
    """The k most frequent wrong pairs of each group."""
    from pyspark.sql import Window

    wrong = df.filter(~F.col(gold).eqNullSafe(F.col(pred))).groupBy(by, gold, pred).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), gold, pred)
    return wrong.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def enrich_errors(predictions: DataFrame, rows: DataFrame, key: str, models: list[str], splits: list[str]) -> DataFrame:
    """Errors of the named models in the named splits with the columns of their rows."""
    wrong = predictions.filter(F.col("model").isin(models) & F.col("split").isin(splits) & ~F.col("correct"))
    return wrong.join(rows, key)
