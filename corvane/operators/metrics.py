"""Classification metrics from grouped counts.

Predictions are aggregated to confusion counts first, so whatever follows works on as
many rows as there are label pairs, not rows of data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zero(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def confusion(df: DataFrame, gold: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Counts n per (by, gold, pred)."""
    return df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """A row for each gold label with a column of counts for each given label."""
    return df.groupBy(F.col(gold).alias("gold")).pivot(pred, labels).count().na.fill(0)


def per_label(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, label, support, predicted, tp, precision, recall, f1) for the labels that
    occur as gold or prediction in the group; 0 where a ratio has no base."""
    sides = F.explode(F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(F.lit(0).cast("long")).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )).alias("s")
    out = counts.select(*by, sides).select(*by, "s.*").groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    return out.select(*by, "label", "support", "predicted", "tp", _zero(F.col("tp"), F.col("predicted")).alias("precision"), _zero(F.col("tp"), F.col("support")).alias("recall"), _zero(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def single_label(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, n, accuracy, macro_f1, weighted_f1, micro_f1). The macro mean is over the
    labels seen as gold or prediction in the group; micro F1 is the accuracy."""
    labels = per_label(counts, by)
    out = labels.groupBy(*by).agg(F.sum("support").alias("n"), F.sum("tp").alias("right"), F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * F.col("support")).alias("weighted"))
    accuracy = _zero(F.col("right"), F.col("n"))
    return out.select(*by, "n", accuracy.alias("accuracy"), "macro_f1", _zero(F.col("weighted"), F.col("n")).alias("weighted_f1"), accuracy.alias("micro_f1"))


def classification_report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Per-label rows, then rows named accuracy, macro avg and weighted avg."""
    labels = per_label(confusion(df, gold, pred))
    rows = labels.select("label", "precision", "recall", "f1", "support")
    total = labels.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("right"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )
    right = _zero(F.col("right"), F.col("n"))
    sums = F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), right.alias("precision"), right.alias("recall"), right.alias("f1"), F.col("n").alias("support")),
        *[F.struct(F.lit(f"{k} avg").alias("label"), F.col(f"{k}_precision").alias("precision"), F.col(f"{k}_recall").alias("recall"), F.col(f"{k}_f1").alias("f1"), F.col("n").alias("support")) for k in ("macro", "weighted")],
    )).alias("s")
    return rows.unionByName(total.select(sums).select("s.*"))


def row_statistics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """df with hits, n_gold, n_pred of two label arrays, both taken as sets."""
    g, p = F.array_distinct(F.coalesce(F.col(gold), F.array().cast("array<string>"))), F.array_distinct(F.coalesce(F.col(pred), F.array().cast("array<string>")))
    return df.withColumns({"hits": F.size(F.array_intersect(g, p)), "n_gold": F.size(g), "n_pred": F.size(p)})


def per_label_multi(df: DataFrame, gold: str, pred: str, by: list[str] = ()) -> DataFrame:
    """(by, label, support, predicted, tp, precision, recall, f1) of two label arrays."""
    mark = lambda c, g, p: F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), lambda x: F.struct(x.alias("label"), F.lit(g).cast("long").alias("support"), F.lit(p).cast("long").alias("predicted"), (F.lit(g) * F.coalesce(F.array_contains(F.col(pred), x), F.lit(False)).cast("long")).alias("tp")))
    rows = df.select(*by, F.explode(F.concat(mark(gold, 1, 0), mark(pred, 0, 1))).alias("s")).select(*by, "s.*")
    out = rows.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    return out.select(*by, "label", "support", "predicted", "tp", _zero(F.col("tp"), F.col("predicted")).alias("precision"), _zero(F.col("tp"), F.col("support")).alias("recall"), _zero(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def multi_label(df: DataFrame, gold: str, pred: str, label_space: list[str] | None = None) -> DataFrame:
    """(n, label_count, subset_accuracy, micro_f1, macro_f1, samples_f1, samples_jaccard,
    hamming_loss); label_space None is the union of the labels seen. A row without any
    label counts as 0 in the sample means; no rows give zeros."""
    stats = row_statistics(df, gold, pred)
    both = F.col("n_gold") + F.col("n_pred")
    rows = stats.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(((F.col("hits") == F.col("n_gold")) & (F.col("hits") == F.col("n_pred"))).cast("double")).alias("subset"),
        F.avg(_zero(2 * F.col("hits"), both)).alias("samples_f1"),
        F.avg(_zero(F.col("hits"), both - F.col("hits"))).alias("samples_jaccard"),
        F.sum(both - 2 * F.col("hits")).alias("wrong"), F.sum("hits").alias("tp"), F.sum(both).alias("both"),
    )
    labels = per_label_multi(df, gold, pred)
    if label_space is None:
        macro = labels.agg(F.avg("f1").alias("macro"), F.count(F.lit(1)).alias("label_count"))
    else:
        macro = labels.filter(F.col("label").isin(label_space)).agg((F.sum("f1") / len(label_space)).alias("macro"), F.lit(len(label_space)).cast("long").alias("label_count"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.crossJoin(F.broadcast(macro)).select(  # one row each
        "n", "label_count", zero(F.col("subset")).alias("subset_accuracy"), zero(_zero(2 * F.col("tp"), F.col("both"))).alias("micro_f1"), zero(F.col("macro")).alias("macro_f1"),
        zero(F.col("samples_f1")).alias("samples_f1"), zero(F.col("samples_jaccard")).alias("samples_jaccard"), zero(_zero(F.col("wrong"), F.col("n") * F.col("label_count"))).alias("hamming_loss"),
    )


def cohen_kappa(df: DataFrame, one: str, other: str, by: list[str] = ()) -> DataFrame:
    """(by, n, agreement, kappa) of the rows in which both labels are neither null nor
    blank; kappa is null if chance alone agrees always."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    counts = confusion(df.filter(~blank(one) & ~blank(other)), one, other, by)
    labels = per_label(counts, by)
    out = labels.groupBy(*by).agg(F.sum("support").alias("n"), F.sum("tp").alias("same"), F.sum(F.col("support").cast("double") * F.col("predicted")).alias("chance"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return out.filter("n > 0").select(*by, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def seed_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population standard deviation of metrics over the seeds of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("seeds"), *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def scorer_summary(df: DataFrame) -> DataFrame:
    """(completed_rows, valid_json_rows, schema_valid_rows, cost_usd) of scorer rows;
    failures are completed rows too."""
    return df.agg(F.count(F.lit(1)).alias("completed_rows"), F.count_if("valid_json").alias("valid_json_rows"), F.count_if("schema_valid").alias("schema_valid_rows"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
