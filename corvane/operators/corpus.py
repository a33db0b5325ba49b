"""Building a corpus: dedupe, ids, quota samples, expansion, provenance, joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import col, content_lengths
from corvane.operators.folder import Folder


def seeded(key: Column | str, seed: int) -> Column:
    """A shuffle order that is the same on any number of machines: the MD5 of the seed
    and the key, in hexadecimal."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), col(key).cast("string")))


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows with one key the last by `order` (null keys are a key)."""
    return _pick(df, key, F.max_by, order)


def first_wins(df: DataFrame, key: str, order: list[str], sets: dict[str, str] | None = None) -> DataFrame:
    """Of the rows with one key the first by `order`, and for each entry of `sets`
    (new column: column) the sorted distinct values that its rows held. A grouped
    minimum, which combines before the shuffle; no window sorts the rows."""
    return _pick(df, key, F.min_by, order, sets)


def _pick(df: DataFrame, key: str, by, order: list[str], sets: dict[str, str] | None = None) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    aggs = [by(F.struct(*rest), F.struct(*order)).alias("__row")]
    aggs += [F.array_join(F.sort_array(F.collect_set(c)), ";").alias(n) for n, c in (sets or {}).items()]
    out = df.groupBy(key).agg(*aggs)
    kept = [c for c in rest if c not in (sets or {})]
    return out.select(key, *[F.col(f"__row.{c}").alias(c) for c in kept], *(sets or {}))


def ranks(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rank from 1 by `order`. Ranks need a total order but no single task:
    rows are range-partitioned and sorted, and each partition's ranks start after the
    counts of those before it. The partitions are a table: a second look at the rows would
    sample their bounds anew and cut them elsewhere."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = df.repartitionByRange(int(parts), *order).withColumn("__part", F.spark_partition_id())
    ordered = Folder(df.sparkSession, None).table("ordered", lambda: dealt)
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before_part"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = ordered.withColumn("__place", place).join(F.broadcast(before), "__part")
    return out.withColumn(name, (F.col("__place") + F.col("__before_part")).cast("long")).drop("__part", "__place", "__before_part")


def ranked_ids(df: DataFrame, order: list[Column], prefix: str, digits: int, name: str) -> DataFrame:
    """df with ids prefix + rank from 1 by `order`, zero-padded."""
    return ranks(df, order, name).withColumn(name, F.format_string(f"{prefix}%0{digits}d", F.col(name)))


def quota_sample(df: DataFrame, key: str, groups: str, quotas: list[tuple[str, int]], size: int, seed: int) -> DataFrame:
    """`size` rows without replacement: for each (group, quota) in order up to quota
    rows that list the group (semicolon-separated column) and are not yet taken, then
    any rest, all in seeded order. The column stage tells which step took a row.

    A step takes the first of the rows that are left, so of rows that list the same of
    the groups all steps together take a prefix in seeded order, of `most` rows at most.
    A histogram of hashes finds where that many rows end; one more pass keeps the rows up
    to there, and the steps run on these alone, whose number the rows do not change.
    """
    most = max(size, sum(q for _, q in quotas))
    listed = F.split(groups, ";")
    has = F.concat(F.lit(""), *[F.coalesce(F.array_contains(listed, g), F.lit(False)).cast("int").cast("string") for g, _ in quotas])
    pool = df.withColumns({"__h": seeded(key, seed), "__has": has})
    pool = pool.withColumn("__bin", F.substring("__h", 1, 5))  # 2^20 bins
    bins = pool.groupBy("__has", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__has").orderBy("__bin")) - F.col("__n")
    last = bins.withColumn("__b", before).filter(F.col("__b") < most).groupBy("__has").agg(F.max("__bin").alias("__last"))
    first = Folder(df.sparkSession, None).table("first", lambda: pool.join(last, "__has").filter(F.col("__bin") <= F.col("__last")).drop("__last", "__bin"))
    taken: list[DataFrame] = []

    def left() -> DataFrame:
        got = reduce(DataFrame.union, [t.select(key) for t in taken]) if taken else None
        return first if got is None else first.join(got, key, "left_anti")

    for i, (group, quota) in enumerate(quotas):
        taken.append(left().filter(F.substring("__has", i + 1, 1) == "1").orderBy("__h", key).limit(quota).withColumn("stage", F.lit(group)))
    out = reduce(DataFrame.unionByName, taken) if taken else first.limit(0).withColumn("stage", F.lit(""))
    rest = max(0, size - sum(q for _, q in quotas))
    have = out.count() if taken else 0
    rest = max(rest, size - have)
    taken_all = out.unionByName(left().orderBy("__h", key).limit(rest).withColumn("stage", F.lit("top_up")))
    return taken_all.orderBy(F.when(F.col("stage") == "top_up", 1).otherwise(0), "__h", key).limit(size).drop("__h", "__has")


def drop_least_informative(df: DataFrame, keys: list[str], synopsis: str, narrative: str, all_text: str, drop: int = 1) -> DataFrame:
    """df without its `drop` rows of least content: ordered by the lengths of all text,
    synopsis and narrative, then `keys`."""
    n = content_lengths(F.col(synopsis), F.col(narrative), F.col(all_text))
    least = df.select(*keys, *[c.alias(f"__n{i}") for i, c in enumerate(n)]).orderBy("__n0", "__n1", "__n2", *keys).limit(drop).select(*keys)
    return df.join(F.broadcast(least), keys, "left_anti")  # `drop` rows


def annotation_sample(df: DataFrame, key: str, label: str, size: int, seed: int) -> DataFrame:
    """A stratified sample: of each class max(1, rint(size * n_class / n)) rows in seeded
    order; of those `size` in another seeded order, which can drop a class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.sum("__c").alias("__n"))
    quota = counts.crossJoin(F.broadcast(total)).select(F.col(label).alias("__l"), F.greatest(F.lit(1), F.rint(size * F.col("__c") / F.col("__n"))).cast("int").alias("__k"))  # total is one row
    w = Window.partitionBy(label).orderBy(seeded(key, seed), key)
    ranked = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= size)
    got = ranked.join(F.broadcast(quota), F.col(label).eqNullSafe(F.col("__l"))).filter("__r <= __k").drop("__r", "__k", "__l")
    return got.orderBy(seeded(key, seed + 1), key).limit(size)


def blind(df: DataFrame, labels: list[str], blanks: list[str]) -> DataFrame:
    """The worksheet of a sample: without its labels, with empty columns to fill in."""
    return df.drop(*labels).withColumns({b: F.lit("") for b in blanks})


def left_with_defaults(df: DataFrame, other: DataFrame, key: str, defaults: dict) -> DataFrame:
    """A left join in which columns of missing partners get defaults; matched nulls stay."""
    marked = other.withColumn("__hit", F.lit(True))
    out = df.join(marked, key, "left")
    return out.withColumns({c: F.when(F.col("__hit"), F.col(c)).otherwise(F.lit(v)) for c, v in defaults.items()}).drop("__hit")


class MissingRows(RuntimeError):
    """Rows that a join needs are not there."""


def strict_inner(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """An inner join that fails if any row of df has no partner."""
    missing = [r[0] for r in df.join(other, key, "left_anti").select(key).limit(5).collect()]
    if missing:
        raise MissingRows(f"no partner for {key}: {missing}")
    return df.join(other, key)


def expect_rows(df: DataFrame, n: int, what: str) -> DataFrame:
    """df, if it has n rows."""
    got = df.count()
    if got != n:
        raise MissingRows(f"{what}: {got} rows, {n} expected")
    return df


def with_provenance(df: DataFrame, status: str, date: str, source: str, scope: str, note: str) -> DataFrame:
    """Four provenance columns, and the note added to notes."""
    notes = F.when(F.coalesce(F.trim("notes"), F.lit("")) == "", F.lit(note)).otherwise(F.concat_ws(" ", F.trim("notes"), F.lit(note)))
    return df.withColumns({"author_verification_status": F.lit(status), "author_verification_date": F.lit(date), "author_verification_source": F.lit(source), "author_verification_scope": F.lit(scope), "notes": notes})


def candidate_rows(records: DataFrame, prefix: str = "CAND_") -> DataFrame:
    """The 15-column candidate projection of first-wins records (acn, query_ids, files,
    date, synopsis, people), ranked by number, the largest first."""
    people = F.coalesce(F.col("people"), F.array().cast("array<struct<`9107`:string,`11330`:string>>"))
    rows = records.withColumns({
        "narrative_present": F.exists(people, lambda p: F.coalesce(p["9107"], F.lit("")) != "").cast("string"),
        "analyst_synopsis_present": (F.coalesce("synopsis", F.lit("")) != "").cast("string"),
    })
    rows = ranked_ids(rows, [F.col("acn").cast("long").desc(), F.col("acn")], prefix, 6, "candidate_id")
    blank = {c: F.lit("not_extracted") for c in ("local_time", "location", "aircraft_make_model", "operator_type", "event_type_field", "flight_phase_field")}
    return rows.select("candidate_id", F.col("acn").cast("string").alias("acn"), F.col("query_ids").alias("query_id"), F.coalesce(F.col("date"), F.lit("")).alias("report_date_or_year"), *[v.alias(k) for k, v in blank.items()], "narrative_present", "analyst_synopsis_present", F.col("files").alias("raw_export_file"), F.lit("not_screened").alias("screening_status"), F.lit("").alias("screening_notes"))


def expand_ids(rows: DataFrame, seeds: DataFrame, key: str, prefix: str, first: int, order: list[Column]) -> DataFrame:
    """corpus_id and role of rows: seed rows keep their id, the others get the numbers
    from `first` on in `order`."""
    known = rows.join(seeds.select(key, "corpus_id"), key).withColumn("expanded_corpus_role", F.lit("seed"))
    new = ranked_ids(rows.join(seeds.select(key), key, "left_anti"), order, "", 1, "__n")
    new = new.withColumn("corpus_id", F.format_string(f"{prefix}%05d", F.col("__n").cast("long") + first - 1)).drop("__n").withColumn("expanded_corpus_role", F.lit("added"))
    return known.unionByName(new)


def batched(df: DataFrame, key: str, size: int) -> DataFrame:
    """(batch, keys) of `size` sorted keys each, the last one shorter."""
    ids = ranked_ids(df.select(key), [F.col(key)], "", 1, "__n")
    return ids.groupBy(F.floor((F.col("__n").cast("long") - 1) / size).alias("batch")).agg(F.sort_array(F.collect_list(key)).alias("keys"))


def best_per_group(df: DataFrame, group: str, score: str, ties: list[str]) -> DataFrame:
    """The row with the highest score of each group, ties by the given columns."""
    w = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
