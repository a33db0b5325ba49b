"""Integrity checks as flag columns, counted in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.lexicon import EXCLUDE, INCLUDE, NOT_RELEVANT
from corvane.functions.text import normalize_text, year_from_value

#: Evidence shorter than this, normalised, is too common to be looked up.
EVIDENCE_LEAST = 30
#: Checks that make an audit fail; the rest are caveats.
BLOCKING = ("duplicate_ids", "duplicate_keys", "missing_raw", "missing_manifest", "rule_mismatches", "blank_required", "include_not_relevant", "exclude_relevant")


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


@dataclass(frozen=True)
class Layout:
    """Column names of the audited table."""

    id: str = "corpus_id"
    key: str = "key"
    status: str = "screening_status"
    primary: str = "primary_event_type"
    evidence: tuple[str, ...] = ("ground_evidence", "cabin_evidence")
    text: str = "all_text"
    date: str = "date"
    required: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)
    first_year: int = 2011
    last_year: int = 2025


def flags(df: DataFrame, at: Layout) -> DataFrame:
    """df with one boolean column for each check on single rows. Columns in_raw and
    in_manifest tell whether a row has its partners; rules maps stored columns to
    recomputed ones."""
    status, primary = F.col(at.status), F.col(at.primary)
    source = normalize_text(at.text)
    cut = lambda e: normalize_text(e)
    found = lambda e: (F.length(cut(e)) >= EVIDENCE_LEAST) & ~F.contains(source, cut(e))
    any_of = lambda cs: _any(list(cs))
    year = year_from_value(at.date)
    return df.withColumns({
        "missing_raw": ~F.col("in_raw"),
        "missing_manifest": ~F.col("in_manifest"),
        "rule_mismatches": any_of(~F.col(a).eqNullSafe(F.col(b)) for a, b in at.rules.items()),
        "blank_required": any_of(blank(c) for c in at.required),
        "include_not_relevant": F.coalesce((status == INCLUDE) & (primary == NOT_RELEVANT), F.lit(False)),
        "exclude_relevant": F.coalesce((status == EXCLUDE) & (primary != NOT_RELEVANT), F.lit(False)),
        "include_without_evidence": F.coalesce((status == INCLUDE) & _all([blank(e) for e in at.evidence]), F.lit(False)),
        "evidence_not_in_source": any_of(found(e) for e in at.evidence),
        "date_outside_window": ~F.coalesce(year.between(at.first_year, at.last_year), F.lit(False)),
    })


def _any(cs: list[Column]) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | c
    return out


def _all(cs: list[Column]) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c
    return out


CHECKS = ("missing_raw", "missing_manifest", "rule_mismatches", "blank_required", "include_not_relevant", "exclude_relevant", "include_without_evidence", "evidence_not_in_source", "date_outside_window")


def roll_up(df: DataFrame, at: Layout, keys: DataFrame | None = None) -> DataFrame:
    """One row: rows, the count of every check, blocking_errors and verdict. `keys` is
    the table's id and key, if these are known before the joins that df holds: repeats
    are then counted without them."""
    flagged = flags(df, at)
    sums = flagged.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in CHECKS])
    repeated = lambda k, name: (df if keys is None else keys).groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias(name))
    out = sums.crossJoin(repeated(at.id, "duplicate_ids")).crossJoin(repeated(at.key, "duplicate_keys"))  # one row each
    blocking = sum((F.col(c) for c in BLOCKING[1:]), F.col(BLOCKING[0]))
    return out.withColumn("blocking_errors", blocking).withColumn("verdict", F.when(F.col("blocking_errors") == 0, F.lit("PASS_WITH_CAVEATS")).otherwise(F.lit("FAIL")))


def mismatches(df: DataFrame, at: Layout) -> DataFrame:
    """(id, field, stored, computed) of every recomputed field that differs."""
    text = lambda c: F.col(c).cast("string")
    rows = [F.when(~F.col(a).eqNullSafe(F.col(b)), F.struct(F.lit(a).alias("field"), text(a).alias("stored"), text(b).alias("computed"))) for a, b in at.rules.items()]
    return df.select(at.id, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("m")).select(at.id, "m.*")
