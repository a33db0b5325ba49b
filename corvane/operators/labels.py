"""Label tables and prediction tables: composed operators with their output layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.lexicon import AVIATION, INCLUDE, NOT_RELEVANT, UNCERTAIN, Lexicon, classify
from corvane.functions.text import event_labels

# Columns of the label tables and of the prediction tables, in order.
SILVER_COLUMNS = (
    "corpus_id", "candidate_id", "acn", "query_id", "silver_screening_status", "silver_primary_event_type",
    "silver_secondary_event_types", "silver_multi_event_flag", "ground_phase_evidence", "cabin_or_service_evidence",
    "reason_for_exclusion", "labeler", "label_date", "verification_status", "notes",
)
VERIFIED_COLUMNS = ("author_verification_status", "author_verification_date", "author_verification_source", "author_verification_scope")
EXPANDED_COLUMNS = ("expanded_corpus_role", "expanded_label_provenance", "expanded_selection_note")
SINGLE_COLUMNS = ("task", "model", "split", "corpus_id", "acn", "gold_label", "predicted_label", "correct")
MULTI_COLUMNS = ("task", "model", "split", "corpus_id", "acn", "gold_labels", "predicted_labels", "exact_match")
NOT_FOUND = "raw_record_not_found"
SEED_ROLE, SEED_PROVENANCE = "seed_5000_author_verified_local_audit", "preserved_seed_label"
ADDED_ROLE, ADDED_PROVENANCE = "expanded_3800_agent_silver", "new_agent_silver_expansion"


def structure_flag(flag: Column | str) -> Column:
    """How many events a record stands for: one, unless its labels need a review."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return F.when(c == "needs_author_review", F.lit("possible_multi_event_needs_event_level_policy")).otherwise(F.lit("single_record_label"))


def relevant_rows(df: DataFrame, status: str = "silver_screening_status", primary: str = "silver_primary_event_type", secondary: str = "silver_secondary_event_types") -> DataFrame:
    """Included rows with at least one event label."""
    return df.filter((F.col(status) == INCLUDE) & (F.size(event_labels(primary, secondary)) > 0))


def silver_rows(manifest: DataFrame, records: DataFrame, labeler: str, date: str, status: str, notes: str, lexicon: Lexicon = AVIATION) -> DataFrame:
    """The 15-column label table: every row of manifest(corpus_id, candidate_id, acn,
    query_id) classified by its record(acn, synopsis, all_text). A row without a record
    is uncertain, not relevant, for the reason NOT_FOUND. One join and one stage."""
    texts = records.select("acn", "synopsis", "all_text", F.lit(True).alias("__found"))
    rows = classify(manifest.join(texts, "acn", "left"), lexicon)
    found = F.col("__found").isNotNull()
    of = lambda c, default: F.when(found, F.col(c)).otherwise(F.lit(default))
    made = {
        "silver_screening_status": of("screening_status", UNCERTAIN),
        "silver_primary_event_type": of("primary_event_type", NOT_RELEVANT),
        "silver_secondary_event_types": of("secondary_event_types", ""),
        "silver_multi_event_flag": of("multi_event_flag", "false"),
        "ground_phase_evidence": of("ground_evidence", ""),
        "cabin_or_service_evidence": of("cabin_evidence", ""),
        "reason_for_exclusion": of("exclusion_reason", NOT_FOUND),
        "labeler": F.lit(labeler), "label_date": F.lit(date), "verification_status": F.lit(status), "notes": F.lit(notes),
    }
    rest = [c for c in manifest.columns if c not in SILVER_COLUMNS]
    return rows.select("corpus_id", "candidate_id", "acn", "query_id", *[v.alias(k) for k, v in made.items()], *rest)


def label_rows(manifest: DataFrame, seeds: DataFrame, records: DataFrame, labeler: str, date: str, status: str, notes: str, lexicon: Lexicon = AVIATION) -> DataFrame:
    """The 22-column label table of an expanded corpus: rows whose acn has a seed label
    keep it, with the ids and the note of the manifest; all others are classified.
    Columns that the seeds lack are empty."""
    base = [c for c in (*SILVER_COLUMNS, *VERIFIED_COLUMNS) if c not in ("corpus_id", "candidate_id", "acn", "query_id")]
    keys = ["corpus_id", "candidate_id", "acn", "query_id"]
    kept = seeds.select("acn", *[(F.coalesce(F.col(c), F.lit("")) if c in seeds.columns else F.lit("")).alias(c) for c in base])
    old = manifest.select(*keys, "expanded_selection_note").join(kept, "acn")
    old = old.withColumns({"expanded_corpus_role": F.lit(SEED_ROLE), "expanded_label_provenance": F.lit(SEED_PROVENANCE)})
    new = manifest.select(*keys, "expanded_selection_note").join(kept.select("acn"), "acn", "left_anti")
    new = silver_rows(new, records, labeler, date, status, notes, lexicon)
    new = new.withColumns({**{c: F.lit("") for c in VERIFIED_COLUMNS}, "expanded_corpus_role": F.lit(ADDED_ROLE), "expanded_label_provenance": F.lit(ADDED_PROVENANCE)})
    every = [*SILVER_COLUMNS, *VERIFIED_COLUMNS, *EXPANDED_COLUMNS]
    return old.select(*every).unionByName(new.select(*every))


def single_predictions(df: DataFrame, task: str, model: str, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """The 8-column prediction table; correct is the text true or false."""
    same = F.col(gold).eqNullSafe(F.col(predicted)).cast("string")
    return df.select(F.lit(task).alias("task"), F.lit(model).alias("model"), "split", "corpus_id", "acn", F.col(gold).alias("gold_label"), F.col(predicted).alias("predicted_label"), same.alias("correct"))


def multi_predictions(df: DataFrame, task: str, model: str, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """The 8-column prediction table of label sets: sorted, joined by semicolons."""
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ";")
    return df.select(F.lit(task).alias("task"), F.lit(model).alias("model"), "split", "corpus_id", "acn", listed(gold).alias("gold_labels"), listed(predicted).alias("predicted_labels"), (listed(gold) == listed(predicted)).cast("string").alias("exact_match"))
