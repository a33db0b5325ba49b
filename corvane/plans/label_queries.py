"""Queries on label tables and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.lexicon import INVENTED
from corvane.operators import labels
from corvane.operators.folder import Folder
from corvane.plans.common import classify_sql, load, q, reports
from corvane.plans.metric_queries import _TAGGED, _tagged

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Documents stand in for records; every ninth has none.
_MANIFEST_SQL = "SELECT 'C' || CAST(doc_id AS VARCHAR) AS corpus_id, 'K' || CAST(doc_id AS VARCHAR) AS candidate_id, CAST(doc_id AS VARCHAR) AS acn, 'Q' || CAST(doc_id % 4 AS VARCHAR) AS query_id, 'note ' || source AS expanded_selection_note FROM documents"
_FOUND_SQL = "doc_id % 9 <> 4"
_SEEDED_SQL = "doc_id % 3 = 0"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    return load(spark, sf_dir, "documents").select(F.concat(F.lit("C"), key).alias("corpus_id"), F.concat(F.lit("K"), key).alias("candidate_id"), key.alias("acn"), F.concat(F.lit("Q"), (F.col("doc_id") % 4).cast("string")).alias("query_id"), F.concat(F.lit("note "), F.col("source")).alias("expanded_selection_note"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).filter(_FOUND_SQL).select(F.col("doc_id").cast("string").alias("acn"), "synopsis", "all_text")


def _silver_sql(labeler: str, date: str, status: str, notes: str, where: str = "true") -> str:
    of = lambda c, default: f"CASE WHEN {_FOUND_SQL} THEN {c} ELSE {q(default)} END"
    return f"""SELECT m.corpus_id, m.candidate_id, m.acn, m.query_id, {of('screening_status', 'uncertain_needs_review')} AS silver_screening_status, {of('primary_event_type', 'not_relevant')} AS silver_primary_event_type,
  {of('secondary_event_types', '')} AS silver_secondary_event_types, {of('multi_event_flag', 'false')} AS silver_multi_event_flag, {of('ground_evidence', '')} AS ground_phase_evidence, {of('cabin_evidence', '')} AS cabin_or_service_evidence,
  {of('exclusion_reason', 'raw_record_not_found')} AS reason_for_exclusion, {q(labeler)} AS labeler, {q(date)} AS label_date, {q(status)} AS verification_status, {q(notes)} AS notes, m.expanded_selection_note
FROM ({_MANIFEST_SQL}) m JOIN screened s ON m.acn = CAST(s.doc_id AS VARCHAR) WHERE {where}"""


_NEW = ("labeler two", "2026-01-02", "not verified", "made by rules")


@query(f"WITH {classify_sql()} SELECT * EXCLUDE (expanded_selection_note) FROM ({_silver_sql(*_NEW)})")
def silver_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _manifest(spark, sf_dir).drop("expanded_selection_note")
    return labels.silver_rows(manifest, _records(spark, sf_dir), *_NEW, lexicon=INVENTED)


_BLANK = ", ".join(f"'' AS {c}" for c in labels.VERIFIED_COLUMNS)


@query(f"""WITH {classify_sql()} SELECT * EXCLUDE (expanded_selection_note), {_BLANK}, 'expanded_3800_agent_silver' AS expanded_corpus_role, 'new_agent_silver_expansion' AS expanded_label_provenance, expanded_selection_note
FROM ({_silver_sql(*_NEW, where='NOT (' + _SEEDED_SQL + ')')})
UNION ALL SELECT corpus_id, candidate_id, acn, query_id, 'include_ground_cabin_event', CASE WHEN CAST(acn AS BIGINT) % 2 = 0 THEN 'fueling' ELSE 'cabin_service' END, '', 'false', '', '', '', 'labeler one', '', '', '', 'verified', '', '', '',
  'seed_5000_author_verified_local_audit', 'preserved_seed_label', expanded_selection_note FROM ({_MANIFEST_SQL}) WHERE CAST(acn AS BIGINT) % 3 = 0""")
def expanded_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = load(spark, sf_dir, "documents").filter(_SEEDED_SQL).select(
        F.col("doc_id").cast("string").alias("acn"), F.lit("include_ground_cabin_event").alias("silver_screening_status"), F.when(F.col("doc_id") % 2 == 0, "fueling").otherwise("cabin_service").alias("silver_primary_event_type"),
        F.lit("false").alias("silver_multi_event_flag"), F.lit("labeler one").alias("labeler"), F.lit("verified").alias("author_verification_status"),
    )
    return labels.label_rows(_manifest(spark, sf_dir), seeds, _records(spark, sf_dir), *_NEW, lexicon=INVENTED)


@query(f"WITH {classify_sql()}, r AS ({_silver_sql(*_NEW)}) SELECT acn, silver_primary_event_type, CASE silver_multi_event_flag WHEN 'needs_author_review' THEN 'possible_multi_event_needs_event_level_policy' ELSE 'single_record_label' END AS structure FROM r WHERE silver_screening_status = 'include_ground_cabin_event' AND (silver_primary_event_type <> 'not_relevant' OR silver_secondary_event_types <> '')")
def relevant_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table is saved first: the filter would be pushed below the classifier's
    projections and compute the whole chain of them for each place that names a label."""
    columns = ("acn", "silver_screening_status", "silver_primary_event_type", "silver_secondary_event_types", "silver_multi_event_flag")
    made = Folder(spark, None).table("labels", lambda: silver_label_rows(spark, sf_dir).select(*columns))
    rows = labels.relevant_rows(made)
    return rows.select("acn", "silver_primary_event_type", labels.structure_flag("silver_multi_event_flag").alias("structure"))


_SPLIT = "CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, 'C' || CAST(doc_id AS VARCHAR) AS corpus_id, CAST(doc_id AS VARCHAR) AS acn"


def _placed(df: DataFrame) -> DataFrame:
    at = F.col("doc_id") % 3
    return df.withColumns({"split": F.when(at == 0, "train").when(at == 1, "dev").otherwise("test"), "corpus_id": F.concat(F.lit("C"), F.col("doc_id").cast("string")), "acn": F.col("doc_id").cast("string")})


@query(f"SELECT 'length' AS task, 'rule' AS model, {_SPLIT}, lang AS gold_label, CASE WHEN n_chars > 400 THEN 'en' ELSE 'de' END AS predicted_label, CASE WHEN lang IS NOT DISTINCT FROM (CASE WHEN n_chars > 400 THEN 'en' ELSE 'de' END) THEN 'true' ELSE 'false' END AS correct FROM documents")
def single_prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("gold"), F.when(F.col("n_chars") > 400, "en").otherwise("de").alias("predicted"))
    return labels.single_predictions(_placed(rows), "length", "rule")


@query(f"WITH {_TAGGED}, s AS (SELECT {_SPLIT}, array_to_string(list_sort(gold), ';') AS g, array_to_string(list_sort(pred), ';') AS p FROM g) SELECT 'tags' AS task, 'terms' AS model, split, corpus_id, acn, g AS gold_labels, p AS predicted_labels, CASE WHEN g = p THEN 'true' ELSE 'false' END AS exact_match FROM s")
def multi_prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.multi_predictions(_placed(_tagged(spark, sf_dir)), "tags", "terms", "gold", "pred")
