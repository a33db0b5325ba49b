"""What queries share: reading tables, and SQL text for the other engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.lexicon import INVENTED, Lexicon, classify
from corvane.functions.text import collapse

#: The white space class for RE2.
RE2_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\p{Z}]+"


def clean_sql(c: str) -> str:
    """SQL of collapse()."""
    return f"trim(regexp_replace(coalesce({c}, ''), '{RE2_WHITE}', ' ', 'g'))"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the synopsis, the rest the narrative."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    text = F.coalesce("text", F.lit(""))
    syn = collapse(F.substring_index(text, "\n", 1))
    rest = collapse(F.when(F.instr(text, "\n") > 0, F.expr("substring(coalesce(text, ''), instr(coalesce(text, ''), '\n') + 1)")).otherwise(F.lit("")))
    docs = docs.select("doc_id", "lang", "source", syn.alias("synopsis"), rest.alias("narrative"))
    return docs.withColumn("all_text", F.trim(F.concat_ws(" ", "synopsis", "narrative")))


def screened(spark: SparkSession, sf_dir: str, lexicon: Lexicon = INVENTED) -> DataFrame:
    return classify(reports(spark, sf_dir), lexicon)


REPORTS_SQL = f"""reports AS (
  SELECT doc_id, lang, source, synopsis, narrative, trim(synopsis || ' ' || narrative) AS all_text FROM (
    SELECT doc_id, lang, source,
      {clean_sql("split_part(coalesce(text, ''), chr(10), 1)")} AS synopsis,
      {clean_sql("CASE WHEN strpos(coalesce(text, ''), chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END")} AS narrative
    FROM documents))"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def any_term(text: str, terms) -> str:
    return "(" + (" OR ".join(f"contains({text}, {q(t)})" for t in terms) or "false") + ")"


def classify_sql(lexicon: Lexicon = INVENTED) -> str:
    """CTEs ending in `screened`, with the columns that classify() adds to reports."""
    strip = lambda c: "".join("replace(" for _ in lexicon.ignored) + c + "".join(f", {q(p)}, '')" for p in lexicon.ignored)
    hits = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {any_term(c, terms)} THEN {q(label)} END" for label, terms in lexicon.categories.items()) + "], lambda x: x IS NOT NULL)"
    place = {label: "list_min([" + ", ".join(f"nullif(strpos(a, {q(t)}), 0)" for t in terms) + "])" for label, terms in lexicon.categories.items()}
    at = lambda group: "list_min([" + ", ".join(f"CASE WHEN list_contains(CASE WHEN len(hits) > 0 THEN hits ELSE [primary_event_type] END, {q(x)}) THEN {place[x]} END" for x in group) + "])"
    snip = lambda group: f"CASE WHEN exclusion_reason <> '' THEN '' ELSE coalesce(trim(regexp_replace(substr(all_text, greatest(1, {at(group)} - 45), 140), '{RE2_WHITE}', ' ', 'g')), '') END"
    allowed = "CASE primary_event_type " + " ".join(f"WHEN {q(k)} THEN list_contains({names(v)}, x)" for k, v in lexicon.allowed.items()) + " ELSE true END"
    guards = " AND ".join(f"NOT (x = {q(label)} AND " + (f"list_contains({names(ps)}, primary_event_type) AND " if ps else "") + f"NOT {any_term('a', terms)})" for label, ps, terms in lexicon.guards)
    return f"""{REPORTS_SQL}, h0 AS (
  SELECT *, lower(synopsis) AS s, lower(all_text) AS a, {strip('lower(synopsis)')} AS s2, {strip('lower(all_text)')} AS a2 FROM reports
), h1 AS (SELECT *, {hits('s2')} AS synopsis_hits, {hits('a2')} AS every FROM h0
), h2 AS (SELECT *, list_filter({names(lexicon.priority)}, lambda x: list_contains(CASE WHEN len(synopsis_hits) > 0 THEN synopsis_hits ELSE every END, x)) AS hits FROM h1
), h3 AS (SELECT *, CASE
    WHEN {any_term('s', lexicon.airborne)} AND NOT list_has_any(synopsis_hits, {names(lexicon.strong)}) THEN 'airborne_or_non_ground_context_only'
    WHEN len(hits) > 0 AND hits[1] = {q(lexicon.assistance)} AND NOT {any_term('s', lexicon.context)} THEN 'passenger_assistance_not_ground_phase'
    WHEN len(hits) = 0 AND NOT {any_term('a', lexicon.fallback)} THEN 'no_ground_cabin_keyword_evidence' ELSE '' END AS exclusion_reason FROM h2
), h4 AS (SELECT *,
    CASE WHEN exclusion_reason <> '' THEN 'exclude_not_ground_or_cabin' WHEN len(hits) = 0 THEN 'uncertain_needs_review' ELSE 'include_ground_cabin_event' END AS screening_status,
    CASE WHEN exclusion_reason <> '' THEN 'not_relevant' WHEN len(hits) = 0 THEN 'other_ground_operation' ELSE hits[1] END AS primary_event_type FROM h3
), h5 AS (SELECT *, CASE WHEN exclusion_reason <> '' OR len(hits) = 0 THEN [] ELSE list_filter(hits[2:], lambda x: {allowed} AND {guards}) END AS secondaries FROM h4
), screened AS (SELECT *, array_to_string(secondaries, ';') AS secondary_event_types,
    CASE WHEN len(secondaries) > 0 THEN 'needs_author_review' ELSE 'false' END AS multi_event_flag,
    {snip(lexicon.ground)} AS ground_evidence, {snip(lexicon.cabin)} AS cabin_evidence FROM h5)"""


def md5_order(key: str, seed: int) -> str:
    return f"md5('{seed}-' || CAST({key} AS VARCHAR))"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
