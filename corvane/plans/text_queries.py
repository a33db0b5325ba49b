"""Queries on text scalars, the classifier and the query language."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import boolquery, structured, text
from corvane.operators import postings
from corvane.operators.folder import Folder
from corvane.plans.common import RE2_WHITE, classify_sql, clean_sql, load, q, rounded, screened

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {classify_sql()} SELECT screening_status, primary_event_type, count(*) AS n FROM screened GROUP BY ALL")
def flagship_screening_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).groupBy("screening_status", "primary_event_type").agg(F.count(F.lit(1)).alias("n"))


_UNESCAPED = "replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@query(f"SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT page_id, {clean_sql(f'''regexp_replace({_UNESCAPED}, '<[^>]+>', ' ', 'g')''')} AS t FROM pages)")
def clean_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "pages").select("page_id", text.clean_text("html").alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@query(f"SELECT doc_id, sha256(lower({clean_sql('text')})) AS text_sha256, coalesce(length(text), 0) AS text_char_count FROM documents")
def normalized_hash_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.text_hash("text").alias("text_sha256"), text.text_length("text").cast("long").alias("text_char_count"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {clean_sql('text')} AS c FROM conversations),
n AS (SELECT conv_id, string_agg(c, ' ' ORDER BY turn) AS narrative FROM t WHERE turn > 0 GROUP BY conv_id),
s AS (SELECT conv_id, min(c) AS synopsis FROM t WHERE turn = 0 GROUP BY conv_id)
SELECT s.conv_id, synopsis, sha256(coalesce(narrative, '')) AS narrative_sha256, length(trim(synopsis || ' ' || coalesce(narrative, ''))) AS n_chars FROM s LEFT JOIN n ON s.conv_id = n.conv_id""")
def nested_record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested records: the first turn is the synopsis, pairs of later
    turns are persons with a narrative and notes."""
    turns = load(spark, sf_dir, "conversations")
    first = turns.filter("turn = 0").groupBy("conv_id").agg(F.min("text").alias("synopsis"))
    rest = turns.filter("turn > 0").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    person = lambda x: F.struct(x["text"].alias("9107"), F.lit("").alias("11330"))
    records = first.join(rest, "conv_id", "left").select("conv_id", "synopsis", F.transform("t", person).alias("people"))
    syn, narrative, every = text.record_text("synopsis", "people", entities=False)
    return records.select("conv_id", syn.alias("synopsis"), F.sha2(narrative, 256).alias("narrative_sha256"), F.length(every).cast("long").alias("n_chars"))


@query("""SELECT o_orderpriority, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS year, count(*) AS n FROM orders
WHERE CAST(substr(strftime(o_orderdate, '%Y-%m'), 1, 4) AS INTEGER) BETWEEN 1994 AND 1996 GROUP BY ALL""")
def year_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    kept = rows.filter(text.in_year_window("month", 1994, 1996))
    return kept.groupBy("o_orderpriority", text.year_from_value("month").alias("year")).agg(F.count(F.lit(1)).alias("n"))


_TERMS = ("thor", "tion", "und ", "que ")


@query(f"""SELECT doc_id, coalesce(trim(regexp_replace(substr(t, greatest(1, place - 45), 140), '{RE2_WHITE}', ' ', 'g')), '') AS snippet
FROM (SELECT doc_id, coalesce(text, '') AS t, list_min([{', '.join(f"nullif(strpos(lower(coalesce(text, '')), {q(t)}), 0)" for t in _TERMS)}]) AS place FROM documents)""")
def evidence_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.snippet("text", F.array(*[F.lit(t) for t in _TERMS])).alias("snippet"))


@query(f"SELECT doc_id, CASE WHEN length(v) <= 180 THEN v ELSE rtrim(substr(v, 1, 177)) || '...' END AS snippet FROM (SELECT doc_id, {clean_sql('text')} AS v FROM documents)")
def safe_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.safe_snippet("text").alias("snippet"))


@query(f"WITH {classify_sql()} SELECT doc_id, array_to_string(synopsis_hits, ';') AS synopsis_hits, array_to_string(hits, ';') AS hits FROM screened")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).select("doc_id", F.array_join("synopsis_hits", ";").alias("synopsis_hits"), F.array_join("hits", ";").alias("hits"))


@query(f"WITH {classify_sql()} SELECT hits[1] AS first_label, primary_event_type, count(*) AS n FROM screened GROUP BY ALL")
def priority_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.size("hits") > 0, F.element_at("hits", 1)).alias("first_label")
    return screened(spark, sf_dir).groupBy(first, "primary_event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {classify_sql()} SELECT exclusion_reason, screening_status, count(*) AS n FROM screened GROUP BY ALL")
def exclusion_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).groupBy("exclusion_reason", "screening_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {classify_sql()} SELECT primary_event_type, x.label AS secondary, count(*) AS n FROM screened, unnest(secondaries) AS x(label) GROUP BY ALL")
def secondary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The outer form: a plain explode would repeat the whole expression in an inferred filter.
    each = screened(spark, sf_dir).select("primary_event_type", F.explode_outer("secondaries").alias("secondary")).filter("secondary IS NOT NULL")
    return each.groupBy("primary_event_type", "secondary").agg(F.count(F.lit(1)).alias("n"))


_RESULT = ("screening_status", "primary_event_type", "secondary_event_types", "multi_event_flag", "ground_evidence", "cabin_evidence", "exclusion_reason")


@query(f"WITH {classify_sql()} SELECT doc_id, {', '.join(_RESULT)} FROM screened")
def classify_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).select("doc_id", *_RESULT)


_TOKENS = "' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g')) || ' '"
_W = "[\\p{L}\\p{N}_]*"


@query(f"""WITH t AS (SELECT doc_id, lang, {_TOKENS} AS w FROM documents)
SELECT lang, count(*) AS n FROM t WHERE (regexp_matches(w, ' the ') OR regexp_matches(w, ' und ') OR regexp_matches(w, ' of the '))
AND (regexp_matches(w, ' tion{_W} ') OR regexp_matches(w, ' ge{_W} ')) AND NOT regexp_matches(w, ' token ') GROUP BY lang""")
def boolean_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.filter(boolquery.matches('((the OR und OR "OF THE") AND (TION% OR ge%)) AND NOT token', "text")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH t AS (SELECT doc_id, string_split(trim({_TOKENS}), ' ') AS w FROM documents)
SELECT doc_id FROM t WHERE len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'that' AND list_contains(w[greatest(1, i - 3):i + 3], 'was'))) > 0""")
def near_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").filter(boolquery.matches("NEAR((that, was), 3)", "text")).select("doc_id")


#: Searches of the index, and what each is in SQL over t(doc_id, x, w), the tokens as text
#: and as a list. A run of two tokens ends one place after it begins.
_RUN = "list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')"
_SEARCHES = {
    "words": ('(the OR und OR "of the") AND (tion% OR ge%) AND NOT token', "regexp_matches(x, ' (the|und|of the) ') AND regexp_matches(x, ' (tion|ge)[\\p{L}\\p{N}_]* ') AND NOT contains(x, ' token ')"),
    "inner": ("%able AND NOT w%d", "regexp_matches(x, ' [\\p{L}\\p{N}_]*able ') AND NOT regexp_matches(x, ' w[\\p{L}\\p{N}_]*d ')"),
    "none": ("NOT (the OR der OR la OR que)", "NOT regexp_matches(x, ' (the|der|la|que) ')"),
    "near": ("NEAR((that, was), 3)", "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'that' AND list_contains(w[greatest(1, i - 3):i + 3], 'was'))) > 0"),
    "near_phrase": ('NEAR(("of the", that), 4)', f"len(list_filter({_RUN}, lambda i: list_contains(w[greatest(1, i - 4):i - 1], 'that') OR list_contains(w[i + 2:i + 5], 'that'))) > 0"),
}


@query("WITH t AS (SELECT doc_id, ' ' || trim(" + _TOKENS + ") || ' ' AS x, string_split(trim(" + _TOKENS + "), ' ') AS w FROM documents) " + " UNION ALL ".join(f"SELECT '{name}' AS search, doc_id FROM t WHERE {sql}" for name, (_, sql) in _SEARCHES.items()))
def boolean_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents indexed, and searched: words, patterns, phrases, NOT and NEAR."""
    index = postings.PositionalIndex(spark, Folder(spark, None).root).build(load(spark, sf_dir, "documents"), "doc_id", "text")
    out = None
    for name, (text_query, _) in _SEARCHES.items():
        found = index.search(text_query).select(F.lit(name).alias("search"), F.col("key").alias("doc_id"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {classify_sql()} SELECT coarse, count(*) AS n FROM (SELECT CASE primary_event_type {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in text.COARSE.items())} ELSE primary_event_type END AS coarse FROM screened) GROUP BY coarse")
def coarse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).groupBy(text.coarse_label("primary_event_type").alias("coarse")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {classify_sql()} SELECT doc_id, array_to_string(list_filter(list_prepend(primary_event_type, secondaries), lambda x: x NOT IN ('', 'not_relevant')), ';') AS labels FROM screened")
def event_label_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).select("doc_id", F.array_join(text.event_labels("primary_event_type", "secondary_event_types"), ";").alias("labels"))


_FAMILY = "CASE " + " ".join(f"WHEN {'starts_with' if k == 'start' else 'contains'}(m, {q(w)}) THEN {q(f)}" for k, w, f in text.FAMILY_RULES) + " ELSE m END"
_MODEL = "CASE p_partkey % 6 WHEN 0 THEN 'majority' WHEN 1 THEN 'tfidf_word12_logreg_balanced' WHEN 2 THEN 'sbert_logreg' WHEN 3 THEN 'tfidf_char36_linear_svc' WHEN 4 THEN 'supervised_minilm_x' ELSE p_type END"


@query(f"SELECT family, count(*) AS n FROM (SELECT {_FAMILY} AS family FROM (SELECT {_MODEL} AS m FROM part)) GROUP BY family")
def model_family_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.expr(_MODEL).alias("m")).groupBy(text.model_family("m").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, count(*) * 120 AS tokens_out, round(sum(tokens_in * p_in + 120 * p_out) / 1e6, 6) AS cost_usd FROM (
SELECT role AS model, greatest(1, CAST(round_even(length(coalesce(text, '')) / 4, 0) AS INTEGER)) AS tokens_in, CASE role WHEN 'user' THEN 0.38 ELSE 0.30 END AS p_in, CASE role WHEN 'user' THEN 0.40 ELSE 0.30 END AS p_out FROM conversations) GROUP BY model""")
def token_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("role", text.approx_tokens("text").alias("t"))
    price = structured.model_price(F.concat("role", F.lit(":cheapest")), {"user": (0.38, 0.40)})
    out = rows.groupBy(F.col("role").alias("model")).agg(F.sum("t").cast("long").alias("tokens_in"), (F.count(F.lit(1)) * structured.ASSUMED_REPLY).alias("tokens_out"), F.sum(structured.token_cost("t", F.lit(structured.ASSUMED_REPLY), *price)).alias("cost_usd"))
    return rounded(out, "cost_usd")


#: A text as a JSON string in ASCII: code by code, beyond 16 bits as two.
_ASCII = """array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda c: CASE
  WHEN c IN ('"', chr(92)) THEN chr(92) || c WHEN c = chr(10) THEN chr(92) || 'n' WHEN c = chr(13) THEN chr(92) || 'r' WHEN c = chr(9) THEN chr(92) || 't'
  WHEN c = chr(8) THEN chr(92) || 'b' WHEN c = chr(12) THEN chr(92) || 'f' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
  WHEN unicode(c) < 65536 THEN chr(92) || 'u' || printf('%04x', unicode(c))
  ELSE chr(92) || 'u' || printf('%04x', 55296 + ((unicode(c) - 65536) >> 10)) || chr(92) || 'u' || printf('%04x', 56320 + ((unicode(c) - 65536) & 1023)) END), '')"""
_HEAD = json.dumps({"task": structured.TASK, "allowed_screening_status": list(structured.STATUS_LABELS), "allowed_event_types": list(structured.EVENT_LABELS), "output_schema": structured.SHAPE, "rules": list(structured.RULES)})[:-1]


@query(f"""SELECT doc_id, {q(structured.SYSTEM)} AS system, md5({q(_HEAD + ', "asrs_report": "')} || {_ASCII} || '"}}') AS user_md5, length({_ASCII}) AS coded_chars FROM documents""")
def structured_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two messages that a scorer gets for every document; the long one as its hash."""
    p = load(spark, sf_dir, "documents").select("doc_id", structured.prompt("text").alias("p"))
    size = F.length(F.col("p")[1]["content"]) - len(_HEAD) - len(', "asrs_report": ""}')
    return p.select("doc_id", F.col("p")[0]["content"].alias("system"), F.md5(F.col("p")[1]["content"].cast("binary")).alias("user_md5"), size.cast("long").alias("coded_chars"))


#: Replies made from events: whole, fenced, cut off, with text around, of a wrong shape.
_REPLY = """CASE event_id % 7
 WHEN 0 THEN '{"screening_status": "include_ground_cabin_event", "primary_event_type": "fueling", "secondary_event_types": ["cabin_service", "cabin_service", "x"], "possible_multi_event": true, "confidence": "High"}'
 WHEN 1 THEN '```json' || chr(10) || '{"screening_status": "exclude_not_ground_or_cabin", "primary_event_type": "not_relevant", "possible_multi_event": false, "confidence": "low"}' || chr(10) || '```'
 WHEN 2 THEN 'Sure: {"screening_status": " uncertain_needs_review ", "primary_event_type": "fueling", "secondary_event_types": [], "confidence": "medium"} done'
 WHEN 3 THEN '{"screening_status": "include_ground_cabin_event", "primary'
 WHEN 4 THEN '[1, 2]'
 WHEN 5 THEN '{"screening_status": 3, "primary_event_type": "gate_or_boarding", "possible_multi_event": "yes", "confidence": "certain"}'
 ELSE props END"""
_EXPECTED = """CASE event_id % 7
 WHEN 0 THEN 'true|false|include_ground_cabin_event|fueling|cabin_service|true|high'
 WHEN 1 THEN 'true|true|exclude_not_ground_or_cabin|not_relevant||false|low'
 WHEN 2 THEN 'true|true|uncertain_needs_review|fueling||false|medium'
 WHEN 3 THEN 'false|false|uncertain_needs_review|not_relevant||false|low'
 WHEN 4 THEN 'false|false|uncertain_needs_review|not_relevant||false|low'
 WHEN 5 THEN 'true|false|uncertain_needs_review|gate_or_boarding||false|low'
 ELSE CASE WHEN json_valid(props) THEN 'true' ELSE 'false' END || '|false|uncertain_needs_review|not_relevant||false|low' END"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.expr(_REPLY.replace("chr(10)", "chr(10)"))
    rows = load(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return rows.select("event_id", structured.validated(structured.extract_object("reply")).alias("v")).select("event_id", "v.*")


@query(f"SELECT event_id, {_EXPECTED} AS result FROM events")
def llm_json_extract_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _validated(spark, sf_dir)
    return v.select("event_id", F.concat_ws("|", *[F.col(c).cast("string") for c in v.columns if c != "event_id"]).alias("result"))


@query(f"""WITH v AS (SELECT string_split({_EXPECTED}, '|') AS r FROM events)
SELECT count(*) AS completed_rows, count(*) FILTER (r[1] = 'true') AS valid_json_rows, count(*) FILTER (r[2] = 'true') AS schema_valid_rows, round(count(*) * 0.0001, 6) AS cost_usd FROM v""")
def llm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.metrics import scorer_summary

    return rounded(scorer_summary(_validated(spark, sf_dir).withColumn("cost_usd", F.lit(0.0001))), "cost_usd")
