"""Queries on building, splitting and auditing a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import audit, corpus, counts, splits
from corvane.operators.folder import Folder
from corvane.plans.common import REPORTS_SQL, classify_sql, clean_sql, load, md5_order, reports, screened
from corvane.sources import files

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'labelled' END AS state FROM documents d LEFT JOIN (SELECT * FROM labels) l ON d.doc_id = l.doc_id")
def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality").withColumn("state", F.lit("labelled"))
    return corpus.left_with_defaults(load(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id", {"quality": -1, "state": "missing"})


@query("SELECT d.doc_id, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def inner_join_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.strict_inner(load(spark, sf_dir, "labels").select("doc_id", "toxic"), load(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


_HASHED = f"SELECT *, sha256(lower({clean_sql('text')})) AS h FROM documents"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.functions.text import text_hash

    return load(spark, sf_dir, "documents").withColumn("h", text_hash("text"))


@query(f"SELECT h, min(doc_id) AS doc_id, array_to_string(list_sort(list_distinct(list(source))), ';') AS sources FROM ({_HASHED}) GROUP BY h")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir).select("h", "doc_id", "source")
    return corpus.first_wins(rows, "h", ["doc_id"], {"sources": "source"}).select("h", "doc_id", "sources")


@query(f"SELECT h, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM ({_HASHED}) GROUP BY h")
def last_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.last_wins(_hashed(spark, sf_dir).select("h", "doc_id", "source"), "h", ["doc_id"])


@query(f"WITH {classify_sql()} SELECT screening_status, multi_event_flag, count(*) AS n FROM screened GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.frequency(screened(spark, sf_dir), "screening_status", "multi_event_flag")


@query("SELECT part, count(*) AS n FROM (SELECT unnest(string_split(p_name || ';' || p_brand || ';' || p_type, ';')) AS part FROM part) GROUP BY part")
def source_coverage_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.concat_ws(";", "p_name", "p_brand", "p_type").alias("sources"))
    return counts.multi_frequency(rows, "sources", name="part")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def split_by_label_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pivoted(load(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(f"SELECT h, count(*) AS n FROM ({_HASHED}) GROUP BY h HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.duplicates(_hashed(spark, sf_dir), "h")


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT o_orderkey) AS orders FROM orders")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"), F.count_distinct("o_orderkey").alias("orders"))


_NORM = lambda c: f"lower({clean_sql(c)})"


@query(f"""WITH {classify_sql()}, b AS (SELECT item_id, text AS passage FROM benchmark),
j AS (SELECT s.*, l.doc_id IS NOT NULL AS in_raw, b.item_id IS NOT NULL AS in_manifest, coalesce(b.passage, '') AS passage,
  CASE WHEN s.doc_id % 50 = 7 THEN 'fueling' ELSE s.primary_event_type END AS stored,
  CASE WHEN s.doc_id % 40 = 3 THEN '' ELSE s.source END AS src, CAST(2008 + s.doc_id % 20 AS VARCHAR) || '-05' AS date, 'k' || CAST(s.doc_id // 2 AS VARCHAR) AS key
  FROM screened s LEFT JOIN labels l ON s.doc_id = l.doc_id LEFT JOIN b ON b.item_id = s.doc_id % 60),
f AS (SELECT *, NOT in_raw AS missing_raw, NOT in_manifest AS missing_manifest, stored IS DISTINCT FROM primary_event_type AS rule_mismatches,
  trim(coalesce(src, '')) = '' OR trim(coalesce(lang, '')) = '' AS blank_required,
  screening_status = 'include_ground_cabin_event' AND stored = 'not_relevant' AS include_not_relevant,
  screening_status = 'exclude_not_ground_or_cabin' AND stored <> 'not_relevant' AS exclude_relevant,
  screening_status = 'include_ground_cabin_event' AND trim(ground_evidence) = '' AND trim(passage) = '' AS include_without_evidence,
  (length({_NORM('ground_evidence')}) >= 30 AND NOT contains({_NORM('all_text')}, {_NORM('ground_evidence')})) OR (length({_NORM('passage')}) >= 30 AND NOT contains({_NORM('all_text')}, {_NORM('passage')})) AS evidence_not_in_source,
  NOT (CAST(substr(date, 1, 4) AS INTEGER) BETWEEN 2011 AND 2025) AS date_outside_window FROM j),
a AS (SELECT count(*) AS "rows", {', '.join(f'CAST(sum(CAST({c} AS BIGINT)) AS BIGINT) AS {c}' for c in audit.CHECKS)},
  (SELECT count(*) FROM (SELECT doc_id FROM f GROUP BY doc_id HAVING count(*) > 1)) AS duplicate_ids,
  (SELECT count(*) FROM (SELECT key FROM f GROUP BY key HAVING count(*) > 1)) AS duplicate_keys FROM f)
SELECT *, {' + '.join(audit.BLOCKING)} AS blocking_errors, CASE WHEN {' + '.join(audit.BLOCKING)} = 0 THEN 'PASS_WITH_CAVEATS' ELSE 'FAIL' END AS verdict FROM a""")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screened documents with planted faults, so that every check finds something."""
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("__i"), F.col("text").alias("passage"))
    rows = screened(spark, sf_dir).join(load(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("in_raw")), "doc_id", "left")
    rows = rows.join(b, F.col("doc_id") % 60 == F.col("__i"), "left").withColumns({
        "in_raw": F.coalesce("in_raw", F.lit(False)), "in_manifest": F.col("__i").isNotNull(), "passage": F.coalesce("passage", F.lit("")),
        "stored": F.when(F.col("doc_id") % 50 == 7, "fueling").otherwise(F.col("primary_event_type")), "src": F.when(F.col("doc_id") % 40 == 3, "").otherwise(F.col("source")),
        "date": F.concat((2008 + F.col("doc_id") % 20).cast("string"), F.lit("-05")), "key": F.concat(F.lit("k"), F.floor(F.col("doc_id") / 2).cast("string")),
    })
    at = audit.Layout(id="doc_id", primary="stored", evidence=("ground_evidence", "passage"), required=("src", "lang"), rules={"stored": "primary_event_type"})
    keys = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("k"), F.floor(F.col("doc_id") / 2).cast("string")).alias("key"))
    return audit.roll_up(rows, at, keys)


@query("SELECT doc_id, 'CAND_' || lpad(CAST(row_number() OVER (ORDER BY doc_id DESC) AS VARCHAR), 6, '0') AS candidate_id FROM documents")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ranked_ids(load(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id").desc()], "CAND_", 6, "candidate_id")


_POOL = f"SELECT doc_id, source || ';' || lang AS gs, {md5_order('doc_id', 20260603)} AS h FROM documents"
_QUOTAS = (("src1", 20), ("fr", 60), ("en", 100))
_SIZE = 200


@query(f"""WITH pool AS MATERIALIZED ({_POOL}),
t1 AS MATERIALIZED (SELECT doc_id, h FROM pool WHERE list_contains(string_split(gs, ';'), 'src1') ORDER BY h LIMIT 20),
t2 AS MATERIALIZED (SELECT doc_id, h FROM pool WHERE list_contains(string_split(gs, ';'), 'fr') AND doc_id NOT IN (SELECT doc_id FROM t1) ORDER BY h LIMIT 60),
t3 AS MATERIALIZED (SELECT doc_id, h FROM pool WHERE list_contains(string_split(gs, ';'), 'en') AND doc_id NOT IN (SELECT doc_id FROM t1) AND doc_id NOT IN (SELECT doc_id FROM t2) ORDER BY h LIMIT 100),
got AS MATERIALIZED (SELECT doc_id, 'src1' AS stage, h FROM t1 UNION ALL SELECT doc_id, 'fr', h FROM t2 UNION ALL SELECT doc_id, 'en', h FROM t3),
rest AS (SELECT doc_id, 'top_up' AS stage, h FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM got) ORDER BY h LIMIT 200),
every AS (SELECT *, row_number() OVER (ORDER BY CASE stage WHEN 'top_up' THEN 1 ELSE 0 END, h) AS r FROM (SELECT * FROM got UNION ALL SELECT * FROM rest))
SELECT doc_id, stage FROM every WHERE r <= 200""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = load(spark, sf_dir, "documents").select("doc_id", F.concat_ws(";", "source", "lang").alias("gs"))
    return corpus.quota_sample(pool, "doc_id", "gs", list(_QUOTAS), _SIZE, 20260603).select("doc_id", "stage")


@query(f"""WITH {REPORTS_SQL}, r AS (SELECT doc_id, row_number() OVER (ORDER BY length(trim(all_text)), length(trim(synopsis)), length(trim(narrative)), doc_id) AS r FROM reports)
SELECT doc_id FROM r WHERE r > 1""")
def bottom1_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.drop_least_informative(reports(spark, sf_dir), ["doc_id"], "synopsis", "narrative", "all_text").select("doc_id")


@query(f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n_c, count(*) OVER () AS n, row_number() OVER (PARTITION BY lang ORDER BY {md5_order('doc_id', 42)}, doc_id) AS r FROM documents),
k AS (SELECT *, row_number() OVER (ORDER BY {md5_order('doc_id', 43)}, doc_id) AS o FROM c WHERE r <= greatest(1, round_even(100 * n_c / n, 0))) SELECT doc_id, lang FROM k WHERE o <= 100""")
def annotation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.annotation_sample(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 100, 42)


_SPLIT = f"""SELECT doc_id, lang, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'dev' ELSE 'test' END AS split FROM (
SELECT doc_id, lang, CAST(count(*) OVER (PARTITION BY lang) AS DOUBLE) AS n, row_number() OVER (PARTITION BY lang ORDER BY {md5_order('doc_id', 5)}, doc_id) AS r FROM documents)"""


@query(_SPLIT)
def stratified_group_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_split(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 5)


@query(f"WITH s AS ({_SPLIT}) SELECT d.doc_id, coalesce(s.split, 'train') AS split FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id AND d.doc_id % 3 = 0")
def expanded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    seeds = splits.hash_split(docs, "doc_id", "lang", 5).filter("doc_id % 3 = 0")
    return splits.extend_split(docs.select("doc_id"), seeds, "doc_id")


@query(f"WITH s AS ({_SPLIT}), h AS ({_HASHED}) SELECT h, count(DISTINCT split) AS splits FROM s JOIN h ON s.doc_id = h.doc_id GROUP BY h HAVING count(DISTINCT split) > 1")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.hash_split(_hashed(spark, sf_dir).select("doc_id", "lang", "h"), "doc_id", "lang", 5)
    return splits.leaks(rows, "h")


#: Groups of one size go to the largest of what the splits lack, in steps of the size.
_DEAL = "list_sort(list_concat(" + ", ".join(f"list_transform(range(k), lambda j: {{'v': j * k.n - d[{i}], 'o': {i}}})" for i in (1, 2, 3)) + "))[1:k]"
_GOT = "[" + ", ".join(f"len(list_filter({_DEAL}, lambda e: e.o = {i}))" for i in (1, 2, 3)) + "]"


@query(f"""WITH RECURSIVE x AS ({_HASHED}), g AS (SELECT h, min(lang) AS s, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY h),
k AS MATERIALIZED (SELECT s, n, CAST(count(*) AS BIGINT) AS k, row_number() OVER (PARTITION BY s ORDER BY n DESC) AS step FROM g GROUP BY s, n),
goal AS (SELECT s, t, CAST(round_even(t * 0.7, 0) AS BIGINT) AS a, CAST(round_even(t * 0.15, 0) AS BIGINT) AS b FROM (SELECT s, CAST(sum(n) AS BIGINT) AS t FROM g GROUP BY s)),
walk AS (SELECT s, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS n, [a, b, t - a - b] AS d, [CAST(0 AS BIGINT), 0, 0] AS c FROM goal
  UNION ALL SELECT w.s, k.step, k.n, list_transform([1, 2, 3], lambda i: d[i] - c2[i] * k.n), c2 FROM (SELECT w.s, w.step, w.d, k.step AS next, k.n, {_GOT} AS c2 FROM walk w JOIN k ON w.s IS NOT DISTINCT FROM k.s AND k.step = w.step + 1) AS w JOIN k ON w.s IS NOT DISTINCT FROM k.s AND k.step = w.next),
r AS (SELECT h, s, n, row_number() OVER (PARTITION BY s, n ORDER BY {md5_order('h', 5)}, h) AS r FROM g)
SELECT doc_id, lang, x.h, CASE WHEN r <= c[1] THEN 'train' WHEN r <= c[1] + c[2] THEN 'dev' ELSE 'test' END AS split FROM x JOIN r ON x.h = r.h JOIN walk ON r.s IS NOT DISTINCT FROM walk.s AND r.n = walk.n AND walk.step > 0""")
def stratified_group_split_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.group_split(_hashed(spark, sf_dir).select("doc_id", "lang", "h"), "h", "lang", 5)
    return rows.select("doc_id", "lang", "h", "split")


@query("SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT DISTINCT c_nationkey, 'only_customer' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) UNION ALL (SELECT k, 'any' FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier))")
def set_ops_union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    name = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return name(c.intersect(s), "both").unionByName(name(c.subtract(s), "only_customer")).unionByName(name(c.union(s).distinct(), "any"))


@query("SELECT CAST((r - 1) // 300 AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) GROUP BY ALL")
def batched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = corpus.batched(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 300)
    return b.select("batch", F.size("keys").cast("long").alias("n"), F.element_at("keys", 1).alias("first"), F.element_at("keys", -1).alias("last"))


@query(f"""WITH t AS (SELECT conv_id, arg_min(text, turn) AS synopsis, max(CASE WHEN turn > 0 AND coalesce(text, '') <> '' THEN 1 ELSE 0 END) AS np FROM conversations GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (ORDER BY conv_id DESC) AS r FROM t)
SELECT 'CAND_' || lpad(CAST(r AS VARCHAR), 6, '0') AS candidate_id, CAST(conv_id AS VARCHAR) AS acn, CASE np WHEN 1 THEN 'true' ELSE 'false' END AS narrative_present, CASE WHEN coalesce(synopsis, '') <> '' THEN 'true' ELSE 'false' END AS analyst_synopsis_present, 'not_extracted' AS location, 'f.json' AS raw_export_file FROM r""")
def candidate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    person = F.when(F.col("turn") > 0, F.struct(F.col("text").alias("9107"), F.lit("").alias("11330")))
    records = turns.groupBy(F.col("conv_id").cast("string").alias("acn")).agg(F.min_by("text", "turn").alias("synopsis"), F.collect_list(person).alias("people"))
    records = records.withColumns({"query_ids": F.lit("Q01"), "files": F.lit("f.json"), "date": F.lit("2020-01")})
    return corpus.candidate_rows(records).select("candidate_id", "acn", "narrative_present", "analyst_synopsis_present", "location", "raw_export_file")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'verified' ELSE 'old note. verified' END AS notes, 'author_verified_single_reviewer' AS author_verification_status, '2026-06-04' AS author_verification_date FROM documents")
def provenance_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 1, F.lit(" old note. ")).alias("notes"))
    return corpus.with_provenance(rows, "author_verified_single_reviewer", "2026-06-04", "review", "record", "verified").select("doc_id", "notes", "author_verification_status", "author_verification_date")


@query("SELECT e.event_id FROM events e WHERE e.event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.streaming.resume import pending

    rows = load(spark, sf_dir, "events").select("event_id")
    done = rows.filter("event_id % 3 = 0").withColumn("error_type", F.when(F.col("event_id") % 2 == 1, "timeout").otherwise(""))
    return pending(rows, done, "event_id", retry_failed=True)


@query("""WITH seeds AS (SELECT doc_id, 'REC_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR), 5, '0') AS corpus_id FROM documents WHERE doc_id % 2 = 0),
rest AS (SELECT doc_id, 'REC_' || lpad(CAST((SELECT count(*) FROM seeds) + row_number() OVER (ORDER BY doc_id DESC) AS VARCHAR), 5, '0') AS corpus_id FROM documents WHERE doc_id % 2 <> 0)
SELECT doc_id, corpus_id, 'seed' AS expanded_corpus_role FROM seeds UNION ALL SELECT doc_id, corpus_id, 'added' FROM rest""")
def expanded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id")
    seeds = corpus.ranked_ids(docs.filter("doc_id % 2 = 0"), [F.col("doc_id")], "REC_", 5, "corpus_id")
    return corpus.expand_ids(docs, seeds, "doc_id", "REC_", seeds.count() + 1, [F.col("doc_id").desc()])


#: What a CSV file keeps of a document: texts as they are, nulls and empty texts alike.
_KEPT = "CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars, md5(coalesce(text, '')) AS text_md5"
_COLUMNS = ["doc_id", "lang", "source", "n_chars", "text"]


def _read_back(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"SELECT {_KEPT} FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as CSV, over what stood there, and read back."""
    path = f"{Folder(spark, None).root}/csv"
    docs = load(spark, sf_dir, "documents").select(*_COLUMNS)
    files.write_csv(docs.limit(1), path, _COLUMNS)
    files.write_csv(docs, path, _COLUMNS)
    return _read_back(files.read_csv(spark, path, _COLUMNS))


@query(f"SELECT *, '' AS note FROM (SELECT {_KEPT} FROM documents)")
def csv_append_and_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended language by language, read with a path that is not there and a
    column that the files lack."""
    root = Folder(spark, None).root
    docs = load(spark, sf_dir, "documents").select(*_COLUMNS)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part in (english, ~english):
        files.append_csv(docs.filter(part), f"{root}/csv", _COLUMNS)
    found = files.read_csv_if_any(spark, [f"{root}/none", f"{root}/csv"], [*_COLUMNS, "note"])
    return found.select(*_COLUMNS[:-1], F.md5(F.col("text").cast("binary")).alias("text_md5"), "note")


@query("""SELECT doc_id, array_to_string(list_filter(string_split(coalesce(source, '') || ';;' || coalesce(lang, ''), ';'), lambda x: x <> ''), '|') AS labels,
printf('%.3f [%.3f, %.3f]', CAST(n_chars AS DOUBLE) / 7, CAST(n_chars AS DOUBLE) / 8, CAST(n_chars AS DOUBLE) / 5) AS ci FROM documents WHERE n_chars IS NOT NULL""")
def label_sets_and_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts between semicolons as labels, and a value with its interval as text."""
    docs = load(spark, sf_dir, "documents").filter("n_chars IS NOT NULL")
    joined = F.concat(F.coalesce("source", F.lit("")), F.lit(";;"), F.coalesce("lang", F.lit("")))
    n = F.col("n_chars").cast("double")
    return docs.select("doc_id", F.array_join(text.label_set(joined), "|").alias("labels"), text.format_ci(n / 7, n / 8, n / 5).alias("ci"))


@query("SELECT l.doc_id, md5(coalesce(d.text, '')) AS text_md5, l.quality AS gold FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def texts_and_labels_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labelled row with its record's text; a row without a record would be an error."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = corpus.strict_inner(load(spark, sf_dir, "labels").select("doc_id", "quality"), docs, "doc_id")
    return rows.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), F.col("quality").alias("gold"))
