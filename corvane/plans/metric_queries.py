"""Queries on metrics, agreement, resampling, features and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import corpus, counts, features, metrics, models, resample
from corvane.operators.columns import ROW
from corvane.operators.folder import Folder
from corvane.operators.vocabulary import Vocabulary
from corvane.plans.common import any_term, classify_sql, load, rounded, screened

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Quality labels against a rule on length; gold is a, pred b.
_PAIR = "SELECT d.doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS a, CASE WHEN n_chars > 1500 THEN 'good' WHEN n_chars > 400 THEN 'bad' ELSE 'short' END AS b, CAST(d.doc_id % 3 AS INTEGER) AS seed FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
#: Return flags against a rule on price, by line number.
_FLAGS = "SELECT l_linenumber AS m, l_returnflag AS a, CASE WHEN l_extendedprice > 50000 THEN 'R' WHEN l_quantity > 20 THEN 'N' ELSE 'A' END AS b FROM lineitem"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    b = F.when(F.col("n_chars") > 1500, "good").when(F.col("n_chars") > 400, "bad").otherwise("short")
    return docs.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("a"), b.alias("b"), (F.col("doc_id") % 3).cast("int").alias("seed"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("l_extendedprice") > 50000, "R").when(F.col("l_quantity") > 20, "N").otherwise("A")
    return load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("m"), F.col("l_returnflag").alias("a"), b.alias("b"))


def _label_sql(rows: str, by: str = "") -> str:
    """Per-label counts of rows(a, b [, by]) with n copies each."""
    k, j = (f"{by}, ", f"x.{by} = y.{by} AND ") if by else ("", "")
    return f"""u AS (SELECT {k}label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS tp FROM (
    SELECT {k}a AS label, 1 AS s, 0 AS p, CASE WHEN a = b THEN 1 ELSE 0 END AS t FROM {rows} UNION ALL SELECT {k}b, 0, 1, 0 FROM {rows}) GROUP BY {k}label),
  f AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted) END AS f1 FROM u)"""


_SINGLE = "CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(tp) / sum(support), 6) AS micro_f1"
_SCORES = ("accuracy", "macro_f1", "weighted_f1", "micro_f1")


@query(f"WITH r AS ({_FLAGS}), {_label_sql('r', 'm')} SELECT m, {_SINGLE} FROM f GROUP BY m")
def single_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.single_label(metrics.confusion(_flags(spark, sf_dir), "a", "b", ["m"]), ["m"]), *_SCORES)


@query(f"WITH r AS ({_FLAGS}) SELECT a AS gold, count(*) FILTER (b = 'A') AS A, count(*) FILTER (b = 'N') AS N, count(*) FILTER (b = 'R') AS R FROM r GROUP BY a")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_flags(spark, sf_dir), "a", "b", ["A", "N", "R"])


@query(f"""WITH r AS ({_PAIR}), {_label_sql('r')}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_report(_pairs(spark, sf_dir), "a", "b"), "precision", "recall", "f1")


_TAGS = {"x": ("thor", "que "), "y": ("tion", "und "), "z": ("ing", "die "), "w": ("token", "eaea")}
_OTHER = {"x": ("thor", "los "), "y": ("tion", "der "), "z": ("ing ",), "w": ("token",)}


def _tag_sql(tags: dict) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {any_term('lower(coalesce(text, chr(32)))', t)} THEN '{k}' END" for k, t in tags.items()) + "], lambda v: v IS NOT NULL)"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.functions.text import contains_any

    low = F.lower(F.coalesce("text", F.lit(" "))).alias("low")  # once a text
    tags = lambda t: F.filter(F.array(*[F.when(contains_any(F.col("low"), v), F.lit(k)) for k, v in t.items()]), lambda x: x.isNotNull())
    return load(spark, sf_dir, "documents").select("doc_id", low).select("doc_id", tags(_TAGS).alias("gold"), tags(_OTHER).alias("pred"))


_TAGGED = f"g AS MATERIALIZED (SELECT doc_id, {_tag_sql(_TAGS)} AS gold, {_tag_sql(_OTHER)} AS pred FROM documents)"
_STAT = "SELECT *, len(list_intersect(gold, pred)) AS h, len(gold) AS ng, len(pred) AS np FROM "
_MULTI = "avg(CASE WHEN h = ng AND h = np THEN 1.0 ELSE 0.0 END) AS subset_accuracy, avg(CASE WHEN ng + np = 0 THEN 0 ELSE 2 * h / (ng + np) END) AS samples_f1, avg(CASE WHEN ng + np - h = 0 THEN 0 ELSE h / (ng + np - h) END) AS samples_jaccard, 2 * sum(h) / sum(ng + np) AS micro_f1"


def _multi_label_sql(rows: str, by: str = "") -> str:
    k = f"{by}, " if by else ""
    return f"""SELECT {k}label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS tp FROM (
    SELECT {k}unnest(gold) AS label, 1 AS s, 0 AS p, 0 AS t FROM {rows} UNION ALL SELECT {k}unnest(pred), 0, 1, 0 FROM {rows} UNION ALL SELECT {k}unnest(list_intersect(gold, pred)), 0, 0, 1 FROM {rows}) GROUP BY {k}label"""


@query(f"""WITH {_TAGGED}, s AS ({_STAT} g), l AS ({_multi_label_sql('g')}),
m AS (SELECT count(*) AS label_count, avg(2 * tp / (support + predicted)) AS macro_f1 FROM l), t AS (SELECT count(*) AS n, {_MULTI}, sum(ng + np - 2 * h) AS wrong FROM s)
SELECT n, label_count, round(subset_accuracy, 6) AS subset_accuracy, round(micro_f1, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1, round(samples_f1, 6) AS samples_f1, round(samples_jaccard, 6) AS samples_jaccard, round(wrong / (n * label_count), 6) AS hamming_loss FROM t, m""")
def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.multi_label(_tagged(spark, sf_dir), "gold", "pred"), "subset_accuracy", "micro_f1", "macro_f1", "samples_f1", "samples_jaccard", "hamming_loss")


@query(f"WITH {_TAGGED}, l AS ({_multi_label_sql('g')}) SELECT label, support, predicted, round(CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END, 6) AS precision, round(CASE WHEN support = 0 THEN 0 ELSE tp / support END, 6) AS recall, round(2 * tp / (support + predicted), 6) AS f1 FROM l")
def per_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.per_label_multi(_tagged(spark, sf_dir), "gold", "pred").drop("tp"), "precision", "recall", "f1")


def _kappa_sql(rows: str) -> str:
    return f"""WITH r AS ({rows}), t AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM r),
x AS (SELECT a, count(*) AS c FROM r GROUP BY a), y AS (SELECT b, count(*) AS c FROM r GROUP BY b), e AS (SELECT sum(x.c * y.c) AS e FROM x JOIN y ON x.a = y.b)
SELECT n, round(po, 6) AS agreement, round((po - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM t, e"""


@query(_kappa_sql(_PAIR))
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cohen_kappa(_pairs(spark, sf_dir), "a", "b"), "agreement", "kappa")


@query(_kappa_sql(f"SELECT * FROM ({_PAIR}) WHERE a = 'good' OR b <> 'short'"))
def conditional_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cohen_kappa(_pairs(spark, sf_dir).filter("a = 'good' OR b <> 'short'"), "a", "b"), "agreement", "kappa")


@query(f"""WITH r AS ({_PAIR}), {_label_sql('r', 'seed')}, s AS (SELECT seed, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM f GROUP BY seed)
SELECT 'quality' AS task, count(*) AS seeds, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_pop(macro_f1), 6) AS macro_f1_std FROM s""")
def seed_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.single_label(metrics.confusion(_pairs(spark, sf_dir), "a", "b", ["seed"]), ["seed"]).withColumn("task", F.lit("quality"))
    return rounded(metrics.seed_summary(scores, ["task"], ["accuracy", "macro_f1"]), "accuracy_mean", "accuracy_std", "macro_f1_mean", "macro_f1_std")


_REPS = 100
_DRAW = "o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS at_ FROM r), n AS (SELECT count(*) AS n FROM o), d AS (SELECT rep, ('0x' || substr(md5('17-' || CAST(rep AS VARCHAR) || '-' || CAST(i AS VARCHAR)), 1, 8))::BIGINT % n AS at_ FROM n, range(0, {reps}) AS a(rep), range(0, n) AS b(i)), x AS MATERIALIZED (SELECT d.rep, o.* FROM d JOIN o ON d.at_ = o.at_)".replace("{reps}", str(_REPS))
_CI = lambda cols: ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {c}_{n}" for c in cols for n, p in (("low", 0.025), ("high", 0.975)))


@query(f"WITH r AS ({_PAIR}), {_DRAW.replace('range(0, n) AS b(i)', '(SELECT unnest(range(0, (SELECT n FROM n))) AS i) AS b')}, {_label_sql('x', 'rep')}, s AS (SELECT rep, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM f GROUP BY rep) SELECT {_CI(('accuracy', 'macro_f1', 'weighted_f1'))} FROM s")
def bootstrap_ci_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.bootstrap_single(_pairs(spark, sf_dir), "a", "b", "doc_id", _REPS)
    return rounded(out, *out.columns)


@query()
def bootstrap_ci_single_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's 1,000 replicates, drawn as counts; too slow for the SQL's form."""
    drawn = resample.resample_counts(metrics.confusion(_pairs(spark, sf_dir), "a", "b"), 1000)
    out = resample.interval(metrics.single_label(drawn, ["rep"]), ["accuracy", "macro_f1", "weighted_f1"])
    return rounded(out, *out.columns)


@query()
def bootstrap_ci_multilabel_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's 1,000 replicates, as Poisson weights of cells in one pass."""
    out = resample.poisson_multi(_tagged(spark, sf_dir), "gold", "pred", 1000)
    return rounded(out, *out.columns)


@query()
def bootstrap_ci_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each language's documents, 1,000 replicates of every group in one pass."""
    rows = _tagged(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    out = resample.poisson_multi(rows, "gold", "pred", 1000, by=["lang"])
    return rounded(out, *[c for c in out.columns if c != "lang"])


_SIX = ("subset_accuracy", "micro_f1", "macro_f1", "samples_f1", "samples_jaccard", "hamming_loss")


@query(f"""WITH {_TAGGED}, r AS (SELECT * FROM g), {_DRAW.replace('range(0, n) AS b(i)', '(SELECT unnest(range(0, (SELECT n FROM n))) AS i) AS b')}, space AS (SELECT count(DISTINCT l) AS k FROM (SELECT unnest(list_concat(gold, pred)) AS l FROM g)),
s AS ({_STAT} x), l AS ({_multi_label_sql('x', 'rep')}), m AS (SELECT rep, sum(2 * tp / (support + predicted)) AS fs FROM l GROUP BY rep),
t AS (SELECT rep, count(*) AS n, {_MULTI}, sum(ng + np - 2 * h) AS wrong FROM s GROUP BY rep),
v AS (SELECT t.*, coalesce(fs, 0) / k AS macro_f1, wrong / (n * k) AS hamming_loss FROM t LEFT JOIN m ON t.rep = m.rep, space) SELECT {_CI(_SIX)} FROM v""")
def bootstrap_ci_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.bootstrap_multi(_tagged(spark, sf_dir), "gold", "pred", "doc_id", _REPS)
    return rounded(out, *out.columns)


@query(f"WITH r AS ({_FLAGS}), {_label_sql('r', 'm')}, s AS (SELECT m, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM f GROUP BY m), k AS (SELECT *, row_number() OVER (PARTITION BY m % 2 ORDER BY macro_f1 DESC, m) AS r FROM s) SELECT m % 2 AS task, m, round(macro_f1, 6) AS macro_f1 FROM k WHERE r = 1")
def best_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.single_label(metrics.confusion(_flags(spark, sf_dir), "a", "b", ["m"]), ["m"]).withColumn("task", F.col("m") % 2)
    return rounded(corpus.best_per_group(scores, "task", "macro_f1", ["m"]).select("task", "m", "macro_f1"), "macro_f1")


@query(f"SELECT m, a, b, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY n DESC, a, b) AS r FROM (SELECT m, a, b, count(*) AS n FROM ({_FLAGS}) WHERE a IS DISTINCT FROM b GROUP BY ALL)) WHERE r <= 3")
def topk_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.top_errors(_flags(spark, sf_dir), "a", "b", "m", 3)


@query(f"WITH r AS ({_FLAGS}), {_label_sql('r', 'm')}, s AS (SELECT m, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY m) SELECT CAST(row_number() OVER (ORDER BY macro_f1 DESC, m) AS INTEGER) AS place, m, macro_f1 FROM s")
def ordered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    scores = rounded(metrics.single_label(metrics.confusion(_flags(spark, sf_dir), "a", "b", ["m"]), ["m"]).select("m", "macro_f1"), "macro_f1")
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc("macro_f1"), "m")))  # a row a model


@query(f"WITH r AS ({_PAIR}), t AS (SELECT a, count(*) AS n FROM r WHERE doc_id % 4 <> 0 GROUP BY a ORDER BY n DESC, a LIMIT 1) SELECT doc_id, a AS gold, (SELECT a FROM t) AS predicted FROM r WHERE doc_id % 4 = 0")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    label = models.majority_label(rows.filter("doc_id % 4 <> 0"), "a")
    return rows.filter("doc_id % 4 = 0").select("doc_id", F.col("a").alias("gold"), F.lit(label).alias("predicted"))


@query(f"SELECT seed, d.lang, d.source, a, b, count(*) AS n FROM ({_PAIR}) r JOIN documents d ON r.doc_id = d.doc_id WHERE seed IN (0, 1) AND a <> b GROUP BY ALL")
def error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumns({"model": F.lit("length"), "split": F.col("seed").cast("string"), "correct": F.col("a") == F.col("b")})
    wrong = counts.enrich_errors(rows, load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["length"], ["0", "1"])
    return wrong.groupBy("seed", "lang", "source", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT 'lines' || CAST(m AS VARCHAR) AS family, a, b FROM ({_FLAGS}) UNION ALL SELECT 'quality', a, b FROM ({_PAIR})), {_label_sql('r', 'family')}
SELECT family, {_SINGLE} FROM f GROUP BY family""")
def family_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir).select(F.concat(F.lit("lines"), F.col("m").cast("string")).alias("family"), "a", "b")
    rows = rows.unionByName(_pairs(spark, sf_dir).select(F.lit("quality").alias("family"), "a", "b"))
    return rounded(metrics.single_label(metrics.confusion(rows, "a", "b", ["family"]), ["family"]), *_SCORES)


def _tfidf_sql(grams: str) -> str:
    return f"""WITH w AS ({grams}), t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
k AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM t GROUP BY term), n WHERE df >= 2 AND df <= 0.95 * n),
v AS (SELECT doc_id, t.term, (1 + ln(tf)) * idf AS x FROM t JOIN k ON t.term = k.term), m AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY doc_id)
SELECT term, count(*) AS docs, round(sum(x / norm), 4) AS weight FROM v JOIN m ON v.doc_id = m.doc_id GROUP BY term"""


def _term_sums(df: DataFrame) -> DataFrame:
    return df.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("weight"), 4).alias("weight"))


@query(_tfidf_sql("SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents)"))
def tfidf_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return _term_sums(features.tfidf_rows(docs, "doc_id", features.word_ngrams("text", 1, 2)))


@query(_tfidf_sql("""SELECT doc_id, unnest(list_concat(list_transform(range(1, greatest(len(p) - 2, 1) + 1), lambda i: substr(p, i, 3)), CASE WHEN len(p) > 3 THEN list_transform(range(1, len(p) - 2), lambda i: substr(p, i, 4)) ELSE [] END)) AS term
FROM (SELECT doc_id, ' ' || unnest(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\p{Z}]+', ' ', 'g'), ' '), lambda x: x <> '')) || ' ' AS p FROM documents)"""))
def tfidf_char_wb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return _term_sums(features.tfidf_rows(docs, "doc_id", features.char_ngrams("text", 3, 4)))


@query(f"""WITH {classify_sql()}, r AS (SELECT x.screening_status AS a, y.screening_status AS b FROM screened x JOIN screened y ON x.doc_id = y.doc_id), {_label_sql('r')}
SELECT 'screening' AS task, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f""")
def rule_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier run again on its own output scores one."""
    one = screened(spark, sf_dir).select("doc_id", F.col("screening_status").alias("gold"))
    two = screened(spark, sf_dir).select("doc_id", F.col("screening_status").alias("pred"))
    out = metrics.single_label(metrics.confusion(corpus.strict_inner(one, two, "doc_id"), "gold", "pred"))
    return rounded(out.select(F.lit("screening").alias("task"), "n", "accuracy", "macro_f1"), "accuracy", "macro_f1")


#: The reference's features: words in runs of 1 to 3 and characters in runs of 3 to 6,
#: with the most terms of each.
_WORDS, _CHARS = (lambda: features.word_ngrams("text", 1, 3), 120_000), (lambda: features.char_ngrams("text", 3, 6), 160_000)


def _vectors(spark: SparkSession, sf_dir: str, *kinds: tuple) -> tuple[DataFrame, DataFrame, int]:
    """Labelled documents with TF-IDF features, three quarters to learn and the rest to
    test, and the number of features; those of several kinds stand one after another."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    docs = docs.withColumns({"quality": F.col("quality").cast("string"), "tags": F.filter(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.col("lang")), lambda x: x.isNotNull())})
    docs = docs.withColumn("learn", F.crc32(F.col("doc_id").cast("string")) % 4 != 0)
    # Terms take far longer than reading, so texts are dealt out to all cores and not by files' row groups.
    folder, held = Folder(spark, None), docs
    docs = folder.table("documents", lambda: held.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id"))
    out, names, size = docs, [f"features{i}" for i in range(len(kinds))], 0
    for (terms, most), name in zip(kinds, names, strict=True):
        found = features.TfIdf(terms(), most, name, first=size).fit(docs.filter("learn"))
        out, size = found.transform(out), size + found.size
    rows = features.joined(out, names, "features").drop("text", *names).withColumn(ROW, F.monotonically_increasing_id())
    out = folder.table("vectors", lambda: rows)
    return out.filter("learn"), out.filter("NOT learn"), size


def _scores(df: DataFrame, label: str) -> DataFrame:
    return rounded(metrics.single_label(metrics.confusion(df, label, "predicted")), *_SCORES)


@query()
def logreg_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in runs of 1 and 2, without accents, as many as there are: their vocabulary is a
    table, and of more weights than the driver holds texts are numbers of the search, or
    from models.DRIVER_ROWS of them on the weights are a table too."""
    folder = Folder(spark, None)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").join(load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id")
    docs = docs.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    docs = docs.select("text", "quality", (F.crc32(F.col("doc_id").cast("string")) % 4 != 0).alias("learn"), F.monotonically_increasing_id().alias("row"))
    held = docs
    docs = folder.table("documents", lambda: held)
    words = Vocabulary(features.word_ngrams("text", 1, 2, strip_accents=True), folder).fit(docs.filter("learn"))
    vectors = folder.table("vectors", lambda: docs.select("row", "quality", "learn").join(words.rows(docs), "row", "left").withColumn(ROW, F.monotonically_increasing_id()))
    return _scores(models.logistic_regression(vectors.filter("learn"), vectors.filter("NOT learn"), "features", "quality", words.size), "quality")


@query()
def svc_ovr_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, size = _vectors(spark, sf_dir, _CHARS)
    return _scores(models.linear_svc(train, test, "features", "quality", size), "quality")


@query()
def svc_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, size = _vectors(spark, sf_dir, _WORDS, _CHARS)
    return _scores(models.calibrated_svc(train, test, "features", "quality", "doc_id", size), "quality")


@query()
def multilabel_ovr_svc(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, size = _vectors(spark, sf_dir, _WORDS, _CHARS)
    out = models.multi_label_svc(train, test, "features", "tags", size)
    return rounded(metrics.multi_label(out, "tags", "predicted_labels"), "subset_accuracy", "micro_f1", "macro_f1", "samples_f1", "samples_jaccard", "hamming_loss")


@query()
def embedding_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), features.unit_embedding("embedding").alias("features"))
    size = rows.agg(F.max(F.size("features.indices"))).first()[0] or 0
    return _scores(models.logistic_regression(rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0"), "features", "label", size), "label")


def _texts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Labelled documents to train on, to choose the epoch by and to test."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").join(load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id")
    part = F.crc32(F.col("doc_id").cast("string")) % 8
    return [docs.filter(part > 2), docs.filter(part == 1), docs.filter(part.isin(0, 2))]


@query()
def encoder_finetune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text encoder trained on labelled documents, scored on held-out ones."""
    found = models.fine_tuned(*_texts(spark, sf_dir), "text", "quality", seeds=(1,))
    return _scores(found, "quality")


@query()
def encoder_seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three seeds trained at once, and what their held-out scores have in common."""
    found = models.fine_tuned(*_texts(spark, sf_dir), "text", "quality")
    scores = metrics.single_label(metrics.confusion(found, "quality", "predicted", ["seed"]), ["seed"]).withColumn("task", F.lit("quality"))
    return rounded(metrics.seed_summary(scores, ["task"], ["accuracy", "macro_f1"]), "accuracy_mean", "accuracy_std", "macro_f1_mean", "macro_f1_std")


@query()
def text_embedding_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen sentence embeddings, learned from the documents' languages, under a linear model."""
    train, dev, test = _texts(spark, sf_dir)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 8
    encoder = models.TextEncoder("text", "lang", settings=models.Settings(epochs=1)).fit(docs.filter(chosen > 2), docs.filter(chosen == 1))
    folder = Folder(spark, None)  # the classifier looks at its rows more than once
    rows = [folder.table(name, lambda d=d: encoder.embed(d).select("quality", features.unit_embedding("embedding").alias("features"))) for name, d in (("learn", train.unionByName(dev)), ("test", test))]
    return _scores(models.logistic_regression(*rows, "features", "quality", encoder.settings.hidden), "quality")
