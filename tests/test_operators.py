"""Metrics, splits, samples, audit, features, models, sources."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import audit, corpus, counts, features, labels, metrics, models, resample, splits
from corvane.sources import files, report, search
from corvane.streaming import resume


def test_single_label_metrics(spark):
    df = spark.createDataFrame(list(zip("aabc", "abbb", strict=True)), "g string, p string")
    m = metrics.single_label(metrics.confusion(df, "g", "p")).first()
    assert (m.n, m.accuracy, m.micro_f1) == (4, 0.5, 0.5)
    assert abs(m.macro_f1 - 0.388889) < 1e-6 and abs(m.weighted_f1 - 0.458333) < 1e-6
    union = spark.createDataFrame([("a", "a"), ("a", "z")], "g string, p string")
    assert abs(metrics.single_label(metrics.confusion(union, "g", "p")).first().macro_f1 - 1 / 3) < 1e-9


def test_multi_label_and_kappa(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["c"], ["c", "d"]), ([], [])], "g array<string>, p array<string>")
    m = metrics.multi_label(df, "g", "p", ["a", "b", "c", "d"]).first()
    assert abs(m.subset_accuracy - 1 / 3) < 1e-9 and abs(m.hamming_loss - 2 / 12) < 1e-9
    assert abs(m.samples_f1 - 0.444444) < 1e-6 and abs(m.samples_jaccard - 1 / 3) < 1e-9 and abs(m.micro_f1 - 2 / 3) < 1e-9
    k = metrics.cohen_kappa(spark.createDataFrame([*zip("aabb", "abbb", strict=True), ("", "a")], "x string, y string"), "x", "y").first()
    assert (k.n, k.agreement, k.kappa) == (4, 0.75, 0.5)
    empty = metrics.multi_label(df.limit(0), "g", "p").first()
    assert empty.n == 0 and empty.subset_accuracy == 0.0


def test_published_majority_scores(spark):
    """118 of 751 rows of one class, all predicted so: accuracy 0.157124."""
    df = spark.createDataFrame([("x", 118), ("y", 633)], "g string, k int").select("g", F.explode(F.sequence(F.lit(1), "k"))).withColumn("p", F.lit("x"))
    assert round(metrics.single_label(metrics.confusion(df, "g", "p")).first().accuracy, 6) == 0.157124


def test_percentiles_and_resampling(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8)], "m double")
    i = resample.interval(df, ["m"]).first()
    assert abs(i.m_low - 1.075) < 1e-9 and abs(i.m_high - 7.7) < 1e-9
    rows = spark.createDataFrame([(i, "ab"[i % 2], "ab"[i % 3 == 0]) for i in range(60)], "id long, g string, p string")
    ci = resample.bootstrap_single(rows, "g", "p", "id", 50).first()
    point = metrics.single_label(metrics.confusion(rows, "g", "p")).first()
    assert ci.accuracy_low <= point.accuracy <= ci.accuracy_high
    drawn = resample.resample_counts(metrics.confusion(rows, "g", "p"), 20).groupBy("rep").agg(F.sum("n").alias("n")).collect()
    assert len(drawn) == 20 and all(r.n == 60 for r in drawn)


def test_splits(spark):
    assert [tuple(splits.targets(n).values()) for n in (2, 3, 10, 14)] == [(1, 0, 1), (2, 0, 1), (7, 2, 1), (10, 2, 2)]
    df = spark.createDataFrame([(i, f"g{i // 2}", "s" if i < 30 else "t") for i in range(60)], "id long, g string, s string")
    out = splits.group_split(df, "g", "s", 1)
    assert out.count() == 60 and splits.leaks(out, "g").count() == 0
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "dev", "test"}
    with pytest.raises(corpus.MissingRows):
        splits.extend_split(df, df.withColumn("split", F.lit("")), "id")


def test_dedupe_and_joins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in corpus.last_wins(df, "k", ["o"]).collect()} == {("a", "y"), ("b", "z")}
    assert {(r.k, r.vs) for r in corpus.first_wins(df, "k", ["o"], {"vs": "v"}).collect()} == {("a", "x;y"), ("b", "z")}
    with pytest.raises(corpus.MissingRows):
        corpus.strict_inner(df, df.filter("k = 'a'").select("k").distinct(), "k")
    assert corpus.ranked_ids(df, [F.col("o").desc(), F.col("v")], "X", 3, "id").orderBy("id").first().id == "X001"


def test_quota_sample_invariants(spark):
    pool = spark.createDataFrame([(i, "q1;q2" if i % 3 else "q2") for i in range(50)], "id long, gs string")
    got = corpus.quota_sample(pool, "id", "gs", [("q1", 5), ("q2", 10)], 20, 7)
    assert got.count() == 20 == got.select("id").distinct().count()
    assert {r["stage"]: r["count"] for r in got.groupBy("stage").count().collect()} == {"q1": 5, "q2": 10, "top_up": 5}


def test_audit(spark):
    rows = [("1", "a", "include_ground_cabin_event", "fueling", "", "text", "2012-01", "r", "fueling", True, True), ("1", "b", "exclude_not_ground_or_cabin", "fueling", "e" * 40, "text", "1999-01", "", "x", False, True)]
    df = spark.createDataFrame(rows, "corpus_id string, key string, screening_status string, primary_event_type string, ground_evidence string, all_text string, date string, need string, rule string, in_raw boolean, in_manifest boolean")
    at = audit.Layout(evidence=("ground_evidence",), required=("need",), rules={"primary_event_type": "rule"})
    r = audit.roll_up(df, at).first()
    assert (r.duplicate_ids, r.duplicate_keys, r.missing_raw, r.rule_mismatches, r.blank_required, r.exclude_relevant, r.include_without_evidence, r.evidence_not_in_source, r.date_outside_window) == (1, 0, 1, 1, 1, 1, 1, 1, 1)
    assert r.blocking_errors == 5 and r.verdict == "FAIL"
    assert [m.computed for m in audit.mismatches(df, at).collect()] == ["x"]


def test_features_and_models(spark):
    df = spark.createDataFrame([(i, "good text here number" if i % 2 else "bad words there count", "x" if i % 2 else "y") for i in range(40)], "id long, t string, y string")
    assert df.limit(1).select(features.char_ngrams(F.lit("ab c"), 3, 4)).first()[0] == [" ab", "ab ", " ab ", " c "]
    assert df.limit(1).select(features.word_ngrams(F.lit("Aa bb c dd"), 1, 2)).first()[0] == ["aa", "bb", "dd", "aa bb", "bb dd"]
    assert df.limit(1).select(features.word_ngrams(F.lit("Éa ﬁx Straße łó"), 1, 1, strip_accents=True)).first()[0] == ["ea", "fix", "straße", "ło"]
    found = features.TfIdf(features.word_ngrams("t", 1, 2), 100, "f", max_df=0.9).fit(df)
    vectors = found.transform(df).coalesce(1).cache()
    for predict in (models.logistic_regression, models.linear_svc):
        out = predict(vectors, vectors, "f", "y", found.size)
        assert out.filter("predicted = y").count() == 40
    cal = models.calibrated_svc(vectors, vectors, "f", "y", "id", found.size, folds=2)
    assert cal.filter("predicted = y").count() == 40 and cal.filter("confidence < 0.5").count() == 0
    tags = vectors.withColumn("tags", F.array("y"))
    assert models.multi_label_svc(tags, tags, "f", "tags", found.size).filter("predicted_labels = tags").count() == 40
    both = features.joined(vectors.withColumn("g", F.col("f")), ["f", "g"], "h").first()
    assert both.h["values"] == both.f["values"] * 2
    assert models.majority_label(df, "y") == "x"


@pytest.mark.parametrize("loss", ["squared_hinge", "logistic"])
def test_linear_weights_are_optimal(spark, loss):
    """The gradient of the stated objective, computed here without the library, is 0 at
    the weights, and no step from them is better."""
    import numpy as np

    from corvane.operators import linear

    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 4)) * (rng.random((50, 4)) < 0.6)
    label = np.array(["a", "b", "c"])[np.argmax(x @ rng.normal(size=(4, 3)) + rng.normal(size=(50, 3)) * 0.3, axis=1)]
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], str(y)) for i, (r, y) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "id long, i array<int>, v array<double>, y string").select("id", "y", F.struct(F.col("i").alias("indices"), F.col("v").alias("values")).alias("f"))
    names = models.Labels(df, "y")
    w = models.one_vs_rest(df, names, "f", 4, loss, 1.0, 200)
    design = np.hstack([x, np.ones((50, 1))])
    for k, name in enumerate(names.names):
        y = np.where(label == name, 1.0, -1.0)
        u = np.where(label == name, 50 / (3 * (label == name).sum()), 1.0)

        def value(v):
            m = y * (design @ v)  # noqa: B023
            return v @ v / 2 + (u * (np.maximum(0, 1 - m) ** 2 if loss == "squared_hinge" else np.log1p(np.exp(-m)))).sum()  # noqa: B023

        best = value(w[:, k])
        assert all(value(w[:, k] + 0.02 * rng.normal(size=5)) > best - 1e-4 for _ in range(50))
        numeric = [(value(w[:, k] + 1e-5 * e) - value(w[:, k] - 1e-5 * e)) / 2e-5 for e in np.eye(5)]
        assert np.abs(numeric).max() < 0.1
    got = {r.id: r.predicted for r in models._classified(df, df, "f", "y", 4, loss, 1.0, 200).collect()}
    assert [got[i] for i in range(50)] == [names.names[j] for j in np.argmax(design @ w, axis=1)]


def test_label_tables(spark):
    manifest = spark.createDataFrame([("C1", "K1", "1", "Q1", "n1"), ("C2", "K2", "2", "Q1", "n2"), ("C3", "K3", "3", "Q1", "n3")], "corpus_id string, candidate_id string, acn string, query_id string, expanded_selection_note string")
    records = spark.createDataFrame([("2", "Fuel truck blocked the stand.", "Fuel truck blocked the stand.")], "acn string, synopsis string, all_text string")
    seeds = spark.createDataFrame([("1", "include_ground_cabin_event", None)], "acn string, silver_screening_status string, notes string")
    out = labels.label_rows(manifest, seeds, records, "me", "2026-01-01", "open", "made")
    assert out.columns == [*labels.SILVER_COLUMNS, *labels.VERIFIED_COLUMNS, *labels.EXPANDED_COLUMNS]
    got = {r.acn: r for r in out.collect()}
    assert (got["1"].corpus_id, got["1"].notes, got["1"].expanded_label_provenance, got["1"].expanded_selection_note) == ("C1", "", "preserved_seed_label", "n1")
    assert got["2"].silver_screening_status == "include_ground_cabin_event" and got["2"].labeler == "me"
    assert (got["3"].silver_screening_status, got["3"].silver_primary_event_type, got["3"].reason_for_exclusion) == ("uncertain_needs_review", "not_relevant", "raw_record_not_found")
    assert {r.acn for r in labels.relevant_rows(out).collect()} == {"2"}
    rows = spark.createDataFrame([("train", "C1", "1", ["b", "a"], ["a", "b"]), ("dev", "C2", "2", [], ["a"])], "split string, corpus_id string, acn string, gold array<string>, predicted array<string>")
    assert [(r.gold_labels, r.predicted_labels, r.exact_match) for r in labels.multi_predictions(rows, "t", "m").collect()] == [("a;b", "a;b", "true"), ("", "a", "false")]


CLIENT = '''
class Client:
    """A search client of two records."""

    def post(self, request):
        assert request["text"] and request["fullformOnly"]
        return [{"acn": 1}, {"acn": 2}]

    def fetch(self, acns):
        return [{"acn": a, "dateOfOccurrence": f"20{10 + a}-05", "synopsis": "s", "people": []} for a in acns]
'''


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from corvane import cli

    (tmp_path / "client_of_test.py").write_text(CLIENT)
    monkeypatch.syspath_prepend(tmp_path)
    spark.sparkContext.addPyFile(str(tmp_path / "client_of_test.py"))  # a client runs on executors

    records = [{"acn": 1, "synopsis": "Fuel truck blocked the stand.", "people": []}, {"acn": 1, "synopsis": "Company memo.", "people": [{"9107": "n"}]}]
    for i, folder in enumerate(("a", "b")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "records.json").write_text(json.dumps(records[i:]))
    paths = [str(tmp_path / f / "records.json") for f in ("a", "b")]
    assert [(r.acn, r.file_ord, r.pos) for r in files.read_records(spark, paths).collect()] == [("1", 0, 0), ("1", 0, 1), ("1", 1, 0)]
    (tmp_path / "m.csv").write_text("corpus_id,candidate_id,acn,query_id,expanded_selection_note\nC1,K1,1,Q1;Q2,n\nC2,K2,2,Q1,n\n")
    base = ["--manifest", str(tmp_path / "m.csv"), "--records", *paths, "--out"]
    got = {r.acn: r for r in cli.main(["screen", *base, str(tmp_path / "s")], spark)["screening"].collect()}
    assert got["1"].primary_event_type == "dispatch_or_coordination" and got["2"].exclusion_reason == "raw_record_not_found"
    assert {r.query_id: r.n for r in files.read_csv(spark, str(tmp_path / "s" / "query_counts")).collect()} == {"Q1": "2", "Q2": "1"}
    assert "## status_counts" in json.loads((tmp_path / "s" / "summary.json").read_text())["summary"]
    assert cli.main(["label", *base, str(tmp_path / "l")], spark)["labels"].count() == 2
    (tmp_path / "p.csv").write_text("task,model,split,corpus_id,acn,gold_label,predicted_label\nt,m,test,1,1,a,a\nt,m,test,2,2,a,b\n")
    assert cli.main(["score", "--predictions", str(tmp_path / "p.csv"), "--out", str(tmp_path / "r")], spark)["metrics"].first().accuracy == 0.5
    assert cli.main(["split", "--rows", str(tmp_path / "p.csv"), "--group", "acn", "--stratum", "gold_label", "--out", str(tmp_path / "x")], spark)["leaks"].count() == 0
    client = ["--client", "client_of_test:Client", "--out"]
    assert cli.main(["collect", *client, str(tmp_path / "c"), "--query-id", "Q1", "--text", "gate", "--last-year", "2011"], spark)["manifest"].count() == 1
    assert cli.main(["counts", *client, str(tmp_path / "q"), "--queries", '{"Q1": "gate"}'], spark)["query_counts"].first().result_count == 2
    assert cli.main(["run", "distinct_counts", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "d")], spark)["distinct_counts"].count() == 1
    cli.main(["list"])
    assert "distinct_counts" in capsys.readouterr().out


def test_external_scorer_and_retry(spark):
    class Busy(Exception):
        status = 503

    waits, calls = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise Busy
        return "ok"

    assert models.retrying(flaky, 3, waits.append)("x") == ("ok", "") and waits == [1, 2]
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    got = models.external_scorer(df, "id", "t", lambda t: (t.upper(), "") if t else 1 / 0).orderBy("id").collect()
    assert [(r.response, r.error_type) for r in got] == [("A", ""), (None, "ZeroDivisionError")]
    done = spark.createDataFrame([(1, "timeout")], "id long, error_type string")
    assert resume.pending(df, done, "id").count() == 1 and resume.pending(df, done, "id", True).count() == 2


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q"\nline'), ("2", "")], "id string, t string")
    files.write_csv(df, str(tmp_path / "c"), ["id", "t"])
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert {tuple(r) for r in back.collect()} == {("1", 'a "q"\nline'), ("2", "")}
    files.append_csv(df, str(tmp_path / "c"), ["id", "t"])
    assert files.read_csv_if_any(spark, [str(tmp_path / "c"), str(tmp_path / "none")], ["id", "new"]).count() == 4
    with pytest.raises(ValueError):
        files.write_csv(df, str(tmp_path / "d"), ["id"])
    (tmp_path / "r.json").write_text(json.dumps([{"acn": 5, "synopsis": "s", "people": [{"9107": "n", "x": 1}]}, {"acn": None}]))
    (tmp_path / "s.json").write_text(json.dumps([{"acn": 5, "synopsis": "t"}]))
    records = files.read_records(spark, [str(tmp_path / "r.json"), str(tmp_path / "s.json")])
    assert corpus.last_wins(records, "acn", ["file_ord", "pos"]).first().synopsis == "t"
    files.write_json_config(spark, {"a": 1}, str(tmp_path / "conf.json"))
    assert json.loads((tmp_path / "conf.json").read_text()) == {"a": 1}
    m = files.manifest(spark, str(tmp_path / "r.json")).first()
    assert m.size_bytes == (tmp_path / "r.json").stat().st_size and len(m.sha256) == 64
    (tmp_path / "m").mkdir()
    for name, size in (("a", 10), ("b c", 5000), ("d", 0)):
        (tmp_path / "m" / name).write_bytes(b"x" * size)
    whole, streamed = (sorted(map(tuple, files.manifest(spark, str(tmp_path / "m"), "m", n).collect())) for n in (10_000, 100))
    assert whole == streamed and [(r[0].replace("%20", " "), r[1]) for r in whole] == [("a", 10), ("b c", 5000), ("d", 0)]
    text = report.document("T", {"rows": df, "three": counts.frequency(df, "id", "t")})
    assert text.startswith("# T") and "| id | t | n |" in text


def test_search(spark):
    records = {i: {"acn": i, "dateOfOccurrence": f"{2009 + i}-01", "synopsis": "s", "people": [{"9107": "n"}]} for i in range(1, 8)}
    post = lambda p: [{"acn": i} for i in records] + [{}]
    got, listed = search.collect_query(spark, "Q01", "x", post, lambda acns: [records[a] for a in acns], 2011, 2014, limit=6)
    assert sorted(r.acn for r in got.collect()) == ["2", "3", "4", "5"]
    assert listed.first().people_count == 1 and len(search.payload("x")["eavs"]) == 44
    assert search.query_counts(spark, post, {"Q01": "x"}, "d", "i", "w").first().result_count == 7
    with pytest.raises(TypeError):
        search.search(lambda p: {}, "x")


def test_streaming_scores_each_key_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    run = lambda: resume.score_new(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), "id", lambda d: d.withColumn("s", F.upper("t")))
    df.write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, t string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_model_queries_have_the_reference_settings(spark, sf, monkeypatch):
    from corvane.plans import metric_queries as q

    asked = []

    class Recorded:
        size = 2

        def __init__(self, terms, most, out, first=0):
            asked.append(most)
            self.out = out

        def fit(self, df):
            return self

        def transform(self, df):
            return df.withColumn(self.out, F.struct(F.array(F.lit(0), F.lit(1)).alias("indices"), F.array(F.lit(1.0), F.lit(2.0)).alias("values")))

    def grams(kind):
        def run(text, low, high, strip_accents=False):
            asked.append((kind, low, high, strip_accents))
            return F.array(F.lit(""))

        return run

    def model(train, test, *args, **given):
        asked.append((args[-1], given))
        return test.withColumns({"predicted": F.lit("a"), "predicted_labels": F.array(F.lit("a"))})

    class Unlimited:
        """A vocabulary of all terms, as a table."""

        size = 2

        def __init__(self, terms, folder, **bounds):
            asked.append(bounds)

        def fit(self, df):
            return self

        def rows(self, df):
            return Recorded.transform(type("At", (), {"out": "features"}), df).select("row", "features")

    monkeypatch.setattr(q.features, "TfIdf", Recorded)
    monkeypatch.setattr(q, "Vocabulary", Unlimited)
    for name, kind in (("word_ngrams", "word"), ("char_ngrams", "char")):
        monkeypatch.setattr(q.features, name, grams(kind))
    for name in ("logistic_regression", "linear_svc", "calibrated_svc", "multi_label_svc"):
        monkeypatch.setattr(q.models, name, model)
    word, char = [("word", 1, 3, False), 120_000], [("char", 3, 6, False), 160_000]
    for query, expected in (
        (q.logreg_tfidf, [("word", 1, 2, True), {}, (2, {})]),  # no bound is given
        (q.svc_ovr_tfidf, [*char, (2, {})]),
        (q.svc_calibrated, [*word, *char, (4, {})]),
        (q.multilabel_ovr_svc, [*word, *char, (4, {})]),
    ):
        asked.clear()
        query(spark, sf)
        assert asked == expected, query.__name__


def test_intervals_of_all_replicates(spark, sf):
    from corvane.plans import metric_queries as q

    for name in ("bootstrap_ci_single", "bootstrap_ci_multilabel"):
        few, all_ = (q.Q[n](spark, sf).first().asDict() for n in (name, f"{name}_1000"))
        assert few.keys() == all_.keys() and all(abs(few[k] - all_[k]) < 0.05 for k in few)
