"""Vocabularies and weights that no machine holds whole equal those that one does."""

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from corvane.operators import features, linear, models, sharded, vocabulary
from corvane.operators.folder import Folder
from corvane.operators.vocabulary import Vocabulary


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(400):
        places = sorted(rng.choice(50, rng.integers(0, 8), replace=False).tolist())
        data.append((i, (places, rng.normal(0, 1, len(places)).tolist()) if i % 90 else None, [1.0 if sum(places) % 2 else -1.0, 1.0 if i % 3 else -1.0], [1.0, 0.5 + i % 2]))
    return spark.createDataFrame(data, f"row long, features {linear.FEATURES}, y array<double>, u array<double>").repartition(3, "row").cache()


def whole(search, size, classes):
    w = np.zeros((size + 1, classes))
    for r in search.weights.collect():
        w[r.shard :: search.shards] = np.frombuffer(r.raw).reshape(-1, classes)
    return w


def test_sharded_weights_equal_the_whole_ones(spark, rows, monkeypatch):
    monkeypatch.setattr(sharded, "ROWS", 32)
    monkeypatch.setattr(sharded, "BLOCKS", 2)
    want = linear.fit(rows, 50, 2, "logistic", iterations=4)
    search = sharded.fit(rows, 50, 2, Folder(spark, None), "logistic", iterations=4, span=13)
    assert search.shards == 4
    assert np.abs(whole(search, 50, 2) - want).max() < 1e-9
    given = {r.row: r.m for r in linear.margins(rows.select("row", "features"), want, "m").collect()}
    got = {r.row: r.margins for r in sharded.margins(rows.select("row", "features"), search).collect()}
    assert got.keys() == given.keys() and max(abs(a - b) for k in got for a, b in zip(got[k], given[k], strict=True)) < 1e-9


def test_models_change_over_by_size(spark, rows, monkeypatch):
    df = rows.withColumn("label", F.when(F.col("y")[0] > 0, "odd").otherwise("even")).select("row", "features", "label")
    want = {r.row: r.predicted for r in models.linear_svc(df, df, "features", "label", 50, iterations=2).collect()}
    monkeypatch.setattr(models, "DRIVER_WEIGHTS", 10)
    got = {r.row: r.predicted for r in models.linear_svc(df, df, "features", "label", 50, iterations=2).collect()}
    assert got == want


def documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    odd = spark.createDataFrame([(None,), ("",), ("zz",), ("the " * 3000,)], "text string")
    return docs.unionByName(odd)


@pytest.mark.parametrize("most", [None, 700])
def test_vocabulary_equals_the_collected_one(spark, sf, monkeypatch, most):
    """Same terms, weights and rows; of terms with equal counts the smaller are kept."""
    monkeypatch.setattr(vocabulary, "FREQUENT", 50)  # both ways of looking up
    folder, terms = Folder(spark, None), features.word_ngrams("text", 1, 2)
    docs = folder.table("docs", lambda: documents(spark, sf).withColumn("row", F.monotonically_increasing_id()))
    found = Vocabulary(terms, folder, size=most).fit(docs)
    table = found.table.orderBy("id").collect()
    assert [r.id for r in table] == list(range(found.size))
    assert [(-r.tf, r.term) for r in table] == sorted((-r.tf, r.term) for r in table)
    model = CountVectorizer(inputCol="t", outputCol="x", minDF=2, maxDF=0.95, vocabSize=1 << 30).fit(docs.select(terms.alias("t")))
    if most is None:
        assert {r.term for r in table} == set(model.vocabulary)
        plain = features.TfIdf(terms, 1 << 30, "f").fit(docs)
        place = {t: i for i, t in enumerate(plain.model.vocabulary)}
        to = [place[r.term] for r in table]
        want = {r.row: dict(zip(r.f["indices"], r.f["values"], strict=True)) for r in plain.transform(docs).collect()}
        got = {r.row: {to[i]: v for i, v in zip(r.features["indices"], r.features["values"], strict=True)} for r in found.rows(docs).collect()}
        assert got.keys() == {k for k, v in want.items() if v}
        for k, v in got.items():
            assert v.keys() == want[k].keys() and all(abs(v[i] - want[k][i]) < 1e-12 for i in v)
    else:
        everything = Vocabulary(terms, folder, "all").fit(docs).table
        assert [r.term for r in table] == [r.term for r in everything.orderBy(F.desc("tf"), "term").limit(most).collect()]


def test_vocabulary_of_no_rows(spark):
    folder = Folder(spark, None)
    none = Vocabulary(F.split("text", " "), folder).fit(spark.createDataFrame([], "text string, row long"))
    assert none.size == 0
    assert none.rows(spark.createDataFrame([("a b", 1)], "text string, row long")).count() == 0


def test_objective_of_wanted_classes_and_as_many_tasks_as_cores(spark, rows):
    found = linear.Objective(rows.repartition(40).select("features", "y", "u"), 50, 2, "squared_hinge", 1.0)
    w = np.random.default_rng(1).normal(0, 1, (51, 2))
    value, gradient = found(w)
    one = found(w, np.array([False, True]))
    assert abs(one[0] - [0, value[1]]).max() < 1e-9 and abs(one[1] - np.stack([np.zeros(51), gradient[:, 1]], 1)).max() < 1e-9
    step = 1e-6 * np.eye(51)[7][:, None]
    assert abs((found(w + step)[0] - found(w - step)[0]) / 2e-6 - gradient[7]).max() < 1e-3
    found.close()


def test_one_classifier_of_two_labels_counts_as_one(spark, rows, monkeypatch):
    df = rows.withColumn("label", F.when(F.col("y")[0] > 0, "odd").otherwise("even")).select("row", "features", "label")
    monkeypatch.setattr(models, "DRIVER_WEIGHTS", 60)  # 51 weights
    monkeypatch.setattr(sharded, "fit", None)
    assert models.linear_svc(df, df, "features", "label", 50, iterations=1).count() == 400


def test_terms_are_counted_once_and_ties_go_by_term(spark, monkeypatch):
    monkeypatch.setattr(features, "HELD", 3)
    df = spark.createDataFrame([(1, "b a"), (2, "d c b a a"), (3, ""), (4, None)], "k long, t string")
    found = features.TfIdf(F.split("t", " "), 3, "f", min_df=1, max_df=1.0, first=5).fit(df)
    assert found.model.vocabulary == ["a", "b", ""]
    got = {r.k: (r.f["indices"], r.f["values"]) for r in found.transform(df).collect()}
    assert got[1][0] == [5, 6] and got[2][0] == [5, 6] and got[3] == ([7], [1.0]) and got[4] == ([], [])
    a, b = (1 + np.log(2)) * (np.log(5 / 3) + 1), np.log(5 / 3) + 1
    assert np.abs(np.array(got[2][1]) - np.array([a, b]) / np.hypot(a, b)).max() < 1e-12
