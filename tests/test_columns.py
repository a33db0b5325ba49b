"""Models of more weights than rows, and terms counted by number, equal the plain forms."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import columns, features, grams, linear, models, sharded
from corvane.operators.folder import Folder


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(60):
        places = sorted(rng.choice(300, rng.integers(1, 20), replace=False).tolist())
        data.append((i, (places, rng.normal(0, 1, len(places)).tolist()) if i % 19 else None, "abc"[i % 3] if i % 7 else None))
    folder = Folder(spark, None)
    return folder.table("rows", lambda: spark.createDataFrame(data, f"id long, features {linear.FEATURES}, label string").repartition(3, "id").withColumn(columns.ROW, F.monotonically_increasing_id()))


def test_search_by_rows_equals_the_one_by_weights(spark, rows, monkeypatch):
    monkeypatch.setattr(columns, "BLOCK", 7)
    number = columns.Rows(rows)
    given = rows.toPandas()
    at = number(given[columns.ROW].to_numpy())
    assert sorted(at) == list(range(60))
    y = np.array([[1.0 if i % 2 else -1.0, 1.0 if i % 3 else -1.0] for i in given["id"]])
    u = np.array([[1.0 if i < 45 else 0.0, 0.5 + i % 2 if i < 45 else 0.0] for i in given["id"]])  # the last 15 are only scored
    plain = rows.join(spark.createDataFrame([(int(r), a.tolist(), b.tolist()) for r, a, b in zip(given[columns.ROW], y, u, strict=True)], f"{columns.ROW} long, y array<double>, u array<double>"), columns.ROW)
    w = linear.fit(plain, 300, 2, "logistic", iterations=12)
    want = {r[columns.ROW]: r.m for r in linear.margins(rows.select(columns.ROW, "features"), w, "m").collect()}
    order = np.argsort(at)
    kernel = columns.Kernel(rows, number)
    m = columns.fit(kernel, y[order], u[order], "logistic", iterations=12)
    kernel.close()
    assert max(np.abs(m[k] - want[r]).max() for k, r in zip(at, given[columns.ROW], strict=True)) < 1e-8
    got = {r[columns.ROW]: r.m for r in columns.with_products(rows, number, m, "m").collect()}
    assert all(got[r] == m[k].tolist() for k, r in zip(at, given[columns.ROW], strict=True))


@pytest.mark.parametrize("names", [["a", "b"], ["a", "b", "c"]])
def test_more_weights_than_rows_need_no_shards(spark, rows, monkeypatch, names):
    train, test = rows.filter(F.col("label").isNull() | F.col("label").isin(names)), rows.select("id", "features")
    monkeypatch.setattr(models, "DRIVER_ROWS", 0)
    want = {r.id: r.predicted for r in models.logistic_regression(train, test, "features", "label", 300, iterations=10).collect()}
    monkeypatch.setattr(models, "DRIVER_ROWS", 1000)
    monkeypatch.setattr(models, "DRIVER_WEIGHTS", 10)
    monkeypatch.setattr(sharded, "fit", None)
    monkeypatch.setattr(linear, "fit", None)
    assert {r.id: r.predicted for r in models.logistic_regression(train, test, "features", "label", 300, iterations=10).collect()} == want


@pytest.mark.parametrize("terms", [("word", 1, 3), ("word", 2, 2), ("char", 3, 6), ("char", 2, 2)])
def test_terms_counted_by_number_are_those_of_the_column(spark, monkeypatch, terms):
    monkeypatch.setattr(grams, "ROWS", 2)
    df = spark.createDataFrame([("a bb a bb a",), (None,), ("",), ("ab Übung abcdefgh ab x\U0001f600yz",), ("\U0001f600",), ("bb abc bb abc bb",)], "t string")
    terms = getattr(features, f"{terms[0]}_ngrams")("t", *terms[1:])
    kind = grams.of(terms)
    assert not isinstance(kind.words, str) and kind.words is not terms
    lists = df.coalesce(1).select(kind.words.alias("w")).toArrow().column(0).combine_chunks()
    found = Counter()
    for texts, term, row, tf in kind.count(lists):
        found.update({(int(r), texts[int(k)].as_py()): int(n) for k, r, n in zip(term, row, tf, strict=True)})
    want = Counter((i, t) for i, r in enumerate(df.coalesce(1).select(terms.alias("x")).collect()) for t in r.x)
    assert found == want


@pytest.mark.parametrize("names", [["a", "b"], ["a", "b", "c"]])
def test_all_folds_and_labels_in_one_search(spark, rows, monkeypatch, names):
    train, test = rows.filter(F.col("label").isin(names)), rows.select("id", "features")
    tags = train.withColumn("tags", F.when(F.col("id") % 2 == 0, F.array("label", F.lit("even"))).otherwise(F.array("label")))

    def run():
        sure = {r.id: (r.predicted, r.confidence) for r in models.calibrated_svc(train, test, "features", "label", "id", 300, iterations=15).collect()}
        return sure, {r.id: r.predicted_labels for r in models.multi_label_svc(tags, test, "features", "tags", 300, iterations=15).collect()}

    monkeypatch.setattr(models, "DRIVER_ROWS", 0)
    want = run()
    monkeypatch.setattr(models, "DRIVER_ROWS", 1 << 20)
    monkeypatch.setattr(linear, "fit", None)
    got = run()
    assert got[1] == want[1]
    assert got[0].keys() == want[0].keys()
    for k, (label, sure) in want[0].items():
        assert got[0][k][0] == label and abs(got[0][k][1] - sure) < 1e-5
