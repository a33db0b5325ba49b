"""Forms that no task holds whole, against the plain ones."""

import random

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import corpus, resample, splits


def test_dealt_equals_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        lack, size, groups = [rng.randint(-5, 40) for _ in range(3)], rng.randint(1, 7), rng.randint(0, 25)
        left, got = list(lack), [0, 0, 0]
        for _ in range(groups):
            i = max(range(3), key=lambda k: (left[k], -k))
            left[i] -= size
            got[i] += 1
        assert splits.dealt(lack, size, groups) == got, (lack, size, groups)


def test_group_split_keeps_groups_and_shares(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 97 == 0 else f"g{int(rng.paretovariate(0.7)) % 300}", rng.choice(["a", "b", None])) for i in range(3000)]
    out = splits.group_split(spark.createDataFrame(rows, "id long, g string, s string").withColumn("split", F.lit("old")), "g", "s", 3).collect()
    assert len(out) == 3000
    by = {}
    for r in out:
        by.setdefault(r.g, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    counts = {s: sum(r.split == s for r in out) for s in splits.SPLITS}
    largest = max(sum(r.g == g for r in out) for g in by)
    assert abs(counts["train"] - 2100) <= 2 * largest and abs(counts["dev"] - 450) <= 2 * largest


def test_quota_sample_equals_one_by_one(spark):
    rng = random.Random(3)
    rows = [(i, ";".join(g for g in "abc" if rng.random() < 0.3) if i % 40 else None) for i in range(4000)]
    quotas, size = [("a", 30), ("b", 500), ("z", 5), ("c", 60)], 700
    order = sorted(rows, key=lambda r: __import__("hashlib").md5(f"9-{r[0]}".encode()).hexdigest())
    want, have = [], set()
    for g, q in quotas:
        got = [r[0] for r in order if g in (r[1] or "").split(";") and r[0] not in have][:q]
        have |= set(got)
        want += [(i, g) for i in got]
    rest = [r[0] for r in order if r[0] not in have][: size - len(want)]
    want += [(i, "top_up") for i in rest]
    got = corpus.quota_sample(spark.createDataFrame(rows, "id long, gs string"), "id", "gs", quotas, size, 9).select("id", "stage").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def tagged(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        gold = [x for x in "abcd" if rng.random() < 0.4]
        pred = [x for x in "abcd" if (x in gold) == (rng.random() < 0.8)]
        rows.append((i, gold if i % 50 else None, pred + pred[:1], "even" if i % 2 else None))
    return spark.createDataFrame(rows, "id long, gold array<string>, pred array<string>, n string").cache()


def test_poisson_intervals_agree_with_draws(spark):
    """Both ways of resampling give the same intervals but for what chance allows."""
    df = tagged(spark)
    drawn = resample.bootstrap_multi(df, "gold", "pred", "id", 300).first()
    fast = resample.poisson_multi(df, "gold", "pred", 2000).first()
    for name in drawn.asDict():
        width = drawn[name.rsplit("_", 1)[0] + "_high"] - drawn[name.rsplit("_", 1)[0] + "_low"]
        assert abs(drawn[name] - fast[name]) < 0.3 * width, name
    again = resample.poisson_multi(df.repartition(7), "gold", "pred", 2000).first()
    assert all(abs(again[k] - fast[k]) < 1e-12 for k in fast.asDict())  # by cell, not by task


def test_poisson_intervals_by_group(spark, monkeypatch):
    df = tagged(spark)
    monkeypatch.setattr(resample, "HELD", 100_000)  # sums are handed on in between
    by = {r.n: r for r in resample.poisson_multi(df, "gold", "pred", 400, by=["n"]).collect()}
    assert by.keys() == {"even", None}
    drawn = resample.bootstrap_multi(df.filter("n = 'even'").drop("n"), "gold", "pred", "id", 300).first()
    for name in drawn.asDict():
        width = drawn[name.rsplit("_", 1)[0] + "_high"] - drawn[name.rsplit("_", 1)[0] + "_low"]
        assert abs(drawn[name] - by["even"][name]) < 0.4 * width, name
    assert resample.poisson_multi(df.limit(0), "gold", "pred", 10, by=["n"]).count() == 0


def test_draws_by_group(spark):
    df = spark.createDataFrame([(i, "x" if i < 30 else None) for i in range(40)], "id long, k string")
    got = resample.draws(df, "id", 5, 1, ["k"]).groupBy("k", "rep").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    assert sorted((str(r.k), r.rep, r.c) for r in got) == sorted((k, r, n) for k, n in (("x", 30), ("None", 10)) for r in range(5))
    assert all((r.hi < 30) == (r.k == "x") for r in got)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_broadcast(spark):
    df = spark.range(50).select("id", F.lit("a").alias("gold"))
    plan = _plan(resample.draws(df, "id", 3, 1))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [__at" not in plan
    got = resample.draws(df, "id", 3, 1).groupBy("rep").count().collect()
    assert sorted((r.rep, r["count"]) for r in got) == [(0, 50), (1, 50), (2, 50)]


def test_multilabel_intervals_draw_once(spark):
    df = spark.createDataFrame([(i, ["a", "b"][: i % 3], ["b"] if i % 4 else None) for i in range(40)], "id long, gold array<string>, pred array<string>")
    assert "md5" not in _plan(resample.bootstrap_multi(df, "gold", "pred", "id", 5))


def test_relevant_rows_do_not_repeat_the_classifier(spark, sf):
    from corvane.plans import registry

    assert "lower(" not in _plan(registry.queries()["relevant_label_rows"](spark, sf))


def test_counting_terms_shuffles_texts_only(spark, monkeypatch):
    from corvane.operators import features

    plans, table = [], features.Folder.table

    def noted(self, name, make=None):
        if name == "counts":
            plans.append(_plan(make()))
        return table(self, name, make)

    monkeypatch.setattr(features.Folder, "table", noted)
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "aa cc"), (2, "bb cc"), (3, None)], "id long, text string")
    got = {(r.id, r.term) for r in features.tfidf_rows(docs, "id", features.word_ngrams("text", 1, 1), min_df=1, max_df=1.0).collect()}
    assert got == {(1, "aa"), (1, "bb"), (1, "cc"), (2, "bb"), (2, "cc")}  # rows of one key are one document
    assert plans[0].count("Exchange") == 1 and "hashpartitioning(id" in plans[0]
