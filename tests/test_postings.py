"""The positional index gives what the scan of all texts gives."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import boolquery
from corvane.operators.postings import PositionalIndex

#: Words of the record search's queries, whole and with other endings, and fillers.
WORDS = sorted({w.replace("%", end) for q in boolquery.QUERY_GROUPS.values() for t in boolquery.leaves(boolquery.parse(q)) for w in t.words for end in ("", "ing")})


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(5)
    phrases = [" ".join(t.words).replace("%", "s") for q in boolquery.QUERY_GROUPS.values() for t in boolquery.leaves(boolquery.parse(q)) if len(t.words) > 1]
    rows = []
    for i in range(300):
        bits = [rng.choice(WORDS if rng.random() < 0.3 else phrases if rng.random() < 0.2 else ["the", "a", "crew", "über", "x1"]) for _ in range(rng.randint(0, 12))]
        rows.append((i if i % 50 else None, rng.choice([" ", "-", ", "]).join(bits).upper() if i % 23 else None))
    rows += [(7, "gate gate ramp"), (7, "gate gate ramp"), (1000, "b " * 20000 + "gate agent " + "c " * 4 + "ramp")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("row", F.lit("another")).repartition(3).cache()
    return df, PositionalIndex(spark, str(tmp_path_factory.mktemp("index"))).build(df, "id", "text", 5)


def both(texts, query):
    df, index = texts
    found = sorted(str(r.key) for r in index.search(query).collect())
    assert found == sorted(str(r.id) for r in df.filter(boolquery.matches(query, "text")).select("id").collect())
    return found


@pytest.mark.parametrize("name", sorted(boolquery.QUERY_GROUPS))
def test_groups_equal_the_scan(texts, name):
    assert both(texts, boolquery.QUERY_GROUPS[name])


ODD = ['NEAR((gate, ramp), 3)', 'NEAR(("gate agent", ramp), 5)', 'NEAR(("gate agent", ramp), 4)', 'NEAR((ramp, "gate agent", "jet bridge", board%), 2)', 'NOT (gate OR ramp)', 'NOT gate AND NOT NEAR((cabin, crew), 2)', '%ing AND gate', '"%ate ramp"', '"gate gate ramp"', 'NEAR((gate, gate), 1)', 'NEAR(("gate gate", gate), 1)', '"load % close%" OR über', "nothing_like_it", "%"]


@pytest.mark.parametrize("query", ODD)
def test_odd_queries_equal_the_scan(texts, query):
    both(texts, query)


def test_near_counts_places(spark):
    said = lambda text, query: spark.range(1).select(boolquery.matches(query, F.lit(text))).first()[0]
    text = "a b c d e f a b"
    for query, holds in (('NEAR(("a b", d), 2)', True), ('NEAR(("a b", d), 1)', False), ('NEAR((d, "a b"), 2)', True), ('NEAR(("d e", "a b"), 2)', True), ('NEAR(("d e", "a b"), 1)', False), ('NEAR(("b c", "c d"), 9)', False), ('NEAR(("a b", "b c"), 5)', True)):
        assert said(text, query) is holds, query


def test_search_reads_ranges_of_words(texts):
    """The words of the query are pushed down to the sorted postings."""
    plan = texts[1].search("gate AND board%")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,gate)" in plan and "StringStartsWith(word,board)" in plan
    assert texts[1].words("gate").first().docs > 0


def test_no_texts(spark, tmp_path):
    index = PositionalIndex(spark, str(tmp_path)).build(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert index.search("a OR NOT b").count() == 0
