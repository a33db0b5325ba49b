"""The search as a data source, and scoring by state."""

import sys
import time

import pytest
from pyspark import cloudpickle

from corvane.sources import search
from corvane.streaming import resume


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


class Busy(Exception):
    status = 503


class StandIn:
    """Records 1 to 25; the first fetch of each batch fails; fetches are noted in a folder."""

    def __init__(self, folder):
        self.folder = str(folder)

    def post(self, request):
        assert request["text"] == "gate AND ramp" and request["fullformOnly"]
        return [{"acn": i} for i in range(1, 26)] + [{"acn": 3}, {}, {"acn": ""}]

    def fetch(self, acns):
        from pathlib import Path

        mark = Path(self.folder) / f"{acns[0]}-{len(acns)}"
        if not mark.exists():
            mark.touch()
            raise Busy("not now")
        return [{"acn": a, "dateOfOccurrence": f"{2000 + a}-05" if a % 10 else "soon", "synopsis": f"s{a}", "people": [{"9107": "n", "x": 1}] if a % 2 else None} for a in acns]


def load(spark, tmp_path, **options):
    spark.dataSource.register(search.data_source(StandIn(tmp_path)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("record_search").options(query="gate AND ramp", batch=10, pause=0.001, **options).load()


def test_search_is_a_data_source(spark, tmp_path):
    df = load(spark, tmp_path)
    assert df.rdd.getNumPartitions() == 3  # a partition a batch
    rows = {r.acn: r for r in df.collect()}
    assert sorted(map(int, rows)) == list(range(1, 26))
    assert rows["3"].year == 2003 and rows["10"].year is None and rows["3"].people[0]["9107"] == "n" and rows["4"].people == []
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1-10", "11-10", "21-5"]
    assert load(spark, tmp_path, limit=4).count() == 4


def test_year_window_is_pushed_down(spark, tmp_path):
    df = load(spark, tmp_path).filter("year BETWEEN 2004 AND 2012 AND synopsis <> 's5'")
    assert sorted(int(r.acn) for r in df.collect()) == [4, 6, 7, 8, 9, 11, 12]
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = next(line for line in plan.splitlines() if "Filter" in line)
    assert "synopsis" in left and ">= 2004" not in left and "<= 2012" not in left  # Spark filters the rest only


def test_faults_of_the_search_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="option query"):
        spark.dataSource.register(search.data_source(StandIn(tmp_path)))
        spark.read.format("record_search").load().count()


def test_each_key_is_scored_once_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, asked = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "asked"
    asked.mkdir()
    folder = str(asked)

    def client(text):
        from pathlib import Path

        class Gone(Exception):
            status = 500

        n = len(list(Path(folder).glob(f"{text}-*"))) + 1
        (Path(folder) / f"{text}-{n}").touch()
        if text == "late" and n < 3 or text == "never":
            raise Gone
        if text == "bad":
            raise ValueError
        return text.upper()

    def put(*rows):
        spark.createDataFrame(rows, "id long, t string").coalesce(1).write.mode("append").parquet(source)

    def run(expected, retry_failed=False):
        rows = spark.readStream.schema("id long, t string").parquet(source)
        query = resume.score_once(rows, "id", "t", client, out, str(tmp_path / "cp"), retries=2, wait=1, retry_failed=retry_failed, every="200 milliseconds")
        end = time.time() + 120
        try:
            while time.time() < end:
                if query.exception():
                    raise query.exception()
                got = [tuple(r) for r in spark.read.schema("key long, response string, error_type string, tries int").parquet(out).collect()] if (tmp_path / "out" / "_spark_metadata").exists() else []
                if len(got) >= expected:
                    return sorted(got, key=str)
                time.sleep(0.5)
        finally:
            query.stop()
        raise AssertionError(got)

    put((1, "a"), (1, "a"), (2, "late"), (3, "bad"), (None, "x"))
    first = run(3)
    assert first == [(1, "A", "", 1), (2, "LATE", "", 3), (3, None, "ValueError", 1)]
    put((1, "a"), (2, "late"), (3, "bad"), (4, "never"), (5, "b"))
    again = run(5)
    assert again == sorted([*first, (4, None, "Gone", 3), (5, "B", "", 1)], key=str)
    assert len(list(asked.glob("a-*"))) == 1 and len(list(asked.glob("late-*"))) == 3 and len(list(asked.glob("bad-*"))) == 1
    put((3, "c"), (1, "a"))
    assert (3, "C", "", 1) in run(6, retry_failed=True)
