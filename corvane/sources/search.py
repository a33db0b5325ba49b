"""Record search with an injected transport, as a Spark data source and as functions.

The search gives record numbers for a query text; details are fetched in batches, one
partition each, so executors fetch in parallel and a lost one fetches its batches again.

    spark.dataSource.register(data_source(client))
    spark.read.format("record_search").option("query", "gate AND ramp").load().filter("year BETWEEN 2011 AND 2014")
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from corvane.functions.text import in_year_window
from corvane.operators.corpus import ranked_ids
from corvane.sources.files import RECORD

BATCH = 300
# The search request, in the interface's form; `text` is the query.
REQUEST = {
    "narrative": True,
    "synopsis": True,
    "callback": True,
    "searchRelatedWords": False,
    "fullformOnly": True,
    "abbreviatedOnly": False,
    "generalAviation": False,
    "uas": False,
    "eavs": [[] for _ in range(44)],
    "acns": "",
    "text": "",
    "locations": [],
    "stateProvinces": [],
    "makeModels": [],
}


def payload(text: str) -> dict:
    """The search request for a query text: narratives and synopses, full forms only."""
    return {**REQUEST, "text": text}


def search(post: Callable[[dict], object], text: str) -> list[int]:
    """Record numbers for a query; anything but a list is an error, items without a
    number are left out."""
    reply = post(payload(text))
    if not isinstance(reply, list):
        raise TypeError(f"the search gave {type(reply).__name__}, not a list")
    return [int(x["acn"]) for x in reply if isinstance(x, dict) and x.get("acn") not in (None, "")]


def details(spark: SparkSession, acns: DataFrame, fetch: Callable[[list[int]], list[dict]], size: int = BATCH, pause: float = 0.25) -> DataFrame:
    """Records of the numbers in column acn, fetched `size` at a time with a pause after
    each batch of a partition."""
    ids = ranked_ids(acns.select(F.col("acn").cast("long").alias("acn")), [F.col("acn")], "", 1, "n")
    batches = ids.groupBy(F.floor((F.col("n").cast("long") - 1) / size).alias("batch")).agg(F.sort_array(F.collect_list("acn")).alias("acns"))
    names = RECORD.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in frames:
            for acns in pdf["acns"]:
                rows = fetch([int(x) for x in acns])
                yield pd.DataFrame([{k: ([{"9107": p.get("9107"), "11330": p.get("11330")} for p in r.get("people") or []] if k == "people" else None if r.get(k) is None else str(r.get(k))) for k in names} for r in rows], columns=names)
                time.sleep(pause)

    return batches.select("acns").mapInPandas(run, RECORD)


def collect_query(spark: SparkSession, query_id: str, text: str, post, fetch, first_year: int, last_year: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records in the year window, their manifest) of one query."""
    found = search(post, text)[:limit]
    acns = spark.createDataFrame([(x,) for x in found], "acn long")
    records = details(spark, acns, fetch, pause=0).filter(in_year_window("dateOfOccurrence", first_year, last_year))
    listed = records.select(F.lit(query_id).alias("query_id"), "acn", F.col("dateOfOccurrence").alias("date_of_occurrence"), F.col("isAbbreviated").alias("is_abbreviated"), F.col("isGeneralAviation").alias("is_general_aviation"), F.col("isUas").alias("is_uas"), F.coalesce(F.size("people"), F.lit(0)).alias("people_count"), (F.coalesce("synopsis", F.lit("")) != "").cast("string").alias("has_synopsis"), F.lit("not_screened").alias("initial_screening_status"))
    return records, listed


def query_counts(spark: SparkSession, post, queries: dict[str, str], run_date: str, interface: str, window: str) -> DataFrame:
    """One row a query with its number of results and what was asked."""
    rows = [(q, run_date, interface, text, "full form only", window, "json", len(search(post, text)), 0, "") for q, text in queries.items()]
    return spark.createDataFrame(rows, "query_id string, run_date string, interface string, query_text string, fixed_filters string, date_window string, export_format string, result_count long, records_exported long, notes string")


#: A record with the year that its date begins with, by which reads are filtered.
SOURCE = T.StructType([*RECORD.fields, T.StructField("year", T.IntegerType())])
#: Filters on a column that a reader applies, as a test of the column's value.
_TESTS = {
    EqualTo: lambda v: lambda x: x == v,
    EqualNullSafe: lambda v: lambda x: x == v,
    GreaterThan: lambda v: lambda x: x is not None and x > v,
    GreaterThanOrEqual: lambda v: lambda x: x is not None and x >= v,
    LessThan: lambda v: lambda x: x is not None and x < v,
    LessThanOrEqual: lambda v: lambda x: x is not None and x <= v,
    In: lambda v: lambda x: x in v,
}


def record_row(record: dict) -> tuple:
    """A record of the interface as a row of SOURCE: values as text, the reports of its
    people, and the year of its date, null if it begins with no four digits."""
    text = lambda name: None if record.get(name) is None else str(record[name])
    people = [(p.get("9107"), p.get("11330")) for p in record.get("people") or []]
    values = [people if f.name == "people" else text(f.name) for f in RECORD.fields]
    date = (text("dateOfOccurrence") or "")[:4]
    return (*values, int(date) if len(date) == 4 and date.isascii() and date.isdigit() else None)


class Batch(InputPartition):
    """Record numbers that one task fetches."""

    def __init__(self, acns: list[int]):
        super().__init__(acns)


class SearchReader(DataSourceReader):
    def __init__(self, client, options: dict):
        self.client, self.tests = client, []
        get = {k.lower(): v for k, v in options.items()}.get
        self.text, self.size, self.retries, self.pause = get("query"), int(get("batch", BATCH)), int(get("retries", 3)), float(get("pause", 0.25))
        self.limit = None if get("limit") is None else int(get("limit"))
        if self.text is None:
            raise ValueError("the option query is missing")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the year or the number are applied where records are fetched."""
        for f in filters:
            make = _TESTS.get(type(f))
            if make and f.attribute in (("year",), ("acn",)) and f.value is not None:
                self.tests.append((f.attribute[0], make(f.value)))
            else:
                yield f

    def partitions(self) -> list[Batch]:
        found = list(dict.fromkeys(search(self.client.post, self.text)))[: self.limit]
        return [Batch(found[i : i + self.size]) for i in range(0, len(found), self.size)]

    def read(self, partition: Batch) -> Iterator[tuple]:
        import time

        from corvane.operators.models import retrying

        fetch = retrying(lambda acns: self.client.fetch(acns), self.retries, lambda s: time.sleep(s * self.pause))
        at = {f.name: i for i, f in enumerate(SOURCE.fields)}
        for record in fetch(partition.value)[0]:
            row = record_row(record)
            if all(test(row[at[name]]) for name, test in self.tests):
                yield row


def data_source(client) -> type[DataSource]:
    """The format record_search over a client with post(request) and fetch(numbers), which
    is sent to the executors. Options: query, batch (records a partition), limit, retries
    after errors of status 429 or 5xx, pause (seconds that the waits count in)."""

    class RecordSearch(DataSource):
        @classmethod
        def name(cls) -> str:
            return "record_search"

        def schema(self) -> T.StructType:
            return SOURCE

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return SearchReader(client, self.options)

    return RecordSearch
