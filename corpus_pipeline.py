"""Corpus pipeline: quality, line dedup, document dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Cases that hold for all stages: columns beyond those of documents are dropped, whatever
their names; nulls stand in any column; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, table, word_count
from corvane.llm.lines import dedup_lines
from corvane.llm.mixing import mix_sources
from corvane.llm.neardup_docs import ngram_links
from corvane.llm.packing import pack, words_of
from corvane.llm.quality import score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels.quality, does not reject. Null and
    empty texts are scored like a passage of zeros; repeated rows stay or go together; without
    labels of its rows the classifier is untrained, and scores of one half and more stay."""
    docs = _documents(docs)
    model = train(docs, table(spark, sf_dir, "labels"))
    return _documents(score(docs, model).filter("score >= 0.5"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones. A document that loses its last
    words by that goes; one that had none from the start stays. Of equal lines the one of
    the least id stays, a null id last; of rows that share an id and a text one; n_chars is
    counted anew where a line went."""
    out = dedup_lines(spark, _documents(docs))
    left = out.filter((F.col("n_removed") == 0) | (word_count("text") > 0))
    changed = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return _documents(left.withColumn("n_chars", changed))


def documents_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the least id. Of rows that
    share this id the one with the least hash stays, of equal rows one. Documents without
    words are no copies of one another."""
    docs = _documents(docs)
    ws = Workspace(spark)
    links = ws.save(ngram_links(spark, docs).select("doc_id", "row", "component"), "links")
    grouped = links.filter("component IS NOT NULL")
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    gone = ws.save(grouped.join(first, "component").filter("row != first.row").select("row").distinct(), "gone")
    twice = ws.save(grouped.groupBy("row").count().filter("count > 1").select("row"), "twice")
    ws.keep("gone", "twice")
    keyed = docs.withColumn("row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    left = keyed.join(gone.hint("shuffle_hash"), "row", "left_anti")
    if not twice.limit(1).collect():
        return _documents(left)
    once = left.join(twice, "row", "left_anti")
    return _documents(once).unionByName(_documents(left.join(twice, "row", "left_semi").dropDuplicates(["row"])))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Equal rows count together; a null source is
    a source; documents without words are never taken."""
    ws = Workspace(spark)
    docs = _documents(docs).withColumn("row", F.xxhash64(*COLUMNS))
    mix = mix_sources(spark, docs, id_col="row").select(F.col("doc_id").alias("row"), F.when(F.col("size") > 0, F.col("taken") / F.col("size")).cast("int").alias("times"))
    mix = ws.save(mix.filter("times > 0").groupBy("row").agg(F.sum("times").cast("int").alias("times"), F.count(F.lit(1)).alias("n")), "times")
    taken = docs.join(mix.hint("shuffle_hash"), "row")
    if mix.filter("n > 1").limit(1).collect():
        taken = taken.filter("n = 1").unionByName(taken.filter("n > 1").dropDuplicates(["row"]))
    return taken.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "times")).alias("__copy")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their words, bucket, batch and slot. A document
    without words is one piece of none, a repeated row is packed each time."""
    return pack(spark, _documents(docs), word_count("text"), tokens=words_of("text"), mark=" ")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", documents_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the knapsack are beyond SQL; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to packed pieces, each on what the one before kept."""
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.save(docs, f"stage-{i}")
    return docs
