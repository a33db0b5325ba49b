"""A positional inverted index of texts, for the boolean query language.

Three tables make it up. `words` is the sorted dictionary; `postings` has a row for each
word and document with the word's places, sorted by word, so that a search reads the row
groups of its words only; `rows` numbers the documents. A word that stands in most
documents has as many postings, never one row that holds them all, and its range of
postings is cut by document.

A search reads the postings of its words, gathers them by document, in one shuffle, and
evaluates the query there: phrases and NEAR by merging lists of places.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import boolquery
from corvane.functions.boolquery import Node, Term


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, words) to a row for each of its distinct words, with its places."""
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            rows, words, lists = [], [], []
            for row, tokens in zip(b.column(0).slice(lo, 64).to_pylist(), b.column(1).slice(lo, 64).to_pylist(), strict=True):
                places: dict[str, list[int]] = {}
                for i, w in enumerate(tokens):
                    places.setdefault(w, []).append(i)
                rows += [row] * len(places)
                words += places
                lists += places.values()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.string()), pa.array(lists, pa.list_(pa.int32()))], names=["row", "word", "at"])


def _patterns(node: Node) -> list[str]:
    """Words and word patterns of the query, each once."""
    return list(dict.fromkeys(w for t in boolquery.leaves(node) for w in t.words))


def _holds_without_words(node: Node) -> bool:
    """Whether a document that has none of the query's words satisfies it."""
    if node.op == "not":
        return not _holds_without_words(node.parts[0])
    if node.op in ("and", "or"):
        return (all if node.op == "and" else any)(_holds_without_words(p) for p in node.parts)
    return False


class PositionalIndex:
    """The index in `folder`, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def build(self, df: DataFrame, key: str, text: str, parts: int | None = None) -> PositionalIndex:
        """Index the texts of df by `key`. Null and empty texts have no words, but are rows
        that a NOT finds; rows with equal or null keys are found each."""
        n = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        put = lambda d, name: d.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}")
        words = F.filter(F.split(boolquery.token_text(F.col(text)), " "), lambda w: w != "")
        put(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words.alias("words")), "texts")
        texts = self._table("texts")
        put(texts.select("row", "key"), "rows")
        lists = texts.select("row", "words").mapInArrow(_postings, "row long, word string, at array<int>")  # a row's words: no shuffle
        put(lists.repartitionByRange(n, "word", "row").sortWithinPartitions("word", "row"), "postings")
        counts = self._table("postings").groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("at")).alias("places"))
        put(counts.repartitionByRange(max(1, n // 8), "word").sortWithinPartitions("word"), "words")
        return self

    def words(self, pattern: str) -> DataFrame:
        """(word, docs, places) of the dictionary's words that match a pattern."""
        return self._table("words").filter(_matches(F.col("word"), pattern))

    def search(self, query: str | Node) -> DataFrame:
        """(key) of every document that satisfies the query."""
        node = boolquery.parse(query) if isinstance(query, str) else query
        patterns = _patterns(node)
        postings, word = self._table("postings"), F.col("word")
        # What begins with a letter is a range of the sorted postings. What does not is
        # looked up in the dictionary, whose words then select postings.
        ranged, loose = [p for p in patterns if not p.startswith("%")], [p for p in patterns if p.startswith("%")]
        wanted = F.lit(False)
        for p in ranged:
            wanted = wanted | _matches(word, p)
        hits = postings.filter(wanted)
        if loose:
            also = F.lit(False)
            for p in loose:
                also = also | _matches(word, p)
            hits = hits.unionByName(postings.filter(~wanted).join(self._table("words").filter(also).select("word"), "word", "left_semi"))
        names = {p: f"at{i}" for i, p in enumerate(patterns)}
        lists = [F.array_sort(F.flatten(F.collect_list(F.when(_matches(word, p), F.col("at"))))).alias(name) for p, name in names.items()]
        found = hits.groupBy("row").agg(*lists)
        none = _holds_without_words(node)
        every = self._table("rows").join(found, "row", "left" if none else "inner")
        empty = F.array().cast("array<int>")
        return every.filter(_holds(node, {p: F.coalesce(F.col(n), empty) for p, n in names.items()})).select("key")


def _matches(word: Column, pattern: str) -> Column:
    """Whether a word is the pattern's; the part before the first % is a range of words."""
    if "%" not in pattern:
        return word == pattern
    head = pattern.split("%")[0]
    whole = word.rlike(f"^{Term((pattern,)).regex()}$")
    if pattern == head + "%":
        return word.startswith(head)
    return word.startswith(head) & whole if head else whole


def _back(places: Column, k: int) -> Column:
    return F.transform(places, lambda x: x - k)


def _starts(term: Term, at: dict[str, Column]) -> Column:
    """Places where the term's words follow one another."""
    out = at[term.words[0]]
    for k, w in enumerate(term.words[1:], 1):
        out = F.array_intersect(out, _back(at[w], k))
    return out


def _holds(node: Node, at: dict[str, Column]) -> Column:
    if node.op == "term":
        return F.size(_starts(node.parts[0], at)) > 0
    if node.op == "not":
        return ~_holds(node.parts[0], at)
    if node.op == "near":
        return boolquery.every_pair(node, [_starts(t, at) for t in node.parts])
    out = _holds(node.parts[0], at)
    for part in node.parts[1:]:
        out = out | _holds(part, at) if node.op == "or" else out & _holds(part, at)
    return out
