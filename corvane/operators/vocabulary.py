"""A vocabulary as a distributed table: no term passes through the driver.

Terms are numbered by rank, the most frequent first: a range-partitioned sort with
offsets from counts. Texts look their terms up by shards of terms: a batch sends each shard
its distinct terms once, with their rows and counts, and the shard sends the entries on to
the rows. No term gets a task of its own, however frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import grams
from corvane.operators.corpus import ranks
from corvane.operators.features import tallied
from corvane.operators.folder import Folder
from corvane.operators.linear import FEATURES

#: Terms of least number, the frequent ones.
FREQUENT = 20_000
#: Entries that a shard of terms aims at, and rows of a batch of features.
SHARD, ROWS = 1 << 21, 512
_RAW = "shard int, raw binary"


def _bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(column: pa.ChunkedArray) -> pa.Table | None:
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in column]
    return pa.concat_tables(parts).combine_chunks() if parts else None


def _sent(shard: np.ndarray, shards: int, cut) -> pa.RecordBatch:
    """(shard, raw): what `cut` makes of the places of each shard."""
    order, ends = np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
    some = np.flatnonzero(np.diff(ends))
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_bytes(cut(order[ends[s] : ends[s + 1]])) for s in some], pa.binary())], names=["shard", "raw"])


def _mod(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(7)) % np.uint64(shards)).astype(np.int64)


def _dealt(kind, shards: int):
    """(row, words) to (shard, raw): distinct terms of a batch, each with rows and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grams.small(batches):
            ids = np.asarray(b.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for texts, term, row, tf in kind.count(b.column(1)):
                sizes = np.bincount(term, minlength=len(texts))
                starts = np.cumsum(sizes) - sizes

                def cut(mine: np.ndarray, texts=texts, row=row, tf=tf, sizes=sizes, starts=starts) -> pa.RecordBatch:
                    many = sizes[mine]
                    ends = np.cumsum(many)
                    each = np.arange(ends[-1]) + np.repeat(starts[mine] - (ends - many), many)
                    at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(at, pa.array(v)) for v in (ids[row[each]], tf[each].astype(np.int32))]
                    return pa.RecordBatch.from_arrays([texts.take(pa.array(mine)), *lists], names=["term", "rows", "tf"])

                yield _sent(_mod(grams.hashed(texts), shards), shards, cut)

    return run


def _known(shards: int):
    """(term, id, idf) dealt out as the terms of texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _sent(_mod(grams.hashed(b.column(0)), shards), shards, lambda mine, b=b: b.take(pa.array(mine)))

    return run


def _entries(shards: int):
    """Texts' and vocabulary's terms of a shard to entries, dealt out by rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, known = _read(left.column("raw")), _read(right.column("raw"))
        empty = pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["shard", "raw"])
        if texts is None or known is None:
            return empty
        place = pc.index_in(texts.column("term").combine_chunks(), value_set=known.column("term").combine_chunks())
        lists = texts.column("rows").combine_chunks()
        sizes = np.array(pc.list_value_length(lists), dtype=np.int64)
        some = np.repeat(np.array(place.is_valid()), sizes)
        at = np.repeat(np.array(pc.fill_null(place, 0)), sizes)[some]
        rows, tf = lists.flatten().to_numpy()[some], texts.column("tf").combine_chunks().flatten().to_numpy()[some]
        ids, w = known.column("id").to_numpy()[at].astype(np.int32), (1 + np.log(tf)) * known.column("idf").to_numpy()[at]
        if not len(rows):
            return empty
        to = _mod(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20), shards)
        return pa.Table.from_batches([_sent(to, shards, lambda mine: pa.RecordBatch.from_arrays([pa.array(rows[mine]), pa.array(ids[mine]), pa.array(w[mine])], names=["row", "id", "w"]))])

    return run


def _whole(out: str):
    """Entries to rows of unit length, in the order of their numbers."""

    def run(table: pa.Table) -> pa.Table:
        found = _read(table.column("raw"))
        rows, ids, w = (found.column(i).to_numpy() for i in range(3))
        order = np.lexsort([ids, rows])
        rows, ids, w = rows[order], ids[order], w[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        sizes = np.diff(starts, append=len(rows))
        w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), sizes)
        batches, ends = [], np.append(starts, len(rows))
        for lo in range(0, len(starts), ROWS):
            cut = ends[lo : lo + ROWS + 1]
            at, whole = pa.array((cut - cut[0]).astype(np.int32)), slice(cut[0], cut[-1])
            lists = [pa.ListArray.from_arrays(at, pa.array(x[whole])) for x in (ids, w)]
            batches.append(pa.RecordBatch.from_arrays([pa.array(rows[cut[:-1]]), pa.StructArray.from_arrays(lists, names=["indices", "values"])], names=["row", out]))
        return pa.Table.from_batches(batches)

    return run


class Vocabulary:
    """Terms of the frame it is fitted on with id, df, tf and idf. Of terms in `min_df` rows
    at least and a share of `max_df` at most, the `size` of highest count, ties to the
    smaller term; ids ascend from `first` by falling count."""

    def __init__(self, terms: Column, folder: Folder, name: str = "terms", min_df: int = 2, max_df: float = 0.95, size: int | None = None, first: int = 0):
        self.kind, self.folder, self.name, self.min_df, self.max_df, self.most, self.first = grams.of(terms), folder, name, min_df, max_df, size, first

    def fit(self, df: DataFrame) -> Vocabulary:
        """Fit on df, which has a number `row` for each row."""
        n = df.count()
        found = df.select(self.kind.words.alias("words")).mapInArrow(tallied(self.kind), "term string, tf long, df long")
        stats = found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter((F.col("df") >= self.min_df) & (F.col("df") <= self.max_df * n))
        stats = self.folder.table(f"{self.name}-counts", lambda: stats)
        ranked = ranks(stats, [F.desc("tf"), F.asc("term")], "rank")
        if self.most is not None:
            ranked = ranked.filter(F.col("rank") <= self.most)
        weighed = ranked.select("term", (F.col("rank") - 1 + self.first).alias("id"), "df", "tf", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
        self.table = self.folder.table(self.name, lambda: weighed)
        self.size = self.table.count()
        return self

    def rows(self, df: DataFrame, out: str = "features") -> DataFrame:
        """(row, out) of df with number `row`: sublinear TF-IDF of length one, as FEATURES.
        Rows without a known term have no entry."""
        words = df.select("row", self.kind.words.alias("words"))
        size = self.table.agg(F.sum("df")).first()[0] or 0  # about the entries
        shards = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
        texts = words.mapInArrow(_dealt(self.kind, shards), _RAW).repartition(shards, "shard")
        known = self.table.select("term", "id", "idf").mapInArrow(_known(shards), _RAW).repartition(shards, "shard")
        entries = texts.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_entries(shards), _RAW)
        return entries.repartition(shards, "shard").groupBy("shard").applyInArrow(_whole(out), f"row long, `{out}` {FEATURES}")
