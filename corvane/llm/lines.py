"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity; lines meet through the
words of their prefixes; length, positional and bitmap filters drop pairs that cannot
be similar; the rest is verified on whole sets. A line that is similar to a line before
it is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import setjoin
from corvane.llm.common import WORD, Workspace, clear_name, parallelism, table
from corvane.llm.setjoin import FLUSH, distinct_runs, first_of, needed, prefix_length, verify
from corvane.llm.vectors import runs
from corvane.llm.words import Hasher, chunks

SIMILAR = (4, 5)
#: Rows of a posting list that are compared with as many others at once.
BLOCK = 1024
#: Likely partners that a line gets from one list in the first round.
NEAREST = 4
#: Words are counted by the top bits of their hashes, in numbers of a fixed size; a
#: word's count is that of all words with these bits. The order needs no exact counts.
COUNTERS = 20
#: Slices in which the counters of all tasks are added up.
SLICES = 64
FIRST, NONE = np.iinfo(np.int64).min, np.zeros(0, dtype=np.int64)


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each line and the end, number of each text's first line and the
    end). Lines end at U+000A; a text has one more than it has such characters."""
    feeds = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    head = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    return np.append(begin, len(data)), head


class Texts:
    """Lines of a run of texts: `hashes` of all words, `words` the number of each line's
    first word, `head` the number of each text's first line, `own` and `line` the text
    of each line and its place there, `digest` that of its words in order."""

    def __init__(self, hasher: Hasher, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        starts, _, self.hashes, _ = hasher.words(data, offsets)
        begin, self.head = split_lines(data, offsets)
        # A text that ends in a line feed has an empty last line where the next begins.
        self.words = np.searchsorted(starts, begin)
        self.words[-1] = len(starts)
        self.digest = hasher.sequences(self.hashes, self.words)
        self.own = np.repeat(np.arange(lo, hi), np.diff(self.head))
        self.line = np.arange(len(self.own)) - self.head[self.own - lo]


def _blob_rows(kind: int, blobs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows = list(blobs)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["kind", "bucket", "blob"])


def _dealt(bucket: np.ndarray, parts: list[np.ndarray]) -> pa.RecordBatch:
    """(bucket, blob) as of setjoin._blobs, each column copied once, into one buffer."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    width = sum(p.itemsize for p in parts)
    raw, done = np.empty(width * len(bucket), dtype=np.uint8), at[:-1] * width
    for p in parts:
        moved, size = p[order].view(np.uint8), p.itemsize
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            raw[done[k] : done[k] + (b - a) * size] = moved[a * size : b * size]
        done = done + np.diff(at) * size
    ends = pa.py_buffer((at * width).astype(np.int32))
    blobs = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends, pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].astype(np.int32)), blobs], names=["bucket", "blob"])


PLACES = ("u8", "i8", "i8", "u4")


def describe(buckets: int):
    """kind 0: places of lines with words, (digest, id, row, line), dealt out by digest;
    kind 1: word counters, in slices; kind 2: hashes of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size, seen = Hasher(), [], 0, []
        counts = np.zeros(1 << COUNTERS, dtype=np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield from _blob_rows(0, setjoin._blobs((parts[0] % np.uint64(buckets)).astype(np.int64), parts))

        for batch in batches:
            ids, rows = pc.fill_null(batch.column(0), FIRST).to_numpy(), batch.column(1).to_numpy()
            seen.append(rows)
            for lo, hi, data, offsets in chunks(batch.column(2)):
                t = Texts(hasher, lo, hi, data, offsets)
                counts += np.bincount((t.hashes >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
                use = np.flatnonzero(np.diff(t.words))
                held.append((t.digest[use], ids[t.own[use]], rows[t.own[use]], t.line[use].astype(np.uint32)))
                size += len(use)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
            if sum(map(len, seen)) > FLUSH:
                yield from _blob_rows(2, [(0, np.concatenate(seen).tobytes())])
                seen = []
        if held:
            yield from flush()
        if seen:
            yield from _blob_rows(2, [(0, np.concatenate(seen).tobytes())])
        if counts.any():
            some = np.flatnonzero(counts)
            yield from _blob_rows(1, setjoin._blobs(some * SLICES >> COUNTERS, [some.astype(np.uint32), counts[some]]))

    return run


def levels(blobs: DataFrame) -> np.ndarray:
    """For each counter how frequent its words are, 0 (once) to 255, in steps of 15 %."""

    def add_up(key: tuple, pdf):
        some, n = setjoin._columns([bytes(x) for x in pdf["blob"]], ("u4", "i8"))
        low = key[0] * (1 << COUNTERS) // SLICES
        total = np.bincount(some.astype(np.int64) - low, n, (1 << COUNTERS) // SLICES)
        level = np.minimum(255, np.log2(np.maximum(total, 1)) * 5).astype(np.uint8)
        return pdf[:1].assign(bucket=key[0], blob=[level.tobytes()])

    out = np.zeros(1 << COUNTERS, dtype=np.uint8)
    size = len(out) // SLICES
    for bucket, raw in blobs.groupBy("bucket").applyInPandas(add_up, "bucket int, blob binary").collect():  # a megabyte
        out[bucket * size : (bucket + 1) * size] = np.frombuffer(raw, dtype=np.uint8)
    return out


def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, line) of the lines that have an equal line before them, from places dealt
    out by digest. Rows that are equal count as one."""

    def close(held: list[bytes]) -> pa.RecordBatch:
        d, ids, rows, line = setjoin._columns(held, PLACES)
        order = np.argsort(d, kind="stable")
        some = np.zeros(len(d), dtype=bool)  # digests that stand more than once
        some[1:] = d[order][1:] == d[order][:-1]
        some[:-1] |= some[1:]
        order = order[some]
        order = order[np.lexsort((rows[order], line[order], ids[order], d[order]))]
        d, rows, line = d[order], rows[order], line[order]
        start = np.append(True, d[1:] != d[:-1])[: len(d)]
        first = np.flatnonzero(start)[np.cumsum(start) - 1]
        later = (rows != rows[first]) | (line != line[first])
        return pa.RecordBatch.from_arrays([pa.array(rows[later]), pa.array(line[later].astype(np.int32))], names=["row", "line"])

    now, held = None, []
    for (bucket,), rows in runs(batches, 1):
        if now is not None and bucket != now:
            yield close(held)
            held = []
        now = bucket
        held += rows.column(1).to_pylist()
    if held:
        yield close(held)


POSTINGS = ("u8", "u8", "u8", "u8", "u4", "u4", "i8", "i8", "u4")
#: Residues of hashes by which the second round picks words and lines: a bounded list
#: for any input. More of them than needed may match, which costs work only.
RESIDUES = 1 << 18


def ordered_words(t: Texts, level: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line, the rarest first, as numbers: level, then hash. With
    `chosen`, lines without a word of those residues have none."""
    keys, first = (level[(t.hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (t.hashes >> np.uint64(8)), t.words
    if chosen is not None:
        found = np.concatenate([[0], np.cumsum(chosen[(keys % np.uint64(RESIDUES)).astype(np.int64)])])
        n, left = np.diff(first), found[first[1:]] > found[first[:-1]]
        keys, first = keys[first[0] :][np.repeat(left, n)], np.concatenate([[0], np.cumsum(np.where(left, n, 0))])
    return distinct_runs(keys, first)


def post(similar: tuple[int, int], buckets: int, level: np.ndarray, words: list[int] | None = None):
    """(bucket, blob) of the prefix words of each line: word, line's digest, parity
    bitmap of its words in two numbers, its size, the word's position, and the line's
    place (id, row, line). With `words`, only of words with those residues."""
    chosen = None if words is None else np.isin(np.arange(RESIDUES), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(c) for c in zip(*held, strict=True)]
            if len(parts[0]):
                yield _dealt((parts[0] % np.uint64(buckets)).astype(np.int64), parts)

        for batch in batches:
            ids, rows = pc.fill_null(batch.column(0), FIRST).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in chunks(batch.column(2)):
                t = Texts(hasher, lo, hi, data, offsets)
                keys, at = ordered_words(t, level, chosen)
                n = np.diff(at)
                use = np.flatnonzero(n)
                if not len(use):
                    continue
                use = use[np.argsort(t.digest[use], kind="stable")]  # of equal lines side by side one
                some = use[np.append(True, t.digest[use][1:] != t.digest[use][:-1])]
                some = some if len(some) == len(use) else _earliest(t, use, ids, rows)
                p = np.zeros(len(n), dtype=np.int64)
                p[some] = prefix_length(n[some], *similar)
                place, own, pos = first_of((keys, at), p)
                # A word that stands once in all texts is shared by none.
                shared = keys[place] >> np.uint64(56) > 0
                if chosen is not None:
                    shared &= chosen[(keys[place] % np.uint64(RESIDUES)).astype(np.int64)]
                place, own, pos = place[shared], own[shared], pos[shared]
                bit, second = np.uint64(1) << ((keys >> np.uint64(1)) & np.uint64(63)), (keys & np.uint64(1)).astype(bool)
                maps = []
                for half in (~second, second):
                    flags = np.zeros(len(n), dtype=np.uint64)
                    filled = np.flatnonzero(n)
                    flags[filled] = np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), at[:-1][filled])
                    maps.append(flags[own])
                text = t.own[own]
                held.append((keys[place], t.digest[own], *maps, n[own].astype(np.uint32), pos.astype(np.uint32), ids[text], rows[text], t.line[own].astype(np.uint32)))
                size += len(place)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _earliest(t: Texts, use: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of lines with equal digests the earliest."""
    use = use[np.lexsort((rows[t.own[use]], t.line[use], ids[t.own[use]], t.digest[use]))]
    return use[np.append(True, t.digest[use][1:] != t.digest[use][:-1])]


#: kind 0: line b may be similar to the earlier line a; their rows and places in these.
#: kind 1: line b has more such partners on the list of word a.
PARTNERS = "kind int, a long, b long, a_row long, a_line int, b_row long, b_line int"


def meet(similar: tuple[int, int], late: list[int] | None = None):
    """From postings sorted by bucket to PARTNERS rows: for each line and word, of the
    earlier lines that may be similar the NEAREST whose bitmaps are nearest. With
    `late`, for lines whose digests have those residues all of them, and for no others.
    A group of k similar lines gives some k rows for a word, not all its pairs."""
    a, b = similar
    flagged = None if late is None else np.isin(np.arange(RESIDUES), late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            token, d, one, two, n, pos, ids, rows, line = setjoin._columns(held, POSTINGS)
            # Classes of equal lines, in the order of their earliest places.
            order = np.argsort(d, kind="stable")
            new = np.append(True, d[order][1:] != d[order][:-1])
            start, number = np.flatnonzero(new), np.cumsum(new) - 1
            lead = order[start]
            best = np.ones(len(order), dtype=bool)
            first = []
            for column, top in ((ids, np.iinfo(np.int64).max), (line.astype(np.int64), np.iinfo(np.int64).max), (rows, np.iinfo(np.int64).max)):
                least = np.minimum.reduceat(np.where(best, column[order], top), start)
                best &= column[order] == least[number]
                first.append(least)
            turn = np.lexsort((first[2], first[1], first[0]))
            rank = np.empty(len(turn), dtype=np.int64)
            rank[turn] = np.arange(len(turn))
            c = np.empty(len(order), dtype=np.int64)
            c[order] = rank[number]
            digest, maps, size = d[lead][turn].astype(np.int64), (one[lead][turn], two[lead][turn]), n[lead][turn].astype(np.int64)
            row_of, line_of = first[2][turn], first[1][turn].astype(np.int32)
            # Lists in the order of places; copies share one posting.
            order = np.lexsort((c, token))
            token, c, pos = token[order], c[order], pos[order].astype(np.int64)
            new = np.append(True, (token[1:] != token[:-1]) | (c[1:] != c[:-1]))
            token, c, pos = token[new], c[new], pos[new]

            def likely(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """(x, y, differing bits) of the pairs that pass all filters; x is earlier."""
                if flagged is not None:
                    go = flagged[digest[c[y]].astype(np.uint64) % np.uint64(RESIDUES)]
                    x, y = x[go], y[go]
                nx, ny = size[c[x]], size[c[y]]
                ok = np.minimum(nx, ny) * b >= np.maximum(nx, ny) * a
                x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
                least = needed(nx, ny, a, b)
                # The word can be the first that both share, and few enough words can differ.
                ok = (pos[x] <= nx - least) & (pos[y] <= ny - least)
                x, y, spare = x[ok], y[ok], (nx + ny - 2 * least)[ok]
                apart = np.bitwise_count(maps[0][c[x]] ^ maps[0][c[y]]).astype(np.int64) + np.bitwise_count(maps[1][c[x]] ^ maps[1][c[y]])
                ok = apart <= spare
                return x[ok], y[ok], apart[ok]

            def out(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
                more, word = NONE, NONE
                if flagged is None and len(y):
                    order = np.lexsort((x, apart, y))
                    x, y = x[order], y[order]
                    new = np.append(True, y[1:] != y[:-1])
                    turn = np.arange(len(y)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                    over = y[turn == NEAREST]
                    more, word = c[over], token[over].astype(np.int64)
                    x, y = x[turn < NEAREST], y[turn < NEAREST]
                i, j = c[x], c[y]
                none = np.zeros(len(more), dtype=np.int64)
                columns = (np.append(np.zeros(len(i), dtype=np.int32), np.ones(len(more), dtype=np.int32)), np.append(digest[i], word), np.append(digest[j], digest[more]), np.append(row_of[i], none), np.append(line_of[i], none.astype(np.int32)), np.append(row_of[j], none), np.append(line_of[j], none.astype(np.int32)))
                return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["kind", "a", "b", "a_row", "a_line", "b_row", "b_line"])

            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            sizes = np.diff(np.append(starts, len(token)))
            for k in np.unique(sizes[(sizes > 1) & (sizes <= BLOCK)]):
                at = starts[sizes == k]
                i, j = np.triu_indices(int(k), 1)
                step = max(1, (1 << 20) // len(i))
                for lo in range(0, len(at), step):
                    yield out(*likely((at[lo : lo + step, None] + i).ravel(), (at[lo : lo + step, None] + j).ravel()))
            for at, k in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK], strict=True):
                for lo in range(0, k, BLOCK):
                    hi = min(k, lo + BLOCK)
                    found = []
                    for early in range(0, hi, BLOCK):
                        x, y = np.meshgrid(np.arange(early, min(hi, early + BLOCK)), np.arange(lo, hi), indexing="ij")
                        go = x < y
                        found.append(likely(at + x[go], at + y[go]))
                    yield out(*(np.concatenate(v) for v in zip(*found, strict=True)))

        now, held = None, []
        for (bucket,), rows in runs(batches, 1):
            if now is not None and bucket != now:
                yield from close(held)
                held = []
            now = bucket
            held += rows.column(1).to_pylist()
        if held:
            yield from close(held)

    return run


def wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, sorted word hashes) of the line numbers listed with each text."""
    hasher = Hasher()
    for batch in batches:
        lines = batch.column(1).to_pylist()
        for lo, hi, data, offsets in chunks(batch.column(0)):
            begin, head = split_lines(data, offsets)
            use = np.array([head[i] + x for i in range(hi - lo) for x in lines[lo + i]], dtype=np.int64)
            if not len(use):
                continue
            parts = [data[begin[i] : begin[i + 1]] for i in use]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            _, _, hashes, first = hasher.words(np.concatenate(parts), at)
            d = hasher.sequences(hashes, first)
            keys, ends = distinct_runs(hashes, first)
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int64)), pa.array([keys[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["d", "tokens"])


def dedup_lines(spark: SparkSession, docs: DataFrame, similar: tuple[int, int] = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the text without its removed lines, n_lines and
    n_removed.

    Lines are ordered by id, then by place in the text, then by a hash of id and text. A
    line with words (A-Z in lower case) is removed if the Jaccard similarity of its word
    set to that of an earlier line is at least similar[0] / similar[1], whether or not
    that line is removed itself. Lines without a word stay: they have no set to compare.
    The lines that remain are joined by line feeds. Lines of equal words in equal order
    are one class and joined once. Words are told apart by 56-bit hashes in the join and
    64-bit hashes in the check, classes by 64-bit digests.

    Cases: a null text stays null, with no lines; null ids come first; of rows that
    repeat an id and a text one counts as the earliest and the others lose all lines
    with words; rows that share an id only are two documents; texts are read whole,
    however long; no rows, no result; columns n_lines and n_removed are replaced, other
    columns may have any names.
    """
    ws = Workspace(spark)
    parts = parallelism(spark)
    buckets = max(64, 2 * parts)
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept_columns])
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = "kind int, bucket int, blob binary"
    base.mapInArrow(describe(buckets), schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{ws.root}/described")
    described = lambda kind: spark.read.schema(schema).parquet(f"{ws.root}/described").filter(F.col("kind") == kind).select("bucket", "blob")
    level = levels(described(1))
    equal = ws.save(described(0).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(copies, "row long, line int").distinct(), "equal")
    repeated = ws.save(described(2).mapInArrow(_row_hashes, "row long").groupBy("row").count().filter("count > 1").select("row"), "repeated")
    ws.drop("described")

    def exchange(name: str, words: list[int] | None = None, lines: list[int] | None = None) -> None:
        posted = base.mapInArrow(post(similar, buckets, level, words), "bucket int, blob binary")
        met = posted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet(similar, lines), PARTNERS)
        met.write.partitionBy("kind").option("compression", "zstd").parquet(f"{ws.root}/{name}")
        del posted, met
        ws.release()

    def partners(name: str, kind: int) -> DataFrame:
        return spark.read.schema(PARTNERS).parquet(f"{ws.root}/{name}").filter(F.col("kind") == kind).drop("kind").distinct()

    def similar_lines(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, b_row, b_line) of the pairs whose word sets are similar, from sets read
        again from their texts."""
        places = pairs.select(F.col("a_row").alias("row"), F.col("a_line").alias("line")).union(pairs.select("b_row", "b_line")).groupBy("row").agg(F.collect_set("line").alias("lines"))
        sets = base.select("row", "text").join(places.hint("shuffle_hash"), "row").select("text", "lines").mapInArrow(wanted_sets, "d long, tokens binary")
        sets = ws.save(sets.dropDuplicates(["d"]), f"{name}-sets")
        ws.release()
        good = verify(pairs.select("a", "b"), sets, similar)
        out = ws.save(pairs.join(good, ["a", "b"]).select("b", "b_row", "b_line").distinct(), f"{name}-similar")
        ws.drop(f"{name}-sets")
        ws.release()
        return out

    # First round: the likeliest earlier partners on each list.
    exchange("met")
    pairs = ws.save(partners("met", 0), "pairs")
    done = similar_lines(pairs, "first")
    # Second round: lines that have other partners and matched none so far.
    open_ = ws.save(partners("met", 1).select("a", "b").join(done, "b", "left_anti"), "open")
    residues = lambda c: [r[0] for r in open_.select(F.pmod(F.col(c), F.lit(RESIDUES)).alias("r")).distinct().collect()]  # noqa: E731  RESIDUES rows at most
    words, lines_left = residues("a"), residues("b")
    late = done
    if lines_left:
        exchange("met-2", words, lines_left)
        rest = partners("met-2", 0).join(open_.select("b").distinct(), "b", "left_semi").join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        rest = ws.save(rest, "rest")
        late = done.unionByName(similar_lines(rest, "second"))

    gone = late.select(F.col("b_row").alias("row"), F.col("b_line").alias("line")).union(equal).groupBy("row").agg(F.collect_set("line").alias("gone"))
    gone = ws.save(gone, "gone")
    for name in ("met", "met-2", "pairs", "first-similar", "second-similar", "open", "rest", "equal"):
        ws.drop(name)
    ws.release()
    return _without(docs, kept_columns, row, gone, repeated, text_col, ws)


def _row_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(1).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, dtype=np.int64))], names=["row"])


def _without(docs: DataFrame, names: list[str], row: Column, gone: DataFrame, repeated: DataFrame, text_col: str, ws: Workspace) -> DataFrame:
    """docs with the lines of `gone` taken out, and all lines with words taken out of
    rows that repeat another."""
    key, own = clear_name(names, "row"), clear_name(names, "gone")
    keyed = docs.withColumn(key, row)
    listed = gone.select(F.col("row").alias(key), F.col("gone").alias(own))
    lines = F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1)

    cut, kept = clear_name(names, "lines"), clear_name(names, "kept")

    def rows(df: DataFrame, every: Column) -> DataFrame:
        is_null = F.col(f"`{text_col}`").isNull()
        # Each step is used more than once, so it is a column before the next; n_lines of
        # texts that keep all lines is counted without cutting them.
        df = df.withColumn(cut, F.when(every | F.col(own).isNotNull(), lines))
        left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(own))
        # The struct binds the lines, which a lambda would compute again for each index.
        some = F.transform(F.array(F.struct(F.col(cut).alias("lines"), left.alias("left"))), lambda x: F.transform(x["left"], lambda i: F.get(x["lines"], i)))[0]
        df = df.withColumn(kept, F.when(every, F.filter(cut, lambda x: ~x.rlike(WORD))).when(F.col(own).isNotNull(), some))
        text = F.col(f"`{text_col}`").cast("string")
        feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
        text = F.when(F.col(kept).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
        n_lines, n_removed = F.coalesce(feeds + 1, F.lit(0)), F.coalesce(F.size(cut) - F.size(kept), F.lit(0))
        return df.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], F.when(is_null, 0).otherwise(n_lines).cast("long").alias("n_lines"), F.when(is_null | F.col(kept).isNull(), 0).otherwise(n_removed).cast("long").alias("n_removed"))

    if not repeated.limit(1).collect():
        return rows(keyed.join(listed.hint("shuffle_hash"), key, "left"), F.lit(False))
    twice = repeated.select(F.col("row").alias(key))
    once = rows(keyed.join(twice, key, "left_anti").join(listed.hint("shuffle_hash"), key, "left"), F.lit(False))
    at, first = clear_name(names, "at"), clear_name(names, "first")
    saved = ws.save(keyed.join(twice, key, "left_semi"), "twice").withColumn(at, F.struct("_metadata.file_name", "_metadata.row_index"))
    firsts = saved.groupBy(key).agg(F.min(at).alias(first))
    ranked = saved.join(firsts, key).join(listed, key, "left")
    return once.unionByName(rows(ranked, F.col(at) != F.col(first)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat earlier ones: id, counts, and the
    digest and length of the text that is left."""
    out = dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
_SQL = """
WITH l AS (
  SELECT doc_id, i, line, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM documents)
), sets AS (SELECT list_sort(w) AS s, min((doc_id, i)) AS at_ FROM l WHERE len(w) > 0 GROUP BY ALL), c AS MATERIALIZED (SELECT row_number() OVER () AS k, s, at_, len(s) AS n FROM sets),
words AS MATERIALIZED (SELECT k, n, unnest(s) AS t FROM c), often AS (SELECT t, count(*) AS f FROM words GROUP BY t),
placed AS (SELECT k, n, words.t, row_number() OVER (PARTITION BY k ORDER BY f, words.t) AS p FROM words JOIN often ON words.t = often.t),
prefix AS MATERIALIZED (SELECT k, n, t FROM placed WHERE p <= n - ceil(0.8 * n) + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a.k AS x, b.k AS y FROM prefix a JOIN prefix b ON a.t = b.t AND a.k <> b.k AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
late AS (SELECT DISTINCT y AS k FROM pairs JOIN c a ON a.k = x JOIN c b ON b.k = y WHERE a.at_ < b.at_ AND 9 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n)),
gone AS (SELECT l.doc_id, l.i FROM l JOIN c ON list_sort(l.w) = c.s LEFT JOIN late ON c.k = late.k WHERE late.k IS NOT NULL OR c.at_ <> (l.doc_id, l.i)),
left_ AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (g.i IS NOT NULL) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS t FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS n_chars_left, sha256(t) AS text_sha256 FROM documents d LEFT JOIN left_ ON d.doc_id = left_.doc_id
"""
ORACLE_SQL = {"op7_line_dedup": _SQL}
