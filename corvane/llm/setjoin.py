"""Parts of the exact set-similarity joins: rarity order, prefixes, postings, filters.

A set is an array of 63-bit token hashes. The order of tokens is: tokens that are not
known to be frequent, by hash, then the frequent ones, the rarest first. Any one order
gives right results; this one keeps frequent tokens out of prefixes. Two sets of n and
m tokens with Jaccard similarity >= t share a token of their prefixes, the first
n - ceil(t n) + 1 tokens. t is a fraction a / b, and all tests are in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import parallelism
from corvane.llm.vectors import runs
from corvane.llm.words import mix64

#: Frequent tokens that the order knows; the rest of them count as rare. This bounds
#: what is broadcast and changes only the amount of work.
HOT_TOKENS = 1 << 17
#: Sets that a token needs to be called frequent.
HOT_LEAST = 16
#: Tokens that a task holds before it hands them on.
FLUSH = 1 << 20
#: Sets that share a token up to which all their pairs are formed at once.
LIST = 8
#: Leaves of a star that one task verifies.
STAR = 1000
TOP = np.uint64(1 << 63)

Sets = tuple[np.ndarray, np.ndarray]  # keys of all sets one after another; offsets
#: From a record batch: (flat token hashes, owner of each, number of sets, row data).
Extract = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, int, object]]]


def prefix_length(n: np.ndarray, a: int, b: int) -> np.ndarray:
    return np.where(n > 0, n - -(-a * n // b) + 1, 0)


def needed(n: np.ndarray, m: np.ndarray, a: int, b: int) -> np.ndarray:
    """Least intersection of sets of n and m tokens with Jaccard >= a / b."""
    return -(-a * (n + m) // (a + b))


class Order:
    """The token order: known frequent tokens with their rank, the rarest first."""

    def __init__(self, tokens: list[int] = ()):
        ranked = np.array(tokens, dtype=np.uint64)
        self.at = np.argsort(ranked, kind="stable").astype(np.uint64)
        self.tokens = ranked[self.at.astype(np.int64)]
        self.some = np.zeros(1 << 20, dtype=bool)  # by top bits, so that few are looked up
        self.some[(self.tokens >> np.uint64(43)).astype(np.int64)] = True

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Tokens as numbers in the order; equal tokens have equal numbers."""
        keys = hashes >> np.uint64(1)
        if len(self.tokens) and len(keys):
            likely = np.flatnonzero(self.some[(keys >> np.uint64(43)).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.tokens, keys[likely]), len(self.tokens) - 1)
            known = self.tokens[i] == keys[likely]
            keys[likely[known]] = TOP + self.at[i[known]]
        return keys

    def plain(self, keys: np.ndarray) -> np.ndarray:
        """Token hashes of keys, in the order of the keys."""
        out = keys.copy()
        known = keys >= TOP
        if known.any():
            by_rank = np.empty_like(self.tokens)
            by_rank[self.at.astype(np.int64)] = self.tokens
            out[known] = by_rank[(keys[known] - TOP).astype(np.int64)]
        return out


def distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> Sets:
    """Sorted distinct keys of each of n owners."""
    order = np.argsort(keys)
    small = owner.astype(np.uint16) if n < 1 << 16 else owner
    order = order[np.argsort(small[order], kind="stable")]
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def distinct_runs(keys: np.ndarray, first: np.ndarray) -> Sets:
    """Sorted distinct keys of each run of keys; `first` holds the number of the first
    key of each run, with one entry more for the end."""
    keys = keys.copy()
    n = np.diff(first)
    many = np.flatnonzero(n > 1)
    for a, b in zip(first[many].tolist(), first[many + 1].tolist(), strict=True):
        keys[a:b].sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    new[first[:-1][n > 0]] = True
    return keys[new], np.concatenate([[0], np.cumsum(new)])[first]


def digests(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever the order of its tokens; 0 if empty."""
    keys, offsets = sets
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(keys + np.uint64(salt)), dtype=np.uint64)])
        out.append(sums[offsets[1:]] - sums[offsets[:-1]])
    return out[0], out[1]


def first_of(sets: Sets, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the flat keys, owner, position in its set) of the first `length` keys
    of each set."""
    owner = np.repeat(np.arange(len(length)), length)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    return sets[1][:-1][owner] + pos, owner, pos


def _blobs(bucket: np.ndarray, parts: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """One (bucket, columns one after another as bytes) for each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, parts = bucket[order], [p[order] for p in parts]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(at, np.append(at[1:], len(bucket)), strict=True):
        yield int(bucket[a]), b"".join(p[a:b].tobytes() for p in parts)


def _columns(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for raw in blobs:
        n, at = len(raw) // width, 0
        for c, k in zip(out, kinds, strict=True):
            c.append(np.frombuffer(raw, dtype=k, count=n, offset=at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(c) for c in out]


class Counter:
    """Counts tokens of a task's sets. Lots are added up before they are handed on."""

    #: Distinct tokens that a task holds.
    MOST = 1 << 20

    def __init__(self, buckets: int):
        self.shift = np.uint64(63 - max(0, buckets - 1).bit_length())
        self.tokens, self.size = [], 0
        self.known = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32))

    def add(self, tokens: np.ndarray) -> None:
        self.tokens.append(tokens)
        self.size += len(tokens)
        if self.size > FLUSH:
            self._pack()

    def _pack(self) -> None:
        if self.tokens:
            tokens, n = np.unique(np.concatenate(self.tokens), return_counts=True)
            tokens, n = np.concatenate([self.known[0], tokens]), np.concatenate([self.known[1], n.astype(np.uint32)])
            order = np.argsort(tokens, kind="stable")  # merges two sorted runs
            tokens, n = tokens[order], n[order]
            at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))[: len(tokens)]
            self.known = (tokens[at], np.add.reduceat(n, at).astype(np.uint32) if len(at) else n)
        self.tokens, self.size = [], 0

    @property
    def full(self) -> bool:
        return len(self.known[0]) > self.MOST

    def flush(self) -> Iterator[tuple[int, bytes]]:
        self._pack()
        tokens, n = self.known
        if len(tokens):
            yield from _blobs((tokens >> self.shift).astype(np.int64), [tokens, n])
        self.known = (tokens[:0], n[:0])


def frequent_tokens(blobs: DataFrame, least: int = HOT_LEAST, most: int = HOT_TOKENS) -> list[int]:
    """The `most` most frequent tokens of (bucket, blob) rows, the rarest of them first."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[bytes]) -> pa.RecordBatch:
            tokens, n = _columns(held, ("u8", "u4"))
            order = np.argsort(tokens)
            tokens, n = tokens[order], n[order].astype(np.int64)
            at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            total = np.add.reduceat(n, at)
            keep = total >= least
            return pa.RecordBatch.from_arrays([pa.array(tokens[at][keep].astype(np.int64)), pa.array(total[keep])], names=["token", "n"])

        now, held = None, []
        for (bucket,), rows in runs(batches, 1):
            if now is not None and bucket != now:
                yield close(held)
                held = []
            now = bucket
            held += rows.column(1).to_pylist()
        if held:
            yield close(held)

    spark = blobs.sparkSession
    dealt = blobs.repartition(parallelism(spark), "bucket").sortWithinPartitions("bucket")
    top = dealt.mapInArrow(add_up, "token long, n long").orderBy(F.desc("n"), "token").limit(most).collect()
    return [r[0] for r in reversed(top)]


class Postings:
    """Prefix tokens of a task's sets, dealt out by token, and memberships, by item."""

    def __init__(self, buckets: int):
        self.buckets = np.uint64(buckets)
        self.clear()

    def clear(self) -> None:
        self.parts, self.members, self.size = [], [], 0

    def belongs(self, item: np.ndarray, member: np.ndarray, n: np.ndarray) -> None:
        self.members.append((item, member, n.astype(np.uint32)))
        self.size += len(item)

    def add(self, keys: np.ndarray, item: np.ndarray, n: np.ndarray, pos: np.ndarray) -> None:
        self.parts.append((keys, item, n.astype(np.uint32), pos.astype(np.uint32)))
        self.size += len(keys)

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if self.parts:
            parts = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            yield from _blobs((mix64(parts[0]) % self.buckets).astype(np.int64), parts)
        if self.members:
            parts = [np.concatenate(c) for c in zip(*self.members, strict=True)]
            yield from _blobs((self.buckets + mix64(parts[0]) % self.buckets).astype(np.int64), parts)
        self.clear()


def pairs_of(item: np.ndarray, n: np.ndarray, pos: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Index pairs within runs of equal tokens that pass the length and the positional
    filter: what can still be shared before, at and after the token must suffice."""
    for k in np.unique(sizes):
        rows = starts[sizes == k]
        i, j = np.triu_indices(int(k), 1)
        step = max(1, (1 << 21) // len(i))
        for lo in range(0, len(rows), step):
            x = (rows[lo : lo + step, None] + i).ravel()
            y = (rows[lo : lo + step, None] + j).ravel()
            yield keep(item, n, pos, x, y, a, b)


def least_shared_sql(n: str, m: str, a: int, b: int) -> str:
    """SQL: least number of prefix tokens that a linked pair with n and m tokens shares."""
    p = lambda x: f"({x} - ({a} * {x} + {b - 1}) div {b} + 1)"
    return f"(({a} * ({n} + {m}) + {a + b - 1}) div {a + b}) - greatest({n} - {p(n)}, {m} - {p(m)})"


def keep(item: np.ndarray, n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...]:
    nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
    px, py = pos[x].astype(np.int64), pos[y].astype(np.int64)
    ok = (np.minimum(nx, ny) * b >= np.maximum(nx, ny) * a) & (item[x] != item[y])
    ok &= np.minimum(px, py) + np.minimum(nx - px, ny - py) >= needed(nx, ny, a, b)
    return x[ok], y[ok]


#: 64-bit words of a parity bitmap: bit i tells whether an odd number of tokens hash to
#: i. Sets that differ in x tokens have bitmaps that differ in x bits at most.
WORDS = 8
MAP = [f"b{i}" for i in range(WORDS)]


def bitmaps(sets: Sets) -> np.ndarray:
    """A row of WORDS numbers for each set."""
    keys, offsets = sets
    n, bits = len(offsets) - 1, 64 * WORDS
    own = np.repeat(np.arange(n), np.diff(offsets))
    odd = np.bincount(own * bits + (keys & np.uint64(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.uint64)


def hopeful(pairs: DataFrame, profiles: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs(a, b) whose sizes and bitmaps, from profiles(d, n, MAP), let them be
    similar."""
    of = lambda k: profiles.select(F.col("d").alias(k), F.col("n").alias(f"n{k}"), *[F.col(m).alias(f"{k}_{m}") for m in MAP])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MAP), F.lit(0))
    x, y = similar
    least = F.expr(f"({x} * (na + nb) + {x + y - 1}) div {x + y}")
    return both.filter((F.least("na", "nb") >= least) & (apart <= F.col("na") + F.col("nb") - 2 * least)).select("a", "b")


def bands(a: int, b: int, most: int = 1 << 31) -> list[int]:
    """Least sizes of bands of sizes, such that sets whose sizes differ by a factor of
    b / a at most are in the same or in neighbouring bands."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * b // a + 1)
    return out


#: Rows of a band that a task holds at once; a larger band is cut into slices.
SLICE = 4096


def list_pairs(a: int, b: int, nearest: bool, block: int = 512):
    """Pairs (a, b, apart) of one slice of a band of a long list that may be similar and
    are in different components. Rows (token, band, slice, guest, d, c, n, pos, MAP) are
    sorted by the first four; a guest comes from the band below or a later slice and
    meets the slice's own rows only. Pairs are looked at in blocks and filtered before
    any is given out: by size, by whether the token can be the first that both share,
    and by the bits in which their bitmaps differ. With `nearest`, each row gives the
    pair with the fewest such bits only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(apart)], names=["a", "b", "apart"])

        def likely(x: tuple, y: tuple, same: bool) -> Iterator[pa.RecordBatch]:
            dx, cx, nx, px, bx = x
            dy, cy, ny, py, by = y
            best, partner = np.full(len(dx), 1 << 30, dtype=np.int64), np.zeros(len(dx), dtype=np.int64)
            for lo in range(0, len(dx), block):
                for at in range(lo if same else 0, len(dy), 8 * block):
                    i, j = slice(lo, lo + block), slice(at, at + 8 * block)
                    n, m = nx[i, None], ny[None, j]
                    least = needed(n, m, a, b)
                    ok = (cx[i, None] != cy[None, j]) & (np.minimum(n, m) * b >= np.maximum(n, m) * a) & (px[i, None] <= n - least) & (py[None, j] <= m - least)
                    u, v = np.nonzero(ok)
                    if same:
                        u, v = u[lo + u < at + v], v[lo + u < at + v]
                    for s in range(0, len(u), 1 << 18):
                        p, q = lo + u[s : s + (1 << 18)], at + v[s : s + (1 << 18)]
                        apart = np.bitwise_count(bx[p] ^ by[q]).sum(1, dtype=np.int64)
                        good = apart <= nx[p] + ny[q] - 2 * needed(nx[p], ny[q], a, b)
                        p, q, apart = p[good], q[good], apart[good]
                        if not nearest:
                            if len(p):
                                yield pairs(dx[p], dy[q], apart)
                            continue
                        if same:
                            p, q, apart = np.append(p, q), np.append(q, p), np.append(apart, apart)
                        order = np.lexsort((dy[q], apart, p))
                        p, q, apart = p[order], q[order], apart[order]
                        head = np.append(True, p[1:] != p[:-1])[: len(p)]
                        p, q, apart = p[head], q[head], apart[head]
                        less = apart < best[p]
                        best[p[less]], partner[p[less]] = apart[less], dy[q[less]]
            found = np.flatnonzero(best < 1 << 30)
            if len(found):
                yield pairs(dx[found], partner[found], best[found])

        now, held, own = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, own
            if held:
                own, held = tuple(np.concatenate(c) for c in zip(*held, strict=True)), []
                yield from likely(own, own, True)

        for (token, band, part, guest), rows in runs(batches, 4):
            if now != (token, band, part):
                yield from close()
                now, own = (token, band, part), None
            some = (rows.column(4).to_numpy(), rows.column(5).to_numpy(), rows.column(6).to_numpy().astype(np.int64), rows.column(7).to_numpy().astype(np.int64), np.stack([c.to_numpy().view(np.uint64) for c in rows.columns[8:]], axis=1))
            if guest == 0:
                held.append(some)
                continue
            yield from close()
            if own is not None:
                yield from likely(some, own, False)
        yield from close()

    return run


def slices_of(listed: DataFrame) -> DataFrame:
    """(token, band, slices) of the bands of lists that are cut."""
    return listed.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices")).filter("slices > 1")


def meet_lists(listed: DataFrame, slices: DataFrame, maps: DataFrame, similar: tuple[int, int], nearest: bool, parts: int) -> DataFrame:
    """list_pairs() of listed(token, band, d, c, n, pos), with its slices_of() and bitmaps
    from maps(d, MAP). Each row stays in its slice of its band, visits the earlier slices,
    and all slices of the band above, so no task holds a whole list."""
    # Only lists that are cut need a row in slices: a small table, which is joined
    # without dealing out the lists by token.
    cut = lambda df: df.join(slices, ["token", "band"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = cut(listed).withColumn("own", F.pmod(F.xxhash64("d"), F.col("slices")))
    columns = ["token", "band", "slice", "guest", "d", "c", "n", "pos"]
    stay = own.select(*columns[:2], F.col("own").alias("slice"), F.lit(0).alias("guest"), *columns[4:])
    visit = own.filter("own > 0").select(*columns[:2], F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)).alias("slice"), F.lit(1).alias("guest"), *columns[4:])
    above = cut(listed.withColumn("band", F.col("band") + 1)).select(*columns[:2], F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("guest"), *columns[4:])
    met = maps.join(stay.unionByName(visit).unionByName(above).hint("shuffle_hash"), "d").select(*columns, *MAP)
    return met.repartition(parts, *columns[:3]).sortWithinPartitions(*columns[:4]).mapInArrow(list_pairs(*similar, nearest), "a long, b long, apart long")


def verify(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs(a, b) whose whole sets are similar. Each a meets its b's, in lots of
    about STAR, so neither a frequent a nor its set is multiplied by its pairs. Each set
    is read once and goes straight to the lots that need it."""
    spark = pairs.sparkSession

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, centre = None, np.zeros(0, dtype=np.uint64)
        for (a, lot, kind), rows in runs(batches, 3):
            if kind == 0:
                own, centre = (a, lot), np.frombuffer(rows.column(4)[0].as_py(), dtype=np.uint64)
                continue
            if own != (a, lot):
                continue
            good = []
            for b, raw in zip(rows.column(3).to_pylist(), rows.column(4), strict=True):
                other = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                least = needed(len(centre), len(other), *similar)
                if min(len(other), len(centre)) < least:
                    continue
                both = np.concatenate([centre, other])
                both.sort(kind="stable")  # merges two sorted runs
                if (both[1:] == both[:-1]).sum() >= least:
                    good.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(good), a, dtype=np.int64)), pa.array(np.array(good, dtype=np.int64))], names=["a", "b"])

    lots = pairs.groupBy("a").agg(F.floor(F.count(F.lit(1)) / STAR).cast("int").alias("lots"))
    centres = lots.select(F.col("a").alias("at"), "a", F.explode(F.sequence(F.lit(0), "lots")).alias("lot"), F.lit(0).alias("kind"), F.col("a").alias("b"))
    leaves = pairs.join(lots, "a").select(F.col("b").alias("at"), "a", F.pmod(F.xxhash64("b"), F.col("lots") + 1).cast("int").alias("lot"), F.lit(1).alias("kind"), "b")
    met = sets.join(centres.unionByName(leaves).hint("shuffle_hash"), sets.d == F.col("at")).select("a", "lot", "kind", "b", "tokens")
    return met.repartition(parallelism(spark), "a", "lot").sortWithinPartitions("a", "lot", "kind").mapInArrow(compare, "a long, b long")


#: kind 0: a pair (a, b) that shares a token, with sizes n and m. kind 1: item b with
#: size n is on the list of token a, which is too long for all pairs; m is the token's
#: position in it. kind 2: set b with
#: m tokens belongs to item a.
CANDIDATES = "kind int, a long, b long, n int, m int"


def candidates(a: int, b: int, buckets: int, most: int = LIST):
    """From (bucket, blob) rows sorted by bucket to CANDIDATES rows. Buckets from `buckets`
    on hold memberships, the others postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a_: np.ndarray, b_: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a_), kind, dtype=np.int32)), pa.array(a_.astype(np.int64)), pa.array(b_.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(m.astype(np.int32))], names=["kind", "a", "b", "n", "m"])

        def close(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            if now >= buckets:
                item, member, n = _columns(held, ("u8", "u8", "u4"))
                order = np.lexsort((member, item))
                item, member, n = item[order], member[order], n[order]
                new = np.append(True, (item[1:] != item[:-1]) | (member[1:] != member[:-1]))
                yield out(2, item[new], member[new], n[new], n[new])
                return
            keys, item, n, pos = _columns(held, ("u8", "u8", "u4", "u4"))
            order = np.lexsort((item, keys))
            keys, item, n, pos = keys[order], item[order], n[order], pos[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (item[1:] != item[:-1]))  # copies share one posting
            keys, item, n, pos = keys[new], item[new], n[new], pos[new]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(starts, len(keys)))
            some = (sizes > 1) & (sizes <= most)
            for x, y in pairs_of(item, n, pos, starts[some], sizes[some], a, b):
                if len(x):
                    s, t = item[x].astype(np.int64), item[y].astype(np.int64)
                    low = s < t
                    yield out(0, np.where(low, s, t), np.where(low, t, s), np.where(low, n[x], n[y]), np.where(low, n[y], n[x]))
            for lo, k in zip(starts[sizes > most], sizes[sizes > most], strict=True):
                i = np.arange(lo, lo + k)
                yield out(1, np.full(k, keys[lo].astype(np.int64)), item[i], n[i], pos[i])

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
