"""N-gram Jaccard join by a grouped prefix join.

Documents are sets of word shingles. Equal sets are one class. Classes with the same
prefix and size are collapsed into one group; groups are joined through the tokens of
their prefixes, and pairs of groups are filtered by length, position and the number of
prefix tokens that they share; groups are then expanded, filtered by bitmaps of their sets and
verified on their whole sets.

Components are what is asked for, so a pair that is known to be connected already
needs no check: first each group is checked against one partner, then only pairs
between different components are. No link between different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import setjoin
from corvane.llm.common import Workspace, parallelism, table
from corvane.llm.graph import components
from corvane.llm.setjoin import FLUSH, MAP, Counter, Order, Postings, bands, bitmaps, candidates, digests, distinct_runs, first_of, hopeful, prefix_length, verify
from corvane.llm.words import Hasher, chunks, mix64

SHINGLE = 5
#: Similarity from which two documents link, as a fraction.
SIMILAR = (4, 5)


def _shingled(texts: pa.Array, hasher: Hasher, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, shingle hashes, number of the first of each
    text and the end), with repeats."""
    factor = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for lo, hi, data, offsets in chunks(texts):
        _, _, hashes, first = hasher.words(data, offsets)
        n = np.diff(first)
        every = np.zeros(len(hashes), dtype=np.uint64)  # of the k words from each word on
        for j in range(min(k, len(hashes))):
            every[: len(hashes) - j] += hashes[j:] * factor[j]
        every += np.uint64(k)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        at = np.concatenate([[0], np.cumsum(count)])
        start = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
        out = every[start]
        for i in np.flatnonzero((n > 0) & (n < k)):
            out[at[i]] = (hashes[first[i] : first[i + 1]] * factor[: n[i]]).sum(dtype=np.uint64)
            out[at[i] : at[i] + 1] += np.uint64(n[i])
        yield lo, hi, mix64(out), at


def describe(k: int, similar: tuple[int, int], buckets: int):
    """kind 0: (doc_id, row, n, d, MAP), d the digest of the set and MAP its bitmap; kind
    1: counts of the tokens that a prefix in the order of hashes alone would hold."""
    names = ["kind", "doc_id", "row", "n", "d", *MAP, "bucket", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counter = Hasher(), Counter(buckets)
        none = pa.nulls(1, pa.int64())

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, raw in counter.flush():
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *[none] * (4 + len(MAP)), pa.array([bucket], pa.int32()), pa.array([raw], pa.binary())], names=names)

        for batch in batches:
            for lo, hi, hashes, at in _shingled(batch.column(2), hasher, k):
                sets = distinct_runs(hashes >> np.uint64(1), at)
                n = np.diff(sets[1])
                d, _ = digests(sets)
                once = np.zeros(hi - lo, dtype=bool)
                once[np.unique(d, return_index=True)[1]] = True  # copies side by side count once
                counter.add(sets[0][first_of(sets, np.where(once, prefix_length(n, *similar), 0))[0]])
                m = hi - lo
                maps = bitmaps(sets).view(np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, dtype=np.int32)), batch.column(0).slice(lo, m), batch.column(1).slice(lo, m), pa.array(n), pa.array(d.astype(np.int64)), *[pa.array(np.ascontiguousarray(x)) for x in maps], pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
            if counter.full:
                yield from flush()
        yield from flush()

    return run


def post(k: int, similar: tuple[int, int], buckets: int, hot: list[int]):
    """(bucket, blob) of the groups' prefix postings and of the groups' members."""
    order = Order(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, postings = Hasher(), Postings(buckets)

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, raw in postings.flush():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([raw], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for _, _, hashes, at in _shingled(batch.column(0), hasher, k):
                d, _ = digests(distinct_runs(hashes >> np.uint64(1), at))
                sets = distinct_runs(order.keys(hashes), at)
                n = np.diff(sets[1])
                p = prefix_length(n, *similar)
                place, own, pos = first_of(sets, p)
                prefix = sets[0][place]
                some = np.flatnonzero(n)
                ends = np.cumsum(p)
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(prefix), dtype=np.uint64)])
                group = mix64(sums[ends] - sums[ends - p] + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
                postings.add(prefix, group[own], n[own], pos)
                postings.belongs(group[some], d[some], n[some])
            if postings.size > FLUSH:
                yield from flush()
        yield from flush()

    return run


def whole_sets(k: int):
    """(d, set as sorted token hashes) of (text) rows. Copies in a task give one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for _, _, hashes, at in _shingled(batch.column(0), hasher, k):
                sets = distinct_runs(hashes >> np.uint64(1), at)
                d, _ = digests(sets)
                new = np.unique(d, return_index=True)[1]
                new = np.sort(new[~np.isin(d[new], seen)])
                seen = np.append(seen, d[new])[-FLUSH:]
                yield pa.RecordBatch.from_arrays([pa.array(d[new].astype(np.int64)), pa.array([sets[0][sets[1][i] : sets[1][i + 1]].tobytes() for i in new], pa.binary())], names=["d", "tokens"])

    return run


def ngram_links(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept, row (a hash of
    id and text), component (a number of the component; null without shingles).

    Two rows link if the Jaccard similarity of their sets of `shingle`-word shingles is
    at least similar[0] / similar[1]; component_id is the least doc_id reachable, kept
    marks it. Tokens are 63-bit hashes, and classes 64-bit digests of sets: N classes
    are told apart but for odds of about N^2 / 2^65. Cases: null, empty and blank texts
    have no shingles and link with nothing; a text with fewer words is one shingle;
    repeated rows link with each other; a row with null id gets its component's least
    id, if any; no rows, no result; other columns are ignored.
    """
    ws = Workspace(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    parts = parallelism(spark)
    buckets = max(64, 2 * parts)
    profile = ", ".join(f"{c} long" for c in ("doc_id", "row", "n", "d", *MAP))
    base.mapInArrow(describe(shingle, similar, buckets), f"kind int, {profile}, bucket int, blob binary").write.partitionBy("kind").option("compression", "zstd").parquet(f"{ws.root}/described")
    read = lambda name, kind, schema: spark.read.schema(f"kind int, {schema}").parquet(f"{ws.root}/{name}").filter(F.col("kind") == kind).drop("kind")
    hot = setjoin.frequent_tokens(read("described", 1, "bucket int, blob binary"))
    ws.drop("described/kind=1")
    members = read("described", 0, profile)
    classes = members.filter("n > 0").groupBy("d").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.min("n").alias("n"), *[F.min(m).alias(m) for m in MAP])
    classes = ws.save(classes, "classes")

    posted = base.select("text").mapInArrow(post(shingle, similar, buckets, hot), "bucket int, blob binary")
    posted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(candidates(*similar, buckets), setjoin.CANDIDATES).write.partitionBy("kind").option("compression", "zstd").parquet(f"{ws.root}/candidates")
    del posted
    ws.release()
    pair_rows, lists, belongs = (read("candidates", kind, "a long, b long, n int, m int") for kind in (0, 1, 2))
    belongs = belongs.select(F.col("a").alias("g"), F.col("b").alias("d"), "n")
    groups = ws.save(belongs.groupBy("g").agg(F.min("d").alias("leader"), F.count(F.lit(1)).alias("size")), "groups")

    # Pairs of groups that share enough of their prefixes; tokens with long lists may
    # be shared too, so as many as both have count for the pair here.
    counted = ws.save(pair_rows.groupBy("a", "b").agg(F.count(F.lit(1)).cast("int").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m")), "counted")
    long_lists = lists.select(F.col("a").alias("token"), F.col("b").alias("g"), "n", F.col("m").alias("pos"))
    on_lists = long_lists.groupBy("g").agg(F.count(F.lit(1)).alias("on_lists"))
    least = setjoin.least_shared_sql("n", "m", *similar)
    left, right = on_lists.select(F.col("g").alias("a"), F.col("on_lists").alias("ha")), on_lists.select(F.col("g").alias("b"), F.col("on_lists").alias("hb"))
    likely = counted.join(left, "a", "left").join(right, "b", "left").filter(F.col("shared") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.expr(least)).select("a", "b")
    likely = ws.save(likely, "likely")
    ws.drop("counted")
    ws.drop("candidates/kind=0")

    # The sets that may link: of groups in pairs, on long lists or with members.
    wanted = likely.select(F.explode(F.array("a", "b")).alias("g")).union(long_lists.select("g")).union(groups.filter("size > 1").select("g")).distinct()
    used = ws.save(belongs.join(wanted, "g", "left_semi"), "used")

    def checked(pairs: DataFrame, turn: str) -> DataFrame:
        """The pairs that are similar: those that their bitmaps allow, by whole sets, which
        are read again from the texts of these pairs alone."""
        pairs = ws.save(hopeful(pairs, classes, similar), f"hopeful-{turn}")
        if not pairs.limit(1).collect():
            return pairs
        need = pairs.select(F.explode(F.array("a", "b")).alias("d")).distinct().join(classes, "d").select("row").distinct()
        sets = ws.save(base.select("row", "text").join(need.hint("shuffle_hash"), "row").select("text").mapInArrow(whole_sets(shingle), "d long, tokens binary"), f"sets-{turn}")
        ws.release()
        out = ws.save(verify(pairs, sets, similar), f"edges-{turn}")
        ws.drop(f"sets-{turn}")
        ws.release()
        return out

    # First round: one partner each.
    lead = groups.select("g", "leader")
    of = lambda df, g, out: df.join(lead.select(F.col("g").alias(g), F.col("leader").alias(out)), g)
    nearest = likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    inside = used.join(groups.filter("size > 1"), "g").filter("d != leader").select(F.col("leader").alias("x"), F.col("d").alias("y"))
    centre = long_lists.groupBy("token").agg(F.min("g").alias("a"))
    on_star = long_lists.select("token", F.col("g").alias("b")).join(centre, "token").select("a", "b").filter("a != b")
    first = ws.save(nearest.union(on_star).distinct(), "first")
    led = of(of(first, "a", "x"), "b", "y").select("x", "y")
    tried = ws.save(led.union(inside).filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "tried-1")
    edges = checked(tried, "1")

    # Then what is still in different components, of lists, groups and pairs of groups:
    # first the nearest partner of each set, then all that is left.
    band = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in bands(*similar)]), lambda x: x <= F.col("n")))
    for turn, near in (("2", True), ("3", False)):
        known = components(edges, ws, f"known-{turn}")
        named = ws.save(used.join(known.select(F.col("node").alias("d"), "component"), "d", "left").select("g", "d", "n", F.coalesce("component", "d").alias("c")), f"named-{turn}")
        parts_of = ws.save(named.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("size")), f"parts-{turn}")
        ga, gb = (parts_of.select(F.col("g").alias(g), F.col("low").alias(f"l{g}"), F.col("high").alias(f"h{g}"), F.col("size").alias(f"s{g}")) for g in ("a", "b"))
        across = ws.save(likely.join(ga, "a").join(gb, "b").filter("least(la, lb) < greatest(ha, hb)").select("a", "b", "sa", "sb"), f"across-{turn}")
        alone = across.filter("sa = 1 AND sb = 1").select("a", "b")
        single = of(of(alone, "a", "x"), "b", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        # The members of a group, and of a pair of groups with more, make lists too.
        crowd = across.filter("sa > 1 OR sb > 1").select(F.xxhash64("a", "b").alias("token"), F.explode(F.array("a", "b")).alias("g"), F.lit(0).alias("pos"))
        crowd = crowd.unionByName(parts_of.filter("low < high").select(F.xxhash64("g").alias("token"), "g", F.lit(0).alias("pos")))
        listed = long_lists.select("token", "g", "pos").unionByName(crowd).join(named, "g")
        mixed = listed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("token")
        listed = ws.save(listed.join(mixed, "token", "left_semi").withColumn("band", band), f"listed-{turn}")
        slices = ws.save(setjoin.slices_of(listed), f"slices-{turn}")
        found = setjoin.meet_lists(listed, slices, classes.select("d", *MAP), similar, near, parts)
        if near:
            # Of an item's nearest partners on all its lists and slices one.
            found = found.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(single).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = ws.save(pairs, f"tried-{turn}")
        # Stars stand for the edges that they come from.
        edges = known.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(checked(pairs, turn))
        tried = tried.unionByName(pairs)

    linked = components(edges, ws, "linked")
    label = classes.join(linked.select(F.col("node").alias("d"), "component"), "d", "left").select("d", "least", F.coalesce("component", "d").alias("component"))
    label = ws.save(label, "label")
    smallest = label.groupBy("component").agg(F.min("least").alias("component_id"))
    named_d = ws.save(label.join(smallest, "component").select("d", "component", "component_id"), "result")
    m = ws.save(members.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("d")).alias("d")), "members")
    ws.keep("result", "members")
    out = m.join(named_d, "d", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "row", "component")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "row", "component")


def op5_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copies among all documents."""
    return ngram_links(spark, table(spark, sf_dir, "documents")).drop("row", "component")


QUERIES = {"op5_ngram_links": op5_ngram_links}
_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), each AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM sets), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * pairs.n >= 80 * (x.n + y.n - pairs.n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN least ON n.doc_id = least.doc_id
"""
ORACLE_SQL = {"op5_ngram_links": _SQL}
