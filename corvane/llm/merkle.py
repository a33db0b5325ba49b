"""Merkle manifest of a dataset by supersteps of messages over RDDs.

Leaves of a group, in order, are the lowest level of its tree; every `arity` consecutive
nodes have one parent. Upward, children message the vertex that stands `levels` levels
above them; a vertex that has all its children hashes the levels between and forwards
its own digest. The groups' roots are the leaves of one more tree. Downward, vertices
broadcast the siblings on the way to the root to their children, until every leaf has
its proof and can be verified by it.

No vertex has more than arity ** levels children, whatever a group's size, and every
superstep is a table in the shared folder, from which a lost executor's part is read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, parallelism, table

ARITY, LEVELS = 2, 8
#: The tree whose leaves are the groups' roots.
TOP = -1
_SORTED = "grp string, id long, leaf string, shown string, part int, at long, own long, i long, ends boolean"
_LEAVES = "tree long, parent long, places array<long>, digests array<string>, shown array<string>, ids array<long>, ends boolean"
_VERTEX = "tree long, place long, done boolean, ends boolean, digest string, digests array<string>"
_LEAF_VERTEX = f"{_VERTEX}, shown array<string>, ids array<long>"


def digest(parts: Iterable[str]) -> str:
    """Hex SHA-256 of the texts one after another."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: dict[str, Column]) -> Column:
    """Hash of a row: of each value its length in bytes, a colon and itself, of nulls `-`."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _climb(digests: list[str], arity: int, levels: int | None) -> list[list[str]]:
    """The levels above `digests`, these first: so many, or up to a single node if None."""
    out = [digests]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append([digest(out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their partition, of the row and the group in it, of
    the row in the group, and whether a group ends there as far as the partition tells."""
    part, at, own, i, now, held = TaskContext.get().partitionId(), 0, -1, 0, object(), None

    def give(rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("grp", pa.string()), ("id", pa.int64()), ("leaf", pa.string()), ("shown", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("own", pa.int64()), ("i", pa.int64()), ("ends", pa.bool_())]))

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["grp"] != now:
                now, own, i = row["grp"], own + 1, 0
            row |= {"part": part, "at": at, "own": own, "i": i, "ends": True}
            if held:
                held["ends"] = held["own"] != own
                out.append(held)
            at, i, held = at + 1, i + 1, row
        if out:
            yield give(out)
    if held:
        yield give([held])


def _first_messages(bases: dict[int, tuple[int, int, bool]], last_at: dict[int, int], width: int):
    """Rows to messages for the parents of the leaves; neighbours share a message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int64()), ("parent", pa.int64()), ("places", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())), ("shown", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("ends", pa.bool_())])
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                tree, shift, goes_on = bases[r["part"]]
                place = r["i"] + (shift if r["own"] == 0 else 0)
                ends = r["ends"] and not (goes_on and r["at"] == last_at[r["part"]])
                key = {"tree": tree + r["own"], "parent": place // width}
                if not out or out[-1]["tree"] != key["tree"] or out[-1]["parent"] != key["parent"]:
                    out.append(key | {"places": [], "digests": [], "shown": [], "ids": [], "ends": False})
                m = out[-1]
                m["ends"] |= ends
                for name, v in (("places", place), ("digests", r["leaf"]), ("shown", r["shown"]), ("ids", r["id"])):
                    m[name].append(v)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _complete(arity: int, levels: int):
    """A vertex from its messages (places, ends, digests, what the places carry)."""

    def run(item):
        (tree, place), messages = item
        messages = sorted(messages, key=lambda m: m[0][0])
        digests = [d for m in messages for d in m[2]]
        ends = any(m[1] for m in messages)
        if not ends and len(digests) != arity**levels:
            raise ValueError(f"vertex {place} of tree {tree} lacks children")
        done = ends and place == 0
        up = _climb(digests, arity, None if done else levels)[-1][0]
        return (tree, place, done, ends, up, digests, *([x for m in messages for x in m[k]] for k in range(3, len(messages[0]))))

    return run


def _paths(digests: list[str], arity: int, levels: int | None) -> list[list[tuple[str, str]]]:
    """For every child of a vertex the siblings on its left and right, level by level."""
    up = _climb(digests, arity, levels)[:-1]
    out = []
    for i in range(len(digests)):
        path = []
        for level in up:
            head = i - i % arity
            path.append(("".join(level[head:i]), "".join(level[i + 1 : head + arity])))
            i //= arity
        out.append(path)
    return out


def _descend(arity: int, levels: int, to_groups: bool = False):
    """Messages of a vertex to its children: siblings up to the root, subroot and root.
    The children of the top tree's lowest vertices are the groups' roots."""

    def run(item):
        (tree, _, done), ((place, digests), (above, subroot, root)) = item
        for i, path in enumerate(_paths(digests, arity, None if done else levels)):
            child = place * arity**levels + i
            if to_groups:
                yield (child, 0, True), (path + above, digests[i], root)
            else:
                yield (tree, child, False), (path + above, subroot, root)

    return run


def _prove(arity: int, levels: int, proofs: bool):
    """Rows of the leaves below a vertex, each verified by its proof."""

    def run(item):
        (_, _, done), ((ids, shown, digests), (above, subroot, root)) = item
        for own, seen, was, path in zip(ids, shown, digests, _paths(digests, arity, None if done else levels), strict=True):
            whole, now = path + above, seen
            for left, right in whole:
                now = digest((left, now, right))
            row = (own, was, subroot, root, digest(s for pair in whole for s in pair), now, now == root)
            yield (*row, [{"left": a, "right": b} for a, b in whole]) if proofs else row

    return run


def manifest(spark: SparkSession, rows: DataFrame, columns: list[str], group: str, order: str, shown: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """One row per row of `rows`: the order column, leaf, subroot, root, proof_sha256,
    folded_root, verified, and with `proofs` the proof, siblings on the left and right by level.

    A leaf hashes `columns`; a group's leaves ascend by the order column, an integer. What
    is verified are the rows as `shown` changes them: folded_root follows from the changed
    row and the siblings of the unchanged ones, verified says that it equals root. Every
    superstep climbs `levels` levels. Cases: a null group is the first one, a null in the
    order column comes first, equal ones ascend by leaf; repeated rows are leaves each; a
    group's only leaf is its subroot and a single group's subroot is the root, with no
    siblings there; empty and very long texts are hashed whole, by Spark; no rows, no
    result; other columns are ignored.
    """
    ws, n = Workspace(spark), parallelism(spark)
    width, end = arity**levels, f"{order} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    end += ", proof array<struct<left:string,right:string>>" if proofs else ""
    own = {c: F.col(c) for c in columns}
    hashed = rows.select(F.col(group).cast("string").alias("grp"), F.col(order).cast("long").alias("id"), leaf(own).alias("leaf"), *[c.alias(f"new_{k}") for k, c in (shown or {}).items()], *[F.col(c).alias(f"old_{c}") for c in columns])
    changed = F.lit(False)
    for k in shown or {}:
        changed |= ~F.col(f"new_{k}").cast("string").eqNullSafe(F.col(f"old_{k}").cast("string"))
    again = leaf({c: F.col(f"new_{c}") if c in (shown or {}) else F.col(f"old_{c}") for c in columns})
    # Equal rows are told apart by a number, so that any number of them can be cut.
    leaves = ws.save(hashed.select("grp", "id", "leaf", F.when(changed, again).otherwise(F.col("leaf")).alias("shown"), F.monotonically_increasing_id().alias("row")), "leaves")
    keys = ["grp", "id", "leaf", "row"]
    marked = leaves.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("grp", "id", "leaf", "shown").mapInArrow(_mark, _SORTED)
    marked = ws.save(marked, "sorted")
    ws.drop("leaves")
    parts = marked.groupBy("part").agg(F.min_by("grp", "at"), F.max_by("grp", "at"), F.max("own"), F.max_by("i", "at"), F.max("at")).orderBy("part").collect()  # a row a partition
    if not parts:
        return spark.createDataFrame([], end)
    bases: dict[int, tuple[int, int, bool]] = {}
    tree, held, size = -1, None, 0
    for k, (part, head, tail, most, i, _) in enumerate(parts):
        same = k > 0 and head == held
        base, shift = (tree, size) if same else (tree + 1, 0)
        bases[part] = (base, shift, k + 1 < len(parts) and parts[k + 1][1] == tail)
        tree, held, size = base + most, tail, i + 1 + (shift if most == 0 else 0)
    groups = tree + 1

    def step(messages: RDD, name: str, schema: str = _VERTEX) -> DataFrame:
        return ws.save(spark.createDataFrame(messages.groupByKey(n).map(_complete(arity, levels)), schema, verifySchema=False), name)

    def climb(vertices: DataFrame, name: str) -> list[DataFrame]:
        """Supersteps upward until every tree has its root."""
        found = [vertices]
        while found[-1].filter("NOT done").limit(1).count():
            rest = found[-1].filter("NOT done").select("tree", "place", "ends", "digest").rdd
            found.append(step(rest.map(lambda v: ((v[0], v[1] // width), ([v[1]], v[2], [v[3]]))), f"{name}-{len(found)}"))
        return found

    first = marked.mapInArrow(_first_messages(bases, {p[0]: p[5] for p in parts}, width), _LEAVES).rdd
    low = climb(step(first.map(lambda m: ((m[0], m[1]), (m[2], m[6], m[3], m[4], m[5]))), "low-0", _LEAF_VERTEX), "low")
    roots = low[0].filter("done").select("tree", "digest")
    for v in low[1:]:
        roots = roots.unionByName(v.filter("done").select("tree", "digest"))
    top = climb(step(roots.rdd.map(lambda r: ((TOP, r[0] // width), ([r[0]], r[0] == groups - 1, [r[1]]))), "top-0"), "top")
    root = top[-1].filter("done").first().digest

    # Reverse supersteps, the top tree first.
    paths = spark.sparkContext.parallelize([((TOP, 0, True), ([], None, root))], 1)
    vertex = lambda v: ((v[0], v[1], v[2]), (v[1], v[3]))
    for v in reversed(top):
        paths = v.select("tree", "place", "done", "digests").rdd.map(vertex).join(paths, n).flatMap(_descend(arity, levels, v is top[0]))
    subroots = paths = _kept(ws, paths, "down-top")
    for k in range(len(low) - 1, 0, -1):
        sent = low[k].select("tree", "place", "done", "digests").rdd.map(vertex).join(paths, n).flatMap(_descend(arity, levels))
        paths = _kept(ws, sent, f"down-{k}").union(subroots)
    last = low[0].select("tree", "place", "done", "ids", "shown", "digests").rdd.map(lambda v: ((v[0], v[1], v[2]), (v[3], v[4], v[5])))
    return spark.createDataFrame(last.join(paths, n).flatMap(_prove(arity, levels, proofs)), end, verifySchema=False)


def _kept(ws: Workspace, paths: RDD, name: str) -> RDD:
    """Messages downward, read from a table."""
    flat = paths.map(lambda m: (*m[0], [list(p) for p in m[1][0]], m[1][1], m[1][2]))
    saved = ws.save(ws.spark.createDataFrame(flat, "tree long, place long, done boolean, path array<array<string>>, subroot string, root string", verifySchema=False), name)
    return saved.rdd.map(lambda r: ((r[0], r[1], r[2]), ([(a, b) for a, b in r[3]], r[4], r[5])))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of a tree per language; some are tampered with."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")).otherwise(F.col("n_chars").cast("string"))
    return manifest(spark, table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"n_chars": tampered})


def _leaf_sql(n_chars: str) -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
    return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce(range(8), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(a, b)), 4294967295)) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS shown FROM crc
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS r FROM hashed
), nodes AS (
  SELECT lang, CAST(0 AS BIGINT) AS lvl, i, n, leaf AS d FROM leaves
  UNION ALL SELECT lang, lvl + 1, i >> 1, n, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE (n + (CAST(1 AS BIGINT) << lvl) - 1) >> lvl > 1 GROUP BY lang, lvl, i >> 1, n
), subroots AS MATERIALIZED (
  SELECT lang, d, max_lvl, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT lang, arg_max(d, lvl) AS d, max(lvl) AS max_lvl FROM nodes GROUP BY lang)
), above AS (
  SELECT CAST(0 AS BIGINT) AS lvl, i, n, d FROM subroots
  UNION ALL SELECT lvl + 1, i >> 1, n, sha256(string_agg(d, '' ORDER BY i)) FROM above WHERE (n + (CAST(1 AS BIGINT) << lvl) - 1) >> lvl > 1 GROUP BY lvl, i >> 1, n
), root AS (SELECT arg_max(d, lvl) AS root, max(lvl) AS height FROM above),
path AS MATERIALIZED (
  SELECT l.r, own.lvl AS step, (l.i >> own.lvl) & 1 AS side, sib.d AS sib
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN nodes own ON own.lang IS NOT DISTINCT FROM l.lang AND own.i = l.i >> own.lvl AND own.lvl < s.max_lvl
  LEFT JOIN nodes sib ON sib.lang IS NOT DISTINCT FROM l.lang AND sib.lvl = own.lvl AND sib.i = xor(l.i >> own.lvl, 1)
  UNION ALL
  SELECT l.r, s.max_lvl + own.lvl, (s.i >> own.lvl) & 1, sib.d
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN root ON true JOIN above own ON own.i = s.i >> own.lvl AND own.lvl < root.height
  LEFT JOIN above sib ON sib.lvl = own.lvl AND sib.i = xor(s.i >> own.lvl, 1)
), fold AS (
  SELECT r, CAST(0 AS BIGINT) AS step, shown AS d FROM leaves
  UNION ALL SELECT f.r, f.step + 1, sha256(CASE WHEN sib IS NULL THEN f.d WHEN side = 0 THEN f.d || sib ELSE sib || f.d END) FROM fold f JOIN path p ON f.r = p.r AND f.step = p.step
), folded AS (SELECT r, arg_max(d, step) AS folded_root FROM fold GROUP BY r),
proof AS (SELECT r, sha256(string_agg(sib, '' ORDER BY step)) AS proof_sha256 FROM path WHERE sib IS NOT NULL GROUP BY r)
SELECT doc_id, leaf, s.d AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN root ON true JOIN folded USING (r) LEFT JOIN proof USING (r)
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE_SQL = {"op11_merkle_manifest": _SQL}
