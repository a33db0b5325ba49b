"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, user first. For each turn, dynamic programming over that automaton
chooses to keep it, merge it into the turn before, relabel it or insert an empty turn
before it, at the least total cost; the repaired sequence is rendered.

One turn is a matrix of costs from the last role before it to the role it gets; such
matrices multiply in (min, +). Long conversations are therefore cut into segments:
each segment is reduced to one small matrix, the matrices of a conversation settle the
role at every cut, and the segments are then repaired and rendered on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, parallelism, table
from corvane.llm.vectors import runs

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the last role.
STATES = 4
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
MERGE, INSERT, RELABEL = 1, 2, 3
#: Turn numbers of a segment.
SEGMENT = 512
BIG = 1 << 40


def step(state: int, role: int) -> tuple[int, int]:
    """(cost, role of the empty turn to insert or 0) of moving from state to role;
    state == role is a merge."""
    if (state, role) in LEGAL:
        return 0, 0
    if state == role:
        return MERGE, 0
    for between in (2, 3):
        if (state, between) in LEGAL and (between, role) in LEGAL:
            return INSERT, between
    return BIG, 0


STEP = [[step(s, r) if r else (BIG, 0) for r in range(STATES)] for s in range(STATES)]


def costs(role: str | None) -> np.ndarray:
    """Cost matrix of one turn: from state s to role r."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    return np.array([[BIG if r == 0 else STEP[s][r][0] + (0 if r == own else RELABEL) for r in range(STATES)] for s in range(STATES)], dtype=np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), BIG)


def repair(roles: list[str | None], enter: int = 0, leave: int | None = None) -> tuple[list[int], int]:
    """(role of each turn, total cost) of the cheapest repair that starts in state
    `enter` and ends in `leave`, if given. Ties: the earlier role in ROLES, from the
    last turn back; between segments, from the last segment back."""
    best = np.full(STATES, BIG, dtype=np.int64)
    best[enter] = 0
    back = []
    for role in roles:
        total = best[:, None] + costs(role)
        back.append(total.argmin(0))
        best = np.minimum(total.min(0), BIG)
    state = int(best.argmin()) if leave is None else leave
    cost, out = int(best[state]), []
    for choice in reversed(back):
        out.append(state)
        state = int(choice[state])
    return out[::-1], cost


def escape(text: str | None) -> str:
    """text with `<|` as `<||`, which no marker begins with; unescape() undoes it."""
    return (text or "").replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def render(roles: list[str | None], texts: list[str | None], fixed: list[int], state: int, last: bool) -> tuple[str, int, int, int, int]:
    """(text, turns out, merges, relabels, insertions). A header ends the turn before.
    Texts are escaped, so that none holds a marker."""
    texts = [escape(t) for t in texts]
    parts, out, merged, relabeled, inserted = [], 0, 0, 0, 0
    for role, text, r in zip(roles, texts, fixed, strict=True):
        relabeled += role != ROLES[r - 1]
        if state == r and (state, r) not in LEGAL:
            merged += 1
            parts.append("\n\n" + text)
        else:
            between = STEP[state][r][1]
            for x in ([between] if between else []) + [r]:
                parts.append(("<|end|>\n" if state else "") + f"<|{ROLES[x - 1]}|>\n")
                state = x
                out += 1
            inserted += bool(between)
            parts.append(text)
        state = r
    if last and state:
        parts.append("<|end|>\n")
    return "".join(parts), out, merged, relabeled, inserted


def format_chats(spark: SparkSession, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per segment: conv_id, segment, piece, n_turns, n_out, n_merged, n_relabeled,
    n_inserted, cost, rendered. A conversation whose turn numbers span less than
    `segment` is one row; else its rendered pieces concatenate by segment and piece.

    Needs conv_id, turn, role, text; other columns are ignored. Turns are ordered by
    number (null last), then role, then a hash of the text, then the text. Segments are
    cut by number, and where more than `segment` turns share one, by role and hash too,
    so no task holds a conversation. Long conversations stay in pieces, since no row need
    hold one. Cases: a role that is null or unknown must be relabelled; a null or empty
    text is an empty turn; repeated rows are turns of their own (equal roles, so they
    merge), in one segment; rows with a null conv_id form one conversation; `<|` in a
    text is escaped; no rows, no result.
    """
    ws = Workspace(spark)
    seg = F.coalesce(F.floor(F.col("turn") / segment), F.lit((1 << 62))).cast("long")
    rows = turns.select(F.col("conv_id").isNull().alias("lost"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), seg.alias("segment"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    keys = ["lost", "conv_id", "segment"]
    # Numbers that more than `segment` turns share: 0 < shift bits of the hash cut them.
    crowd = rows.groupBy("lost", "conv_id", "segment", "turn").count().filter(F.col("count") > segment)
    crowd = ws.save(crowd.select(*keys, "turn", F.least(F.lit(40), F.ceil(F.log2(F.col("count") / segment))).cast("int").alias("shift")), "crowd")
    if crowd.limit(1).collect():
        a, b = rows.alias("a"), crowd.alias("b")
        on = (F.col("a.lost") == F.col("b.lost")) & (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.segment") == F.col("b.segment")) & F.col("a.turn").eqNullSafe(F.col("b.turn"))
        part = F.struct(F.col("a.turn").isNull().alias("last"), F.col("a.turn").alias("turn"), F.when(F.col("shift").isNotNull(), F.col("a.role")).alias("role"), F.when(F.col("shift").isNotNull(), F.expr("shiftright(a.hash, 64 - shift)")).alias("cut"))
        rows = ws.save(a.join(b, on, "left").select("a.*", part.alias("part"), F.col("shift").isNotNull().alias("crowded")), "rows")
        # Pieces of a segment in order: what comes before a crowded number, its parts, and so on.
        pieces = rows.filter("crowded").select(*keys, "part").distinct()
        turns_of = rows.filter("NOT crowded").join(pieces.select(*keys).distinct(), keys, "left_semi").select(*keys, "part").distinct()
        place = Window.partitionBy(*keys).orderBy("part")
        numbered = ws.save(pieces.unionByName(turns_of).withColumn("piece", F.row_number().over(place)), "pieces")
        a, b = rows.alias("a"), numbered.alias("b")
        on = (F.col("a.lost") == F.col("b.lost")) & (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.segment") == F.col("b.segment")) & F.col("a.part").eqNullSafe(F.col("b.part"))
        rows = a.join(b, on, "left").select("a.lost", "a.conv_id", F.col("a.segment"), "a.turn", "a.role", "a.text", "a.hash", F.coalesce("b.piece", F.lit(0)).alias("piece"))
    else:
        rows = rows.withColumn("piece", F.lit(0))
    keys = [*keys, "piece"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list, tuple]]:
        """(key, roles, texts, states) of each segment of a sorted partition."""
        now, roles, texts, extra = None, [], [], ()
        for key, rows in runs(batches, 4):
            if key != now:
                if now is not None:
                    yield now, roles, texts, extra
                now, roles, texts = key, [], []
                extra = tuple(rows.column(i)[0].as_py() for i in range(6, rows.num_columns))
            roles += rows.column(4).to_pylist()
            texts += rows.column(5).to_pylist()
        if now is not None:
            yield now, roles, texts, extra

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, roles, _, _ in whole(batches):
            total = None
            for role in roles:
                total = costs(role) if total is None else product(total, costs(role))
            out.append((*key, total.ravel().tolist()))
        if out:
            c = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.bool_()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.list_(pa.int64()))], names=[*keys, "m"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry and exit state of each segment of one conversation."""
        pdf = pdf.sort_values(["segment", "piece"])
        ms = [np.array(m, dtype=np.int64).reshape(STATES, STATES) for m in pdf["m"]]
        best, back = np.full(STATES, BIG, dtype=np.int64), []
        best[0] = 0
        for m in ms:
            total = best[:, None] + m
            back.append(total.argmin(0))
            best = np.minimum(total.min(0), BIG)
        leave = [int(best.argmin())]
        for choice in reversed(back):
            leave.append(int(choice[leave[-1]]))
        leave = leave[::-1]
        return pdf[keys].assign(enter=leave[:-1], leave=leave[1:], final=[False] * (len(ms) - 1) + [True])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lost, conv, part, piece), roles, texts, (enter, leave, final) in whole(batches):
            # A conversation of one segment needs no settled states.
            fixed, cost = repair(roles, enter or 0, leave)
            text, *n = render(roles, texts, fixed, enter or 0, True if final is None else final)
            yield pa.RecordBatch.from_pylist([{"conv_id": None if lost else conv, "segment": part, "piece": piece, "n_turns": len(roles), "n_out": n[0], "n_merged": n[1], "n_relabeled": n[2], "n_inserted": n[3], "cost": cost, "rendered": text}], schema=pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("piece", pa.int32()), *((k, pa.int64()) for k in ("n_turns", "n_out", "n_merged", "n_relabeled", "n_inserted", "cost")), ("rendered", pa.string())]))

    def ordered(df: DataFrame, *more: str) -> DataFrame:
        return df.repartition(parallelism(spark), *keys).sortWithinPartitions(*keys, F.col("turn").asc_nulls_last(), "role", "hash", "text").select(*keys, "role", "text", *more)

    several = ws.save(rows.groupBy("lost", "conv_id").agg(F.min(F.struct("segment", "piece")).alias("a"), F.max(F.struct("segment", "piece")).alias("b")).filter("a < b").select("lost", "conv_id"), "several")
    long_rows = rows.join(several, ["lost", "conv_id"], "left_semi")
    matrices = ordered(long_rows.withColumn("text", F.lit(None).cast("string"))).mapInArrow(reduce, "lost boolean, conv_id long, segment long, piece int, m array<long>")
    states = ws.save(matrices.groupBy("lost", "conv_id").applyInPandas(settle, "lost boolean, conv_id long, segment long, piece int, enter int, leave int, final boolean"), "states")
    both = rows.join(states, keys, "left")
    return ordered(both, "enter", "leave", "final").mapInArrow(write, "conv_id long, segment long, piece int, n_turns long, n_out long, n_merged long, n_relabeled long, n_inserted long, cost long, rendered string")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return format_chats(spark, table(spark, sf_dir, "conversations"))


def costs_of_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of the repairs: turns and least cost of each conversation."""
    return op1_chat_format(spark, sf_dir).groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("cost").alias("cost"))


#: The cheapest way into each role, turn after turn; c holds them by state.
_OWN = "CASE role " + " ".join(f"WHEN '{r}' THEN {i + 1}" for i, r in enumerate(ROLES)) + " ELSE 0 END"
_NEXT = ", ".join("list_min([" + ", ".join(f"c[{s + 1}] + {STEP[s][r][0]}" for s in range(STATES)) + f"]) + CASE WHEN own = {r} THEN 0 ELSE {RELABEL} END" for r in range(1, STATES))
_SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT conv_id, {_OWN} AS own, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, n, [0, {BIG}, {BIG}, {BIG}]::BIGINT[] AS c FROM t
  UNION ALL SELECT w.conv_id, t.k, w.n, [{BIG}, {_NEXT}]::BIGINT[] FROM walk w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k + 1
)
SELECT conv_id, n AS n_turns, list_min(c) AS cost FROM walk WHERE k = n
"""

QUERIES = {"op1_chat_format": op1_chat_format, "costs_of_op1": costs_of_op1}
ORACLE_SQL = {"costs_of_op1": _SQL}
