"""Packing by optimal length buckets.

Sequences longer than the longest bucket are cut into consecutive pieces. Dynamic
programming over the global histogram of piece lengths picks the bucket boundaries
that pad least; inside a bucket, batches are filled up to a token budget.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import WORD, Workspace, ordinal, table, word_count

MAX_LENGTH = 4096
BUCKETS = 16
TOKEN_BUDGET = 65536


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets that minimise the padded total.

    cost(i, j): what the lengths i..j take when all are padded to length j. The cost
    obeys the quadrangle inequality, so the best split point of a layer rises with j
    and each layer is solved by halving: O(buckets * d log d) for d lengths.
    """
    order = np.argsort(lengths)
    x, c = lengths[order].astype("float64"), counts[order].astype("float64")
    d = len(x)
    if not d:
        return []
    before = np.concatenate([[0.0], np.cumsum(c)])
    best = x * before[1:]
    choice = []
    for _ in range(1, min(buckets, d)):
        new, cut = np.empty(d), np.zeros(d, dtype="int64")
        work = [(0, d - 1, 0, d - 1)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            # i: index of the first length in the last bucket; 0 means one bucket in all.
            i = np.arange(a, min(b, j) + 1)
            total = np.where(i > 0, best[np.maximum(i - 1, 0)], 0.0) + x[j] * (before[j + 1] - before[i])
            k = int(np.argmin(total))
            new[j], cut[j] = total[k], i[k]
            work += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        choice.append(cut)
        best = new
    bounds, j = [int(x[-1])], d - 1
    for cut in reversed(choice):
        if cut[j] == 0:
            break
        j = int(cut[j]) - 1
        bounds.append(int(x[j]))
    return bounds[::-1]


def pack(spark: SparkSession, docs: DataFrame, length: str | Column = "n_tokens", id_col: str = "doc_id", max_length: int = MAX_LENGTH, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, seed: int = 11, tokens: str | Column | None = None, mark: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bucket, padded, batch, slot, and
    with `tokens`, an array of `length` tokens, the piece's own tokens. Words that never
    hold `mark`, one character, travel as one text between marks, which takes far less.

    `length` names the column (or is the expression) of token counts. A sequence of n
    tokens gives ceil(n / max_length) pieces, no token is lost. padded is the bound of
    the piece's bucket; a batch holds at most max(1, token_budget // padded) pieces of
    one bucket, and slot is the place in it. The histogram has at most max_length
    entries whatever the input, which is all that the driver sees. Cases: null, zero
    and negative lengths give one piece of 0 tokens in bucket 0 with padded 0, so no
    document is lost; repeated rows give repeated pieces; no rows, no result; other
    columns are ignored.
    """
    ws = Workspace(spark)
    n = F.greatest(F.coalesce((F.col(length) if isinstance(length, str) else length).cast("long"), F.lit(0)), F.lit(0))
    given = [] if tokens is None else [(F.col(tokens) if isinstance(tokens, str) else tokens).alias("tokens")]
    sized = docs.select(F.col(id_col).alias("doc_id"), n.alias("__n"), *given)
    cut = F.slice("tokens", (F.col("piece") * max_length + 1).cast("int"), F.lit(max_length))
    own = [] if tokens is None else [(cut if mark is None else F.array_join(cut, mark)).alias("tokens")]
    back = [] if tokens is None else [F.col("tokens") if mark is None else F.when(F.col("n_tokens") > 0, F.split("tokens", re.escape(mark))).otherwise(F.array().cast("array<string>")).alias("tokens")]
    more = [] if tokens is None else ["tokens"]
    pieces = ws.save(
        sized.select("doc_id", "__n", *more, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("__n") / max_length).cast("long") - 1, F.lit(0)))).alias("piece")).select(
            "doc_id", "piece", (F.col("piece") * max_length).alias("start"), F.least(F.lit(max_length), F.col("__n") - F.col("piece") * max_length).cast("int").alias("n_tokens"), *own
        ),
        "pieces",
    )
    histogram = pieces.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most max_length rows
    bounds = bucket_bounds(np.array([r[0] for r in histogram], dtype="int64"), np.array([r[1] for r in histogram], dtype="int64"), buckets)
    bucket = F.lit(0)
    padded = F.lit(0)
    for k in range(len(bounds) - 1, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k + 1)).otherwise(bucket)
        padded = F.when(F.col("n_tokens") <= bounds[k], F.lit(bounds[k])).otherwise(padded)
    zero = F.col("n_tokens") == 0
    rows = pieces.withColumns({"bucket": F.when(zero, 0).otherwise(bucket), "padded": F.when(zero, 0).otherwise(padded), "__h": F.xxhash64("doc_id", "piece", F.lit(seed))})
    placed = ordinal(rows, ["bucket"], "__h", "__place", ws, ["doc_id", "piece"])
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("padded"), F.lit(1)))).cast("long")
    return placed.select("doc_id", "piece", "start", "n_tokens", "bucket", "padded", *more, F.expr("__place").alias("__place"), room.alias("__room")).select(
        "doc_id", "piece", "start", "n_tokens", "bucket", "padded", F.floor(F.col("__place") / F.col("__room")).alias("batch"), (F.col("__place") % F.col("__room")).cast("int").alias("slot"), *back
    )


def padding(packed: DataFrame) -> DataFrame:
    """bucket, padded, pieces, batches, tokens and padding (empty places) of each bucket."""
    totals = packed.groupBy("bucket", "padded").agg(F.count(F.lit(1)).alias("pieces"), (F.max("batch") + 1).alias("batches"), F.sum("n_tokens").alias("tokens"))
    return totals.withColumn("padding", F.col("pieces") * F.col("padded") - F.col("tokens"))


def words_of(text: str) -> Column:
    """The words of a text, none of a null."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed by their words, which the pieces carry."""
    return pack(spark, table(spark, sf_dir, "documents"), word_count("text"), tokens=words_of("text"), mark=" ")


def padding_of_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the buckets pad, from the packed documents."""
    return padding(op4_pack(spark, sf_dir))


def pieces_of_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of the packed documents: their pieces and the words of each."""
    return op4_pack(spark, sf_dir).select("doc_id", "piece", "start", "n_tokens", F.md5(F.array_join("tokens", " ").cast("binary")).alias("words_md5"))


_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil(len(w) / {MAX_LENGTH}.0) AS BIGINT)))) AS piece FROM w)
SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST(piece * {MAX_LENGTH} AS BIGINT) AS start, CAST(least({MAX_LENGTH}, len(w) - piece * {MAX_LENGTH}) AS INTEGER) AS n_tokens,
  md5(array_to_string(w[piece * {MAX_LENGTH} + 1:(piece + 1) * {MAX_LENGTH}], ' ')) AS words_md5 FROM p
"""

QUERIES = {"op4_pack": op4_pack, "padding_of_op4": padding_of_op4, "pieces_of_op4": pieces_of_op4}
ORACLE_SQL = {"pieces_of_op4": _SQL}
