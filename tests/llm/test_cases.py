"""Ties, odd rows and long texts of the training-data operators and the pipeline."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, mixing, neardup_docs, packing, quality, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_repair_breaks_ties_from_the_last_turn_back():
    rng = random.Random(0)
    for _ in range(80):
        roles = [rng.choice(["user", "assistant", "system", None, "bot"]) for _ in range(rng.randint(1, 6))]
        best = None
        for given in itertools.product(range(1, chat.STATES), repeat=len(roles)):
            cost, state = 0, 0
            for role, r in zip(roles, given, strict=True):
                cost, state = cost + int(chat.costs(role)[state][r]), r
            key = (cost, given[::-1])
            best = key if best is None else min(best, key)
        fixed, cost = chat.repair(roles)
        assert (cost, tuple(fixed[::-1])) == best


def test_rendered_conversations_are_legal_and_whole(spark):
    """Random conversations, parsed back from what is rendered, with all counts."""
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "user", "assistant", "system", None, "bot"]), rng.choice(["", None, "hi", "a <|user|> b", "<|", "<||end|>", "x" * 50_000])) for c in range(40) for t in range(rng.randint(1, 9))]
    got = {r.conv_id: r for r in chat.format_chats(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("x"))).collect()}
    for c in {r[0] for r in rows}:
        given, r = [x for x in rows if x[0] == c], got[c]
        parts = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", r.rendered, re.S)
        assert "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in parts) == r.rendered
        body = [role for role, _ in parts]
        body = body[1:] if body[0] == "system" else body
        assert body == [("user", "assistant")[i % 2] for i in range(len(body))]
        assert (r.n_turns, r.n_out) == (len(given), len(parts)) and r.n_out == r.n_turns - r.n_merged + r.n_inserted
        assert r.cost == 3 * r.n_relabeled + r.n_merged + 2 * r.n_inserted
        turns = [text for _, text in parts]
        texts = iter(chat.escape(x[3]) for x in sorted(given, key=lambda x: x[1]))
        joined = "\n\n".join(turns)
        for text in texts:  # every text is there, in order
            at = joined.index(text)
            joined = joined[at + len(text) :]


def test_given_rules_of_equal_length(spark):
    rules = (("allow", "ab.cd", "/pq"), ("block", "x.ab.cd", "/"), ("allow", "e.fg", "/1"), ("block", "e.fg", "/1"))
    df = spark.createDataFrame([("x.ab.cd", "/pq"), ("ab.cd", "/pq"), ("e.fg", "/12"), ("z", "/")], "h string, p string")
    got = [tuple(r.f) if r.f else None for r in df.select(urls.fitting_rule(F.col("h"), F.col("p"), rules).alias("f")).collect()]
    assert got == [("x.ab.cd/", "block"), ("ab.cd/pq", "allow"), ("e.fg/1", "block"), None]


def test_rules_are_found_without_writing_them_out(spark):
    """The matcher says what the first of all rules says that fits."""
    rng = random.Random(2)
    parts = ["a", "b", "c", "d"]
    rows = [(f"http://{x}.{x}{x}.org/{y}/{y}{y}/{i}", (x, y) in (("a", "b"), ("c", "d")) and rng.random() < 0.97) for i in range(600) for x, y in [(rng.choice(parts), rng.choice(parts))]]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    every = urls.mine_rules(labelled)
    assert len(every) > len(urls.mine_classes(labelled)[0]) > 0
    first = urls.matcher(*urls.mine_classes(labelled))
    for r in labelled.limit(150).select("url", urls.tokens_of(F.col("url")).alias("t")).collect():
        want = next(((key, c) for key, _, c in every if set(key) <= set(r.t)), None)
        assert first(r.t) == want
    twice = spark.createDataFrame([(1, rows[0][0]), (1, rows[0][0]), (None, rows[0][0]), (2, None)], "page_id long, url string").withColumn("verdict", F.lit("x"))
    got = [tuple(r) for r in urls.judge(spark, twice, labelled).drop("page_id").collect()]
    assert len(got) == 4 and len(set(got[:3])) == 1 and ("", "") == got[3][:2]


def test_budgets_without_a_bound_are_fitted_whole():
    rng = np.random.default_rng(3)
    for _ in range(40):
        lengths = rng.choice(np.arange(2, 60), rng.integers(1, 5), replace=False).astype(np.int64)
        counts = rng.integers(1, 30, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        sums = {0}
        for x, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * x for s in sums for k in range(n + 1)}
        best = min(abs(s - budget) for s in sums)
        take = mixing.fit_budget(lengths, counts, budget, None)
        assert (0 <= take).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - budget) == best


def test_batches_are_filled_without_gaps(spark):
    df = spark.createDataFrame([(i % 50, (i * 37) % 23) for i in range(400)], "doc_id long, n_tokens long")
    out = packing.pack(spark, df, max_length=9, buckets=3, token_budget=40).collect()
    for bucket in {r.bucket for r in out}:
        rows = [r for r in out if r.bucket == bucket]
        room = max(1, 40 // max(1, rows[0].padded))
        assert sorted((r.batch, r.slot) for r in rows) == [(i // room, i % room) for i in range(len(rows))]


def test_packed_pieces_hold_the_words(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = {}
    for r in packing.op4_pack(spark, sf).collect():
        assert len(r.tokens) == r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.piece, r.tokens))
    assert {d: [w for _, t in sorted(p) for w in t] for d, p in pieces.items()} == {d: WORD.findall(t or "") for d, t in texts.items()}
    totals = packing.padding_of_op4(spark, sf).collect()
    assert sum(r.tokens for r in totals) == sum(len(t) for p in pieces.values() for _, t in p)


def test_scores_of_repeated_rows_and_own_columns(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "### %%% $$$ " * 20 if i % 2 else "plain words go on here. " * 20) for i in range(200)], "doc_id long, text string")
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, "### %%%"), (1, "### %%%"), (None, None), (2, ""), (3, "w " * 100_000)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = [(r.doc_id, r.score, r.n_passages) for r in quality.score(odd, model).collect()]
    assert got[0] == got[1] and all(0 <= s <= 1 for _, s, _ in got) and got[2][1:] == got[3][1:] and got[4][2] == -(-100_000 // quality.PASSAGE)


def test_links_of_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-2000])), (3, " ".join(reversed(words))), (4, "w" * 2_000_000), (5, "W" * 2_000_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup_docs.ngram_links(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(9))).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {1: (59_996, 1), 2: (57_996, 1), 3: (59_996, 3), 4: (1, 4), 5: (1, 4)}


@pytest.fixture(scope="module")
def odd_documents(spark):
    long = " ".join(f"u{i}" for i in range(80))
    rows = [(1, long), (1, long), (2, None), (None, "a line\nthat repeats"), (3, "that repeats\nbut not here"), (None, None), (4, ""), (5, "a line\n\n"), (6, "x" * 300_000 + "\nown words")]
    df = spark.createDataFrame([(i, t, None if i == 3 else "en", "web", None if i == 5 else len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"row": F.lit(1), "n_removed": F.lit(7), "score": F.lit(0.0), "predicted": F.lit(0)})


def test_lines_stage_on_odd_rows(spark, sf, odd_documents):
    """The first of equal lines stays, in order of ids, a null one last."""
    import corpus_pipeline as cp

    out = cp.lines_stage(spark, odd_documents, sf)
    assert tuple(out.columns) == cp.COLUMNS
    got = sorted(((r.doc_id, r.text, r.lang, r.n_chars) for r in out.collect()), key=str)
    by = {}
    for i, t, _, _ in got:
        by.setdefault(i, []).append(t)
    assert by[2] == [None] and by[4] == [""] and len(by[1]) == 1 and by[6][0].endswith("own words")
    lines = [line for ts in by.values() for t in ts for line in (t or "").split("\n") if WORD.search(line)]
    assert len(lines) == len(set(lines)) and {"a line", "that repeats", "but not here"} <= set(lines)


def test_quality_stage_on_odd_rows(spark, sf, odd_documents):
    """What stays are rows of the input, as its own model scores them."""
    import corpus_pipeline as cp

    out = cp.quality_stage(spark, odd_documents, sf)
    assert tuple(out.columns) == cp.COLUMNS
    docs = odd_documents.select(*cp.COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = quality.score(docs, model).filter("score >= 0.5").select(*cp.COLUMNS)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
