"""Training-data operators against brute force, and the cases that they define."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, graph, lines, mixing, neardup_docs, neardup_vectors, packing, quality, registry, secrets, setjoin, topk, urls
from corvane.llm.common import Workspace
from corvane.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
vocab = [f"w{i}" for i in range(60)]
graph_lot = graph.LOT


def test_every_operator_is_registered():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def shown(rows):
    return sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got.select(*want.columns).collect()) == shown(want.fetchall())


# 1 -------------------------------------------------------------------------------


def cheapest(roles):
    """Least cost over all ways to relabel turns, merge neighbours and put one empty turn
    before a turn, by what is legal: a system turn at the head, user first, in turns."""
    best = None
    for given in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        relabels = sum(a != b for a, b in zip(given, roles, strict=True))
        for merged in itertools.product((False, True), repeat=len(roles) - 1):
            if any(m and given[i] != given[i + 1] for i, m in enumerate(merged)):
                continue
            turns = [given[0], *(r for r, m in zip(given[1:], merged, strict=True) if not m)]
            for empty in itertools.product((None, "user", "assistant"), repeat=len(turns)):
                every = [x for e, t in zip(empty, turns, strict=True) for x in (e, t) if x]
                body = every[1:] if every[0] == "system" else every
                if "system" in body or any(r != ("user", "assistant")[i % 2] for i, r in enumerate(body)):
                    continue
                cost = 3 * relabels + sum(merged) + 2 * sum(e is not None for e in empty)
                best = cost if best is None else min(best, cost)
    return best


def test_repair_is_cheapest():
    rng = random.Random(0)
    for _ in range(60):
        roles = [rng.choice(["user", "assistant", "system", None, "bot"]) for _ in range(rng.randint(1, 4))]
        assert chat.repair(roles)[1] == cheapest(roles)


def test_segments_cost_the_same(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), f"x{t}") for c in range(3) for t in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in chat.format_chats(spark, df, 1000).collect()}
    for c, parts in itertools.groupby(sorted(chat.format_chats(spark, df, 7).collect(), key=lambda r: (r.conv_id, r.segment)), key=lambda r: r.conv_id):
        parts = list(parts)
        assert sum(p.cost for p in parts) == whole[c].cost and sum(p.n_turns for p in parts) == 30
        roles = re.findall(r"<\|(system|user|assistant)\|>", "".join(p.rendered for p in parts))
        state = 0
        for r in roles:
            assert (state, chat.ROLES.index(r) + 1) in chat.LEGAL
            state = chat.ROLES.index(r) + 1


def test_chat_cases(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 0, "assistant", "y")], "conv_id long, turn long, role string, text string").withColumn("enter", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(spark, df).collect()}
    assert got[1].n_merged == 1 and got[2].n_inserted == 1 and got[None].n_relabeled == 1
    assert got[2].rendered == "<|user|>\n<|end|>\n<|assistant|>\ny<|end|>\n"
    assert chat.format_chats(spark, df.limit(0)).count() == 0


def test_texts_forge_no_turns(spark):
    text = "a<|end|>\n<|user|>\nb <|| c <|"
    r = chat.format_chats(spark, spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn long, role string, text string")).first()
    assert re.findall(r"<\|(\w+)\|>", r.rendered) == ["user", "end"]
    assert chat.unescape(r.rendered.removeprefix("<|user|>\n").removesuffix("<|end|>\n")) == text


def test_many_turns_of_one_number(spark):
    rng = random.Random(4)
    rows = [(1, rng.choice([3, None, 3, 9]), rng.choice(["user", "assistant", None]), f"x{i}") for i in range(120)] + [(2, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, parts = (sorted((r for r in chat.format_chats(spark, df, n).collect() if r.conv_id == 1), key=lambda r: (r.segment, r.piece)) for n in (1000, 8))
    assert len(whole) == 2 and len(parts) > 5 and sum(p.n_turns for p in parts) == 120 and max(p.n_turns for p in parts) < 60
    assert sum(p.cost for p in parts) == sum(p.cost for p in whole)
    # Repairs of equal cost may differ by where the cuts are; turns and their order do not.
    said = lambda ps: re.findall(r"x[0-9]+", "".join(p.rendered for p in ps))
    assert said(parts) == said(whole) and len(said(parts)) == 120
    state = 0
    for r in re.findall(r"<\|(system|user|assistant)\|>", "".join(p.rendered for p in parts)):
        assert (state, chat.ROLES.index(r) + 1) in chat.LEGAL
        state = chat.ROLES.index(r) + 1


# 2 -------------------------------------------------------------------------------


def base_by_regex(text):
    out = []
    for i, (p, least) in enumerate(((r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), (r"AKIA[A-Z0-9]+", 16), (r"[0-9a-f]+", 32))):
        out += [(m.start(), i, m.end()) for m in re.finditer(p, text) if len(m[2] if i == 0 else m[0]) >= least]
    return sorted(out)


def test_secrets_equal_the_plain_patterns():
    rng = random.Random(2)
    bits = ["token", "=", ":", "secret", " ", '"', "abcdefgh", "0" * 33, "AKIA", "A" * 13, "api_key", "é", "TOKEN", "1f" * 16, "ſecret=abcdefgh"]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        base, every = secrets.scan(text)
        assert base == base_by_regex(text) and set(base) <= set(every)


def test_nested_layers_map_back():
    s = 'password = "abcdefgh1234"'
    b64 = base64.b64encode(s.encode()).decode()
    packed = base64.b64encode(zlib.compress((s * 3).encode())).decode()
    for layer in (b64, base64.b64encode(b64.encode()).decode(), packed, "".join(f"\\u{ord(c):04x}" for c in s), "".join(f"%{b:02x}" for b in s.encode())):
        base, every = secrets.scan("é x " + layer + " y")
        assert not [b for b in base if b[1] == 0] and any(k == 0 and 4 <= a < e <= 4 + len(layer) for a, k, e in every), layer
    assert secrets.scan(None) == ([], []) and secrets.scan("%25" * 50 + "41")[0] == []


def found_in(text, inside):
    return any(k == 0 and text.index(inside) <= a < e <= text.index(inside) + len(inside) for a, k, e in secrets.scan(text)[1])


def test_no_layer_is_left_out():
    s = 'password = "abcdefgh1234"'
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    nested = b64("".join(f"%{b:02x}" for b in s.encode()))
    many = " ".join(b64(f"nothing to see in {i:06d}") for i in range(10_050))
    assert found_in(nested + " " + many, nested) and found_in(many + " " + nested, nested)
    long = b64(zlib.compress(("é, so it goes on. " * 1_100_000 + s).encode(), 9))
    assert found_in("x " + long, long)
    run = b64(zlib.compress(b"a" * ((1 << 20) - 9) + b" " + s.encode()))
    assert found_in(run, run)
    chain = s.encode()
    for _ in range(secrets.MAX_CHAIN + 3):
        chain = zlib.compress(chain)
    assert [k for _, k, _ in secrets.scan(b64(chain))[1]] == [secrets.UNREAD]


def test_layers_of_any_bytes():
    import gzip

    s = 'password = "abcdefgh1234"'
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    for odd in ("\xa0", "\u3000", "\u200b", "\xad", "\ufeff", "\f", "\0"):
        for layer in (b64(odd + " " + s), b64(zlib.compress((odd + " " + s).encode()))):
            assert found_in("é " + layer, layer), (odd, layer)
    bare = zlib.compressobj(9, zlib.DEFLATED, -15)
    bare = bare.compress((s + ", and so on and so on").encode()) + bare.flush()
    assert found_in(b64(bare), b64(bare))
    for raw in (gzip.compress(gzip.compress(s.encode())), zlib.compress(gzip.compress(s.encode())), gzip.compress(b"a") + gzip.compress(s.encode())):
        assert found_in(b64(raw), b64(raw))
    for foreign in ("/", "a/", "user/home/", "abcde", "x" * 30 + "/"):
        for layer in (b64(s), b64(zlib.compress(s.encode())), b64(gzip.compress(s.encode()))):
            assert found_in(foreign + layer, layer), (foreign, layer)
    rng = random.Random(3)
    noise = "".join(rng.choices("qxzv ,", k=400))
    for raw in ((noise[:50] + s + noise[50:]).encode(), zlib.compress((noise + s).encode())):
        for end in ("\n", "\r\n", "\n  "):
            whole = b64(raw)
            wrapped = end.join(whole[i : i + 76] for i in range(0, len(whole), 76))
            assert found_in("key:\n" + wrapped + "\n\nnext", wrapped), (raw, end)
    # A span is that of the characters that hold the secret.
    assert secrets.scan("x " + b64("abc, " + s)) == ([], [(8, 0, 2 - (-(5 + len(s) - 1) * 4 // 3))])


def test_random_nesting():
    """Secrets under random layers; every one is found, within what holds it."""
    import gzip

    rng = random.Random(5)
    b64 = lambda x: base64.b64encode(x).decode()
    wraps = {
        "url": lambda t: "".join(f"%{x:02x}" for x in t.encode()),
        "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "base64": lambda t: b64(t.encode()),
        "zlib": lambda t: b64(zlib.compress(t.encode())),
        "gzip": lambda t: b64(gzip.compress(t.encode())),
        "both": lambda t: b64(gzip.compress(zlib.compress(t.encode()))),
    }
    for _ in range(60):
        t = rng.choice(['password = "abcdefgh1234"', "token: 'abcdefgh1234'", "secret=abcdefgh1234;"])
        for name in rng.choices(list(wraps), k=rng.randint(1, 4)):
            if len(t) > 20_000:
                break
            t = rng.choice(["", "note: ", "é, "]) + wraps[name](t) + rng.choice(["", " end", "."])
        before = "".join(rng.choices("abc ,.é", k=rng.randint(0, 9))) + " "
        assert any(k == 0 and len(before) <= a < e <= len(before) + len(t) for a, k, e in secrets.scan(before + t + " x")[1]), t[:200]


def test_layers_in_any_order():
    """Every pair of layers, and random ones: text layers hold bytes, compressed or not,
    and compressed data holds bytes before and after what counts."""
    import gzip

    rng = random.Random(6)
    b64 = lambda x: base64.b64encode(x)
    texts = {
        "base64": b64,
        "quoted": lambda x: "".join(chr(c) if chr(c).isalnum() and c < 128 else f"%{c:02X}" for c in x).encode(),
        "url": lambda x: "".join(f"%{c:02x}" for c in x).encode(),
        "x": lambda x: "".join(f"\\x{c:02x}" for c in x).encode(),
        "u": lambda x: "".join(f"\\u{c:04x}" for c in x).encode(),
        "utf16": lambda x: b64("".join(map(chr, x)).encode("utf-16-le")),
        "utf16be": lambda x: b64("".join(map(chr, x)).encode("utf-16-be")),
    }
    packs = {
        "gzip": lambda x: gzip.compress(x, mtime=0),
        "zlib": lambda x: zlib.compress(x),
        "behind": lambda x: gzip.compress(b"header, " + x + b"\xff trailer", mtime=0),
        "same": lambda x: x + b" ",
    }
    secret = b'password = "abcdefgh1234"'
    pairs = [(a, p, b, q) for a in texts for p in packs for b in texts for q in packs]
    chosen = [(a, p, b, q) for a, p, b, q in pairs if p == q] + rng.sample(pairs, 150)
    for a, p, b, q in chosen:
        if "utf16" in a + b and "utf16" in (a if p != "same" else "") + (b if q != "same" else ""):
            continue  # compressed bytes are no text of two-byte characters
        t = texts[b](packs[q](texts[a](packs[p](secret)))).decode()
        assert found_in("é, " + t + " x", t), (a, p, b, q)
    for a, p in itertools.product(texts, packs):
        if p == "same" or "utf16" not in a:
            t = texts[a](packs[p](secret)).decode()
            assert found_in(t, t), (a, p)


def test_short_and_deep_packed_runs():
    import gzip

    b64 = lambda x: base64.b64encode(x).decode()
    for raw, kind in ((b"0" * 32, 2), (b"AKIA" + b"A" * 12, 1), (b"token=aaaaaaaa", 0)):
        bare = zlib.compressobj(9, zlib.DEFLATED, -15)
        for packed in (zlib.compress(raw, 9), gzip.compress(raw, mtime=0), bare.compress(raw) + bare.flush()):
            for before in ("key ", "/", "a/"):
                t = before + b64(packed)
                assert any(k == kind and e <= len(t) and a >= len(before) for a, k, e in secrets.scan(t + " x")[1]), (raw, packed, before)
    chain = b"token=abcdefgh1234"
    for _ in range(20):
        chain = gzip.compress(chain, mtime=0)
    assert [k for _, k, _ in secrets.scan(b64(chain))[1]] == [secrets.UNREAD]
    assert [k for _, k, _ in secrets.scan(b64(chain), 20)[1]] == [0]


def test_packed_data_across_windows(monkeypatch):
    """Compressed data in unpacked bytes that are not held whole, wherever it begins."""
    import gzip

    monkeypatch.setattr(secrets, "WHOLE", 3000)
    monkeypatch.setattr(secrets, "WINDOW", 1000)
    monkeypatch.setattr(secrets, "PROBE", 64)
    rng = random.Random(7)
    filler = rng.randbytes(1500).hex().upper().encode().replace(b"0", b", ")
    for at in (0, 1, 900, 2950, 3000, 3100, 9000):
        inner = gzip.compress(rng.randbytes(2500) + b" token=abcdefgh1234 ", mtime=0)
        t = base64.b64encode(gzip.compress((filler * 4)[:at] + inner + filler, mtime=0)).decode()
        assert found_in(t, t), at


def test_a_find_ends_at_its_last_place():
    s = 'xx password = "abcdefgh1234'
    t = base64.b64encode(s.encode()).decode().rstrip("=")
    whole = t + "%3D" * (-len(t) % 4)
    ends = {e for _, k, e in secrets.scan(whole)[1] if k == 0}
    assert len(ends) == 1 and (not -len(t) % 4 or ends == {len(whole)})


def test_scan_of_noise_takes_little():
    import time

    text = base64.b64encode(random.Random(8).randbytes(1 << 20)).decode()
    began = time.process_time()
    secrets.scan(text)
    assert time.process_time() - began < 10


def test_long_text_with_one_escape():
    import tracemalloc

    text = "plain words, " * 200_000 + "token%3Dabcdefgh1234 " + "and more, " * 200_000
    tracemalloc.start()
    assert any(text[a:e] == "token%3Dabcdefgh1234" for a, k, e in secrets.scan(text)[1])
    assert tracemalloc.get_traced_memory()[1] < 12 * len(text)
    tracemalloc.stop()


def test_secret_rows(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh"), (1, "token=abcdefgh"), (2, None), (None, "")], "doc_id long, text string").withColumn("spans", F.lit(0))
    got = sorted(secrets.scan_secrets(df).collect(), key=str)
    assert len(got) == 4 and sum(r.n_assign for r in got) == 2
    assert {r.base_sha256 for r in got if not r.n_assign} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan_secrets(df.limit(0)).count() == 0


# 3 -------------------------------------------------------------------------------


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "CELL", 30)
    monkeypatch.setattr(neardup_vectors, "SLICE", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    x = np.concatenate([base, base[:25] + rng.normal(scale=0.15, size=(25, 6)), base[:5] * 2, np.repeat(base[:1], 40, 0) + rng.normal(scale=0.05, size=(40, 6))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0, None] + [0.0] * 4), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {r.vec_id: r for r in neardup_vectors.near_links(spark, df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a = u @ u.T >= 0.9
    np.fill_diagonal(a, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[a[i]].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (a[i].sum(), label[i], label[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))
    assert neardup_vectors.near_links(spark, df.limit(0)).count() == 0


def test_vectors_that_share_ids(spark):
    rows = [(7, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (8, [1.0, 0.01, 0.0]), (None, [0.0, 1.0, 0.01]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.01, 1.0]), (5, [0.02, 1.0, 0.0]), (8, [1.0, 0.01, 0.0])]
    got = neardup_vectors.near_links(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    expected = [(7, 2, 7, True), (7, 2, 5, False), (8, 2, 7, False), (8, 2, 7, False), (None, 2, 5, False), (5, 2, 5, True), (None, 1, None, False), (None, 1, None, False)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


# 4 -------------------------------------------------------------------------------


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 5))
        x, c = np.sort(rng.choice(np.arange(1, 60), n, replace=False)), rng.integers(1, 5, n)
        cost = lambda bs: sum(m * min(b for b in bs if b >= v) for v, m in zip(x, c, strict=True))  # noqa: B023, E731
        best = min(cost([*s, x[-1]]) for j in range(min(k, n)) for s in itertools.combinations(x[:-1], j))
        got = packing.bucket_bounds(x, c, k)
        assert len(got) <= k and cost(got) == best


def test_packing_keeps_every_token(spark):
    df = spark.createDataFrame([(1, 250), (2, 0), (3, None), (4, 30), (4, 30), (None, 99)], "doc_id long, n_tokens long").withColumn("bucket", F.lit("x"))
    out = packing.pack(spark, df, max_length=100, buckets=3, token_budget=200).collect()
    assert sum(r.n_tokens for r in out) == 250 + 30 + 30 + 99 and len(out) == 3 + 5
    for _, batch in itertools.groupby(sorted(out, key=lambda r: (r.bucket, r.batch)), key=lambda r: (r.bucket, r.batch)):
        batch = list(batch)
        assert len({r.slot for r in batch}) == len(batch) <= max(1, 200 // max(1, batch[0].padded))
        assert all(r.n_tokens <= r.padded for r in batch)
    assert packing.pack(spark, df.limit(0)).count() == 0
    texts = spark.createDataFrame([(i, list(range(n))) for i, n in enumerate((250, 0, 30, 100))], "doc_id long, words array<int>")
    cut = packing.pack(spark, texts, F.size("words"), max_length=100, buckets=2, tokens="words")
    assert all(r.tokens == list(range(r.start, r.start + r.n_tokens)) for r in cut.collect())
    totals = packing.padding(cut).collect()
    assert sum(r.padding for r in totals) == sum(r.padded - r.n_tokens for r in cut.collect()) and sum(r.pieces for r in totals) == 6


# 5 and 7 -------------------------------------------------------------------------


def noisy_texts(seed, n):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(n)]
    for _ in range(n):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    shared = " ".join(rng.choices(vocab, k=30))
    return texts + [shared + " " + t for t in texts[:15]] + ["", None, "  ", "A b", "a B", texts[0]]


@pytest.mark.parametrize("most", [1, 8])
def test_ngram_links_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(setjoin.candidates, "__defaults__", (most,))
    monkeypatch.setattr(setjoin, "SLICE", 7)
    texts = noisy_texts(5, 60)
    ids = list(range(len(texts)))
    # Rows that repeat an id, with the same and with another text, and null ids that link others.
    long = [f"v{i}" for i in range(60)]
    chain = [" ".join(["x"] * k + long[k:]) for k in (0, 4, 8, 12)]
    for i, t in ((7, texts[7]), (7, texts[8]), (900, chain[0]), (None, chain[1]), (901, chain[2]), (None, chain[3]), (None, "quite alone with these words here"), (902, "a " + "b" * 100_000)):
        ids.append(i)
        texts.append(t)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({"d": F.lit(1), "row": F.lit(2)})
    got = neardup_docs.ngram_links(spark, df).collect()

    def shingles(t):
        w = WORD.findall(low(t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = [shingles(t) for t in texts]
    label = list(range(len(s)))
    for _ in range(len(s)):
        old = list(label)
        for i, j in itertools.combinations(range(len(s)), 2):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                label[i] = label[j] = min(label[i], label[j])
        if old == label:
            break
    least = {c: min((ids[i] for i in range(len(s)) if label[i] == c and ids[i] is not None), default=None) for c in set(label)}
    expected = []
    for i in range(len(s)):
        c = least[label[i]] if s[i] else ids[i]
        expected.append((ids[i], len(s[i]), c, c is not None and c == ids[i]))
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got))) == sorted(map(str, expected))
    assert neardup_docs.ngram_links(spark, df.limit(0)).count() == 0


def lines_left(rows):
    """Lines that stay in each of (id, text) rows: brute force, in the order of rows."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    words = lambda line: frozenset(WORD.findall(low(line)))
    width = max(((t or "").count("\n") for _, t in rows), default=0)
    seen, out = [], {k: [] for k in order}
    # Rows that share an id are compared place by place.
    for _, group in itertools.groupby(order, key=lambda k: rows[k][0]):
        group = list(group)
        for place in range(width + 1):
            for k in group:
                lines_ = (rows[k][1] or "").split("\n")
                if place < len(lines_):
                    w = words(lines_[place])
                    if not w or not any(5 * len(w & v) >= 4 * len(w | v) for v in seen):
                        out[k].append(lines_[place])
                    seen += [w] if w else []
    return [None if t is None else "\n".join(out[k]) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("nearest", [1, 4])
def test_line_dedup_equals_brute_force(spark, monkeypatch, nearest):
    monkeypatch.setattr(lines, "NEAREST", nearest)
    rng = random.Random(7)
    pool = [t for t in noisy_texts(7, 40) if t]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 4))) for _ in range(60)] + [None, "", "\n\n"]
    rows = [(None, pool[3] + "\nnew"), *enumerate(texts), (900, texts[0]), (900, texts[0]), (901, pool[9] + " x\n\ny z")]
    rows += [(902, "some words that no other text has\n \nq"), (902, "some words that no other text has\n \nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("x"), "id": F.lit(1), "__gone": F.lit(2), "__row": F.lit(3), "row": F.lit(4), "gone": F.lit(5)})
    out = lines.dedup_lines(spark, df)
    assert out.columns == ["doc_id", "text", "id", "__gone", "__row", "row", "gone", "n_lines", "n_removed"]
    got = out.collect()
    expected = [(i, t, 0 if u is None else u.count("\n") + 1) for (i, u), t in zip(rows, lines_left(rows), strict=True)]
    assert sorted(map(str, ((r.doc_id, r.text, r.n_lines) for r in got))) == sorted(map(str, expected))
    assert lines.dedup_lines(spark, df.limit(0)).count() == 0


def test_line_dedup_cuts_a_text_once_and_skips_unchosen_lines(spark):
    docs = spark.createDataFrame([(1, "a b c\nd"), (2, "a b c\n\ne f"), (3, None), (4, "")], "doc_id long, text string")
    out = lines.dedup_lines(spark, docs)
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == {1: ("a b c\nd", 2, 0), 2: ("\ne f", 3, 1), 3: (None, 0, 0), 4: ("", 1, 0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    data = np.frombuffer(b"a b c\nd b\ne", dtype=np.uint8)
    t, level = lines.Texts(lines.Hasher(), 0, 1, data, np.array([0, len(data)])), np.ones(1 << lines.COUNTERS, dtype=np.uint8)
    keys, at = lines.ordered_words(t, level)
    some, ends = lines.ordered_words(t, level, np.isin(np.arange(lines.RESIDUES), (keys[at[1] : at[2]] % np.uint64(lines.RESIDUES)).astype(np.int64)))
    assert np.diff(at).tolist() == [3, 2, 1] and np.diff(ends).tolist() == [3, 2, 0] and (some == keys[:5]).all()
    parts = [np.array([9, 4, 7, 2], dtype=np.uint64), np.array([1, 2, 3, 4], dtype=np.uint32)]
    dealt = lines._dealt(np.array([1, 0, 1, 3]), parts)
    assert list(zip(*(c.to_pylist() for c in dealt.columns), strict=True)) == list(setjoin._blobs(np.array([1, 0, 1, 3]), parts))


def test_every_line_dedup_equals_brute_force(spark):
    rng = random.Random(17)
    pool = [" ".join(rng.choices(vocab[:8], k=rng.randint(1, 7))) for _ in range(120)] + ["再版", "a b c d " * 125, "", " "]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 4))) for _ in range(60)] + [None, "a b c d " * 125, "y" * 70_000, "z\n" * 3000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [t for _, t in sorted((r.doc_id, r.text) for r in lines.dedup_lines(spark, df).fillna("none").collect())] == [t if t is not None else "none" for t in lines_left(rows)]


def test_line_query_removes_short_repeats(spark, tmp_path):
    spark.createDataFrame([(1, "see also\none two three four five six"), (2, "See  also\nnew"), (3, "new\n\nnew")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_chars_left) for r in lines.op7_line_dedup(spark, str(tmp_path)).collect()} == {1: (2, 0, 36), 2: (2, 1, 3), 3: (3, 2, 0)}


class Spied(Workspace):
    """Notes how many exchanges the plan of each saved table has."""

    def save(self, df, name):
        self.widths = [*getattr(self, "widths", []), (df._jdf.queryExecution().executedPlan().toString().count("Exchange "), name)]
        return super().save(df, name)


@pytest.mark.parametrize("lot", [graph.LOT, 8])
def test_components(spark, monkeypatch, lot):
    monkeypatch.setattr(graph, "LOT", lot)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(30)]
    ws = Spied(spark)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert len(ws.widths) == 2 if lot == graph_lot else len(ws.widths) > 2  # a short list takes no rounds


def test_near_copies_take_small_plans(spark, sf, monkeypatch):
    spies = []
    monkeypatch.setattr(neardup_docs, "Workspace", lambda s: spies.append(Spied(s)) or spies[-1])
    neardup_docs.op5_ngram_links(spark, sf)
    assert max(spies[0].widths)[0] <= 12 and sum(n for n, _ in spies[0].widths) <= 120, sorted(spies[0].widths)


# 6 -------------------------------------------------------------------------------


def test_quality_gradients_and_held_out_accuracy(spark):
    rng = np.random.default_rng(6)
    model, bags, x, y = quality.Model(1), np.array([3, 1, 4]), rng.normal(size=(8, quality.N_FEATURES)), np.array([1, 0, 1.0])
    grad = model.step(x, bags, y)
    loss = lambda: -(y * np.log(p := model.forward(x, bags)[-1]) + (1 - y) * np.log(1 - p)).mean()
    for k, g in grad.items():
        at = tuple(rng.integers(0, s) for s in model.p[k].shape)
        old = model.p[k][at]
        decay = quality.DECAY * old if k.isupper() or k in "wc" else 0
        model.p[k][at] = old + 1e-5
        up = loss()
        model.p[k][at] = old - 1e-5
        down = loss()
        model.p[k][at] = old
        assert abs((up - down) / 2e-5 + decay - g[at]) < 1e-6
    d = "/root/testdata/sf0.01"
    got = quality.op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93


def test_features_and_scores_equal_plain_ones():
    import pyarrow as pa

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Word", "word", "9x", "a,", "ÉÉ", "longerword", "A.", "word"]) for _ in range(rng.randint(0, 150))) + rng.choice(["", "\n", " "]) for _ in range(12)]
    hasher, classes = quality.Hasher(), quality._byte_classes()
    rows = [(x, n) for x, n in quality.encode(pa.array(texts), hasher, classes)]
    x, bags = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    at = 0
    for text, n in zip(texts, bags, strict=True):
        raw = text.encode()
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        assert n == max(1, -(-len(words) // quality.PASSAGE))
        for k in range(n):
            own = words[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
            lo = 0 if k == 0 else own[0][0]
            hi = words[(k + 1) * quality.PASSAGE][0] if k + 1 < n else len(raw)
            part = raw[lo:hi]
            if own:
                share = np.bincount(classes[np.frombuffer(part, dtype=np.uint8)], minlength=quality.N_CLASSES) / len(part)
                assert np.allclose(x[at, : quality.N_CLASSES], share, atol=1e-6)
                said = [raw[a:b].lower() for a, b in own]
                sizes = np.array([len(w) for w in said])
                stats = [sizes.mean() / 10, sizes.std() / 10, sum(a == b for a, b in zip(said, said[1:])) / len(said), len(set(said)) / len(said)]  # noqa: B905
                assert np.allclose(x[at, quality.N_CLASSES : quality.N_CLASSES + 4], stats, atol=1e-5)
            at += 1
    model = quality.Model(2)
    *_, weights, _, y = model.forward(x.astype(float), bags)
    p, at = model.p, 0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for n, score in zip(bags, y, strict=True):
        h = [np.tanh(np.clip(x[i], -8, 8) @ p["E"] + p["e"]) for i in range(at, at + n)]
        logits = [(np.tanh(v @ p["V"] + p["v"]) * sigmoid(v @ p["U"] + p["u"])) @ p["w"] for v in h]
        a = np.exp(logits) / np.exp(logits).sum()
        assert np.allclose(a, weights[at : at + n]) and np.isclose(score, sigmoid(sum(w * v for w, v in zip(a, h, strict=True)) @ p["c"] + p["b"][0]))
        at += n


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "x " * 50_000, 9.0)], "doc_id long, text string, score double")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.score(docs, model).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got) and max(r.n_passages for r in got) == -(-50_000 // quality.PASSAGE)
    assert quality.score(docs.limit(0), model).count() == 0


# 8 -------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = [
        ("https://a.example.COM/en/70?x", "a.example.com", "/en/70", "example.com/en/7", "allow"), ("http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
        ("http://xcom/en/1", "xcom", "/en/1", None, "allow"), ("http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "allow"), ("http://n.net/de/9#f", "n.net", "/de/9", "net/de/", "block"),
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("a://h?q=://z/en/", "h", "", None, "allow"), ("u://o.org/es/", "o.org", "/es/", "org/es/", "block"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in urls.judge(spark, df, spark.createDataFrame([], "url string, bad boolean")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(cases))] == [c[1:] for c in cases]


def test_url_mining(spark):
    good = [(f"https://good{i % 5}.example.org/a/{i}", False) for i in range(60)]
    bad = [(f"https://www.pills.example.org/buy/{i}?ref=x", True) for i in range(40)]
    labelled = spark.createDataFrame(good + bad, "url string, bad boolean")
    mined = urls.mine_rules(labelled)
    assert mined and all(c >= urls.CONFIDENCE and n >= urls.LEAST for _, n, c in mined)
    counts = lambda key: [b for u, b in good + bad if set(key) <= own[u]]
    own = {r.url: set(r.t) for r in labelled.select("url", urls.tokens_of(F.col("url")).alias("t")).collect()}
    assert all(len(counts(k)) == n and abs(sum(counts(k)) / n - c) < 1e-9 for k, n, c in mined)
    pages = spark.createDataFrame([(1, "http://pills.example.org/buy/9?ref=y"), (2, "https://good1.example.org/a/7")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(spark, pages, labelled, ()).collect()} == {1: "block", 2: "allow"}


def test_url_rules_equal_all_combinations(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        names = [f"n{k}" for k in range(7) if rng.random() < 0.5]
        bad = {"n2", "n5"} <= set(names) and rng.random() < 0.9 or rng.random() < 0.1
        always = "".join(f"a{k}=1&" for k in range(8))  # before the names, in all URLs
        rows.append((f"https://w.x.y.example.org/one/two/{i}?{always}{'&'.join(f'{n}=1' for n in names)}", bad))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = urls.mine_rules(labelled)
    own = [(set(re.findall(r"n[0-9]", u)), b) for u, b in rows]
    strong = {}
    for k in range(1, 8):
        for key in itertools.combinations([f"n{i}" for i in range(7)], k):
            hits = [b for t, b in own if set(key) <= t]
            if len(hits) >= urls.LEAST and sum(hits) / len(hits) >= urls.CONFIDENCE and not any(s < set(key) and c >= sum(hits) / len(hits) for s, c in ((set(x), y[1]) for x, y in strong.items())):
                strong[key] = (len(hits), sum(hits) / len(hits))
    assert ("n2", "n5") in strong and {tuple(t[2:] for t in k): (n, c) for k, n, c in mined} == strong
    pages = spark.createDataFrame([(1, f"http://h.org/?{'&'.join(f'z{i}' for i in range(30))}&n2&n5"), (2, "http://h.org/?n2")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(spark, pages, labelled, ()).collect()} == {1: "block", 2: "allow"}
    got = spark.createDataFrame([("http://a.b.c.d.org/p/q/r/s9",)], "url string").select(urls.tokens_of(F.col("url")).alias("t")).first().t
    assert {"h:a.b.c.d.org", "h:b.c.d.org", "h:c.d.org", "h:d.org", "m:q", "m:r", "p:p", "l:s9"} <= set(got)


# 9 -------------------------------------------------------------------------------


def test_budget_fit_is_nearest():
    rng = np.random.default_rng(9)
    for _ in range(150):
        n = int(rng.integers(1, 6))
        x, c = rng.choice(np.arange(1, 50), n, replace=False), rng.integers(1, 4, n)
        goal = float(rng.uniform(0, (x * c).sum() * 1.1))
        sums = {0}
        for v, m in zip(x, c, strict=True):
            sums = {s + j * v for s in sums for j in range(m + 1)}
        take = mixing.fit_budget(x, c, goal)
        assert (take <= c).all() and (take >= 0).all()
        assert abs((take * x).sum() - round(goal)) <= min(abs(s - round(goal)) for s in sums) + 1
        near = mixing.fit_budget(x, c, goal, exact=40)
        assert (near <= c).all() and (near >= 0).all()


def test_large_budgets_are_met():
    """Above EXACT_BUDGET an even share goes first; the sum still is the nearest one."""
    rng = np.random.default_rng(2)
    for _ in range(5):
        x = np.sort(rng.choice(np.arange(1, 3000), 300, replace=False))
        c = rng.integers(1, 400, 300)
        goal = int(rng.uniform(0.2, 0.8) * (x * c).sum())
        take = mixing.fit_budget(x, c, goal)
        assert goal > mixing.EXACT_BUDGET and (take >= 0).all() and (take <= c).all() and (take * x).sum() == goal
        share = (take * x).sum() / (x * c).sum()
        assert np.median(np.abs(take / c - share)) < 0.02


def test_targets_equal_turn_by_turn_sharing(spark):
    rng = random.Random(1)
    for sizes in ([5, 100, 3, 0, 40, 41, 7], [10], [0, 0], [rng.randint(0, 500) for _ in range(40)]):
        totals = spark.createDataFrame([(f"s{i:02d}" if i else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = {r.source: r.target for r in mixing.fill_targets(totals, (1.0, 2.0, 3.0), 3, Workspace(spark)).collect()}
        order = sorted(got, key=lambda s: (s is None, s or ""))
        size = {f"s{i:02d}" if i else None: n for i, n in enumerate(sizes)}
        weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(order)}
        full: set = set()
        while True:
            left, free = sum(sizes) - sum(3 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
            want = {s: 3 * size[s] if s in full else left * weight[s] / free for s in order}
            over = {s for s in order if s not in full and want[s] > 3 * size[s]}
            if not over:
                break
            full |= over
        assert all(abs(got[s] - want[s]) < 1e-6 for s in order)


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(["w"] * rng.randint(1, 9))) for i in range(200)] + [(500, "c", None), (501, "c", ""), (7, "a", "w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("x"))
    got = mixing.mix_sources(spark, df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(spark, df).collect())) and len(got) == len(rows)
    total = sum(r.size for r in got)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert mine[0].source_size == sum(r.size for r in mine) and mine[0].target <= 3 * mine[0].source_size + 1e-6
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in mine)
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6
    assert mixing.mix_sources(spark, df.limit(0)).count() == 0


# 10 ------------------------------------------------------------------------------


def test_top_k_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op10_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect())) == sorted(con.sql(topk.ORACLE_SQL["op10_top_k"]).fetchall())


def test_top_k_cases(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", 8)
    rng = np.random.default_rng(10)
    x = rng.integers(-3, 4, size=(60, 3)) / 4.0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(100, None), (150, [float("inf")] * 3), (200, [1.0]), (250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    v = np.floor(x * 256).astype(int)
    got = sorted(map(tuple, topk.top_k(spark, df, F.col("vec_id") % 50 == 0).collect()))
    expected = []
    for q in (0, 50):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-int(v[q] @ v[i]), i))[:5]
        expected += [(q, n + 1, i, int(v[q] @ v[i])) for n, i in enumerate(order)]
    # The query of one number has no other vector of its length to find.
    assert got == expected
    assert topk.top_k(spark, df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(spark, df, F.lit(None).cast("boolean")).count() == 0


def plain_top(rows, asks):
    """Result rows of queries among (id, vector), by the number of the row."""
    out = []
    x = [np.floor(256 * np.array(v)).astype(int) for _, v in rows]
    for i, (q, _) in enumerate(rows):
        if asks(q):
            order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-int(x[i] @ x[j]), rows[j][0] is None, rows[j][0] or 0))[:5]
            out += [(q, n + 1, rows[j][0], int(x[i] @ x[j])) for n, j in enumerate(order)]
    return sorted(out, key=str)


def test_top_k_goes_by_row(spark, tmp_path, monkeypatch):
    """Rows that share an id find one another, and rows without an id are found."""
    monkeypatch.setattr(topk, "SLICE", 8)
    monkeypatch.setattr(topk, "RING", 4)
    small = [(50, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [0.5, 0.0])]
    rng = np.random.default_rng(11)
    large = [(rng.choice([0, 50, 7, None, 8, 9, 100]), (rng.integers(-8, 9, 4) / 8.0).tolist()) for _ in range(150)]
    large = [(None if i is None else int(i), v) for i, v in large]
    for name, rows in (("small", small), ("large", large), ("alike", [(50, [1.0, 2.0])] * 40 + [(None, [1.0, 2.0])] * 40)):
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        got = [tuple(r) for r in topk.op10_top_k(spark, f"{tmp_path}/{name}").select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(got, key=str) == plain_top(rows, lambda q: q is not None and q % 50 == 0), name
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/{name}/embeddings.parquet/*.parquet'")
        assert sorted(con.sql(topk.ORACLE_SQL["op10_top_k"]).fetchall(), key=str) == sorted(got, key=str)
    # Queries from outside are compared with all rows, their equals too.
    df = spark.createDataFrame(small, "vec_id long, embedding array<double>")
    out = sorted(map(tuple, topk.top_k(spark, df, df.limit(1), 2).select("query_id", "rank", "vec_id", "score").collect()))
    assert out == [(50, 1, 50, 2 * 256 * 256), (50, 2, 50, 256 * 256)]


# pipeline ------------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = cp.quality_stage(spark, docs, sf)
    assert tuple(first.columns) == cp.COLUMNS
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert len(good & kept) > 0.95 * len(good)
    out = cp.run(spark, sf)
    assert out.count() > 0 and out.filter("n_tokens > padded").count() == 0
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= kept


def test_exact_copy_with_short_lines_goes(spark, sf):
    import corpus_pipeline as cp

    a = "Chapter one\nit was a quiet day at the old harbour\n\nThe end"
    rows = [(1, a), (2, "another text with words of its own\nsee also"), (3, a), (4, None), (5, "The end\nof something new and different")]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = cp.lines_stage(spark, df, sf)
    got = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert got == {1: (a, len(a)), 2: (rows[1][1], len(rows[1][1])), 4: (None, 0), 5: ("of something new and different", 30)}
    assert {r.doc_id for r in cp.documents_stage(spark, left, sf).collect()} == {1, 2, 4, 5}


def test_pipeline_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls, empty texts, repeated rows and ids, more columns, and no rows at all."""
    import corpus_pipeline as cp

    long = " ".join(f"u{i}" for i in range(80))
    rows = [(1, long), (1, long), (1, "another text of the same id with words"), (2, "v " + long), (None, long + " w"), (None, None), (3, None), (4, ""), (4, ""), (5, "short one"), (6, "quite different words " * 9)]
    df = spark.createDataFrame([(i, t, "en", None if i == 3 else "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "__row": F.lit(2), "score": F.lit(0.0), "times": F.lit(1)})
    assert cp.quality_stage(spark, df, sf).count() >= 0
    left = cp.documents_stage(spark, df, sf)
    assert left.columns == list(cp.COLUMNS)
    # Of 1, 1, 2 and the null id, near copies, one row stays; without words all do.
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted([("1", long), ("1", rows[2][1]), ("None", ""), ("3", ""), ("4", ""), ("4", ""), ("5", "short one"), ("6", rows[10][1])])
    words = lambda t: len(WORD.findall(t or ""))
    mixed = cp.mixing_stage(spark, df, sf)
    taken, total = {}, sum(words(t) for _, t in rows)
    for r in mixed.collect():
        taken[r.doc_id, r.text] = taken.get((r.doc_id, r.text), 0) + 1
    assert set(taken) <= set(rows) and all(n <= 3 * rows.count(k) for k, n in taken.items())
    assert abs(sum(n * words(t) for (_, t), n in taken.items()) - total) <= 2
    packed = cp.packing_stage(spark, df, sf).collect()
    assert len(packed) == len(rows) and sum(r.n_tokens for r in packed) == total
    for stage in (cp.quality_stage, cp.lines_stage, cp.documents_stage, cp.mixing_stage, cp.packing_stage):
        assert stage(spark, df.limit(0), sf).count() == 0
