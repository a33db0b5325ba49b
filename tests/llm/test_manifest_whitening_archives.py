"""Manifest, whitening and archives against brute force, and the cases that they define."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corvane.llm import merkle, warc, whitening


def text_of(row):
    return [str(v) for v in row]


# 11 ------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests, arity):
    """Root, and for every leaf (place in its run, the run's others) by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, i in enumerate(at):
            head = i - i % arity
            paths[k].append((i - head, [digests[j] for j in range(head, min(len(digests), head + arity)) if j != i]))
            at[k] = i // arity
        digests = [H(*digests[k : k + arity]) for k in range(0, len(digests), arity)]
    return digests[0], paths


def plain_manifest(rows, arity=2):
    """rows(doc_id, source, lang, n_chars, text) as the contract states them."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append((ordered, *plain_tree([plain_leaf(r) for r in ordered], arity)))
    root, above = plain_tree([t[1] for t in trees], arity)
    out = []
    for (ordered, subroot, paths), rest in zip(trees, above, strict=True):
        for r, path in zip(ordered, paths, strict=True):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = plain_leaf((*r[:3], r[3] + 1, r[4]) if changed else r)
            for place, others in path + rest:
                now = H(*others[:place], now, *others[place:])
            out.append((r[0], plain_leaf(r), subroot, root, H(*(x for _, o in path + rest for x in o)), now, now == root))
    return sorted(out, key=text_of)


ODD_DOCUMENTS = [(None, "a", None, 5, "x"), (None, "a", None, 5, "x"), (1, None, "", None, ""), (1, None, "", None, None), (2**62, "é", "zz", 2**63 - 1, "ü" * 5), (0, "s", "zz", 2**63 - 1, "t" * 300_000), (7, "s", "é", 1, "t")]
DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"


def in_folder(spark, tmp_path, name, rows, schema):
    df = spark.createDataFrame(rows, schema).withColumn("leaf", F.lit("another column")).withColumn("digest", F.lit(1))
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("size", [0, 1, 2, 700])
def test_manifest_equals_brute_force(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(rng.randint(0, size), "s", rng.choice(["en", "en", "en", "de", None]), rng.randint(0, 9), "t" * rng.randint(0, 5)) for _ in range(size)]
    got = merkle.op11_merkle_manifest(spark, in_folder(spark, tmp_path, "documents", rows, DOCUMENTS)).collect()
    assert sorted(map(tuple, got), key=text_of) == (plain_manifest(rows) if rows else [])


def test_manifest_of_odd_rows(spark, tmp_path):
    got = merkle.op11_merkle_manifest(spark, in_folder(spark, tmp_path, "documents", ODD_DOCUMENTS * 3, DOCUMENTS)).collect()
    assert sorted(map(tuple, got), key=text_of) == plain_manifest(ODD_DOCUMENTS * 3)


@pytest.mark.parametrize("arity,levels", [(2, 1), (3, 2), (5, 1)])
def test_manifest_is_the_same_by_any_superstep(spark, arity, levels):
    rows = [(i, "s", f"l{i % 13 if i % 2 else 0}", 1, f"t{i}") for i in range(120)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    got = merkle.manifest(spark, df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", arity=arity, levels=levels, proofs=True).collect()
    want = {r[0]: r for r in plain_manifest(rows, arity)}
    for r in got:
        assert tuple(r)[:5] == want[r.doc_id][:5] and r.verified
        now = r.leaf
        for left, right in r.proof:  # a proof verifies its row on its own
            now = H(left, now, right)
        assert now == r.root


# 12 ------------------------------------------------------------------------------


def plain_whitening(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, ((n * x - s) / n) @ u, e


@pytest.mark.parametrize("rows,dim", [(500, 20), (40, 7), (30, 64)])
def test_whitening_equals_eigenvectors(spark, rows, dim):
    rng = np.random.default_rng(rows)
    v = rng.normal(5000, 1, (rows, dim)) * rng.uniform(0.5, 9, dim)
    v[rows // 2 :] = v[0]  # half of all rows are copies
    got = whitening.whiten(spark, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(7)).orderBy("vec_id").collect()
    n, deviation, projected, e = plain_whitening(v)
    live = min(16, dim, n - 1)
    want = projected[:, :live] / np.sqrt(e[:live])
    have = np.array([r.whitened[:live] for r in got])
    assert np.abs(have * np.sign((have * want).sum(0)) - want).max() < 1e-8
    assert [r.deviation for r in got] == deviation and {r.n for r in got} == {n}
    assert np.allclose(got[0].explained[:live], e[:live] / e.sum(), rtol=1e-6)
    assert got[0].identity_error < 1e-8 and all(x is None for x in got[0].whitened[live:])


def test_merging_loses_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(10**6 - 300, 10**6 + 300, (900, 12))
    whole = whitening.decompose(x)
    cuts = [0, 1, 5, 300, 899, 900]
    merged = whitening._merged([whitening.decompose(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
    assert merged[:2] == whole[:2] and merged[2].shape == (12, 12)
    assert np.allclose(merged[2].T @ merged[2], whole[2].T @ whole[2], rtol=1e-11)


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [1.0, 2.5, 3.0]), (4, None), (5, []), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 2.0]), (8, [1e300, 1.0, 2.0]), (9, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x"))
    got = whitening.whiten(spark, df).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "8", "9", "None"]
    assert {r.n for r in got if r.vec_id != 9} == {3}
    alone = next(r for r in got if r.vec_id == 9)
    assert (alone.n, alone.deviation, alone.whitened, alone.explained, alone.identity_error) == (1, 0, [None], [None], None)
    assert next(r for r in got if r.vec_id == 8).deviation is None
    assert whitening.whiten(spark, df.limit(0)).count() == 0


# 13 ------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def odd_pages():
    many = "<p>" + "x" * 300 + " P*M\x18\0\0\0\0 "  # the mark between archived records, in a text
    rows = [(i, f"http://a/{i} b\r\nc%é", many) for i in range(500)] + [(7, None, many)] * 3 + [(None, "u", None)] * 150 + [(5, "u", "short")] * 5
    return rows + [(9, "u", "é" * 1_000_000)] * 2 + [(None, "q", "z" * 100)] * 3 + [(3, "", "z" * 99)] * 2 + [(11, "u", "")]


def test_archives_round_trip(spark, tmp_path):
    rows = odd_pages()
    path = in_folder(spark, tmp_path, "pages", rows, PAGES)
    warc.write_archives(spark, spark.read.parquet(f"{path}/pages.parquet").repartition(5), f"{path}/out")
    got = warc.read_archives(spark, f"{path}/out", payloads=True).collect()
    by = {r.record_id: r for r in got}
    assert len(by) == len(rows)
    back = [(r.page_id, r.url, (r.payload if r.record_type == "response" else by[r.refers_to_record].payload).decode()) for r in got]
    assert sorted(back, key=text_of) == sorted(((a, b, c or "") for a, b, c in rows), key=text_of)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    want = con.sql(warc.ORACLE_SQL["op13_warc"])
    query = warc.op13_warc(spark, path).select(*want.columns).collect()
    assert sorted(map(tuple, query), key=text_of) == sorted(want.fetchall(), key=text_of)


def test_archive_layout(spark, tmp_path):
    """A skippable frame with a dictionary leads; each record decodes on its own."""
    rows = [(i, f"http://host/{i}", f"<html><body class='same for all pages'><p>{i * 7919}</p></body></html>" * 4) for i in range(400)]
    warc.write_archives(spark, spark.createDataFrame(rows, PAGES), f"{tmp_path}/out")
    files = sorted(tmp_path.glob("out/part-*"))
    assert files
    plain = 0
    for f in files:
        raw = f.read_bytes()
        assert int.from_bytes(raw[:4], "little") == 0x184D2A5D
        size = int.from_bytes(raw[4:8], "little")
        known = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        assert known.dict_id() != 0  # trained, not raw content
        one = zstandard.ZstdDecompressor(dict_data=known).decompress(raw[8 + size + 8 :], max_output_size=1 << 20)
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
        records = list(warc.read_frames(raw))
        assert records[0] == one
        plain += sum(len(zstandard.compress(r)) for r in records)
    assert sum(f.stat().st_size for f in files) < 0.6 * plain  # dictionaries counted, digests do not compress


def test_frames_by_windows_and_damage():
    rng = random.Random(3)
    records = [warc.encode_record(f"urn:page:{i}:0", "u", p, hashlib.sha256(p).hexdigest()) for i in range(30) for p in [rng.randbytes(rng.choice([0, 1, 5000]))]]
    archive = b"".join(f + warc.EMPTY_FRAME for f in warc.frames(iter(records)))
    for window in (1, 7, 1 << 16):
        assert list(warc.read_frames(archive, window)) == records
    with pytest.raises(ValueError):
        list(warc.read_frames(archive[: len(archive) // 2]))
    with pytest.raises(ValueError):
        warc.decode_record(records[0].replace(b"sha256:", b"sha256:0"))
    assert list(warc.frames(iter([]))) == []


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark, spark.createDataFrame([], PAGES), f"{tmp_path}/out")
    assert warc.read_archives(spark, f"{tmp_path}/out").count() == 0
