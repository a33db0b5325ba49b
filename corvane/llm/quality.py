"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded as a vector; gated attention
weighs the passages; the weighted sum is scored. Only document labels are known: which
passages matter is learned from them (gated attention pooling as published by Ilse,
Tomczak and Welling, 2018).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import small_batches, table
from corvane.llm.words import Hasher, chunks

#: Words of a passage.
PASSAGE = 64
#: Labelled documents, the first by a seeded hash of their id, that the model is fitted on.
SAMPLE = 6000
#: Passages of a document that the fit sees, evenly spaced over it. Scores see all.
MOST_PASSAGES = 64
BUCKETS = 32
HIDDEN, GATES = 32, 16
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.004, 1e-4
#: Byte classes: lower, upper, digit, newline, other space, beyond ASCII, and single marks.
MARKS = b".,!?|#%&*$@:;-_/<>()=+\"'"
N_CLASSES = 7 + len(MARKS)
N_STATS = N_CLASSES + 9
N_FEATURES = N_STATS + BUCKETS


def _byte_classes() -> np.ndarray:
    table = np.full(256, 6, dtype=np.int64)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[10], table[[9, 11, 12, 13, 32]], table[128:] = 3, 4, 5
    for i, b in enumerate(MARKS):
        table[b] = 7 + i
    return table


def encode(texts: pa.Array, hasher: Hasher, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features of all passages, number of passages of each text) for runs of texts. A
    text without words is one passage of zeros."""
    for lo, hi, data, offsets in chunks(texts):
        starts, ends, hashes, first = hasher.words(data, offsets)
        n_words = np.diff(first)
        bags = np.maximum(1, -(-n_words // PASSAGE))
        total = int(bags.sum())
        head = np.cumsum(bags) - bags
        own = np.repeat(np.arange(hi - lo), bags)
        turn = np.arange(total) - head[own]
        begin = np.minimum(first[own] + turn * PASSAGE, first[own + 1])
        count = np.minimum(first[own + 1] - begin, PASSAGE)
        x = np.zeros((total, N_FEATURES), dtype=np.float32)
        if len(starts):
            at = np.repeat(np.arange(total), count)  # passage of each word
            # Bytes of a passage: from its first word to the next passage's, or the text's end.
            left = np.where(count > 0, starts[np.minimum(begin, len(starts) - 1)], offsets[own])
            left = np.where(turn == 0, offsets[own], left)
            right = np.append(left[1:], len(data))
            right = np.where(np.append(own[1:], -1) != own, offsets[own + 1], right)
            size = right - left
            place = np.repeat(np.arange(total), size)
            x[:, :N_CLASSES] = np.bincount(place * N_CLASSES + classes[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES) / np.maximum(size, 1)[:, None]
            words = np.maximum(count, 1).astype(np.float64)
            length = (ends - starts).astype(np.float64)
            mean = np.bincount(at, length, total) / words
            x[:, N_CLASSES] = mean / 10
            x[:, N_CLASSES + 1] = np.sqrt(np.maximum(0, np.bincount(at, length**2, total) / words - mean**2)) / 10
            same = np.zeros(len(hashes))
            same[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
            x[:, N_CLASSES + 2] = np.bincount(at, same, total) / words
            key = np.sort((at.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
            new = np.append(True, key[1:] != key[:-1])
            x[:, N_CLASSES + 3] = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=total) / words
            opening, closing = classes[data[starts]], classes[data[ends - 1]]
            x[:, N_CLASSES + 4] = np.bincount(at, opening == 1, total) / words
            x[:, N_CLASSES + 5] = np.bincount(at, closing >= 6, total) / words
            x[:, N_CLASSES + 6] = np.bincount(at, (opening == 1) & (closing == 1), total) / words
            x[:, N_CLASSES + 7] = np.bincount(at, length <= 3, total) / words
            x[:, N_CLASSES + 8] = count / PASSAGE
            bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
            x[:, N_STATS:] = np.bincount(at * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / words[:, None]
        yield x, bags


class Model:
    """Encoder h = tanh(E x), attention a = softmax(w (tanh(V h) * sigmoid(U h))), score
    sigmoid(c sum(a h) + b)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = {"E": draw(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN), "V": draw(HIDDEN, GATES), "v": np.zeros(GATES), "U": draw(HIDDEN, GATES), "u": np.zeros(GATES), "w": draw(GATES, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "b": np.zeros(1)}

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"] + p["v"]), 1 / (1 + np.exp(-(h @ p["U"] + p["u"])))
        logit = (t * g) @ p["w"]  # bounded by sum|w|, so exp is safe
        head = np.cumsum(bags) - bags
        raw = np.exp(logit)
        a = raw / np.repeat(np.add.reduceat(raw, head), bags)
        z = np.add.reduceat(a[:, None] * h, head, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return x, h, t, g, a, z, y

    def step(self, x: np.ndarray, bags: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        p = self.p
        x, h, t, g, a, z, y = self.forward(x, bags)
        own, head = np.repeat(np.arange(len(bags)), bags), np.cumsum(bags) - bags
        d = (y - label) / len(bags)
        dz = d[:, None] * p["c"]
        dh = a[:, None] * dz[own]
        da = (h * dz[own]).sum(1)
        dl = a * (da - np.add.reduceat(a * da, head)[own])
        dt, dg = dl[:, None] * p["w"] * g * (1 - t * t), dl[:, None] * p["w"] * t * g * (1 - g)
        dh += dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        out = {"E": x.T @ dx, "e": dx.sum(0), "V": h.T @ dt, "v": dt.sum(0), "U": h.T @ dg, "u": dg.sum(0), "w": (t * g).T @ dl, "c": z.T @ d, "b": d.sum(keepdims=True)}
        return {k: v + DECAY * p[k] if k.isupper() or k in "wc" else v for k, v in out.items()}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Model:
    """Fit by Adam on the given bags. Without labels of both kinds, the score is the
    share of label 1 (one half without any) for all."""
    model = Model(seed)
    rate = labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < rate < 1:
        model.p["c"][:] = 0
        model.p["b"][:] = np.log((rate + 1e-3) / (1 - rate + 1e-3))
        return model
    every = np.concatenate(bags)
    model.mean, model.scale = every.mean(0), every.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    m, v, n = {k: np.zeros_like(x) for k, x in model.p.items()}, {k: np.zeros_like(x) for k, x in model.p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        pace = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            grad = model.step(np.concatenate([bags[j] for j in pick]), np.array([len(bags[j]) for j in pick]), labels[pick])
            n += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] = model.p[k] - pace * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id"):
    """True for the fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, classes = Hasher(), _byte_classes()
    for batch in batches:
        out = []
        for x, bags in encode(batch.column(0), hasher, classes):
            for part in np.split(x, np.cumsum(bags)[:-1]):
                out.append(part[np.unique(np.linspace(0, len(part) - 1, min(len(part), MOST_PASSAGES)).astype(np.int64))].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["bag", "label"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of `label_col`, fitted on at most `sample` labelled documents of the
    learning folds and MOST_PASSAGES of their passages, which bounds what the driver
    gets. Of several labels of a document the mean counts, rounded up; of several texts
    the one with the least hash."""
    small_batches(docs.sparkSession)
    usable = labels.filter(~held_out()).filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    picked = usable.groupBy("doc_id").agg((F.avg(label_col) >= 0.5).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")  # `sample` rows
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    rows = texts.select("text", "label").mapInArrow(_encode_batches, "bag binary, label double").collect()
    rows.sort(key=lambda r: (r[0], r[1]))  # the order of arrival must not show
    bags = [np.frombuffer(r[0], dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64) for r in rows]
    return fit(bags, np.array([r[1] for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, score (double, 0 to 1), n_passages, and the passage with the
    largest attention with its weight. Needs doc_id and text. Whole texts are read,
    without a shuffle. Cases: null and empty texts are a passage of zeros; repeated
    rows are scored alike; columns of the same names are replaced."""
    small_batches(docs.sparkSession)
    extra = {"score": "double", "n_passages": "long", "top_passage": "long", "top_weight": "double"}
    kept = [c for c in docs.columns if c not in extra]
    schema = ", ".join([f"`{n}` {t}" for n, t in docs.select(*kept).dtypes] + [f"{k} {t}" for k, t in extra.items()])
    text_at = kept.index("text")
    parts = model.p, model.mean, model.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, classes, own = Hasher(), _byte_classes(), Model()
        own.p, own.mean, own.scale = parts
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for x, bags in encode(batch.column(text_at), hasher, classes):
                *_, a, _, y = own.forward(x.astype(np.float64), bags)
                head = np.cumsum(bags) - bags
                best = np.maximum.reduceat(a, head)
                where = np.flatnonzero(a == np.repeat(best, bags))
                top = where[np.searchsorted(where, head)] - head
                for c, v in zip(cols, (y, bags, top, best), strict=True):
                    c.append(v)
            flat = [np.concatenate(c) if c else np.zeros(0) for c in cols]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat[0], pa.float64()), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.int64)), pa.array(flat[3], pa.float64())], names=[*kept, *extra])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels.quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_passage", "top_weight")


QUERIES = {"op6_quality": op6_quality}
ORACLE_SQL: dict[str, str] = {}
