"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, gated attention (tanh and sigmoid
branches, multiplied) weighs the encodings, and the weighted sum is scored by a logistic unit.
The only labels are those of documents; the weights of passages are learned from them. Passages
are described by their characters and by how their words repeat; training is a few thousand
parameters on a bounded sample of labelled documents, scoring runs over every passage of every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import hashing
from lodestar.llm.common import batches, discard, stored, table

#: Bounds of the sample of labelled documents that is learned from, in expectation: documents, and bytes of their texts. Each is read whole.
TRAIN_DOCS, TRAIN_BYTES = 6000, 64 << 20
PASSAGE_WORDS = 64
HASHED = 32
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 128, 0.01, 1e-4, 7
THRESHOLD = 0.3

_CLASS = np.full(256, 9, np.uint8)  # other ASCII
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|\t", b"#$%&*@^~")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 10
N_CLASS = 11
N_FEATURES = N_CLASS + 6 + HASHED
U = np.uint64


def features(text: str | None) -> np.ndarray:
    """A row for each passage of PASSAGE_WORDS words; one row of zeros for a text without words."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    data = np.frombuffer(raw, np.uint8)
    words = hashing.word_hashes(raw)
    if not len(words):
        return np.zeros((1, N_FEATURES), np.float32)
    space = hashing._SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    n = -(-len(words) // PASSAGE_WORDS)
    cuts = np.concatenate([[0], starts[PASSAGE_WORDS::PASSAGE_WORDS], [len(data)]])
    sizes = np.diff(cuts)
    passage = np.repeat(np.arange(n), sizes)
    chars = np.bincount(passage * N_CLASS + _CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS) / sizes[:, None]
    at = np.arange(len(words)) // PASSAGE_WORDS
    count = np.bincount(at, minlength=n)
    _, first, inverse = np.unique(words, return_index=True, return_inverse=True)
    fresh = np.bincount(first // PASSAGE_WORDS, minlength=n) / count  # words not seen before in the document
    own = np.bincount(np.unique(at * len(first) + inverse) // len(first), minlength=n) / count  # distinct within the passage
    again = np.bincount(at[1:], words[1:] == words[:-1], minlength=n) / count  # words that repeat the one before
    length = sizes / count
    bag = np.bincount(at * HASHED + (words & U(HASHED - 1)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED) / count[:, None]
    out = np.concatenate([chars, np.stack([fresh, own, again, np.log1p(length), np.log1p(count), np.full(n, np.log1p(len(words)))], 1), bag], 1)
    return out.astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Parameters and passes of the network."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = {
            "w": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
            "a": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """x: passages of all bags, those of bag i from starts[i] on."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        weight = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(weight[:, None] * h, starts)
        return x, h, t, s, weight, bag, z, _sigmoid(z @ p["c"] + p["d"])

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, t, s, weight, bag, z, out = self.forward(x, starts)
        err = (out - y) / len(y)
        dz = err[:, None] * p["c"]
        dh = weight[:, None] * dz[bag]
        dweight = (h * dz[bag]).sum(1)
        de = weight * (dweight - np.add.reduceat(weight * dweight, starts)[bag])
        dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
        dh = (dh + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": ((t * s) * de[:, None]).sum(0), "c": z.T @ err, "d": err.sum(keepdims=True)}


def train(bags: list[np.ndarray], y: np.ndarray) -> Model:
    """Adam on the cross-entropy of documents' labels; the order of `bags` decides nothing but rounding."""
    everything = np.concatenate(bags)
    rng = np.random.default_rng(SEED)
    model = Model(everything.mean(0), everything.std(0) + 1e-3, rng)
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            sizes = np.array([len(bags[i]) for i in some])
            grads = model.gradients(np.concatenate([bags[i] for i in some]), np.cumsum(sizes) - sizes, y[some])
            step += 1
            for k, g in grads.items():
                g = g + DECAY * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from `docs` (doc_id, text) joined with `labels` (doc_id, quality 0/1; repeated: the least). None if no document is labelled.

    Of all labelled documents those are learned from whose hash falls under a rate that keeps their
    number under TRAIN_DOCS and their texts under TRAIN_BYTES in expectation; every passage of them
    is. Of repeated rows with one doc_id the least text is taken; null texts are a passage of zeros.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rate = TRAIN_DOCS / max(labelled, 1)
    sample = known.where(draw < rate)
    if not labelled:
        return None
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    texts = stored(texts, "labelled")  # at most about TRAIN_DOCS rows by construction, whatever the size of the tables
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TRAIN_BYTES:
        texts = texts.where(draw < rate * (TRAIN_BYTES / size))

    def bag(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(it):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "bag": [features(t).tobytes() for t in pdf["text"]]})

    rows = texts.mapInPandas(bag, "doc_id long, quality int, bag binary").toArrow().sort_by([("doc_id", "ascending")])
    discard(texts)
    if not rows.num_rows:
        return None
    bags = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES).astype(np.float64) for x in rows["bag"].to_pylist()]
    return train(bags, rows["quality"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with `score` (0 to 1, higher: good likelier) and `predicted` (1 if score >= 0.3, else 0).

    Null and empty texts are one passage of zeros and get a score like any other. Without a model
    every score is 1. Every passage of the whole text counts; other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches(it):
            if model is None:
                value = np.ones(len(pdf))
            else:
                rows = [features(t) for t in pdf["text"]]
                sizes = np.array([len(x) for x in rows])
                value = model.forward(np.concatenate(rows).astype(np.float64), np.cumsum(sizes) - sizes)[-1]
            yield pdf.assign(score=value, predicted=(value >= THRESHOLD).astype(np.int32))

    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    return docs.select([f.name for f in kept]).mapInPandas(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` with its score; learned from the labelled rows that are not held out, as `fit` and `score` say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
