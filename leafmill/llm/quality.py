"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader (FTRL-proximal).

A text is split at ASCII white space. Each word has two faces: the lower-cased word, and its shape (letters, capitals,
digits and the symbols around them, lengths left out). Features are hashed n-grams of one and two words, of one to three
shapes, and a mark for each word that repeats the one before. A feature weighs 1 / sqrt(number of words) at each
occurrence, so a score is one sparse dot product over the whole text.

Training takes a bounded sample (labelled_sample: at most `per_class` texts of each class, whole, of CLASS_BYTES together); the
classes' counts over all labelled rows put the odds right afterwards.

Defined results: null and empty texts score by the intercept alone; very long texts and words are read to their end; repeated
rows and equal texts score alike (rows that repeat an id are one in training, the least text counts); without labels, or with labels
of a single class, the score is the (smoothed) share of label 1; an empty table gives an empty table; further columns are
ignored by score() and kept by keep().
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame

from .common import Words, filter_scores, in_order, labelled_sample, map_scores, mix64, sigmoid, worker_cache

BITS = 18
#: Texts of each class that training takes at most.
PER_CLASS = 2500
MAX_WORDS = 400_000

_RUNS = re.compile(r"(A+)|(a+)|(0+)|(.)\4*", re.S)


def shape(word: str) -> str:
    """Letters as A or a, digits as 0, other characters as they are; runs shortened to one (symbols: to two)."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(lambda m: m[0][:1] if m[4] is None else m[0][:2], kinds)


class Hasher:
    """Texts to hashed n-gram feature indices."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.known = Words(MAX_WORDS)

    @staticmethod
    def look(words: list[bytes]) -> list[bytes]:
        """Both hashes of each word, big-endian: 16 bytes take less room than two numbers, and join into an array at once."""
        import xxhash

        texts = [w.decode("utf-8", "replace") for w in words]
        return [xxhash.xxh3_64_digest(t.lower().encode()) + xxhash.xxh3_64_digest(shape(t).encode(), 7) for t in texts]

    def features(self, text: str | None):
        """(indices with repeats, number of words)."""
        import numpy as np

        words = (text or "").encode().split()  # bytes split at ASCII white space alone
        n = len(words)
        if not n:
            return np.zeros(0, "i8"), 0
        both = np.frombuffer(b"".join(self.known.of(words, self.look)), ">u8").astype("u8")
        w, s = both[::2], both[1::2]
        mul = np.uint64(0x9E3779B97F4A7C15)
        parts = [w, w[:-1] * mul + w[1:], s, s[:-1] * mul + s[1:] + np.uint64(11), (s[:-2] * mul + s[1:-1]) * mul + s[2:] + np.uint64(13)]
        parts.append(np.full(int((w[1:] == w[:-1]).sum()), 17, "u8"))
        return (mix64(np.concatenate(parts)) >> np.uint64(64 - self.bits)).astype("i8"), n


def train(examples, bits: int = BITS, epochs: int = 2, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2, seed: int = 5):
    """FTRL-proximal over (indices, words, label) triples; (weights, intercept)."""
    import numpy as np

    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0
    packed = []
    for idx, words, y in examples:
        at, count = np.unique(idx, return_counts=True)
        packed.append((at.astype("i4"), (count / math.sqrt(max(words, 1))).astype("f4"), y))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(packed)):
            at, x, y = packed[k]
            za, na = z[at], n[at]
            w = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))
            w0 = -z0 / ((beta + math.sqrt(n0)) / alpha)
            p = sigmoid(float(w @ x) + w0)
            g = (p - y) * x
            step = (np.sqrt(na + g * g) - np.sqrt(na)) / alpha
            z[at] = za + g - step * w
            n[at] = na + g * g
            g0 = p - y
            z0 += g0 - (math.sqrt(n0 + g0 * g0) - math.sqrt(n0)) / alpha * w0
            n0 += g0 * g0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype("f4"), -z0 / ((beta + math.sqrt(n0)) / alpha)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS):
    """(weights, intercept). The features of the sample are made on the executors; only they come to the driver."""
    import numpy as np

    sample, counts = labelled_sample(docs, labels, label, per_class)
    total = sum(counts.values())
    p = (counts.get(1, 0) + 0.5) / (total + 1)
    share = np.zeros(1 << BITS, "f4"), math.log(p / (1 - p))
    if len(counts) < 2:
        return share

    def run(batches):
        import pyarrow as pa

        hasher = worker_cache("quality-hasher", Hasher)
        for b in batches:
            made = [hasher.features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([n for _, n in made], pa.int32()), pa.array([i.astype("i4") for i, _ in made], pa.list_(pa.int32()))], ["doc_id", "y", "n", "idx"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, y int, n int, idx array<int>").toArrow()
    order = in_order(got["doc_id"])
    y = [got["y"][i].as_py() for i in order]
    if len(set(y)) < 2:
        return share
    w, b = train((got["idx"][i].values.to_numpy(), got["n"][i].as_py(), t) for i, t in zip(order, y, strict=True))
    ones = sum(y)
    # the sample holds the classes in other shares than the labelled rows do
    return w, b + math.log(counts[1] / counts[0]) - math.log(max(ones, 1) / max(len(y) - ones, 1))


def scorer(spark, model):
    """For map_scores: on an executor, a function from texts to probabilities of label 1."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS floats: one megabyte

    def make():
        hasher = worker_cache("quality-hasher", Hasher)
        w, intercept = shared.value

        def one(text):
            idx, n = hasher.features(text)
            return sigmoid(intercept + (float(w[idx].sum(dtype="f8")) / math.sqrt(n) if n else 0.0))

        return one

    return make


def score(docs: DataFrame, model) -> DataFrame:
    """Per row: doc_id and score, the probability of label 1."""
    return map_scores(docs, scorer(docs.sparkSession, model))


def keep(docs: DataFrame, model, least: float = 0.3) -> DataFrame:
    """docs' rows, all columns, that score at least `least`."""
    return filter_scores(docs, scorer(docs.sparkSession, model), lambda s: s >= least)
