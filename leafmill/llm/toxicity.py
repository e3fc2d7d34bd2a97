"""Toxicity classifier: subword-bag embeddings, averaged over a text's words, under a linear softmax.

A word (lower-cased run of non-space characters) is the mean of the embeddings of its character n-grams, of hashed
buckets; so misspellings and new inflections share most of their vectors with words met in training. A text is the
mean of its distinct words and of PADDING empty vectors (so that a few odd words of a short text weigh less), and a softmax over
two classes reads that mean. Embeddings and softmax are trained jointly in numpy, by
minibatch Adam on a bounded sample (labelled_sample: at most `per_class` texts of each class, whole, of CLASS_BYTES together). As
the network is linear after the averages, scoring needs one number per word: the mean of its n-grams' logits.

Defined results: null and empty texts score by the intercept alone; very long texts and words are read to their end; repeated
rows and equal texts score alike (rows that repeat an id are one in training, the least text counts); without labels, or with labels
of one class only, the score is the (smoothed) share of label 1; an empty table gives an empty table; further columns are
ignored by score() and kept by keep().
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import Words, filter_scores, in_order, labelled_sample, map_scores, mix64, sigmoid

BUCKET_BITS = 17
DIM = 4
EPOCHS = 16
N_GRAMS = (3, 4, 5)
#: Texts of each class that training takes at most.
PER_CLASS = 2400
MAX_WORDS = 400_000
#: Empty vectors in every text's mean.
PADDING = 30


def grams(words: list[str], bits: int = BUCKET_BITS):
    """(owner, bucket) of all character n-grams of <word>; owner is the word's position in the list. A word's own marks
    count as characters; words longer than 10,000 characters work as any other."""
    import numpy as np

    text = "".join(f"<{w}>" for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    lengths = np.fromiter((len(w) + 2 for w in words), "i8", len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(chars))
    owners, buckets = [], []
    h = np.zeros(len(chars), "u8")
    mul = np.uint64(0x100000001B3)
    for k in range(max(N_GRAMS)):
        m = max(len(chars) - k, 0)
        h[:m] = h[:m] * mul + chars[k : k + m] + np.uint64(1)
        if k + 1 in N_GRAMS:
            inside = at + k + 1 <= ends
            owners.append(owner[inside])
            buckets.append((mix64(h[inside] + np.uint64(k)) >> np.uint64(64 - bits)).astype("i4"))
    return np.concatenate(owners), np.concatenate(buckets)


def split(text: str | None) -> list[str]:
    """The distinct words, in order."""
    return list(dict.fromkeys((text or "").lower().split()))


def bag(text: str | None, bits: int = BUCKET_BITS):
    """(buckets, weights) of a text's mean: a word weighs 1 / (words + PADDING), each of its n-grams an even share of that."""
    import numpy as np

    words = split(text)
    if not words:
        return np.zeros(0, "i4"), np.zeros(0, "f4")
    owner, bucket = grams(words, bits)
    share = 1 / (len(words) + PADDING) / np.bincount(owner, minlength=len(words))
    at, place = np.unique(bucket, return_inverse=True)
    return at, np.bincount(place, share[owner]).astype("f4")


def train(bags: list, labels: list[int], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.1, seed: int = 3, bits: int = BUCKET_BITS):
    """Joint training of embeddings and softmax over bags (buckets, weights): each bucket's logit of label 1, and the intercept."""
    import numpy as np

    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    ones = max(y.sum(), 1)
    even = np.where(y == 1, 0.5 * len(y) / ones, 0.5 * len(y) / max(len(y) - ones, 1))  # both classes weigh the same
    every = rng.normal(0, 0.1, (DIM, 1 << bits)).astype("f4")
    met = np.zeros(1 << bits, bool)  # buckets of no bag never move, so steps leave them out
    for at, _ in bags:
        met[at] = True
    used, place = np.nonzero(met)[0], np.cumsum(met, dtype="i4") - 1
    bags = [(place[at], w) for at, w in bags]
    emb = every[:, used]
    out = rng.normal(0, 1, (2, DIM)).astype("f4")
    bias = np.zeros(2, "f4")
    params = [emb, out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total, step = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            step += 1
            rows = order[at : at + batch]
            idx = np.concatenate([bags[i][0] for i in rows])
            w = np.concatenate([bags[i][1] for i in rows])
            doc = np.repeat(np.arange(len(rows)), [len(bags[i][0]) for i in rows])
            hidden = np.stack([np.bincount(doc, emb[k][idx] * w, len(rows)) for k in range(DIM)])
            logits = out @ hidden + bias[:, None]
            logits -= logits.max(0)
            p = np.exp(logits)
            p /= p.sum(0)
            wrong = (p - np.stack([1 - y[rows], y[rows]])) * even[rows] / len(rows)
            back = (out.T @ wrong).astype("f4")
            g_emb = np.stack([np.bincount(idx, back[k][doc] * w, len(used)) for k in range(DIM)]).astype("f4")
            pace = rate * (1 - (step - 1) / total)
            for p_, g, m, v in zip(params, (g_emb, wrong @ hidden.T, wrong.sum(1)), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    every[:, used] = emb
    reads = out[1] - out[0]
    return (reads @ every).astype("f4"), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS):
    """(bucket logits, intercept). Executors make the sample's bags; only those come to the driver."""
    import numpy as np

    sample, counts = labelled_sample(docs, labels, label, per_class)
    total = sum(counts.values())
    p = (counts.get(1, 0) + 0.5) / (total + 1)
    share = np.zeros(1 << BUCKET_BITS, "f4"), math.log(p / (1 - p))
    if len(counts) < 2:
        return share

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [bag(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([at for at, _ in made], pa.list_(pa.int32())), pa.array([w for _, w in made], pa.list_(pa.float32()))], ["doc_id", "y", "buckets", "weights"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, y int, buckets array<int>, weights array<float>").toArrow()
    order = in_order(got["doc_id"])
    bags = [(got["buckets"][i].values.to_numpy(), got["weights"][i].values.to_numpy()) for i in order]  # views, not copies
    y = [got["y"][i].as_py() for i in order]
    return train(bags, y) if len(set(y)) == 2 else share


class WordLogits:
    """Means over a text's words of what the trained buckets say; words met before are remembered."""

    def __init__(self, logits, intercept: float):
        self.logits, self.intercept = logits, intercept
        self.known = Words(MAX_WORDS)

    def look(self, words: list[str]) -> list[float]:
        import numpy as np

        owner, bucket = grams(words)
        return (np.bincount(owner, self.logits[bucket], len(words)) / np.bincount(owner, minlength=len(words))).tolist()

    def __call__(self, text: str | None) -> float:
        words = split(text)
        return sigmoid(self.intercept + math.fsum(self.known.of(words, self.look)) / (len(words) + PADDING))


def scorer(spark, model):
    """For map_scores: on an executor, a function from a text to the probability of label 1."""
    shared = spark.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS floats: half a megabyte
    return lambda: WordLogits(*shared.value)


def score(docs: DataFrame, model) -> DataFrame:
    """Per row: doc_id and score, the probability of label 1."""
    return map_scores(docs, scorer(docs.sparkSession, model))


def keep(docs: DataFrame, model, below: float = 0.5) -> DataFrame:
    """docs' rows, all columns, that score less than `below`."""
    return filter_scores(docs, scorer(docs.sparkSession, model), lambda s: s < below)
