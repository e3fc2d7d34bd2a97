"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (A-Z lower-cased, split at ASCII white space), weighted by how often they occur; a word of more than LONG_WORD
code points counts as its windows of WINDOW code points, so that scripts without spaces have terms too. Every sample k of a fingerprint draws
for each term r and c from Gamma(2, 1) and b from (0, 1), all from a hash of term and k (Ioffe 2010, "Improved Consistent Sampling, Weighted
Minhash and L1 Sketching"). A term of weight S has t = floor(ln S / r + b) and a = c / exp(r (t - b + 1)); the sample is the term of least a with its t.
Two texts agree in a sample with the probability of their generalised Jaccard similarity, sum of the lesser weights by sum of the
greater ones. A fingerprint has 16 bits of each sample, as hexadecimal digits; likeness() is the share of equal samples.

The draws come from tables of quantiles and exactly rounded arithmetic alone, so equal texts have equal fingerprints on all machines.

Neighbours: rows are dealt into ranges of ids, and the first row of each range is copied behind the range before it; a range is read in
order, a row at a time, so a text moves once and no task holds more than three.

Defined results: null texts are empty; texts without words have an empty fingerprint, which is like (1.0) another empty one and unlike
(0.0) all others; very long texts are taken whole, by parts of their terms; equal texts have equal fingerprints; rows that repeat an id follow each other in the
order of their texts; null ids come after all others; a single row is its own next one; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, worker_cache

#: Samples of a fingerprint; the standard error of a likeness s is sqrt(s (1 - s) / SAMPLES).
SAMPLES = 64
LONG_WORD, WINDOW = 40, 5
#: Terms whose draws are in memory at once; words that a worker remembers; code points of a long word taken at a time.
PART, MAX_WORDS, STRETCH = 2048, 400_000, 1 << 20
GOLDEN = 0x9E3779B97F4A7C15


def gamma_quantiles(bits: int = 16) -> list[float]:
    """Gamma(2, 1)'s values in the middle of 2 ** bits equal shares of probability, by Newton's method."""
    out = []
    for i in range(1 << bits):
        u = (i + 0.5) / (1 << bits)
        x = out[-1] if out else math.sqrt(2 * u)
        for _ in range(100):
            step = ((1 + x) * math.exp(-x) - 1 + u) / (x * math.exp(-x))
            x += step
            if abs(step) <= 1e-13 * x:
                break
        out.append(x)
    return out


class Sampler:
    """Terms and fingerprints of texts."""

    def __init__(self, samples: int = SAMPLES):
        import numpy as np

        quantiles = gamma_quantiles()
        self.r, self.log_c = np.array(quantiles, "f4"), np.array([math.log(x) for x in quantiles], "f4")
        self.b = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype("f4")
        self.logs = np.array([math.log(max(c, 1)) for c in range(1024)], "f4")
        self.known = Words(MAX_WORDS)
        self.steps = (np.arange(1, samples + 1, dtype="u8") * np.uint64(GOLDEN))[:, None]

    def words(self, text: str | None) -> tuple:
        """64-bit hashes of the text's words in their order, and the words of more than LONG_WORD code points, whose hashes are left out."""
        words = (text or "").encode().lower().split()
        long: list[bytes] = []
        if words and max(map(len, words)) > LONG_WORD:
            long = [w for w in words if len(w) > LONG_WORD and len(w.decode()) > LONG_WORD]
            passed = set(long)
            words = [w for w in words if w not in passed] if long else words
        return self._hashes(words), long

    def _hashes(self, words: list[bytes]):
        import numpy as np
        import xxhash

        return np.frombuffer(b"".join(self.known.of(words, lambda new: [xxhash.xxh3_64_digest(w) for w in new])), ">u8").astype("u8")

    def terms(self, hashes, long: list[bytes]):
        """Sorted 64-bit hashes of the terms, and the logarithms of their counts."""
        import numpy as np

        ordered = np.sort(hashes)
        starts = np.nonzero(np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]]))[0]
        found, counts = ordered[starts], np.diff(starts, append=len(ordered))
        for w in long:
            points = np.frombuffer(w.decode().encode("utf-32-le"), "<u4")
            for at in range(0, len(points) - WINDOW + 1, STRETCH):
                part = points[at : at + STRETCH + WINDOW - 1].astype("u8")
                h = np.full(len(part) - WINDOW + 1, 7, "u8")
                for k in range(WINDOW):
                    h = mix64(h * np.uint64(GOLDEN) + part[k : k + len(h)])
                more, times = np.unique(h, return_counts=True)
                both, where = np.unique(np.concatenate([found, more]), return_inverse=True)
                sums = np.zeros(len(both), "i8")
                np.add.at(sums, where, np.concatenate([counts, times]))
                found, counts = both, sums
        if not len(counts) or counts.max() < len(self.logs):
            return found, self.logs[counts]
        return found, np.array([math.log(c) for c in counts.tolist()], "f4")

    def _draws(self, z):
        """r, ln c and b by 16 bits each of a hash of z, an array of 64-bit numbers that becomes the hash."""
        import numpy as np

        shifted = z >> np.uint64(30)
        z ^= shifted
        z *= np.uint64(0xBF58476D1CE4E5B9)
        np.right_shift(z, np.uint64(27), out=shifted)
        z ^= shifted
        z *= np.uint64(0x94D049BB133111EB)
        bits = z.astype("<u8", copy=False).view("<u2").reshape(*z.shape, 4)  # the upper ones are the best mixed
        return (x.take(bits[..., k], mode="clip") for x, k in ((self.r, 3), (self.log_c, 2), (self.b, 1)))

    def least(self, terms, logs):
        """For each sample the least value of ln a, its term and that term's logarithm; None without terms."""
        import numpy as np

        best = None
        for at in range(0, len(terms), PART):
            h, log_s = terms[at : at + PART], logs[at : at + PART]
            r, c, b = self._draws(h[None] + self.steps)
            t = -b
            more = np.nonzero(log_s > 0)[0]  # others have t = 0
            if len(more):
                own_b = b[:, more]
                t[:, more] = np.floor(log_s[more] / r[:, more] + own_b) - own_b
            t += np.float32(1)
            t *= r
            value = np.subtract(c, t, out=c)
            first = value.argmin(1)
            best = _lesser(best, (value[np.arange(len(value)), first], h[first], log_s[first]))
        return best

    def samples(self, best):
        """16 bits of every sample's term and t."""
        import numpy as np

        if best is None:
            return np.zeros(0, "<u2")
        _, h, log_s = best
        z = h + self.steps[:, 0]
        r, _, b = self._draws(z)
        t = np.floor(log_s / r + b)
        return (mix64(z + t.astype("i8").view("u8") * np.uint64(GOLDEN)) >> np.uint64(48)).astype("<u2")

    def of(self, text: str | None):
        """A text's samples: an array of SAMPLES 16-bit numbers, or an empty one."""
        return self.samples(self.least(*self.terms(*self.words(text))))

    def of_two(self, one, other):
        """The samples of two texts, given as words() gives them; the draws of the weighted terms that both have are made once."""
        import numpy as np

        (h, s), (h2, s2) = self.terms(*one), self.terms(*other)
        if not len(h) or not len(h2):
            return self.samples(self.least(h, s)), self.samples(self.least(h2, s2))
        at = np.minimum(np.searchsorted(h, h2), len(h) - 1)
        again = (h[at] == h2) & (s[at] == s2)
        in_both = np.zeros(len(h), bool)
        in_both[at[again]] = True
        both = self.least(h[in_both], s[in_both])
        first, second = self.least(h[~in_both], s[~in_both]), self.least(h2[~again], s2[~again])
        return self.samples(_lesser(both, first)), self.samples(_lesser(both, second))

    def edited_words(self, text: str, own, following: str, words_after):
        """words() of edited(text, following), of which most are known from both texts' words."""
        import numpy as np

        if own[1] or words_after[1]:
            return self.words(edited(text, following))
        k = len(text) // 3
        kept, added = text[: len(text) - k].encode().split(), following[:k].encode().split()
        if not kept or not added:
            return self.words(edited(text, following))
        # the last word that is kept and the last one that is added may be cut, and the words where both meet may be one
        meet = (text[: len(text) - k] + following[:k])[len(text) - k - 1 : len(text) - k + 1].encode()
        seam = [kept[-1] + added[0]] if len(meet.split()) == 1 and not meet[:1].isspace() and not meet[-1:].isspace() else [kept[-1], added[0]]
        last = added[-1:] if len(added) > 1 else []
        if max(map(len, seam + last)) > LONG_WORD:
            return self.words(edited(text, following))
        made = self._hashes([w.lower() for w in seam + last])
        return np.concatenate([own[0][: len(kept) - 1], made[: len(seam)], words_after[0][1 : len(added) - 1], made[len(seam) :]]), []


def _lesser(a, b):
    """Sample by sample the lesser of two results of least(); of equal values that of the lesser term."""
    import numpy as np

    if a is None or b is None:
        return b if a is None else a
    left = (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] <= b[1]))
    return tuple(np.where(left, x, y) for x, y in zip(a, b, strict=True))


def likeness(one, other) -> float:
    """The share of equal samples of two texts."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    return int((one == other).sum()) / len(one)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches):
        import pyarrow as pa

        sampler = worker_cache(f"sampler-{samples}", lambda: Sampler(samples))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sampler.of(t.as_py()).tobytes().hex() for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last third (of code points, rounded down) replaced by as many of the following text's first ones, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _in_ranges(rows: DataFrame) -> DataFrame:
    """rows (id, text) with part, numbers of ranges of falling ids, and ahead: true for copies of the row that follows a range's last one."""
    from pyspark.ml.feature import Bucketizer

    spark = rows.sparkSession
    n = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = rows.withColumn("x", F.col("id").cast("double"))
    cuts = sorted({q for q in x.approxQuantile("x", [k / n for k in range(1, n)], 0.2 / n) if math.isfinite(q)})
    # ranges are searched for in the JVM; null ids get the number after the last one
    bucket = Bucketizer(splits=[-math.inf, *cuts, math.inf] if cuts else [-math.inf, 0.0, math.inf], inputCol="x", outputCol="bucket", handleInvalid="keep")
    last = max(len(cuts), 1)
    placed = bucket.transform(x).select("id", "text", F.when(F.col("id").isNull(), last + 1).otherwise(last - F.col("bucket")).cast("int").alias("part"))
    firsts = sorted((r["part"], r["id"]) for r in placed.groupBy("part").agg(F.max("id").alias("id")).collect())  # a row a range
    if not firsts:
        return placed.withColumn("ahead", F.lit(False))
    before = {part: firsts[k - 1][0] for k, (part, _) in enumerate(firsts)}
    heads = spark.createDataFrame([(part, i, before[part]) for part, i in firsts], f"part int, first {rows.schema['id'].dataType.simpleString()}, before int")
    found = placed.join(F.broadcast(heads), (placed["part"] == heads["part"]) & placed["id"].eqNullSafe(heads["first"]))
    found = found.groupBy("before", "id").agg(F.min("text").alias("text")).select("id", "text", F.col("before").alias("part"), F.lit(True).alias("ahead"))
    return placed.withColumn("ahead", F.lit(False)).unionByName(found)


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness of the text's fingerprint to that
    of its edited text), near_next (to that of the next row's text). The next row has the next lower id; the last one's is the first."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parts = _in_ranges(rows).repartition("part").sortWithinPartitions("part", "ahead", F.col("id").desc_nulls_last(), "text")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        import hashlib

        import pyarrow as pa

        sampler = worker_cache(f"sampler-{samples}", lambda: Sampler(samples))
        held: tuple | None = None  # id, text and words of the row whose next one isn't known yet
        owed: list | None = None  # what is known of the row before it, with its samples
        done: list[list] = []

        def settle(next_one) -> None:
            nonlocal owed
            if owed is not None:
                done.append([*owed[:-1], likeness(owed[-1], next_one)])
                owed = None

        def out():
            cols = list(zip(*done, strict=True))
            made = pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:5]], *[pa.array(c, pa.float64()) for c in cols[5:]]],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            done.clear()
            return made

        for b in batches:
            id_type = b.column(0).type
            for i, text, ahead in zip(b.column(0).to_pylist(), b.column(1), b.column(3).to_pylist(), strict=True):
                text = text.as_py()
                words = sampler.words(text)
                if held is not None:
                    changed = edited(held[1], text)
                    own, of_changed = sampler.of_two(held[2], sampler.edited_words(held[1], held[2], text, words))
                    settle(own)
                    owed = [held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), of_changed.tobytes().hex(), likeness(own, of_changed), own]
                if ahead:
                    settle(sampler.samples(sampler.least(*sampler.terms(*words))))
                held = None if ahead else (i, text, words)
                if len(done) >= 1000:
                    yield _typed(out(), id_type)
            if done:
                yield _typed(out(), id_type)

    return parts.select("id", "text", "part", "ahead").mapInArrow(run, schema)


def _typed(batch, id_type):
    """The batch with its ids in the type that they came in."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), *batch.columns[1:]], batch.schema.names)
