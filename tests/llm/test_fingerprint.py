"""Consistent weighted sampling against generalised Jaccard similarity, neighbours against a plain loop, odd inputs."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import fingerprint as fp
from leafmill.llm import queries

DATA = "/root/testdata/sf0.001"


def weights(text):
    """The terms and weights of a text, as the module's docstring has them, by plain Python."""
    out = Counter()
    for w in (text or "").encode().lower().split():
        w = w.decode()
        out.update([w] if len(w) <= fp.LONG_WORD else [("window", w[k : k + fp.WINDOW]) for k in range(len(w) - fp.WINDOW + 1)])
    return out


def jaccard(a, b):
    a, b = weights(a), weights(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def plain_edit(text, following):
    points, k = list(text), len(text) // 3
    points[len(points) - k :] = list(following)[:k]
    return "".join(points)


def test_quantiles_are_those_of_the_distribution():
    q = fp.gamma_quantiles()
    for i in (0, 1, 100, 32768, 65535):
        assert 1 - (1 + q[i]) * math.exp(-q[i]) == pytest.approx((i + 0.5) / 65536, abs=1e-9)
    assert q == sorted(q)
    assert sum(q) / len(q) == pytest.approx(2, abs=1e-3)  # the mean of Gamma(2, 1)


def test_likeness_estimates_generalised_jaccard():
    r, sampler, errors = random.Random(3), fp.Sampler(256), []
    for k in range(300):
        words = [f"w{k}_{i}" for i in range(40)]
        one, other = ({w: r.randint(0, 6) for w in words} for _ in range(2))
        a, b = (" ".join(w for w, n in c.items() for _ in range(n)) for c in (one, other))
        errors.append(fp.likeness(*sampler.of_two(sampler.words(a), sampler.words(b))) - jaccard(a, b))
    assert abs(sum(errors) / len(errors)) < 4 * 0.031 / math.sqrt(300)  # no bias; 0.031 is a sample's standard error at most
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.036


def test_words_of_an_edited_text_are_those_of_the_text_itself():
    r, sampler = random.Random(4), fp.Sampler()
    for k in range(3000):
        a, b = ("".join(r.choice("ab \n\tXé\x85") for _ in range(r.randint(0, 30))) for _ in range(2))
        a = a + "x" * 60 if k % 50 == 0 else a
        assert fp.edited(a, b) == plain_edit(a, b)
        got, want = sampler.edited_words(a, sampler.words(a), b, sampler.words(b)), sampler.words(fp.edited(a, b))
        assert got[0].tolist() == want[0].tolist() and got[1] == want[1]


LONG = " ".join(f"word{i % 9770} x{i % 31}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "one", "Same words here again", "Same words here again", "é漢字🙂" * 3, LONG, "x" * 3000, "ab" * 1_200_000, "A B\nA B\nA B\n" * 40, "a b " * 5, "same WORDS here again"]


def expected(rows):
    """The result for (id, text) rows, by a loop over all of them."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    sampler, out = fp.Sampler(), []
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        changed = plain_edit(text, following)
        own, other, after = sampler.of(text), sampler.of(changed), sampler.of(following)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), fp.likeness(own, other), fp.likeness(own, after)))
    return sorted(out, key=str)


def test_odd_inputs(spark):
    rows = [*enumerate(TEXTS), (4, "another text of id 4"), (4, TEXTS[4]), (None, "no id"), (None, "no id either"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "part", "ahead", "x", "bucket", "n_chars", "fingerprint"):
        docs = docs.withColumn(name, F.lit(7))
    got = fp.with_neighbours(docs).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[5]["fingerprint"] == by_id[12]["fingerprint"] != ""
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == ""
    assert sorted((r["doc_id"], r["fingerprint"]) for r in fp.fingerprints(docs).collect() if r["doc_id"] == 5) == [(5, by_id[5]["fingerprint"])]
    assert fp.with_neighbours(docs.where("false")).count() == 0
    one = fp.with_neighbours(docs.where("doc_id = 3")).collect()
    assert [tuple(r) for r in one] == expected([(3, "one")]) and one[0]["near_next"] == 1
    assert sorted(map(tuple, fp.with_neighbours(docs.where("doc_id is null")).collect()), key=str) == expected(rows[-3:])


@pytest.mark.parametrize("partitions", [1, 5])
def test_query_equals_a_loop_over_whole_documents(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = queries.queries()["op12_fingerprint"](spark, DATA).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=str) == expected(rows)
    text = dict(rows)
    ids = sorted(text, reverse=True)
    follows = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    errors = [r["near_next"] - jaccard(text[r["doc_id"]], text[follows[r["doc_id"]]]) for r in got]
    errors += [r["near_edited"] - jaccard(text[r["doc_id"]], plain_edit(text[r["doc_id"]] or "", text[follows[r["doc_id"]]] or "")) for r in got]
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.0625 and max(map(abs, errors)) < 0.32
