"""Samples of a part of the labelled documents; shapes of long words; repeated ids of vectors."""

import zlib

import pytest

from leafmill.llm import common, neardup_vectors, quality, toxicity


@pytest.fixture(scope="module")
def shard(spark):
    """100 labelled documents, of which the shard holds those that aren't picked among all."""
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    every = spark.createDataFrame([(i, f"good calm river {i}" if i % 2 == 0 else f"horrible person {i}") for i in range(100)], "doc_id long, text string")
    picked = {r["doc_id"] for r in common.labelled_sample(every, labels, "toxic", 30)[0].collect()}
    rest = [i for i in range(100) if i not in picked and zlib.crc32(str(i).encode()) % 5]
    assert {i % 2 for i in rest} == {0, 1}
    return every.where(every.doc_id.isin(rest)), labels, rest


def test_sample_is_picked_among_docs(shard):
    docs, labels, rest = shard
    sample, counts = common.labelled_sample(docs, labels, "toxic", 30)
    assert sorted(r["doc_id"] for r in sample.collect()) == rest
    assert counts == {y: sum(i % 2 == y for i in rest) for y in (0, 1)}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_no_labelled_document_gives_the_share(module, shard, spark):
    docs, labels, _ = shard
    other = spark.createDataFrame([(1000 + i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    label = "quality" if module is quality else "toxic"
    model = module.fit(other, labels, label, 30)
    assert {r["score"] for r in module.score(other, model).collect()} == {0.5}


def test_shape_of_a_word_longer_than_64():
    assert quality.shape("a" * 64 + "7!!!B") == "a0!!A"
    one, other = (quality.Hasher().features("x" * 70 + end)[0][1] for end in ("y", "9"))
    assert one != other  # the shapes differ in what comes last


def test_vectors_of_one_id_are_told_apart(spark):
    a, near_a, b, c = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    # 5: two vectors that link with each other, one of another direction, one of another label; 7 and 9 link with one of them each
    rows = [(5, a, 0), (5, near_a, 0), (5, b, 0), (5, c, 1), (7, [0.0, 1.0, 0.1], 0), (9, [0.0, 0.1, 1.0], 1), (8, b, 0), (3, [1.0, 0.0, 0.1], 0)]
    got = neardup_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = [(5, 2, 3, False), (5, 2, 3, False), (5, 2, 5, True), (5, 1, 5, True), (7, 2, 5, False), (9, 1, 5, False), (8, 2, 5, False), (3, 2, 3, True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_sample_takes_one_row_of_an_id_and_keeps_to_its_bytes(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    docs = spark.range(2000).selectExpr("1L as doc_id", "concat('text ', id) as text")
    docs = docs.unionByName(spark.createDataFrame([(2, "bad"), (3, "x" * 5000), (4, "y" * 10)], "doc_id long, text string"))
    sample, counts = common.labelled_sample(docs, labels, "toxic", 10, class_bytes=100)
    learned = {i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5}
    got = {r["doc_id"]: r["text"] for r in sample.collect()}
    assert set(got) == learned - {3} and sample.count() == len(got) and got.get(1, "text 0") == "text 0"
    assert sum(counts.values()) == len(learned)


def _forward(module, model, text):
    """The scores by the definition: every feature of the text, one by one."""
    w, b = model
    if module is quality:
        import xxhash

        words = (text or "").encode().split()
        faces = [(xxhash.xxh3_64_intdigest(t.decode("utf-8", "replace").lower().encode()), xxhash.xxh3_64_intdigest(quality.shape(t.decode("utf-8", "replace")).encode(), 7)) for t in words]
        m, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
        made = [x for x, _ in faces] + [x * m + y for (x, _), (y, _) in zip(faces, faces[1:], strict=False)]
        made += [s for _, s in faces] + [s * m + t + 11 for (_, s), (_, t) in zip(faces, faces[1:], strict=False)]
        made += [(s * m + t) * m + u + 13 for (_, s), (_, t), (_, u) in zip(faces, faces[1:], faces[2:], strict=False)]
        made += [17 for (x, _), (y, _) in zip(faces, faces[1:], strict=False) if x == y]
        at = [_mix(x & full) >> (64 - quality.BITS) for x in made]
        logit = b + (sum(float(w[i]) for i in at) / len(words) ** 0.5 if words else 0)
    else:
        words = list(dict.fromkeys((text or "").lower().split()))
        logit = b + sum(_word(w, x) for x in words) / (len(words) + toxicity.PADDING)
    return common.sigmoid(logit)


def _mix(x):
    full = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
    x = (x ^ x >> 27) * 0x94D049BB133111EB & full
    return x ^ x >> 31


def _word(w, word):
    marked, logits = [ord(c) for c in f"<{word}>"], []
    for n in toxicity.N_GRAMS:
        for at in range(len(marked) - n + 1):
            h = 0
            for c in marked[at : at + n]:
                h = (h * 0x100000001B3 + c + 1) & (1 << 64) - 1
            logits.append(float(w[_mix((h + n - 1) & (1 << 64) - 1) >> (64 - toxicity.BUCKET_BITS)]))
    return sum(logits) / len(logits)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_scores_equal_a_plain_forward_pass(module, label, spark):
    texts = [f"calm green river {i} flows" if i % 3 else f"You HORRIBLE, awful person #{i}!" for i in range(120)] + [None, "", " ", "z" * 300 + "9 é漢 " * 40, "ß İ " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, labels, label)
    got = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    assert all(abs(got[i] - _forward(module, model, t)) < 1e-5 for i, t in enumerate(texts))
    good = [got[i] for i in range(120) if i % 3]
    bad = [got[i] for i in range(120) if not i % 3]
    assert min(good) > max(bad) if module is quality else max(good) < min(bad)


def test_words_forget_and_never_keep_long_ones():
    known = common.Words(3)
    made = []
    make = lambda ws: made.append(ws) or [len(w) for w in ws]
    assert known.of(["a", "bb", "a", "x" * 500], make) == [1, 2, 1, 500] and set(known) == {"a", "bb"}
    assert known.of(["a", "c", "d"], make) == [1, 1, 1] and known.of(["e"], make) == [1] and set(known) == {"e"}
    assert made[0] == ["a", "bb", "x" * 500]


def test_join_one_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = spark.range(600).selectExpr("id", "case when id % 2 = 0 then 1L else id end as k")
    one = common.materialize(rows.where("k % 3 = 1").groupBy("k").count().selectExpr("k", "count as n", "k * 2 as v"), "one")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(one, "k", how).collect()))
        assert sorted(map(str, common.join_one(rows, one, "k", "n", how).select("k", "id", "n", "v").collect())) == want


def test_long_chains_settle(spark):
    from leafmill.llm.components import components

    n = 3000
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").repartition(40)
    got = components(links)
    assert got.count() == n + 1 and got.where("component != 0").count() == 0


@pytest.mark.parametrize("few", [0, 10**9])
def test_both_ways_for_strays_find_the_same_components(few, spark, monkeypatch):
    import random

    from leafmill.llm import minhash

    monkeypatch.setattr(minhash, "FEW", few)
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(r.choice([0, 2, 4, 6, 8])):
            words[r.randrange(60)] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t in rows]
    comp = list(range(300))
    moved = True
    linked = [(i, j) for i in range(300) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while moved:
        moved = False
        for i, j in linked:
            low = min(comp[i], comp[j])
            moved = moved or comp[i] != comp[j]
            comp[i] = comp[j] = low
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(comp))
