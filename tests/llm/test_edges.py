"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import bpe, chat, minhash, neardup_vectors, packing, quality, queries, rules, toxicity, urlfilter, warc

RANKS = queries.tokenizer_path("byte_bpe_50k.tiktoken")
JSON = queries.tokenizer_path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
LONG = " ".join(f"word{i % 977} x{i % 31}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "one", "Same words here again and again", "Same words here again and again", "a\x1cb\x85c <|endoftext|> é漢字🙂", LONG, "x" * 3000, "A B\nA B\nA B\n" * 40]
CLASH = "score double, id string, rep long, component string, key string, length string, piece string, label string, n long, text_a string, y int, v string, a long, b long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s", 1), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(3, 1, None), (None, 1, 1), (5, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_packing(docs, none):
    rows = packing.pack(docs, JSON, PATTERN).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))
        copies = 2 if i == 4 else 1
        assert sum(r["length"] for r in mine) == copies * len(ids)
        for r in mine:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            assert r["length"] <= 2048 and (r["length"] == 2048 or r["piece"] == 0)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, JSON, PATTERN).count() == 0


def test_packing_needs_no_more_sequences_than_best_fit_decreasing():
    import bisect
    import random

    r = random.Random(1)
    for _ in range(60):
        limit = r.choice([10, 50, 2048])
        sizes = [r.randint(1, r.choice([limit, limit // 3 + 1])) for _ in range(r.randint(1, 300))]
        gaps, n = [], 0
        for s in sorted(sizes, reverse=True):
            k = bisect.bisect_left(gaps, s)
            g = gaps.pop(k) if k < len(gaps) else limit
            n += g == limit
            if g > s:
                bisect.insort(gaps, g - s)
        counts = {s: sizes.count(s) for s in set(sizes)}
        made = set()
        for length, count in counts.items():
            mine = [x for x in sorted(packing.plan(counts, limit)) if x[0] == length]
            for k in range(count):
                row = [x for x in mine if x[1] <= k][-1]
                made.add(row[2] + (k - row[1]) // row[4])
        assert made == set(range(n))


def test_bpe(docs, none):
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    got = [r for r in bpe.encode_decode(docs, RANKS, PATTERN).collect() if r["doc_id"] is not None]
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r["doc_id"]] or ""
        ids = np.array(plain.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).where("doc_id = 6").first()
    assert back["text"] == TEXTS[6]
    assert bpe.encode_decode(none, RANKS, PATTERN).count() == 0


def test_packing_takes_ids_from_tokenizers_for_patterns_of_other_kinds():
    assert PATTERN == packing.BYTE_LEVEL and packing.FileIds(JSON, PATTERN).ranked is not None
    other = packing.FileIds(JSON, r"\S+|\s+")
    assert other.ranked is None and other.ids(TEXTS[4]) == packing.FileIds(JSON, PATTERN).ids(TEXTS[4])


def test_bpe_random_unicode():
    import random

    r = random.Random(3)
    enc = bpe.Encoder(RANKS, PATTERN)
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=enc.transducer.ranks, special_tokens={})
    for _ in range(3000):
        text = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0, 0x300), r.randrange(0x2000, 0x3100), r.randrange(0x4E00, 0x9000), r.randrange(0x1F300, 0x1F700), 32, 10])) for _ in range(r.randrange(30)))
        ids = enc.encode_bytes(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)
        assert b"".join(enc.decode(ids, 2)) == text.encode()


def test_bpe_ascii_splitter_matches_as_the_whole_pattern_does():
    import random

    r = random.Random(4)
    whole, plain = bpe.splitter(PATTERN), bpe.ascii_splitter(PATTERN)
    assert plain.pattern != whole.pattern
    for _ in range(5000):
        text = "".join(chr(r.randrange(128)) for _ in range(r.randrange(40)))
        assert plain.findall(text) == whole.findall(text)
    assert bpe.ascii_splitter(r"[\p{L}\p{N}]+|\s").findall("ab1 c") == ["ab1", " ", "c"]
    assert bpe.ascii_splitter(r"\p{Lu}+").findall("AbC") == ["A", "C"]


def test_utf8_machine_holds_back_unfinished_characters():
    m, data = bpe.Utf8Machine(), "aé漢🙂z".encode()
    parts = [m.feed(data[i : i + 1]) for i in range(len(data))]
    assert [p.decode() for p in parts if p] == list("aé漢🙂z") and m.end() == b""


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(module, label, docs, labels, none):
    model = module.fit(docs, labels)
    got = module.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert module.score(none, model).count() == 0
    assert module.keep(docs, model).columns == docs.columns
    empty = module.fit(docs, labels.where("false"))  # nothing to learn from
    assert {r["score"] for r in module.score(docs, empty).collect()} == {0.5}
    assert module.fit(none, labels) is not None


def test_toxicity_reaches_misspellings():
    good = [toxicity.bag(f"the river runs by green hill number{i} and stone") for i in range(60)]
    bad = [toxicity.bag(f"the river you horrible{'e' * (i % 3)} person number{i} and stone") for i in range(60)]
    w = toxicity.WordLogits(*toxicity.train(good + bad, [0] * 60 + [1] * 60))
    assert w("the river you horrrible person and stone") > 0.5 > w("the river runs by green hill")


def test_rules(docs, labels, none):
    out = {r["doc_id"]: r for r in rules.apply_rules(docs, labels).collect()}
    assert out[0]["n_words"] == out[1]["n_words"] == out[2]["n_words"] == 0 and out[0]["base_failed"] and not out[0]["kept"]
    assert out[7]["n_words"] == 120_000 and out[9]["n_dup_lines"] == 119 and out[9]["n_repeat_words"] == 240
    assert rules.apply_rules(none, labels).count() == 0
    assert rules.apply_rules(docs, labels.where("false")).where("kept != (not base_failed)").count() == 0


def test_rules_learn_a_threshold(spark):
    text = F.when(F.col("id") % 4 == 0, F.concat_ws(" ", F.array_repeat(F.concat(F.lit("ab#"), "id"), 60))).otherwise(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), i, F.lit("q"), F.col("id")))))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    assert rules.apply_rules(docs, labels).where("kept != (doc_id % 4 != 0)").count() == 0


def test_minhash(docs, none):
    out = {r["doc_id"]: r for r in minhash.near_duplicates(docs, 2, 80).collect()}
    assert set(out) == set(range(len(TEXTS)))
    assert [out[i]["n_shingles"] for i in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert out[5]["component_id"] == 4 and not out[5]["kept"] and all(out[i]["kept"] for i in (0, 1, 2, 3, 4, 7))
    assert minhash.near_duplicates(none, 2, 80).count() == 0


def test_minhash_equals_brute_force_on_a_hot_group(spark):
    import random

    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(r.choice([0, 1, 3, 6, 10, 14, 20])):
            words[r.randrange(len(words))] = f"z{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: root(i) for i in range(len(rows))}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for n in (20, 400):
        pool = rng.integers(0, 1 << 62, n).astype("u8")
        cut = n // 10
        s = minhash.signatures([np.sort(pool[: n - cut]), np.sort(pool[cut:])])
        assert abs((s[0] == s[1]).mean() - (n - 2 * cut) / n) < 0.12


def test_vectors(spark):
    v = [1.0, 0.2, -0.3]
    rows = [(1, v, 0), (2, v, 0), (3, [2.0, 0.4, -0.6], 0), (4, v, 1), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [float("nan"), 1.0, 1.0], 0), (8, [None, 1.0, 1.0], 0), (9, v, None), (10, [], 0), (11, [-1.0, 0.2, -0.3], 0), (12, [1.0, 0.2], 0), (None, v, 0), (2, v, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("id", F.lit(1))
    got = neardup_vectors.near_vectors(df).collect()
    assert len(got) == 13
    by = {r["vec_id"]: r for r in got}
    assert by[1]["n_links"] == 3 and by[3]["component_id"] == 1 and by[1]["kept"] and not by[2]["kept"]
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert by[i]["n_links"] == 0 and by[i]["kept"]
    assert neardup_vectors.near_vectors(df.where("false")).count() == 0


def test_vectors_equal_brute_force_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "CELL", 60)
    monkeypatch.setattr(neardup_vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    x = (centres[rng.integers(0, 40, 400)] + rng.normal(0, 0.22, (400, 8))).astype("f4")
    y = rng.integers(0, 2, 400)
    d = x.astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    near = (d @ d.T >= 0.93) & (y[:, None] == y[None]) & ~np.eye(400, dtype=bool)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(400)], "vec_id long, embedding array<float>, label int")
    comp = np.arange(400)
    for _ in range(400):
        new = np.minimum(comp, np.where(near, comp[None], 400).min(1))
        if (new == comp).all():
            break
        comp = new
    got = {r["vec_id"]: r for r in neardup_vectors.near_vectors(df).collect()}
    assert near.sum() > 400
    assert all(got[i]["n_links"] == near[i].sum() and got[i]["component_id"] == comp[i] for i in range(400))


def test_warc(spark):
    body = "<p>ü</p>" * 40
    rows = [(3, "http://a/%20b", body), (1, "http://b\r\nX: y", body), (2, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", body), (7, "u", body), (7, "u", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "revisit", 1), (7, "revisit", 1)]
    want = {(r[0], len((r[2] or "").encode()), hashlib.sha256((r[2] or "").encode()).hexdigest()) for r in rows}
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got} == want
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_predicates_and_payloads(spark, tmp_path, compression):
    pages = spark.createDataFrame([(i, f"http://h/{i % 3}\tx%", f"page {i // 2} " * 30) for i in range(20)], "page_id long, url string, html string")
    warc.archive(pages, f"file://{tmp_path}/w", compression)
    found = warc.load(spark, f"file://{tmp_path}/w")
    only = found.where("record_type = 'revisit'")
    assert only.count() == 10 and only.where("octet_length(payload) > 0").count() == 0
    assert found.where(F.col("target_uri") == "http://h/1\tx%").count() == 7
    bare = warc.load(spark, f"file://{tmp_path}/w", payload=False)
    assert bare.count() == 20 and bare.where("payload is not null").count() == 0
    assert found.where("record_type = 'response'").select("payload").distinct().count() == 10


def test_warc_skips_payloads_unread():
    class Counted:
        def __init__(self, data):
            import io

            self.f, self.read_bytes = io.BytesIO(data), 0

        def readline(self):
            return self.f.readline()

        def read(self, n):
            self.read_bytes += n
            return self.f.read(n)

        def seek(self, n, whence):
            self.f.seek(n, whence)

    data = b"".join(warc.record({"record_type": k}, b"x" * 1000) for k in ("response", "revisit", "response"))
    stream = Counted(data)
    got = list(warc.read_records(stream, lambda h: h["WARC-Type"] == "revisit"))
    assert len(got) == 1 and stream.read_bytes == 1000


def test_chat(spark):
    rows = [(1, 1, "assistant", "</s>[INST] \\ <\\s>"), (1, 0, "user\nx", "[/INST]<s>"), (2, 0, None, None), (2, 0, None, None), (None, 0, "assistant", "n"), (3, None, "Assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold(chat.from_rows(df)))).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 2, 2: 2, None: 1, 3: 1}
    said = "user\nx\n[/INST]<s>\nassistant\n</s>[INST] \\ <\\s>\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] \\ <\\s>").hexdigest() and got[3]["loss_chars"] == 0
    assert chat.digests(chat.render(chat.fold(chat.from_rows(df.where("false"))))).count() == 0


def test_chat_folds_events(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "he"), (1, 1, 2, "delta", None, "llo"), (1, 1, 4, "delta", None, "new"), (1, 1, 3, "regenerate", None, None), (1, 0, 5, "edit", None, "hi!"), (1, 2, 6, "message", "user", "gone"), (1, 2, 7, "delete", None, None), (1, 3, 8, "delta", "assistant", "late")]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).orderBy("turn").collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "hi!"), (1, 1, "assistant", "new"), (1, 3, "assistant", "late")]


def test_escapes_are_reversible():
    import itertools

    for n in range(6):
        for parts in itertools.product(["<", "[", "\\", "s>", "/INST]", "a"], repeat=n):
            text = "".join(parts)
            out, _ = chat.render_turn("user", text)
            assert chat.parse(out) == [("user", text)]
            assert chat.unescape(chat.escape(text)) == text


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/x", "http://example.com/en/x", "http://a.b.net/es/", "http://net/fr/1?x=/es/", "http://com", "ftp://x.org/#://net/es/", "nothing", None, "://net/es/", "http://notexample.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit(2))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(df, queries.URL_RULES).collect()}
    assert [got[i] for i in range(10)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), ("net/fr/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/es/", "block"), ("com/", "allow")]
    assert urlfilter.judge(df.where("false"), queries.URL_RULES).count() == 0
    assert urlfilter.judge(df, []).where("verdict != 'allow'").count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urlfilter.build(spark, [f"k{i}" for i in range(0, 4000, 9)] + ["absent"], keys)
    assert len(cascade.levels) >= 2
    got = {r["key"] for r in keys.where(cascade.listed(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(0, 4000, 9)}


def test_stages(spark, docs, labels, none, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert made.columns == start.columns
            made.write.parquet(out := str(tmp_path / f"{name}-{start is docs}"))
            now = spark.read.parquet(out)
    gone = corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id is null or doc_id in (4, 5)"), str(tmp_path))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in gone.where("doc_id is not null").collect()) == [(False, 4), (False, 4)]
    assert gone.where("doc_id is null").count() == 1
