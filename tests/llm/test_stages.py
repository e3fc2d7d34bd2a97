"""The pipeline's stages, the quality rules' counts and chat event logs against brute force and SQL."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_samples import _forward

import corpus_pipeline
from leafmill.llm import chat, packing, quality, queries, rules, toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good, bad and toxic documents, near copies among the good, and their labels."""
    r = random.Random(6)
    words = [f"{a}{b}" for a in ("ri", "mo", "ta", "len", "gru", "sol") for b in ("va", "ner", "lo", "mis", "tan", "pe", "dor")]
    rows, labels = [], []
    for i in range(360):
        text = " ".join(r.choices(words, k=60))
        bad, toxic = i % 6 == 1, i % 6 == 2
        if bad:
            text = " ".join(f"{w.upper()}##{r.randrange(9)}$$" for w in r.choices(words, k=40))
        if toxic:
            text = " ".join(text.split()[:40] + r.choices(["horrible", "idiot", "disgusting", "loathsome"], k=12))
        if i % 9 == 0 and i:
            base = rows[r.randrange(len(rows))][1] or ""
            text = base if i % 2 else " ".join([*base.split()[:-1], "end"])
        rows.append((i, text, "en", "s", len(text)))
        if i % 9:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (402, " ".join(words * 400), "en", "s", 1), (None, "no id here", None, None, None), (403, rows[3][1], "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def key(row):
    return (row["doc_id"] is None, row["doc_id"], row["text"])


@pytest.mark.parametrize(("number", "module", "label", "passes"), [(0, quality, "quality", lambda s: s >= 0.3), (1, toxicity, "toxic", lambda s: s < 0.5)])
def test_filters_keep_what_a_plain_forward_pass_keeps(number, module, label, passes, corpus, spark):
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    kept = corpus_pipeline.STAGES[number][1](spark, docs, corpus).collect()
    model = module.fit(docs, labels, label)
    want = [r for r in docs.collect() if passes(_forward(module, model, r["text"]))]
    assert sorted(kept, key=key) == sorted(want, key=key) and 200 < len(kept) < docs.count()


def components(rows, size=5, percent=80):
    sets = []
    for r in rows:
        words = (r["text"] or "").lower().split()
        sets.append({tuple(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))} if words else set())
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k]):
                a, b = top(i), top(k)
                group[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(rows))]


def test_near_duplicate_stage(corpus, spark):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = sorted((r for r in docs.collect() if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    want = {rows[i]["doc_id"] for i, g in enumerate(components(rows)) if g == i}
    got = corpus_pipeline.drop_near_duplicates(spark, docs, corpus).collect()
    assert {r["doc_id"] for r in got if r["doc_id"] is not None} == want and sum(r["doc_id"] is None for r in got) == 1
    assert len(want) < len(rows) - 20


def test_whole_pipeline(corpus, spark):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, corpus).collect(), docs.schema)
    got = corpus_pipeline.run(spark, corpus).collect()
    encode = packing.FileIds(queries.tokenizer_path("byte_bpe_50k.json"), queries.split_pattern()).ids
    want, sizes = [], []
    for r in docs.collect():
        n = len(encode(r["text"] or "")) // 4 + 1
        want += [(r["doc_id"], k, start, length) for k, (start, length) in enumerate(packing.cut(n, 2048))]
    sizes = [w[3] for w in want]
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got), key=order) == sorted(want, key=order)
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            n, fit = n + 1, 2048
        else:
            gaps.remove(fit)
        gaps.append(fit - s)
    assert len({r["sequence_id"] for r in got}) == n


COUNTS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
again AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri), rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t), ll AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN ll USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c ORDER BY doc_id"""


def test_rule_counts_equal_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(COUNTS).fetchall()
    got = queries.op4_quality_rules(spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and sum(r[-1] for r in want) > 10


def test_rules_agree_with_labels_that_they_did_not_see(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = rules.apply_rules(docs, labels.where(~unseen)).join(labels.where(unseen).select("doc_id", "quality"), "doc_id").where("not base_failed")
    n, right = out.agg(F.count("*"), F.count_if(F.col("kept") == (F.col("quality") == 1))).first()
    assert n > 300 and right >= 0.97 * n


def test_chat_logs_equal_a_plain_fold(spark):
    r = random.Random(9)
    log = []
    for conv in range(40):
        for seq in range(r.randrange(1, 40)):
            kind = r.choice(["message", "delta", "delta", "edit", "regenerate", "delete"])
            log.append((conv, r.randrange(4), seq, kind, r.choice(["user", "assistant", None]), r.choice([None, "", "a", "</s>", "[INST]\\", "ü🙂\n"])))
    want = {}
    for conv, turn, seq, kind, role, text in sorted(log, key=lambda x: (x[0], x[1], x[2])):
        turns = want.setdefault(conv, {}).setdefault(turn, [])
        if kind == "message" or (not turns or turns[-1] is None) and kind != "delete":
            turns.append([role or "", text or ""])
        elif kind == "delete":
            if turns and turns[-1] is not None:
                turns[-1] = None
        else:
            last = turns[-1]
            last[0] = role or last[0]
            last[1] = last[1] + (text or "") if kind == "delta" else (text or "") if kind == "edit" else ""
    said = {c: [m for t in sorted(turns) for m in turns[t] if m is not None] for c, turns in want.items()}
    events = spark.createDataFrame(r.sample(log, len(log)), "conv_id long, turn long, seq long, kind string, role string, text string")
    got = {x["conv_id"]: x for x in chat.digests(chat.render(chat.fold(events))).collect()}
    assert set(got) == {c for c, m in said.items() if m}
    for c, x in got.items():
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said[c]).encode()).hexdigest()
        assert x["loss_sha256"] == hashlib.sha256("".join(b for a, b in said[c] if a == "assistant").encode()).hexdigest()
