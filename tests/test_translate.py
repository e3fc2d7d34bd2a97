"""The text channel with pluggable models."""

import hashlib

import duckdb
import pandas as pd
import pytest
from leafmill import queries as library
from leafmill.operators import xhtml
from leafmill.plans import translate
from pyspark.sql import functions as F


def test_backend_gets_each_text_once_and_fills_all(spark):
    segs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, " "), (5, None), (6, "x " * 2000)], "seg_id long, text string")
    known = spark.createDataFrame([], "k string, t string")
    out = translate.translate(segs, known, "en", lambda texts: [f"<{t.strip()}>" for t in texts])
    got = {r["seg_id"]: (r["out"], r["state"], r["ok"]) for r in out.collect()}
    assert got[1] == got[3] == ("<aa>", "miss", True) and got[2][0] == "<bb>"
    assert got[4] == (" ", "blank", True) and got[5] == (None, "blank", True)
    assert got[6][0].count("<") == 4 and got[6][2]
    lines = translate.new_cache_lines(out, "en")
    assert lines.count() == 3
    again = translate.translate(segs, lines.select("k", "t"), "en", lambda texts: 1 / 0)
    assert {r["state"] for r in again.collect()} == {"hit", "blank"}


def test_missing_answers_are_bisected_and_kept_as_source(spark):
    segs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "seg_id long, text string")
    known = spark.createDataFrame([], "k string, t string")
    out = translate.translate(segs, known, "en", lambda texts: [None if "3" in t else t.upper() for t in texts])
    got = {r["seg_id"]: (r["out"], r["ok"]) for r in out.collect()}
    assert got[3] == ("text 3", False) and got[2] == ("TEXT 2", True)
    assert translate.new_cache_lines(out, "en").count() == 5


def test_budgets():
    calls = []
    b = translate.Budget(max_requests=3)
    for i in range(20):
        translate.ask(lambda t: calls.append(t) or ["x"], [str(i)], b)
    assert len(calls) == 3
    b, calls = translate.Budget(stall_limit=4), []
    for i in range(40):
        translate.ask(lambda t: calls.append(t) or [""], [str(i)], b)
    assert len(calls) <= 12

    def down(texts):
        calls.append(texts)
        raise ConnectionError

    b, calls = translate.Budget(failure_limit=2), []
    for i in range(40):
        assert translate.ask(down, [str(i)], b) == [None]
    assert len(calls) <= 4
    calls = []
    translate.ask(lambda t: calls.append(t) or [None] * len(t), [str(i) for i in range(24)], translate.Budget())
    assert len(calls) <= 2.5 * 24


def test_tokens_retries_and_refused_accounts():
    calls = []
    b = translate.Budget(max_tokens=2500)
    for i in range(20):
        translate.ask(lambda t: calls.append(t) or (["x"], 1000), [str(i)], b)
    assert len(calls) == 3 and b.tokens == 3000
    tries = {}

    def late(texts):
        for t in texts:
            tries[t] = tries.get(t, 0) + 1
        return [t.upper() if t != "c" or len(texts) == 1 and tries[t] > 2 else None for t in texts]

    assert translate.ask(late, ["a", "b", "c", "d"], translate.Budget()) == ["A", "B", "C", "D"]
    assert tries == {"a": 1, "b": 1, "c": 3, "d": 1}

    def refused(texts):
        raise PermissionError("402")

    with pytest.raises(translate.Stopped):
        translate.ask(refused, ["a"], translate.Budget())


def test_contexts(spark):
    html = "<p>a <b>b</b> c</p><div>d" + "e" * 500 + "<i>f</i></div>"
    toks = xhtml.tokens(spark.createDataFrame([(1, html)], "id long, html string"), "id", F.col("html"))
    got = [r["context"] for r in xhtml.contexts(toks, "id").orderBy("pos").collect()]
    assert got == ["", "a", "a b", "", "e" * 400]


def test_answers_of_the_offline_model_are_judged(spark, tmp_path):
    texts = ["ils ont, pas an aielle reoi", "plain", "I cannot. " * 300, "known, pas an aielle", "pas an aielle, reoi", "plain", "known, pas an aielle"]
    pd.DataFrame({"doc_id": [1, 2, 3, 4, 5, 6, 7], "text": texts}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("c9_new_cache_lines", "l1_translate_texts"):
        got, want = library.queries()[name](spark, str(tmp_path)), con.sql(library.oracle_sql()[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    refused = "pas an aielle, reoi"
    assert dict(library.queries()["l1_translate_texts"](spark, str(tmp_path)).select("seg_id", "ok").collect()) == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True}
    keys = {r["k"] for r in library.queries()["c9_new_cache_lines"](spark, str(tmp_path)).collect()}
    assert keys == {hashlib.md5(b"t5|zh|plain").hexdigest()} and hashlib.md5(f"t5|zh|{refused}".encode()).hexdigest() not in keys


def test_copies_of_the_source_are_not_cached(spark):
    text = "これはとても長い文章です。"
    segs = spark.createDataFrame([(1, text, text, "miss", True), (2, text, "这是很长的文章", "miss", True)], "seg_id long, text string, out string, state string, ok boolean")
    assert [r["t"] for r in translate.new_cache_lines(segs, "简体中文").collect()] == ["这是很长的文章"]


def test_refusals_of_a_backend_are_not_cached(spark):
    segs = spark.createDataFrame([(1, "aa"), (2, "bb")], "seg_id long, text string")
    out = translate.translate(segs, spark.createDataFrame([], "k string, t string"), "en", lambda texts: ["As an AI, no" if t == "aa" else t.upper() for t in texts])
    assert [r["t"] for r in translate.new_cache_lines(out, "en").collect()] == ["BB"]
    assert {r["seg_id"]: r["why"] for r in out.collect()} == {1: "疑似模型拒答", 2: None}


def test_failures_are_the_first_five_hundred(spark):
    rows = spark.range(2000).selectExpr("id % 3 as doc", "id as seg_id", "repeat('x', 400) as text", "id % 2 = 0 as ok", "'w' as why").repartition(7)
    got = [(r["doc"], r["seg_id"], len(r["source"])) for r in translate.failures(rows).collect()]
    assert got == [(d, i, 300) for d, i in sorted((i % 3, i) for i in range(2000) if i % 2)][:500]
