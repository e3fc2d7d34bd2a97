"""What a Python worker holds of a batch besides what comes and goes."""

import hashlib
import random
import re
import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from leafmill import queries as library
from leafmill.functions import echo
from leafmill.operators import chunking
from leafmill.sources import files


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_slices_are_whole_and_bounded(kind):
    data = [b"x" * n for n in (0, 9, 3, 3, 3, 30, 0, 1)] + [None] * 7 + [b"yy"] * 9
    for a in (pa.array(data, kind), pa.array([b"z", *data], kind).slice(1)):
        parts = [p.to_pylist() for p in files.slices(a, 4, 9)]
        assert [x for p in parts for x in p] == data
        assert all(len(p) <= 4 and (len(p) == 1 or sum(len(x or b"") for x in p) <= 9) for p in parts)
    assert list(files.slices(pa.array([], kind))) == []


def test_a_batch_is_decoded_in_bounded_memory():
    texts = [f"{i}汉" + "字" * 5000 for i in range(3000)]
    data = pa.array([None if i % 7 == 0 else t.encode(("gb18030", "utf-16")[i % 2]) for i, t in enumerate(texts)])
    tracemalloc.start()
    try:
        got = files._decoded.func(data)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [None if i % 7 == 0 else t for i, t in enumerate(texts)]
    assert peak < 20e6  # texts alone are 30 MB as strings; Arrow's own memory is not counted


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 20, 1200])
def test_pieces_are_cut_in_the_jvm(spark, limit):
    r = random.Random(limit)
    texts = ["", None, "x" * limit, "x" * (limit + 1), "𠀀" * (3 * limit + 1), "a\u2028" * 2 * limit, "]^-&&[\\" * limit]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(6 * limit))) for letters in ("ab", "ab。 ", "ab\n\r\x85\x1c", "𠀀a’", "字\u3000", "a" * 500 + "…") for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.split_long(F.col("t"), limit).alias("p"))
    assert dict(df.collect()) == {i: None if t is None else chunking.cuts(t, limit) for i, t in enumerate(texts)}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["c9_new_cache_lines", "l1_translate_texts", "w2_batches"])
def test_whole_texts_stay_in_the_jvm(spark, name):
    plan = library.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and set(re.findall(r"\b(_\w+)\((?=[^)]*\)#)", plan)) <= {"_judged"}


def test_the_offline_model_leaves_the_matcher_no_text(spark, tmp_path, monkeypatch):
    """So what Python holds for c9 doesn't grow with texts, whatever they are: those with kana have an answer without any."""
    texts = [f"{i}" + "これはとても長い文章です。カナ、漢字" * n for i, n in enumerate((1, 2, 9, 70, 400) * 4)] + ["plain", "かな", "ー" * 30]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    monkeypatch.setattr(echo, "_judged", lambda x: F.when(x["a"].isNotNull(), F.raise_error(F.lit("left open")).cast("boolean")).otherwise(x["known"]))
    found = library.queries()["c9_new_cache_lines"](spark, str(tmp_path))
    asked = [t for i, t in enumerate(texts) if i % 4]
    assert sorted(r["k"] for r in found.collect()) == sorted(hashlib.md5(f"t5|zh|{t}".encode()).hexdigest() for t in asked)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="left open"):  # else the test would see nothing
        spark.createDataFrame([(texts[1], texts[1] + "あ")], "t string, o string").select(echo.is_echo(F.col("t"), F.col("o"))).collect()
