"""Answers, requests, pages and settings on awkward inputs."""

from pyspark.sql import functions as F

from leafmill.functions import answers, prompts, render
from leafmill.operators import align
from leafmill.sources import settings


def test_translations_of_all_shapes(spark):
    rows = {
        '{"translations": [{"id": "0:1", "text": "a"}, {"translation": "b"}, "c", {"id": 7}, {"id": 8, "text": null}, {"id": 9, "text": 5}, 6, null]}': [(0, "0:1", "a"), (1, "1", "b"), (2, "2", "c"), (3, "7", "")],
        '{"translations": []}': [],
        '{"translations": "x"}': None,
        '{"other": 1}': None,
        "no json": None,
        "": None,
    }
    df = spark.createDataFrame([(a,) for a in rows], "a string")
    got = {r["a"]: None if r["t"] is None else [tuple(x) for x in r["t"]] for r in df.select("a", answers.translations(F.col("a")).alias("t")).collect()}
    assert got == rows


def test_single_answers(spark):
    rows = {" x ": "x", "": "", '{"translations": ["y "]}': "y", '{"translations": [{"id": 1, "text": "z"}]} bye': "z", "[1, 2]": "", "{broken": "", None: ""}
    df = spark.createDataFrame([(a,) for a in rows], "a string")
    assert {r["a"]: r["t"] for r in df.select("a", answers.single_answer(F.col("a")).alias("t")).collect()} == rows


def test_interleaving_as_html(spark):
    pages = spark.createDataFrame([(1, "# a\n[[FIG:2]]b[[FIG:9]]"), (2, "c"), (3, None)], "k long, text string")
    figures = spark.createDataFrame([(1, 2, 0, "<figure/>")], "k long, n int, ord int, body string")
    got = {r["k"]: r["text"] for r in align.interleave(pages, figures, "k", as_html=True).collect()}
    assert got == {1: "<h3>a</h3>\n<figure/>\n<p>b</p>\n<p></p>", 2: "<p>c</p>", 3: None}


def test_requests_and_pages(spark):
    one = spark.range(1)
    items = F.array(F.struct(F.lit("0:0").alias("id"), F.lit('a "b"').alias("text"), F.lit("c" * 500).alias("context")))
    got = one.select(prompts.payload(items).alias("p"), prompts.candidate_count(F.lit("none")).alias("n"), prompts.single_prompt(F.lit("x"), "en").alias("s")).first()
    assert got["p"] == '{"items":[{"id":"0:0","text":"a \\"b\\"","context":"' + "c" * 400 + '"}]}' and got["n"] == 0 and got["s"].endswith("\n\nx")
    none = F.array().cast("array<struct<label:string,text:string>>")
    assert one.select(*[render.page_body(none, t, w).alias(f"{t}{w}") for t in (True, False) for w in (True, False)]).first()[:] == ("", "", "", "")


def test_settings(spark):
    lines = ["", "# A=1", "A = 1 ", "B='x=\"y\"'", 'C="q"', "=v", "no", "﻿D=4", None]
    got = settings.pairs(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {r["name"]: r["value"] for r in got} == {"A": "1", "B": 'x="y"', "C": "q", "D": "4"}
