"""The matcher's bounds against the matcher itself, below and beyond the 200 characters from which on it leaves out what is frequent."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from leafmill.functions import echo
from leafmill.functions import text as fx


def changed(r, text, rate):
    out = []
    for c in text:
        x = r.random()
        if x < rate / 3:
            continue
        out.append(c if x > rate else r.choice("あいうabc"))
        if x > 1 - rate / 3:
            out.append(r.choice("えお漢字"))
    return "".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_verdicts_are_the_matchers(seed):
    r, seen = random.Random(seed), set()
    for _ in range(150):
        letters = r.choice(["あい", "あいうえおかきくけこ", "".join(map(chr, range(0x4E00, 0x4E00 + r.choice([30, 300, 3000]))))])
        a = "".join(r.choice(letters) for _ in range(r.choice([0, 5, 40, 150, 199, 200, 250, 600, 1200])))
        b = r.choice([a, changed(r, a, r.choice([0.01, 0.05, 0.1, 0.2])), "译" + a, a[::-1], "".join(r.sample(a, len(a))), a[len(a) // 3 :] + a[: len(a) // 3]])
        want = SequenceMatcher(None, a, b).ratio() >= 0.9
        assert echo.near(a, b) == want
        seen.add(want)
    assert seen == {True, False}


@pytest.mark.parametrize("seed", range(4))
def test_a_text_within_the_other_is_the_first_block(seed):
    r, seen = random.Random(seed), set()
    for _ in range(400):
        letters = r.choice(["あいう", "あいうえおかきくけこ", "".join(map(chr, range(0x4E00, 0x4E00 + r.choice([30, 60, 300]))))])
        a = "".join(r.choice(letters + "]^-\\xyz" * (r.random() < 0.3)) for _ in range(r.choice([8, 60, 199, 200, 250, 900])))
        part = lambda: a[(i := r.randrange(len(a))) : i + r.randrange(len(a) // 8 + 2)]
        b = r.choice(["译" + a, part() + a, part() + a + part(), a + part(), a])
        for x, y in ((a, b), (b, a)):
            held = echo.holds(x, y)
            assert not held or SequenceMatcher(None, x, y).find_longest_match().size == len(a)
            assert echo.near(x, y) == (SequenceMatcher(None, x, y).ratio() >= 0.9)
            seen.add(held)
    assert seen == {True, False}


def test_a_marked_copy_never_reaches_the_matcher(monkeypatch):
    r = random.Random(0)
    text = "".join(r.choice("あいうえおbcdfgh" if i % 25 else "jklmnpq") for i in range(100_000))
    monkeypatch.setattr(echo, "SequenceMatcher", None)
    assert echo.near("译" + text, text) and echo.near(text, text + "。")


def test_texts_are_stripped_once(spark):
    df = spark.createDataFrame([("あいうえおかきくけこ", "译あいうえおかきくけこ"), ("あいうえおかきくけこ", None), (None, "あ"), ("ab", "ab")], "a string, b string").select(echo.is_echo(F.col("a"), F.col("b")).alias("e"))
    assert [x["e"] for x in df.collect()] == [True, False, False, False]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2 and "regexp_replace" not in plan


def test_strips_what_it_did(spark):
    every = "".join(chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000)
    got = spark.createDataFrame([(every,)], "t string").select(fx.normalized(F.col("t")), F.regexp_replace("t", fx.ECHO_STRIP, "")).first()
    assert got[0] == got[1] and len(got[0]) < len(every)
