"""Whole tables and whole texts against brute force."""

import base64
import hashlib
import re
from difflib import SequenceMatcher

import pandas as pd
import pytest

from leafmill import queries as library
from leafmill.functions import geometry
from leafmill.functions import text as fx

DATA = "/root/testdata/sf0.001"


def run(spark, name, folder=DATA):
    return [tuple(r) for r in library.queries()[name](spark, folder).collect()]


@pytest.fixture(scope="module")
def rects():
    """(page, cand_idx, x0, y0, x1, y1, is_drawing) of every order line."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    out = []
    for order, line, part, supp, quantity, flag in pd.read_parquet(f"{DATA}/lineitem.parquet")[cols].itertuples(index=False):
        x, y = float(part % 300), float(supp % 400)
        out.append((order, line * 10**9 + part * 10_000 + supp, x, y, x + 20 + quantity * 6, y + 20 + part % 50 * 7, flag == "R"))
    return out


def size(r):
    return (r[4] - r[2]) * (r[5] - r[3])


@pytest.fixture(scope="module")
def candidates(rects):
    side = lambda r: 40 if r[6] else 30
    return [r for r in rects if min(r[4] - r[2], r[5] - r[3]) >= side(r) and 0.01 <= size(r) / 480_000 <= 0.72]


def zone(r):
    third = lambda v, all_: 0 if v < all_ / 3 else 1 if v < 2 * all_ / 3 else 2
    return geometry.ZONES[third((r[3] + r[5]) / 2, 800) * 3 + third((r[2] + r[4]) / 2, 600)]


def pages(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_figures_of_all_orders(spark, rects, candidates):
    assert sorted(run(spark, "p6_figure_candidates")) == sorted(r[:2] for r in candidates)
    assert sorted(run(spark, "f9_zone")) == sorted((*r[:2], zone(r)) for r in rects)
    held = pages(candidates)
    assert sorted(run(spark, "j11_candidate_count")) == sorted((p, len(held.get(p, []))) for p in pages(rects))


def test_suppression_on_all_orders(spark, candidates):
    want = []
    for page, rows in pages(candidates).items():
        kept = []
        for r in sorted(rows, key=lambda r: (-size(r), r[1])):
            if not any(max(min(r[4], k[4]) - max(r[2], k[2]), 0) * max(min(r[5], k[5]) - max(r[3], k[3]), 0) > size(r) * 0.7 for k in kept):
                kept.append(r)
        want += [(page, r[1]) for r in kept]
    assert sorted(run(spark, "j6_suppress")) == sorted(want)


def test_reading_order_keeps_eight(spark, candidates):
    want = []
    for page, rows in pages(candidates).items():
        want += [(page, r[1], k) for k, r in enumerate(sorted(rows, key=lambda r: (round(r[3]), round(r[2]), r[1]))[:8])]
    assert max(k for _, _, k in want) > 3
    assert sorted(run(spark, "o3_reading_order")) == sorted(want)


def test_matching_on_all_orders(spark, rects):
    want = []
    for page, rows in pages(rects).items():
        free = sorted(rows, key=lambda r: r[1])
        left = []
        for r in sorted(rows, key=lambda r: -r[1]):
            pos = ("", "center", zone(r))[r[1] % 3]
            hit = next((c for c in free if zone(c) == pos), None)
            if hit is None:
                left.append(r)
            else:
                free.remove(hit)
                want.append((page, 10 - r[1], hit[1], "zone"))
        want += [(page, 10 - r[1], c[1], "order") for r, c in zip(left, free, strict=False)]
    assert sorted(run(spark, "j4_j5_match")) == sorted(want)


KANA = str.maketrans("aeiou", "あえいおう")


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Folder and texts: what matters comes after more characters than any prefix had."""
    plain = "bcdfg hjklm " * 40
    texts = [plain + end for end in ("", " i cannot", " as an AI", " あいう", " 汉字", " aeiou " * 90, "无法翻译", "xyz " * 700) for _ in range(12)]
    folder = str(tmp_path_factory.mktemp("texts"))
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder, texts


def value(i, t):
    return (t.translate(KANA), "译文" + t, "I CANNOT " + t, "\n  ", "译" * 12 + "か", "汉" + t.translate(KANA))[i % 6]


def judge(v):
    """(usable, trustworthy)"""
    v = v.strip()
    kana, cjk = len(re.findall("[\u3040-\u30ff]", v)), len(re.findall("[\u4e00-\u9fff]", v))
    good = bool(v) and not any(m in v.lower() for m in fx.REFUSALS) and not (kana and not cjk)
    return good, good and kana * 10 <= max(kana + cjk, 1)


def test_cache_judges_whole_texts(spark, texts):
    folder, docs = texts
    values = [value(i, t) for i, t in enumerate(docs)]
    for name, k in (("p8_usable", 0), ("p9_trustworthy", 1)):
        assert sorted(run(spark, name, folder)) == [(i, judge(v)[k]) for i, v in enumerate(values)]
    key = lambda i: hashlib.md5(f"t5|zh|{i % 200}".encode()).hexdigest()
    version = lambda i: None if i % 11 == 0 else 2 if i % 7 == 0 else 1
    assert sorted(run(spark, "a8_first_wins", folder)) == sorted((key(i), v) for i, v in enumerate(values) if version(i) == 1 and judge(v)[0])
    good = sum(judge(v)[1] for v in values)
    assert run(spark, "a6_cache_audit", folder) == [(len(docs), good, len(docs) - good, sum(version(i) is None for i in range(len(docs))))]
    got = library.queries()["k11_cache_clean"](spark, folder).select("n", "k", "t").collect()
    assert sorted(map(tuple, got)) == [(i, key(i), v) for i, v in enumerate(values) if judge(v)[1]]


def test_echo_of_whole_texts(spark, tmp_path):
    texts = ["bcdfg hjklm " * 40 + "aeiou", "aeiou " * 400, "bcdfg " * 50, "aei", "".join(chr(0x4E00 + i * 7 % 5000) + "a" for i in range(3000))]
    texts = [t for t in texts for _ in range(2)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    strip = lambda t: re.sub(fx.ECHO_STRIP, "", t)
    kana = lambda t: len(re.findall(fx.KANA, t))
    want = []
    for i, t in enumerate(texts):
        source = t.translate(KANA)
        s, v = strip(source), strip("译" + source if i % 2 else source + "。")
        able = len(s) >= 8 and kana(s) >= 3
        open_ = kana(v) > 0 and abs(len(v) - len(s)) <= max(2, int(len(s) * 0.25))
        want.append((i, able and (v == s or open_ and SequenceMatcher(None, v, s).ratio() >= 0.9)))
    assert sorted(run(spark, "p10_echo", str(tmp_path))) == want
    assert want[0][1]  # kana only beyond 200 characters


def test_functions_take_whole_texts(spark, texts):
    folder, docs = texts
    assert sorted(run(spark, "f1_strip_ruby", folder)) == [(i, f"<p><ruby>{t}</ruby></p>") for i, t in enumerate(docs)]
    want = [(i, "data:image/png;base64," + base64.b64encode(t.encode()).decode(), hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(docs)]
    assert sorted(run(spark, "f8_data_url", folder)) == want


def test_failed_units_keep_300_characters(spark, texts):
    folder, docs = texts
    got = {r["source"]: r["report"] for r in library.queries()["k7_failed_units"](spark, folder).collect()}
    assert got == {f"s{s}": "\n".join(f"[{i}] {docs[i][:300]}" for i in range(s, len(docs), 3)) for s in range(3)}
