"""Running contexts in parallel ranges against a plain fold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import xhtml


def fold(page):
    """(pos, context) of slots, one token after the other."""
    out, now, depth, at, pos = [], "", 0, 0, 0

    def text(part):
        nonlocal now, pos
        if part:
            if depth == 0 and any(c.isalpha() for c in part):
                out.append((pos, now))
            now = f"{now} {part}".strip()
            now = now[-400:] if len(now) > 400 else now
            pos += 1

    for m in re.finditer(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<[^>]*>", page):
        text(page[at : m.start()])
        tag, at, pos = m[0], m.end(), pos + 1
        found = re.match(r"</?\s*([A-Za-z0-9:_-]+)", tag)
        name = found[1].lower() if found else ""
        if name in xhtml.SKIP:
            depth = max(0, depth - 1) if tag.startswith("</") else depth if tag.endswith("/>") else depth + 1
        if name in xhtml.BLOCK and not tag.startswith("</"):
            now = ""
    text(page[at:])
    return out


def got(spark, pages):
    toks = xhtml.tokens(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), "id", F.col("html"))
    return sorted((r["id"], r["pos"], r["context"]) for r in xhtml.contexts(toks, "id").collect())


def want(pages):
    return sorted((i, pos, ctx) for i, page in enumerate(pages) for pos, ctx in fold(page))


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def made(seed, n, parts, longest=60):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, longest))) for _ in range(n)]


WORDS = ["a", " b ", "\n", "  ", "word " * 20, " " * 30, "x" * 401, " y" * 210, "é　", "&amp;", "<b>", "</b>", "<i>", "<br/>", "<!-- c -->"]


def test_random_pages(spark, ranges):
    pages = made(1, 150, [*WORDS, "<p>", "</p>", "<script>", "</script>", "<div>"])
    assert got(spark, pages) == want(pages)


def test_stretches_over_many_ranges(spark, ranges):
    pages = made(2, 4, WORDS, 900) + made(3, 3, ["<b>", "x ", "y", "</b>", "   "], 3000) + ["<p>" + " <i></i>" * 500 + "end<b>z</b>"]
    assert got(spark, pages) == want(pages)


def test_a_page_of_many_tokens(spark, ranges):
    page = "".join(f"t{i}<b>" for i in range(60_000))
    assert got(spark, [page]) == want([page])
