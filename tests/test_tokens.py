"""Tokens of pages against a plain scan, also of pages whose angles nothing closes."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill import queries as library
from leafmill.operators import xhtml
from leafmill.plans import jobs
from leafmill.plans.rounds import Limits
from leafmill.sources import files, sinks


def plain(page):
    """Tags, comments, sections and instructions one after the other; what lies between is text."""
    out, at = [], 0
    for m in re.finditer(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<[^>]*>", page):
        out += [page[at : m.start()]] * (m.start() > at) + [m[0]]
        at = m.end()
    return out + [page[at:]] * (at < len(page))


def odd_pages(seed, n):
    r = random.Random(seed)
    parts = ["<!--", "-->", "<![CDATA[", "]]>", "<?", "?>", "<", ">", "<b ", "a", " x ", "<p>", "</p>", "<pre/>", "<script>", "</script>", "\n"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(n)]


ODD = ["<p>a" + "<b " * 2000, "<p>a</p>" + "x < y " * 500 + "<p>b</p> < c <", "<!-- a > b " * 300 + "--><p>c", "<!-- a>b " * 300, "<p>" + "<![CDATA[ a> b" * 100, "<? a>" * 50 + "?", "", "<", ">", "<p>a > b < c</p>", "<!--><p>x", "<p>" + "<!-- > " * 40 + "--> y < z"]


def test_tokens_equal_a_plain_scan(spark):
    pages = [*ODD, *odd_pages(1, 3000)]
    for page in pages:
        assert xhtml.split_tokens(page) == plain(page)
    got = xhtml.tokens(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), "id", F.col("html")).select("id", "pos", "tok").collect()
    made = {}
    for i, pos, tok in got:
        made.setdefault(i, {})[pos] = tok
    assert made == {i: dict(enumerate(plain(p))) for i, p in enumerate(pages) if p}


def test_queries_over_odd_pages_equal_their_sql(spark, tmp_path):
    pages = [*ODD, *odd_pages(2, 200)]
    pd.DataFrame({"page_id": range(len(pages)), "url": "", "html": pages}).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    for name in ("w4_xhtml_units", "w5_skip_depth", "p1_text_slots", "w7_first_of_group"):
        got, want = library.queries()[name](spark, str(tmp_path)), con.sql(library.oracle_sql()[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("page", ["<p>a" + "<b " * 1_000_000, "<p>a</p><!--" + "<b> c <!-- " * 100_000])
def test_open_angles_by_the_million(spark, tmp_path, page):
    df = spark.createDataFrame([(1, "", page)], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    tokens = ["<p>", page[3:]] if page.startswith("<p>a<b") else ["<p>", "a", "</p>", "<!--<b>", *(x for _ in range(99_999) for x in (" c ", "<!-- <b>")), " c <!-- "]
    got = library.queries()["w5_skip_depth"](spark, str(tmp_path)).first()
    assert got["tokens"] == len(tokens)
    assert library.queries()["w4_xhtml_units"](spark, str(tmp_path)).where("text like 'a%'").count() >= 1
    whole = library.queries()["l1_translate_pages"](spark, str(tmp_path)).first()
    assert whole["chars"] >= len(page)
    if page.startswith("<p>a<b"):
        book = sinks.package([("a.opf", b"<dc:language>en</dc:language>"), ("c.xhtml", page[:30_000].encode())])
        jobs.run_epubs(spark.createDataFrame([("b.epub", book)], "path string, content binary"), "fr", f"{tmp_path}/out", lambda texts: [t.upper() for t in texts], Limits(together=4096))
        made = next((tmp_path / "out/epub").glob("*.epub")).read_bytes()
        assert {n: d for _, n, d in files.entries(made)}["c.xhtml"].decode().startswith("<p>A&lt;B")
