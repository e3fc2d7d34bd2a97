"""Every registered query of the library against its SQL at the smallest scale."""

import html
import re

import duckdb
import pandas as pd
import pytest

from leafmill import queries as library
from leafmill.functions import text as fx
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    cell = lambda v: "NULL" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_query_equals_sql(name, spark, con):
    got, want = library.queries()[name](spark, DATA).toPandas(), con.sql(library.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_run(spark):
    for name in sorted(set(library.queries()) - set(library.oracle_sql())):
        assert library.queries()[name](spark, DATA).count() > 0


def test_plain_text_of_odd_pages(spark, tmp_path):
    """Against the rules one after the other in plain Python, which knows all entities."""
    odd = ["<p>in the&amp</p>Die", "a&ampx &AMP; &amp;lt; &#x27;&eacute;&hellip;&copy2020&nbsp;", " x ", "\x0bx<br\x0b/>y\x85", "　x ", "a</blocKquote>b", "<ſcript>x</SCRIPT>y"]
    odd += ["<scripté>x</script>y", "<styles>x</style>y", "<script>open", "", None, "<p>&amp</p>" * 5000]
    pd.DataFrame({"page_id": range(len(odd)), "url": "", "html": odd}).to_parquet(tmp_path / "pages.parquet")
    got = dict(library.queries()["f2_plain_text"](spark, str(tmp_path)).select("page_id", "text").collect())

    def plain(page):
        for pattern, new in ((r"(?is)<(script|style)\b.*?</\1>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|h[1-6]|li|tr|blockquote|section|article)>", "\n"), (r"<[^>]+>", "")):
            page = re.sub(pattern, new, page)
        page = re.sub("[ \t\u00a0]+", " ", html.unescape(page))
        return re.sub(r"\n{3,}", "\n\n", page).strip()

    assert got == {i: None if page is None else plain(page) for i, page in enumerate(odd)}


def test_plain_text_of_a_page_of_angles(spark):
    page = "<p>a " + "<b " * 300_000
    got = spark.createDataFrame([(page,)], "html string").select(fx.plain_text(F.col("html")).alias("t")).first()["t"]
    assert got == page[3:].strip()
