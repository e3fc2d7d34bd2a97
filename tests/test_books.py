"""EPUB packages as a data source, files of books with a commit."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.sources import books, sinks


class Counted(io.BytesIO):
    """A file that knows which of its bytes were read."""

    def __init__(self, data):
        super().__init__(data)
        self.places = set()

    def read(self, n=-1):
        at = self.tell()
        got = super().read(n)
        self.places.update(range(at, at + len(got)))
        return got


OPF = """<package><manifest><item id="a" href="text/a.xhtml#x"/><item media-type="x" href="../b%20c.xhtml" id="b"/>
<item id="gone" href="none.xhtml"/><item id="b2" href="text/d.htm"/></manifest><spine><itemref idref="b2"/><itemref
linear="no" idref="b"/><itemref idref="nobody"/><itemref idref="b2"/><itemref idref="gone"/></spine></package>"""


def package(parts, folder=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if folder:
            z.writestr(zipfile.ZipInfo("OEBPS/"), b"")
        for name, data in parts:
            z.writestr(name, data)
    return out.getvalue()


PARTS = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", '<rootfile full-path="OEBPS/c.opf"/>'), ("OEBPS/text/a.xhtml", "<p>a</p>"), ("OEBPS/c.opf", OPF), ("z.OPF", "<x/>"), ("b%20c.xhtml", "<p>b</p>"), ("OEBPS/text/d.htm", b"<p>\xff d</p>"), ("OEBPS/p.png", bytes(range(256)) * 2000), ("META-INF/x.xml", "<x/>"), ("OEBPS/toc.ncx", "<n/>")]


def test_unwanted_entries_are_not_read():
    data = package(PARTS)
    where = {i.filename: (i.header_offset, i.compress_size) for i in zipfile.ZipFile(io.BytesIO(data)).infolist()}
    stream = Counted(data)
    got = list(books.read_package(stream, "x", lambda name: name.endswith(".xhtml")))
    assert [(r[2], r[4]) for r in got] == [("OEBPS/text/a.xhtml", b"<p>a</p>"), ("b%20c.xhtml", b"<p>b</p>")]
    at, size = where["OEBPS/p.png"]
    assert not stream.places & set(range(at, at + size - 1100))  # the end of the file is looked through for the directory
    stream = Counted(data)
    assert [r[2] for r in books.read_package(stream, "x", payload=False)] == [n for n, _ in PARTS]


@pytest.fixture
def folder(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/one.epub").write_bytes(package(PARTS))
    (tmp_path / "in/deep/two.EPUB").write_bytes(package([("b.xhtml", "2b"), ("a.html", "2a")], False))
    (tmp_path / "in/no.epub").write_bytes(b"not a zip")
    (tmp_path / "in/cut.epub").write_bytes(package(PARTS)[:500])
    (tmp_path / "in/empty.epub").write_bytes(b"")
    (tmp_path / "in/pictures.epub").write_bytes(package([("mimetype", "x"), ("p.png", "p"), ("META-INF/container.xml", "c")]))
    (tmp_path / "in/other.txt").write_text("no package")
    return f"file://{tmp_path}/in"


def test_predicates_reach_the_reader(spark, folder):
    df = books.read_epubs(spark, folder)
    names = lambda cond: sorted(r["name"] for r in df.where(cond).collect())
    assert names("name = 'b.xhtml'") == ["b.xhtml"]
    assert names("name like '%.xhtml'") == ["OEBPS/text/a.xhtml", "b%20c.xhtml", "b.xhtml"]
    assert names("name in ('a.html', 'OEBPS/p.png') and name like 'a%'") == ["a.html"]
    assert names("name like '%text%'") == ["OEBPS/text/a.xhtml", "OEBPS/text/d.htm"]
    assert df.where("path like '%two%'").count() == 2
    reader = books.EpubReader({"path": folder})
    assert list(reader.pushFilters([books.StringEndsWith(("name",), ".htm"), books.EqualTo(("size",), 3)])) and not reader.passes("name", "x.html") and reader.passes("name", "x.htm")
    bad = {r["path"].rsplit("/", 1)[1]: r["error"].split(":")[0] for r in df.where("error is not null").collect()}
    assert bad == {"no.epub": "not a zip", "cut.epub": "not a zip", "empty.epub": "not a zip", "pictures.epub": "no documents"}
    assert books.read_epubs(spark, folder, payload=False).where("data is not null").count() == 0


def test_documents_in_reading_order(spark, folder):
    docs = books.documents(books.read_epubs(spark, folder)).orderBy("book", "place", "ord").select("book", "name", books.text_of(F.col("data")).alias("text")).collect()
    got = {}
    for book, name, text in docs:
        got.setdefault(book.rsplit("/", 1)[1], []).append((name, text))
    assert got == {"one.epub": [("OEBPS/text/d.htm", "<p>\ufffd d</p>"), ("b%20c.xhtml", "<p>b</p>"), ("OEBPS/text/a.xhtml", "<p>a</p>")], "two.EPUB": [("b.xhtml", "2b"), ("a.html", "2a")]}


def test_files_are_written_and_read_back(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = [(b, i, f"d{i}.xhtml" if i else "mimetype", f"{b} {i} ".encode() * (1 + 3000 * (i == 2))) for b in ("x/one.epub", "y/ONE.epub", "two", "a:b?") for i in range(4)]
    df = spark.createDataFrame(rows, "book string, ord int, name string, data binary")
    books.write_books(df, out)
    names = sorted(f.name for f in (tmp_path / "out").iterdir())
    assert len(names) == 4 and "two.epub" in names and "a_b_.epub" in names and sum(n.lower().startswith("one-") for n in names) == 2
    with zipfile.ZipFile(tmp_path / "out/two.epub") as z:
        first = z.infolist()[0]
        assert (first.filename, first.compress_type, first.extra, first.flag_bits & 8) == ("mimetype", zipfile.ZIP_STORED, b"", 0)
        assert z.testzip() is None and z.read("d2.xhtml") == b"two 2 " * 3001
    assert (tmp_path / "out/two.epub").read_bytes()[30:58] == b"mimetypeapplication/epub+zip"
    again = books.read_epubs(spark, out).where("name != 'mimetype'").select("name", "data").collect()
    assert sorted((n, bytes(d)) for n, d in again) == sorted((n, d) for _, i, n, d in rows if i)
    books.write_books(df.where("book = 'two'"), out)
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["two.epub"]
    texts = spark.createDataFrame([("t", 2, "b"), ("t", 1, "a\n"), ("u", 1, None)], "book string, ord int, data string")
    books.write_books(texts, out, "txt")
    assert (tmp_path / "out/t.txt").read_text() == "a\n\n\nb\n" and (tmp_path / "out/u.txt").read_text() == "\n" and (tmp_path / "out/two.epub").exists()
    books.write_books(texts.where("false"), out, "txt")
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["two.epub"]


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    books.write_books(spark.createDataFrame([("old", 1, "a.xhtml", b"x")], "book string, ord int, name string, data binary"), out)
    df = spark.range(20).selectExpr("id div 5 as book", "cast(id as int) as ord", "'a.xhtml' as name", "cast(if(id = 19, raise_error('lost'), 'x') as binary) as data")
    with pytest.raises(Exception, match="lost"):
        books.write_books(df, out)
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["old.epub"]


def test_package_of_rows_equals_the_written_file(spark, tmp_path):
    rows = [("b", 0, "a.xhtml", b"<p>x</p>"), ("b", 1, "p.png", b"\x89PNG")]
    df = spark.createDataFrame(rows, "book string, ord int, name string, data binary")
    books.write_books(df, f"file://{tmp_path}")
    assert (tmp_path / "b.epub").read_bytes() == bytes(sinks.packages(df).first()["content"])
