"""WARC archives: members that are passed over unread, other writers' archives, rolled archives, records' headers."""

import gzip
import io
import os

import pytest

from leafmill.llm import warc


class Counted(io.BytesIO):
    """A file that counts the bytes read from it."""

    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


RECORDS = [({"record_type": k, "record_id": f"<urn:x:{i}>", "target_uri": "u"}, os.urandom(n)) for i, (k, n) in enumerate([("response", 300_000), ("revisit", 0), ("response", 5), ("response", 4_000), ("revisit", 70_000), ("response", 400_000)])]


@pytest.mark.parametrize("squeeze", [warc.member, lambda data: gzip.compress(data, 1)])
@pytest.mark.parametrize("wanted", ["response", "revisit", None])
def test_members_give_the_wanted_records(squeeze, wanted):
    stream = warc.Members(Counted(b"".join(squeeze(warc.record(v, p)) for v, p in RECORDS)))
    got = [(h["WARC-Record-ID"], p) for h, p in warc.read_records(stream, lambda h: h["WARC-Type"] == wanted)]
    assert got == [(v["record_id"], p) for v, p in RECORDS if v["record_type"] == wanted]


def test_unwanted_members_are_not_read():
    raw = Counted(b"".join(warc.member(warc.record(v, p)) for v, p in RECORDS))
    size = len(raw.getbuffer())
    inflated = []
    stream = warc.Members(raw)
    more = stream._more
    stream._more = lambda least=1: inflated.append(least) or more(least)
    got = list(warc.read_records(stream, lambda h: h["WARC-Record-ID"] == "<urn:x:2>"))
    assert [p for _, p in got] == [RECORDS[2][1]] and raw.taken < size / 2
    assert list(warc.read_records(warc.Members(Counted(raw.getvalue())), payloads=False))[5][1] is None


def test_members_are_plain_gzip():
    data = b"".join(warc.member(warc.record(v, p)) for v, p in RECORDS)
    assert gzip.decompress(data) == b"".join(warc.record(v, p) for v, p in RECORDS)


def test_broken_archives_are_told():
    data = warc.member(warc.record(*RECORDS[0]))
    for cut in (20, 200, len(data) // 2):
        with pytest.raises((ValueError, KeyError)):
            list(warc.read_records(warc.Members(io.BytesIO(data[:cut]))))


def test_small_members_need_no_seek_each():
    raw = Counted(b"".join(warc.member(warc.record({"record_type": "response", "record_id": str(i)}, b"x" * 2000)) for i in range(3000)))
    size = len(raw.getbuffer())
    assert sum(1 for _ in warc.read_records(warc.Members(raw), payloads=False)) == 3000 and raw.taken <= size + warc.CHUNK


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_roll_and_records_have_what_the_format_asks(spark, tmp_path, compression):
    pages = spark.range(200).selectExpr("case when id = 7 then null else id end as page_id", "concat('http://h/', id) as url", "repeat(concat('page ', id div 2, ' '), 200) as html").coalesce(1)
    out = f"file://{tmp_path}/w"
    warc.register(spark)
    warc.records_of(pages).coalesce(1).write.format("warc").option("path", out).option("compression", compression).option("roll_mb", "0.01").mode("append").save()
    files = sorted((tmp_path / "w").iterdir())
    assert len(files) > 3 and all(f.stat().st_size < 20_000 for f in files)
    got = warc.load(spark, out).collect()
    assert len(got) == 200 and sum(r["record_id"] is None for r in got) == 1
    opened = gzip.open if compression == "gzip" else open
    text = b"".join(opened(f, "rb").read() for f in files).decode()
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"):
        assert text.count(f"\r\n{name}: ") == 200
    assert text.count("\r\nWARC-Profile: ") == sum(r["record_type"] == "revisit" for r in got) == 99


def test_records_of_other_writers():
    raw = b"".join([
        b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <urn:x:1>\r\nWARC-Target-URI: http://a/b%20c?x=%E9&y=100%\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n",
        b"WARC/1.1\nWARC-Type: request\nWARC-Target-URI: http://a/%zz\xe9\nX-Long: one\n two\n\tthree\nno colon\nCONTENT-LENGTH:  2 \n\nde\n\n",
        "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://é/\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(),
    ])
    got = list(warc.read_records(io.BytesIO(raw)))
    assert [(h["WARC-Type"], h["WARC-Target-URI"], p) for h, p in got] == [("response", "http://a/b%20c?x=%E9&y=100%", b"abc"), ("request", "http://a/%zzé", b"de"), ("response", "http://é/", b"")]
    assert got[0][0]["WARC-Record-ID"] == "<urn:x:1>" and got[1][0]["X-Long"] == "one two three"


@pytest.mark.parametrize("uri", ["http://a/b%20c?x=%E9", "100%", "%zz", "a\nb", " lead", "trail ", "tab\tin", "é\x7f%41", "", "a b"])
def test_headers_come_back_as_they_were(uri):
    made = warc.record({"record_type": "response", "record_id": "<urn:x:1>", "target_uri": uri}, b"p")
    (headers, payload), = warc.read_records(io.BytesIO(made))
    assert headers["WARC-Target-URI"] == uri and payload == b"p"
    if not warc.needs_escape(uri):
        assert f"WARC-Target-URI: {uri}\r\n".encode() in made and warc.ESCAPED.encode() not in made


def test_broken_archives(spark, tmp_path):
    good = warc.record({"record_type": "response", "record_id": "<urn:x:1>", "target_uri": "u"}, b"abc")
    (tmp_path / "a.warc").write_bytes(good + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nxx")
    (tmp_path / "b.warc").write_bytes(good + good[:-20])
    (tmp_path / "c.warc.gz").write_bytes(warc.member(good) + warc.member(good)[:40])
    (tmp_path / "d.warc").write_bytes(b"nothing\r\n")
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(good + good))
    warc.register(spark)
    read = lambda bad: spark.read.format("warc").option("bad", bad).load(f"file://{tmp_path}")
    rows = read("row").collect()
    assert sum(r["error"] is None for r in rows) == 5 and all(bytes(r["payload"]) == b"abc" for r in rows if r["error"] is None)
    assert sorted(r["error"].split(": ")[0].rsplit("/", 1)[1] for r in rows if r["error"]) == ["a.warc", "b.warc", "c.warc.gz", "d.warc"]
    with pytest.raises(Exception, match="length|within|begins"):
        read("fail").collect()
