"""Operators on fixtures that the given tables lack."""

import io
import zipfile

from pyspark.sql import functions as F

from leafmill.functions import markdown
from leafmill.functions import text as fx
from leafmill.functions.echo import is_echo
from leafmill.operators import chunking, xhtml
from leafmill.sources import files, sinks
from leafmill.streaming import checkpoints


def test_cuts_are_lossless_and_short():
    for text in ("あ" * 20_000, "一二三四五六七八九十一二三四五六。" * 500, "word " * 2000, "", "x"):
        made = chunking.cuts(text)
        assert "".join(made) == text
        assert max(map(len, made)) <= 1200


def test_batches():
    assert chunking.batch_numbers([1000, 900, 100, 1700, 50]) == [0, 1, 1, 2, 2]
    assert chunking.batch_numbers([1] * 50) == [0] * 24 + [1] * 24 + [2] * 2
    assert chunking.batch_numbers([5000, 1]) == [0, 1]


def test_units_merge_ruby_and_skip(spark):
    html = "<html><body><p>a <b>b</b><ruby>c<rt>x</rt></ruby></p><script>let s = 1</script><p>1 2</p><pre>z<i>y</i></pre><p>d<br/>e</p></body></html>"
    df = spark.createDataFrame([(1, html)], "id long, html string")
    toks = xhtml.tokens(df, "id", fx.strip_ruby(F.col("html")))
    assert [r["text"] for r in xhtml.units(toks, "id").orderBy("unit").collect()] == ["a bc", "d", "e"]
    out = xhtml.units(toks, "id").withColumn("out", F.concat(F.lit("<"), "text"))
    assert xhtml.splice(toks, out, "id").first()["html"].startswith("<html><body><p>&lt;a bc <b></b><ruby></ruby></p><script>let s = 1</script><p>1 2</p>")


def test_quality_table(spark):
    rows = [("你好，世界", True, True), ("", False, False), ("I cannot do this", False, False), ("こんにちは", False, False), ("汉字汉字汉字汉字汉字か", True, True), ("汉字かなかな", True, False), (None, False, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "v string")
    got = df.select(fx.usable(F.col("v"), "zh").alias("u"), fx.trustworthy(F.col("v"), "zh").alias("t")).collect()
    assert [(r["u"], r["t"]) for r in got] == [(u, t) for _, u, t in rows]


def test_echo(spark):
    ja = "これはとても長い文章です"
    df = spark.createDataFrame([(ja, ja + "。"), (ja, "这是一个很长的句子"), ("短い", "短い"), (ja, ja[:-1] + "だ"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(is_echo(F.col("a"), F.col("b"))).collect()] == [True, False, False, True, False]


def test_markdown():
    assert markdown.to_html("") == "<p></p>"
    assert markdown.to_html("# a\n**b** c") == "<h1>a</h1>\n<p><strong>b</strong> c</p>"
    assert markdown.to_html("1. x\n2. y", 1) == "<ul><li>x</li><li>y</li></ul>"
    assert markdown.to_html("```\na<b\n```\n```\nc\n```") == "<pre>a&lt;b</pre>\n<pre>c</pre>"
    assert markdown.to_html("|a|b|\n|--|--|\n|1|2|") == "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"
    assert markdown.to_plain("> it's *so*") == "it's so"


def test_decode_and_animation():
    assert files.decode("﻿é".encode()) == "é"
    assert files.decode("汉字".encode("gb18030")) == "汉字"
    frame = b"\x2c" + bytes(8) + b"\x00" + b"\x02\x01\x00\x00"
    head = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0])
    assert files.animated(head + frame + frame + b"\x3b") and not files.animated(head + frame + b"\x3b")
    assert files.animated(b"\x89PNG\r\n\x1a\n....acTL") and not files.animated(b"junk") and not files.animated(b"GIF89a")
    assert files.animated(b"RIFF\x00\x00\x00\x00WEBPVP8X\x00\x00\x00\x00\x02")


def test_epub_round_trip(spark):
    rows = [("b", 0, "a.xhtml", b"<p>x</p>"), ("b", 1, "mimetype", b"application/epub+zip"), ("b", 2, "img/p.png", b"\x89PNG")]
    made = sinks.packages(spark.createDataFrame(rows, "book string, ord int, name string, data binary")).first()
    with zipfile.ZipFile(io.BytesIO(made["content"])) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    back = files.epub_entries(spark.createDataFrame([("b", bytes(made["content"]))], "path string, content binary"))
    assert {(r["name"], bytes(r["data"])) for r in back.collect()} == {(r[2], r[3]) for r in rows}
    assert files.join_href("OEBPS", "t/../c.xhtml#x") == "OEBPS/c.xhtml"


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i % 7, i) for i in range(50)], "k long, v long").coalesce(1).write.json(src)
    for _ in range(2):  # the second run finds nothing new
        checkpoints.run_available(checkpoints.first_results(spark, src, "k long, v long", "k"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["k"] for r in got.collect()) == list(range(7))


def test_plain_text_knows_all_entities(spark):
    rows = ["<p>caf&eacute;&#8217;s &hellip; &#x41;&amp;lt; &copy2020</p>", "<p>a &amp;amp; b&nbsp;&middot;</p>", "<SCRIPT>x</script><p>1 & 2 &amp x</p>", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, html string")
    got = [r["t"] for r in df.orderBy("id").select(fx.plain_text(F.col("html")).alias("t")).collect()]
    assert got == ["café’s … A&lt; ©2020", "a &amp; b ·", "1 & 2 & x", None]


def test_splice_escapes_content_alone_and_keeps_text_for_answers_without_letters(spark):
    df = spark.createDataFrame([(1, '<p>say <b>so</b> </p><p> one <i>two</i></p><p>three</p>')], "id long, html string")
    toks = xhtml.tokens(df, "id", F.col("html"))
    units = xhtml.units(toks, "id")
    out = units.withColumn("out", F.when(F.col("unit") == 0, "say \"hi\" it's <1> & ").when(F.col("unit") == 1, "…")).where("unit < 2")
    assert xhtml.splice(toks, out, "id").first()["html"] == "<p>say \"hi\" it's &lt;1&gt; &amp; <b></b> </p><p> one <i></i></p><p>three</p>"


def test_package_names(spark):
    assert files.join_href("", "a/../b.xhtml#x") == "a/../b.xhtml" and files.join_href("O", "a/../b.xhtml") == "O/b.xhtml"
    rows = [('<rootfile full-path="x.opf"/>', ["a.opf"]), ("<r/>", ["a.xhtml", "B.OPF", "c.opf"]), (None, ["a.opf.txt"]), (None, [])]
    df = spark.createDataFrame(rows, "c string, n array<string>")
    assert [r[0] for r in df.select(files.opf_path(F.col("c"), F.col("n"))).collect()] == ["x.opf", "B.OPF", "", ""]


def test_pages_of_rendered_texts(spark):
    from leafmill.functions import render

    df = spark.createDataFrame([("o", "t"), ("", "t"), ("o", ""), ("", None), (" ", "t")], "o string, t string")
    page = lambda *how: [r[0] for r in df.select(render.page(F.col("o"), F.col("o"), F.col("t"), *how)).collect()]
    sep, none = "— 译文 —", "(本页无可用内容)"
    assert page(True, True, False) == [f"o\n\n{sep}\n\nt", "t", "o", none, f"{sep}\n\nt"]
    assert page(True, False, False) == ["t", "t", none, none, "t"]
    assert page(False, False, True) == ["o", f"<p><i>{none}</i></p>", "o", f"<p><i>{none}</i></p>", f"<p><i>{none}</i></p>"]


def test_pictures(spark):
    from leafmill.functions import prompts

    rows = [("a.png", "image", b"\x89PNG\r\n\x1a\nIDAT"), ("b.png", "image", b"\x89PNG\r\n\x1a\nacTL"), ("c.pdf", "pdf", b"%PDF-2"), ("d.pdf", "pdf", b"%PDF-x"), ("e.txt", "txt", b"t")]
    df = spark.createDataFrame([(p, k, bytearray(c)) for p, k, c in rows], "path string, kind string, content binary")
    got = sorted((r["path"], r["page_no"] or 0, r["error"] or "") for r in files.images(df, "pages", lambda data, mode: [mode.encode()] * int(data[5:])).collect())
    assert [g[:2] for g in got] == [("a.png", 1), ("b.png", 0), ("c.pdf", 1), ("c.pdf", 2), ("d.pdf", 0)] and got[1][2] == "animated" and "ValueError" in got[4][2]
    assert files.images(df).where("path = 'c.pdf'").first()["error"] == "ValueError: no renderer"
    asked = df.select(*[prompts.vision_prompt(t, o, F.lit("法语"), F.lit(n)).alias(f"c{i}") for i, (t, o, n) in enumerate([(False, False, 0), (True, False, 3), (True, True, 0)])]).first()
    assert all("[[FIG:n]]" in p and "<<<FIGURES>>>" in p for p in asked) and "caption_t" not in asked[0] and "caption_t" in asked[1]
    assert "法语" in asked[1] and "【译文】" in asked[2] and spark.createDataFrame([tuple(asked)], "a string, b string, c string").select(prompts.candidate_count(F.col("a")), prompts.candidate_count(F.col("b"))).first()[:] == (0, 3)


def test_uploads(spark, tmp_path):
    from urllib.parse import quote

    from leafmill.functions import uploads
    from leafmill.sources import tables

    body = b'--x\r\nContent-Disposition: form-data; name="title"\r\n\r\n\xe4\xb9\xa6\r\n--x\r\nContent-Disposition: form-data; name="file"; filename="a.txt"\r\nContent-Type: text/plain\r\n\r\nline\x00\r\n--x\r\nContent-Disposition: form-data\r\n\r\nnone\r\n--x--\r\n'
    df = spark.createDataFrame([(1, "multipart/form-data; boundary=x", bytearray(body)), (2, "text/plain", bytearray(b"x")), (3, None, None)], "id long, content_type string, body binary")
    got = sorted((r["id"], r["field"], r["file"], r["value"], r["data"] and bytes(r["data"])) for r in files.forms(df).collect())
    assert got == [(1, "file", "a.txt", None, b"line\x00"), (1, "title", None, "书", None)]
    names = ["汉 a~*/+b.zip", "plain.zip", "é"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(uploads.content_disposition(F.col("n"))).collect()
    assert [r[0].split("''")[1] for r in rows] == [quote(n) for n in names]
    (tmp_path / "file").write_text("x")
    out = f"file://{tmp_path}"
    assert tables.first_writable(spark, [f"{out}/file/below", f"{out}/FILE/below", f"{out}/made"]) == (f"{out}/made", True)
    assert tables.first_writable(spark, [f"{out}/made"]) == (f"{out}/made", False)
    zips = sinks.archives(spark.createDataFrame([(1, "b", bytearray(b"2")), (1, "a", bytearray(b"1"))], "book long, name string, data binary")).first()
    assert zipfile.ZipFile(io.BytesIO(zips["content"])).namelist() == ["a", "b"]
