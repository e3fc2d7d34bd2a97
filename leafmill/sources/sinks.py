"""Outputs: texts, EPUB packages, JSON lines."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import render
from ..functions.text import xml_escape
from ..operators.chunking import chapters


def ordered_text(parts: DataFrame, by: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """K1, K2: a text per `by`: its parts in order. A book's parts meet in one row, as its file does."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), separator)
    return parts.groupBy(by).agg(joined.alias("text"))


def header(title: Column, *metas: tuple[str, Column]) -> Column:
    """a title, a rule of equal signs as long (4 at least), and the metas that aren't empty."""
    lines = [title, F.repeat(F.lit("="), F.greatest(F.length(title), F.lit(4)).cast("int"))]
    lines += [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v)) for name, v in metas]
    return F.concat_ws("\n", *lines)


def overlay(entries: DataFrame, replaced: DataFrame) -> DataFrame:
    """Entries (book, name, data) with replaced bytes where there are some."""
    return entries.join(replaced.select("book", "name", F.col("data").alias("_new")), ["book", "name"], "left").withColumn("data", F.coalesce("_new", "data")).drop("_new")


def package(rows: list[tuple[str, bytes]]) -> bytes:
    """K3, K4: a package of (name, data), the media type first and stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), b"application/epub+zip", zipfile.ZIP_STORED)
        for name, data in rows:
            if name != "mimetype":
                info = zipfile.ZipInfo(name)
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, data)
    return out.getvalue()


def archives(entries: DataFrame) -> DataFrame:
    """(book, content): a plain zip per book of its entries (book, name, data), sorted by name."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(zip(frame["name"], frame["data"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"book": [frame["book"].iloc[0]], "content": [out.getvalue()]})

    kind = entries.schema["book"].dataType.simpleString()
    return entries.select("book", "name", "data").groupBy("book").applyInPandas(run, f"book {kind}, content binary")


def packages(entries: DataFrame) -> DataFrame:
    """(book, content): a package per book, made where the book's entries meet."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ord", "name"])
        return pd.DataFrame({"book": [frame["book"].iloc[0]], "content": [package(list(zip(frame["name"], frame["data"], strict=True)))]})

    kind = entries.schema["book"].dataType.simpleString()
    return entries.select("book", "ord", "name", "data").groupBy("book").applyInPandas(run, f"book {kind}, content binary")


#: Where a book's files are, and how they look.
CONTAINER = '<?xml version="1.0" encoding="utf-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
CSS = """body { line-height: 1.7; margin: 5%; }
p { margin: 0.6em 0; text-align: justify; }
blockquote { border-left: 3px solid #bbb; padding-left: 1em; }
table { border-collapse: collapse; margin: 1em auto; }
th, td { border: 1px solid #999; padding: 0.3em 0.6em; }
pre { white-space: pre-wrap; }
.tr-sep { border-bottom: 1px dotted #ccc; font-style: italic; }
figure.fig { text-align: center; page-break-inside: avoid; }
figure.fig img { max-width: 100%; }
.fig-cap { display: block; font-style: italic; }
p.fig-note { font-size: 0.9em; }
"""


def book_entries(pages: DataFrame, books: DataFrame, assets: DataFrame | None = None, per_chapter: int = 8) -> DataFrame:
    """K3: the files (book, ord, name, data) of an EPUB 3 package per book: container, package file, navigation, NCX, style, chapters of
    per_chapter pages, assets. sinks.packages makes packages of them.

    pages: (book, page_no, html); books: (book, title, lang, source, modified); assets: (book, id, href, media_type, data). What a package
    lists is gathered by names alone; chapters and assets keep their rows."""
    about = books.select("book", "title", "lang", "source", "modified")
    numbered = chapters(pages, "book", "page_no", per_chapter)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "html"))), lambda x: x["html"]), "\n")
    made = numbered.groupBy("book", "chapter").agg(body.alias("body"))
    n = (F.col("chapter") + 1).cast("int")
    made = made.join(about, "book").select("book", n.alias("n"), F.format_string("chap%04d.xhtml", n).alias("href"), render.xhtml_page(F.col("title"), F.col("body"), F.col("lang")).alias("text"))
    esc = xml_escape
    listed = made.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("n", "href"))).alias("chapters"))
    if assets is not None:
        own = assets.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("id", "href", "media_type"))).alias("assets"))
        listed = listed.join(own, "book", "left")
    else:
        listed = listed.withColumn("assets", F.expr("cast(null as array<struct<id:string,href:string,media_type:string>>)"))
    listed = about.join(listed, "book", "left")
    chaps = F.coalesce("chapters", F.expr("cast(array() as array<struct<n:int,href:string>>)"))
    each = lambda f, sep: F.array_join(F.transform(chaps, f), sep)
    num = lambda x: x["n"].cast("string")
    item = lambda i, href, kind, more="": F.concat(F.lit('<item id="'), i, F.lit('" href="'), href, F.lit('" media-type="'), kind, F.lit(f'"{more}/>'))
    lit = F.lit
    manifest = F.concat_ws(
        "\n    ",
        item(lit("ncx"), lit("toc.ncx"), lit("application/x-dtbncx+xml")), item(lit("nav"), lit("nav.xhtml"), lit("application/xhtml+xml"), ' properties="nav"'), item(lit("css"), lit("style.css"), lit("text/css")),
        F.nullif(each(lambda x: item(F.concat(lit("chapter-"), num(x)), x["href"], lit("application/xhtml+xml")), "\n    "), lit("")),
        F.nullif(F.array_join(F.transform(F.coalesce("assets", F.expr("cast(array() as array<struct<id:string,href:string,media_type:string>>)")), lambda a: item(esc(a["id"]), esc(a["href"]), esc(F.coalesce(a["media_type"], lit("image/png"))))), "\n    "), lit("")),
    )
    uid = F.concat(lit("urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", F.col("book").cast("string"), "title")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    head = '<?xml version="1.0" encoding="utf-8"?>\n'
    opf = F.concat(
        lit(f'{head}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid">\n  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n    <dc:identifier id="uid">'), uid,
        lit("</dc:identifier>\n    <dc:title>"), esc(F.col("title")), lit("</dc:title>\n    <dc:language>"), esc(F.col("lang")), lit('</dc:language>\n    <dc:creator>leafmill</dc:creator>\n    <meta property="dcterms:modified">'), F.col("modified"),
        lit('</meta>\n    <meta name="source-document" content="'), esc(F.coalesce("source", lit(""))), lit('"/>\n  </metadata>\n  <manifest>\n    '), manifest, lit('\n  </manifest>\n  <spine toc="ncx">\n    '),
        each(lambda x: F.concat(lit('<itemref idref="chapter-'), num(x), lit('"/>')), "\n    "), lit("\n  </spine>\n</package>"),
    )
    points = each(lambda x: F.concat(lit('<li><a href="'), x["href"], lit('">'), num(x), lit("</a></li>")), "")
    nav = render.xhtml_page(lit("目录"), F.concat(lit('<nav epub:type="toc"><ol>'), points, lit("</ol></nav>")), F.col("lang"))
    marks = each(lambda x: F.concat(lit('<navPoint id="np'), num(x), lit('" playOrder="'), num(x), lit('"><navLabel><text>'), num(x), lit('</text></navLabel><content src="'), x["href"], lit('"/></navPoint>')), "")
    ncx = F.concat(lit(f'{head}<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n  <head><meta name="dtb:uid" content="'), uid, lit('"/></head>\n  <docTitle><text>'), esc(F.col("title")), lit("</text></docTitle>\n  <navMap>"), marks, lit("</navMap>\n</ncx>"))
    first = [("META-INF/container.xml", lit(CONTAINER)), ("OEBPS/content.opf", opf), ("OEBPS/nav.xhtml", nav), ("OEBPS/toc.ncx", ncx), ("OEBPS/style.css", lit(CSS))]
    fixed = listed.select("book", F.explode(F.array(*[F.struct(lit(i).alias("ord"), lit(name).alias("name"), F.encode(text, "UTF-8").alias("data")) for i, (name, text) in enumerate(first)])).alias("x")).select("book", "x.*")
    out = fixed.unionByName(made.select("book", (F.col("n") + 9).alias("ord"), F.concat(lit("OEBPS/"), "href").alias("name"), F.encode("text", "UTF-8").alias("data")))
    if assets is not None:
        out = out.unionByName(assets.select("book", lit(1 << 30).alias("ord"), F.concat(lit("OEBPS/"), "href").alias("name"), "data"))
    return out


def with_language(opf: Column, tag: str) -> Column:
    """the package file with its first language replaced."""
    found = F.regexp_extract(opf, "(?s)<dc:language[^>]*>[^<]*</dc:language>", 0)
    at = F.instr(opf, found) if isinstance(found, str) else F.locate("<dc:language", opf)
    new = F.regexp_replace(found, ">[^<]*<", f">{tag}<")
    return F.when(found == "", opf).otherwise(F.concat(F.substring(opf, F.lit(1), at - 1), new, F.substring(opf, at + F.length(found), F.length(opf))))


def append_json(rows: DataFrame, path: str) -> None:
    """K5: rows appended as JSON lines."""
    rows.write.mode("append").json(path)
