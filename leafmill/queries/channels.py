"""The text channel end to end, pages and figures rendered, packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render
from ..functions import text as fx
from ..operators import chunking, guards, xhtml
from ..plans import translate
from ..operators.cache import first_k
from ..sources import books, files, sinks, tables
from . import query
from .caches import _MARKS
from .guards import _LOG, _log
from .texts import CUTS_SQL

_DONE = "CASE WHEN n = 1 THEN o ELSE regexp_replace(o, '^\\n+|\\n+$', '', 'g') END"
#: The offline model's answers, of which those with a refusal's mark leave the source; its texts have no kana, so none is a copy of its source.
_WHOLE = f"""w AS (SELECT doc_id, string_agg({_DONE}, chr(10) ORDER BY k) AS out, bool_and(ok) AS ok FROM (
 SELECT doc_id, k, NOT refused AS ok, CASE WHEN refused THEN text ELSE '【译】' || text END AS o, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT *, regexp_matches(lower(text), '{_MARKS}') AS refused FROM pieces)) GROUP BY doc_id)"""


@query(CUTS_SQL + f""", known AS (SELECT DISTINCT text, '译' || length(text) AS t FROM documents WHERE doc_id % 4 = 0),
{_WHOLE}
SELECT d.doc_id AS seg_id, coalesce(known.t, w.out) AS out, CASE WHEN known.t IS NULL THEN 'miss' ELSE 'hit' END AS state, known.t IS NOT NULL OR w.ok AS ok FROM documents d JOIN w USING (doc_id) LEFT JOIN known ON known.text = d.text""")
def l1_translate_texts(read):
    docs = read("documents").select(F.col("doc_id").alias("seg_id"), "text")
    known = docs.where("seg_id % 4 = 0").select(fx.text_key(F.lit("zh"), F.col("text")).alias("k"), F.concat(F.lit("译"), F.length("text")).alias("t")).distinct()
    return translate.translate(docs, known, "zh").select("seg_id", "out", "state", "ok")


@query("""WITH RECURSIVE s AS (SELECT conv_id // 5 AS doc, length(text) AS size, row_number() OVER (PARTITION BY conv_id // 5 ORDER BY conv_id, turn) AS n FROM conversations),
b(doc, n, batch, used, items) AS (SELECT doc, n, 0, size, 1 FROM s WHERE n = 1 UNION ALL
 SELECT s.doc, s.n, CASE WHEN used + size > 1800 OR items >= 24 THEN batch + 1 ELSE batch END, CASE WHEN used + size > 1800 OR items >= 24 THEN size ELSE used + size END, CASE WHEN used + size > 1800 OR items >= 24 THEN 1 ELSE items + 1 END FROM b JOIN s ON s.doc = b.doc AND s.n = b.n + 1)
SELECT doc, batch::BIGINT AS batch, count(*)::BIGINT AS items, max(used)::BIGINT AS chars FROM b GROUP BY doc, batch""")
def g8_shared_requests(read):
    """Requests that carry texts of several segments of a document, each text whole."""
    from pyspark.sql.window import Window

    c = read("conversations").select(F.expr("conv_id div 5").alias("doc"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seg_id"), F.lit(0).alias("k"), "text")
    made = chunking.batched(c, ["doc", "seg_id"])
    made = made.select(F.expr("(items[0].seg_id div 1000) div 5").alias("doc"), "nth", "part", F.size("items").cast("long").alias("items"), F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x["text"])).cast("long").alias("chars"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("part", "nth"))
    return made.select("doc", (place - 1).cast("long").alias("batch"), "items", "chars")


@query(CUTS_SQL + f", {_WHOLE} SELECT DISTINCT md5('t5|zh|' || d.text) AS k, 1 AS v FROM documents d JOIN w USING (doc_id) WHERE w.ok AND NOT regexp_matches(lower(w.out), '{_MARKS}') AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 4 = 0 AND e.text = d.text)")
def c9_new_cache_lines(read):
    """A line for every text that the offline model was asked for and whose answers hold no refusal's mark."""
    docs = read("documents").select(F.col("doc_id").alias("seg_id"), "text")
    known = docs.where("seg_id % 4 = 0").select(fx.text_key(F.lit("zh"), F.col("text")).alias("k"), F.lit("译文").alias("t")).distinct()
    return translate.new_cache_lines(translate.translate(docs, known, "zh"), "zh").select("k", "v")


@query(f"""WITH {_LOG}, i AS (SELECT *, sum((tokens < 700)::INT) OVER (PARTITION BY job ORDER BY seq) AS isl FROM log), s AS (SELECT *, sum((tokens >= 700)::INT) OVER (PARTITION BY job, isl ORDER BY seq) AS run FROM i)
SELECT job, max(run)::BIGINT AS longest, coalesce(max(run) >= 3, false) AS aborts FROM s GROUP BY job""")
def w9_transport_failures(read):
    runs = guards.run_length(_log(read), "job", "seq", F.col("tokens") < 700, "run")
    return runs.groupBy("job").agg(F.max("run").cast("long").alias("longest"), (F.max("run") >= 3).alias("aborts"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || '〔' || lang || '〕' WHEN doc_id % 3 = 1 THEN lang ELSE source END AS plain FROM documents")
def f26_figure_plain(read):
    body = F.when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("source"))
    caption = F.when(F.col("doc_id") % 3 == 2, F.col("source")).otherwise(F.col("lang"))
    return read("documents").select("doc_id", render.figure_plain(body, caption).alias("plain"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<figure class="fig"><img src="f/' || doc_id || '.png" alt=""/><figcaption>' || source || '<br/>&lt;x&gt; <span class="fig-cap">' || lang || '</span></figcaption></figure>' WHEN 1 THEN '<p class="fig-note"><figcaption>' || source || '<br/>&lt;x&gt; <span class="fig-cap">' || lang || '</span></figcaption></p>' ELSE '' END AS html FROM documents""")
def f26_figure_html(read):
    k = F.col("doc_id") % 3
    body = F.when(k == 2, "").otherwise(F.concat("source", F.lit("\n<x>")))
    href = F.when(k == 0, F.concat(F.lit("f/"), "doc_id", F.lit(".png"))).otherwise("")
    return read("documents").select("doc_id", render.figure_html(body, F.when(k == 2, "").otherwise(F.col("lang")), href).alias("html"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || chr(10) || chr(10) || '— 译文 —' || chr(10) || chr(10) || lang WHEN doc_id % 3 = 1 THEN lang ELSE source END AS text FROM documents")
def f28_page_plain(read):
    k = F.col("doc_id") % 3
    blocks = F.filter(F.array(F.struct(F.lit("原文").alias("label"), F.when(k == 1, "").otherwise(F.col("source")).alias("text")), F.struct(F.lit("译文").alias("label"), F.when(k == 2, "").otherwise(F.col("lang")).alias("text"))), lambda b: b["text"] != "")
    return read("documents").select("doc_id", render.page_plain(render.block(blocks, "原文"), render.block(blocks, "译文"), True).alias("text"))


@query("SELECT a.l_orderkey AS page_no, sum(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0))::DOUBLE AS shared FROM (SELECT l_orderkey, l_partkey % 300 AS x0, l_partkey % 300 + 50 AS x1 FROM lineitem) a JOIN (SELECT o_orderkey, o_custkey % 300 AS x0, o_custkey % 300 + 80 AS x1 FROM orders) b ON a.l_orderkey = b.o_orderkey GROUP BY 1")
def f10_overlap(read):
    from ..functions import geometry

    unit = lambda p: {f"{p}y0": F.lit(0.0), f"{p}y1": F.lit(1.0)}
    a = read("lineitem").select(F.col("l_orderkey").alias("page_no"), (F.col("l_partkey") % 300).cast("double").alias("a_x0"), (F.col("l_partkey") % 300 + 50).cast("double").alias("a_x1")).withColumns(unit("a_"))
    b = read("orders").select(F.col("o_orderkey").alias("page_no"), (F.col("o_custkey") % 300).cast("double").alias("b_x0"), (F.col("o_custkey") % 300 + 80).cast("double").alias("b_x1")).withColumns(unit("b_"))
    return a.join(b, "page_no").groupBy("page_no").agg(F.sum(geometry.overlap("a_", "b_")).alias("shared"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'OEBPS/c' || page_id || '.opf' WHEN 1 THEN 'b' || page_id || '.OPF' WHEN 2 THEN 'b' || page_id || '.OPF' ELSE '' END AS opf FROM pages")
def f35_find_opf(read):
    """Named by the container; else, where that names none or is absent, the first of the package's names; else none."""
    k = F.col("page_id") % 4
    container = F.when(k == 0, F.concat(F.lit('<rootfile full-path="OEBPS/c'), "page_id", F.lit('.opf"/>'))).when(k == 1, "<rootfiles/>")
    names = F.when(k != 3, F.array(F.lit("a.xhtml"), F.concat(F.lit("b"), "page_id", F.lit(".OPF")), F.lit("z.opf"))).otherwise(F.array(F.lit("a.opf.xhtml")))
    return read("pages").select("page_id", files.opf_path(container, names).alias("opf"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'OEBPS/text/c' || page_id || '.xhtml' WHEN 1 THEN 'x/../text/./c' || page_id || '.xhtml' WHEN 2 THEN 'text/c' || page_id || '.xhtml' ELSE 'c' || page_id || '.xhtml' END AS name FROM pages")
def f34_normal_href(read):
    """Below a folder; in the package's own, where nothing is normalised; out of a folder; beyond the package."""
    k = F.col("page_id") % 4
    base = F.when(k == 0, "OEBPS").when(k == 1, "").when(k == 2, "OEBPS/a").otherwise("OEBPS")
    start = F.when(k < 2, "x/../text/./c").when(k == 2, "../../text/c").otherwise("../../c")
    return read("pages").select("page_id", files.joined_href(base, F.concat(start, "page_id", F.lit(".xhtml#n"))).alias("name"))


@query("SELECT source, string_agg('[' || doc_id || '] ' || left(text, 300), chr(10) ORDER BY doc_id) AS report FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 500) GROUP BY source")
def k7_failed_units(read):
    """With the 300 characters of a source, and the first 500 rows, that a report keeps."""
    kept = first_k(read("documents").select("source", "doc_id", "text"), ["source"], ["doc_id"], 500)
    rows = kept.select("source", "doc_id", F.concat(F.lit("["), "doc_id", F.lit("] "), F.left("text", F.lit(300))).alias("line"))
    return sinks.ordered_text(rows, "source", "doc_id", "line", "\n").withColumnRenamed("text", "report")


@query("SELECT conv_id AS book, count(*)::BIGINT + 1 AS files FROM conversations GROUP BY conv_id")
def k3_packages(read):
    """A package file per conversation, written and read back."""
    rows = read("conversations").select(F.col("conv_id").alias("book"), F.col("turn").cast("int").alias("ord"), F.format_string("c%04d.xhtml", "turn").alias("name"), F.encode(F.concat(F.lit("<p>"), "text", F.lit("</p>")), "UTF-8").alias("data"))
    folder = tables.new_path(rows.sparkSession, "packages")
    books.write_books(rows, folder)
    made = books.read_epubs(rows.sparkSession, folder, payload=False)
    return made.groupBy(F.regexp_extract("path", "(\\d+)\\.epub$", 1).cast("long").alias("book")).agg(F.count("*").alias("files"))


@query("""WITH p AS (SELECT page_id // 8 AS book, page_id, length(html) AS chars FROM pages)
SELECT book, 'OEBPS/p' || page_id || '.xhtml' AS name, row_number() OVER (PARTITION BY book ORDER BY CASE WHEN page_id % 3 <> 0 THEN -page_id ELSE 1073741824 END, page_id)::BIGINT AS place, chars::BIGINT AS chars FROM p""")
def s6_epub_documents(read):
    """Packages of eight pages each, written as files; of what they hold, documents alone are read, and put in the order of their spines."""
    from pyspark.sql.window import Window

    p = read("pages").select(F.expr("page_id div 8").alias("book"), "page_id", "html")
    name = F.concat(F.lit("p"), "page_id", F.lit(".xhtml"))
    item = F.concat(F.lit('<item id="i'), "page_id", F.lit('" href="'), name, F.lit('#top" media-type="application/xhtml+xml"/>'))
    ref = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('<itemref idref="i'), "page_id", F.lit('"/>')))
    in_order = lambda x, falling: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", x.alias("x"))), not falling), lambda y: y["x"]), "")
    opf = F.concat(F.lit("<package><manifest>"), in_order(item, False), F.lit("</manifest><spine>"), in_order(F.coalesce(ref, F.lit("")), True), F.lit("</spine></package>"))
    listed = p.groupBy("book").agg(opf.alias("opf"))
    fixed = listed.select("book", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("META-INF/container.xml").alias("name"), F.encode(F.lit('<rootfile full-path="OEBPS/c.opf"/>'), "UTF-8").alias("data")), F.struct(F.lit(1).alias("ord"), F.lit("OEBPS/c.opf").alias("name"), F.encode("opf", "UTF-8").alias("data")))).alias("x")).select("book", "x.*")
    pages = p.select("book", (F.col("page_id") % 8 + 2).cast("int").alias("ord"), F.concat(F.lit("OEBPS/"), name).alias("name"), F.encode("html", "UTF-8").alias("data"))
    spark = p.sparkSession
    folder = tables.new_path(spark, "packages")
    books.write_books(fixed.unionByName(pages), folder)
    docs = books.documents(books.read_epubs(spark, folder))
    book = F.regexp_extract("book", "(\\d+)\\.epub$", 1).cast("long").alias("book")
    place = F.row_number().over(Window.partitionBy("book").orderBy("place", "ord")).cast("long").alias("place")
    return docs.select(book, "name", place, F.length(books.text_of(F.col("data"))).cast("long").alias("chars"))


@query("SELECT doc_id, text || '汉' AS text FROM documents")
def s7_decoded_text(read):
    """Texts as bytes of several encodings (UTF-8 with and without its mark, GB18030, UTF-16 of both orders), decoded by trial."""
    import pyarrow as pa

    def gb18030(text):
        parts = [pa.array([None if t is None else t.encode("gb18030") for t in part.to_pylist()], pa.binary()) for part in files.slices(text)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    k, text = F.col("doc_id") % 5, F.concat("text", F.lit("汉"))
    marked = lambda mark, name: F.concat(F.lit(mark), F.encode(text, name))
    data = (
        F.when(k == 0, F.encode(text, "UTF-8")).when(k == 1, marked(b"\xef\xbb\xbf", "UTF-8")).when(k == 2, F.arrow_udf(gb18030, "binary")(F.when(k == 2, text)))
        .when(k == 3, marked(b"\xff\xfe", "UTF-16LE")).when(k == 4, marked(b"\xfe\xff", "UTF-16BE"))
    )
    return read("documents").select("doc_id", files.decoded(data).alias("text"))


@query("SELECT event_id, event_id % 8 IN (0, 2, 3, 6) AS animated FROM events")
def p7_animated(read):
    """PNG, WEBP and GIF, moving and still: a WEBP whose picture holds the letters ANIM is still, one with the flag or the chunk moves."""
    riff = lambda *chunks: b"RIFF\0\0\0\0WEBP" + b"".join(n + len(b).to_bytes(4, "little") + b + b"\0" * (len(b) % 2) for n, b in chunks)
    frame = b"\x2c" + b"\0" * 8 + b"\0" + b"\x02\x02\x4c\x01\0"
    gif = lambda n: b"GIF89a\x01\0\x01\0\0\0\0" + frame * n + b"\x3b"
    made = [b"\x89PNG\r\n\x1a\nacTL", b"\x89PNG\r\n\x1a\nIDAT", riff((b"VP8X", b"\x02" + b"\0" * 9)), riff((b"VP8X", b"\0" * 10), (b"ANIM", b"\0" * 6)), riff((b"VP8 ", b"xxANIMxx")), riff((b"VP8X", b"\0" * 10), (b"VP8 ", b"oddANIM")), gif(2), gif(1)]
    data = F.get(F.array(*[F.lit(bytearray(m)) for m in made]), (F.col("event_id") % 8).cast("int"))
    return read("events").select("event_id", files.is_animated(data).alias("animated"))


@query("SELECT doc_id, length(substr(text, 1, 400))::BIGINT AS chars FROM documents")
def o7_context_limit(read):
    return read("documents").select("doc_id", F.length(F.substring("text", 1, 400)).cast("long").alias("chars"))


@query()
def w1_running_context(read):
    """The text before each slot, cut to its last 400 characters, from the last opening block tag on."""
    return xhtml.contexts(xhtml.tokens(read("pages"), "page_id", F.col("html")), "page_id")


@query("SELECT l_orderkey AS page_no, count(*)::BIGINT AS figures, (sum(l_linenumber))::BIGINT AS numbers FROM lineitem GROUP BY l_orderkey")
def a12_page_counts(read):
    return read("lineitem").groupBy(F.col("l_orderkey").alias("page_no")).agg(F.count("*").alias("figures"), F.sum("l_linenumber").alias("numbers"))


@query("SELECT substr(k, 1, 3) AS job, sum(n)::BIGINT AS tokens FROM (SELECT md5(event_type) || (event_id % 50) AS k, arg_min(event_id % 13, event_id) AS n FROM events GROUP BY 1) GROUP BY 1")
def a10_cached_usage(read):
    """Usage summed over the first record of every key of a job."""
    from ..operators import cache

    rows = read("events").select(F.concat(F.md5("event_type"), F.col("event_id") % 50).alias("k"), "event_id", (F.col("event_id") % 13).alias("n"))
    return cache.first_wins(rows, ["k"], ["event_id"]).groupBy(F.substring("k", 1, 3).alias("job")).agg(F.sum("n").alias("tokens"))


