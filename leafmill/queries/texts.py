"""Plain texts: blocks, pieces, batches, estimates, keys, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import chunking
from ..plans import estimate
from ..sources import files, sinks
from . import query

_WS = r"[\s\x{A0}\x{3000}]"
_CLASS = "。！？!?；;…．.\\n）)】」』”\"''’、，,：:\\s"
CUTS_SQL = f"""WITH RECURSIVE c(doc_id, k, s, e, n) AS (
 SELECT doc_id, 0, 0, CASE WHEN length(text) <= 1200 THEN length(text) ELSE 600 + coalesce(nullif(length(regexp_extract(substr(text, 601, 600), '(?s)^.*[{_CLASS}]')), 0), 600) END, length(text) FROM documents
 UNION ALL
 SELECT c.doc_id, k + 1, e, CASE WHEN e + 1200 >= n THEN n ELSE e + 600 + coalesce(nullif(length(regexp_extract(substr(d.text, e + 601, 600), '(?s)^.*[{_CLASS}]')), 0), 600) END, n FROM c JOIN documents d USING (doc_id) WHERE e < n)
, pieces AS (SELECT c.doc_id, k, e - s AS size, substr(d.text, s + 1, e - s) AS text FROM c JOIN documents d USING (doc_id))
, b(doc_id, k, batch, used, items) AS (
 SELECT doc_id, 0, 0, size, 1 FROM pieces WHERE k = 0
 UNION ALL
 SELECT p.doc_id, p.k, CASE WHEN used + size > 1800 OR items >= 24 THEN batch + 1 ELSE batch END, CASE WHEN used + size > 1800 OR items >= 24 THEN size ELSE used + size END, CASE WHEN used + size > 1800 OR items >= 24 THEN 1 ELSE items + 1 END
 FROM b JOIN pieces p ON p.doc_id = b.doc_id AND p.k = b.k + 1)
"""


@query(CUTS_SQL + "SELECT doc_id, k::BIGINT AS k, text FROM pieces")
def f3_split_long(read):
    p = read("documents").select("doc_id", F.posexplode(chunking.split_long(F.col("text"))).alias("k", "text"))
    return p.select("doc_id", F.col("k").cast("long").alias("k"), "text")


@query(CUTS_SQL + "SELECT doc_id, k::BIGINT AS k, batch::BIGINT AS batch FROM b")
def w2_batches(read):
    p = chunking.pieces(read("documents"))
    return p.select("doc_id", F.col("k").cast("long").alias("k"), F.col("batch").cast("long").alias("batch"))


@query(CUTS_SQL + """, d AS (SELECT doc_id, count(*) AS pieces, max(size) AS longest, sum(size) AS chars FROM pieces GROUP BY doc_id), q AS (SELECT doc_id, max(batch) + 1 AS batches FROM b GROUP BY doc_id),
t AS (SELECT count(*)::BIGINT AS segments, sum(pieces)::BIGINT AS pieces, sum(batches)::BIGINT AS batches, sum(chars)::BIGINT AS chars, max(longest)::BIGINT AS max_piece, max(chars)::BIGINT AS max_segment FROM d JOIN q USING (doc_id)),
i AS (SELECT *, 4 * batches AS requests_worst, (chars * 9) // 10 + 500 * batches AS input_tokens, (chars * 11) // 10 AS output_tokens, 8192 * batches AS output_limit FROM t)
SELECT *, (input_tokens * 15 + output_tokens * 60) / 100.0 AS cost_low, (input_tokens * 15 + output_tokens * 60) / 50.0 AS cost_high FROM i""")
def a4_plan(read):
    """The dry run: what a translation of all documents would take."""
    return estimate.plan(chunking.pieces(read("documents")), "doc_id")


@query(f"SELECT conv_id, b.i::BIGINT AS block, b.t AS text FROM (SELECT conv_id, unnest(list_transform(generate_series(1, len(x)), lambda i: {{'i': i - 1, 't': x[i]}})) AS b FROM (SELECT conv_id, list_filter(list_transform(string_split(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), '\\r\\n?', chr(10), 'g'), chr(10) || chr(10)), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: s <> '') AS x FROM conversations GROUP BY conv_id))")
def f19_blocks(read):
    book = sinks.ordered_text(read("conversations"), "conv_id", "turn", "text")
    return book.select("conv_id", F.posexplode(fx.blocks(F.col("text"))).alias("block", "text")).withColumn("block", F.col("block").cast("long"))


_KANA_SQL = "translate(text, 'aeiou', 'あえいおう')"
_STRIP_SQL = "[\\s\\x{3000}、。，,．.！!？?…「」『』（）()\\[\\]【】〈〉《》\\-—ー~〜\"''“”‘’·]+"


@query(f"SELECT doc_id, regexp_replace({_KANA_SQL}, '{_STRIP_SQL}', '', 'g') AS text FROM documents")
def f4_normalized(read):
    return read("documents").select("doc_id", fx.normalized(F.translate("text", "aeiou", "あえいおう")).alias("text"))


@query("SELECT doc_id, md5('t5|' || lang || '|' || text) AS key FROM documents")
def f5_text_key(read):
    return read("documents").select("doc_id", fx.text_key(F.col("lang"), F.col("text")).alias("key"))


@query("SELECT DISTINCT source, lang, substr(sha1('v3-figures|txt|pages|150|' || lang || '|False|True|vision|' || source), 1, 12) AS key FROM documents")
def f6_job_key(read):
    fields = [*map(F.lit, ("v3-figures", "txt", "pages", "150")), F.col("lang"), *map(F.lit, ("False", "True", "vision")), F.col("source")]
    return read("documents").select("source", "lang").distinct().withColumn("key", fx.job_key(fields))


@query("SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(text)) AS url, md5(text) AS digest FROM documents")
def f8_data_url(read):
    return read("documents").select("doc_id", fx.data_url(F.lit("image/png"), F.encode("text", "UTF-8")).alias("url"), F.md5("text").alias("digest"))


@query("""SELECT i AS id, CASE WHEN starts_with(h, '255044462D') THEN 'pdf' WHEN starts_with(h, '504B0304') OR e = 'epub' THEN 'epub' WHEN e IN ('pdf','png','jpg','jpeg','webp','bmp','tif','tiff','gif','jp2','j2k','pnm','pgm','ppm') THEN 'image' WHEN e = 'txt' THEN 'txt' END AS kind
FROM (SELECT event_id AS i, CASE event_id % 4 WHEN 0 THEN '255044462D' WHEN 1 THEN '504B030414' ELSE '0000000000' END AS h, CASE event_id % 7 WHEN 0 THEN 'epub' WHEN 1 THEN 'png' WHEN 2 THEN 'txt' WHEN 3 THEN 'gif' WHEN 4 THEN 'pdf' ELSE 'doc' END AS e FROM events)""")
def s1_kind(read):
    k, m = F.col("event_id") % 4, F.col("event_id") % 7
    head = F.when(k == 0, "255044462D").when(k == 1, "504B030414").otherwise("0000000000")
    ext = F.when(m == 0, "EPUB").when(m == 1, "png").when(m == 2, "txt").when(m == 3, "Gif").when(m == 4, "pdf").otherwise("doc")
    return read("events").select(F.col("event_id").alias("id"), fx.kind(head, F.concat(F.lit("a/b.c/name."), ext)).alias("kind"))


@query("SELECT event_id, (props->>'$.k') AS k, value FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS ok, json_object('k', event_type) AS props, value FROM events) WHERE ok IS NOT NULL")
def s8_json_lines(read):
    """Lines that are blank, broken or no object are left out."""
    k = F.col("event_id") % 15
    good = F.to_json(F.struct("event_id", F.col("event_type").alias("k"), "value"))
    line = F.when(k == 0, "").when(k == 5, '{"k": ').when(k == 10, "[1]").otherwise(good)
    return files.json_lines(read("events").select(line.alias("value")), "event_id long, k string, value double")


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' ELSE 'zh-CN' END AS tag FROM documents""")
def f31_language_tag(read):
    name = F.when(F.col("lang") == "en", "English (UK)").when(F.col("lang") == "fr", "FR").when(F.col("lang") == "de", "low German").otherwise("日本語")
    return read("documents").select("doc_id", fx.language_tag(name).alias("tag"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id ELSE source END AS title FROM documents")
def f32_title(read):
    explicit = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("T"), "doc_id")).otherwise("")
    return read("documents").select("doc_id", F.coalesce(F.nullif(explicit, F.lit("")), F.nullif("source", F.lit("")), F.lit("book")).alias("title"))


@query("SELECT source, source || chr(10) || repeat('=', greatest(length(source), 4)) || chr(10) || 'language: ' || min(lang) || chr(10) || 'texts: ' || count(*) AS head FROM documents GROUP BY source")
def f29_header(read):
    g = read("documents").groupBy("source").agg(F.min("lang").alias("lang"), F.count("*").cast("string").alias("n"))
    return g.select("source", sinks.header(F.col("source"), ("language", F.col("lang")), ("note", F.lit("")), ("texts", F.col("n"))).alias("head"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def k1_ordered_text(read):
    return sinks.ordered_text(read("conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3)::BIGINT AS chapter FROM conversations")
def w3_chapters(read):
    return chunking.chapters(read("conversations"), "conv_id", "turn", 3).select("conv_id", "turn", F.col("chapter").cast("long").alias("chapter"))


_MD = "'**' || lang || '** see `' || source || '` and *n' || doc_id || '* at [here](https://x.org/' || doc_id || ') __end__'"


@query("SELECT doc_id, '<strong>' || lang || '</strong> see <code>' || source || '</code> and <em>n' || doc_id || '</em> at <a href=\"https://x.org/' || doc_id || '\">here</a> <strong>end</strong>' AS html FROM documents")
def f22_inline_markdown(read):
    made = F.concat(F.lit("**"), "lang", F.lit("** see `"), "source", F.lit("` and *n"), "doc_id", F.lit("* at [here](https://x.org/"), "doc_id", F.lit(") __end__"))
    return read("documents").select("doc_id", fx.inline_markdown(made).alias("html"))


def _markdown():
    return F.concat(F.lit("## T "), "doc_id", F.lit("\n\n- "), "lang", F.lit("\n- b\n\n> q\n> r\n\n| a | b |\n|---|---|\n| "), "source", F.lit(" | 2 |\n\n---\n```\nx < y\n```\nend of\n"), "source")


@query("""SELECT doc_id, '<h4>T ' || doc_id || '</h4>' || chr(10) || '<ul><li>' || lang || '</li><li>b</li></ul>' || chr(10) || '<blockquote><p>q r</p></blockquote>' || chr(10) || '<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>' || source || '</td><td>2</td></tr></tbody></table>' || chr(10) || '<hr/>' || chr(10) || '<pre>x &lt; y</pre>' || chr(10) || '<p>end of ' || source || '</p>' AS html FROM documents""")
def f24_markdown_html(read):
    from ..functions.markdown import markdown_to_html

    return read("documents").select("doc_id", markdown_to_html(_markdown(), F.lit(2)).alias("html"))




@query("SELECT doc_id, '<p>a</p><dc:language id=\"x\">' || 'zh-CN' || '</dc:language><dc:language>' || lang || '</dc:language>' AS opf FROM documents")
def f33_set_language(read):
    opf = F.concat(F.lit('<p>a</p><dc:language id="x">'), "lang", F.lit("</dc:language><dc:language>"), "lang", F.lit("</dc:language>"))
    return read("documents").select("doc_id", sinks.with_language(opf, "zh-CN").alias("opf"))


@query("SELECT event_id, least(pow(2, event_id % 9), 30)::BIGINT AS seconds FROM events")
def f40_backoff(read):
    return read("events").select("event_id", fx.backoff(F.col("event_id") % 9).alias("seconds"))


