"""Page bodies, figures' texts, rendered Markdown, requests, settings and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers, markdown, prompts, render, uploads
from ..functions import text as fx
from ..operators import align
from ..sources import files, settings, sinks
from . import query
from .texts import _markdown


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN lang WHEN 3 THEN source WHEN 4 THEN '7' ELSE '' END AS out FROM documents")
def f17_single_answer(read):
    k = F.col("doc_id") % 5
    made = F.when(k == 0, F.concat(F.lit(" "), "source", F.lit("\n"))).when(k == 1, F.concat(F.lit('{"translations": [{"id": 0, "text": " '), "lang", F.lit('"}]}')))
    made = made.when(k == 2, '["x"]').when(k == 3, F.concat(F.lit('```json\n{"translations": [5, "'), "source", F.lit('"]}\n```'))).otherwise("7")
    return read("documents").select("doc_id", answers.single_answer(F.when(k == 3, F.regexp_replace(made, "```(json)?", "")).otherwise(made)).alias("out"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS refused FROM events")
def p14_json_mode(read):
    k = F.col("event_id") % 4
    message = F.when(k == 0, "Unknown field Response_Format").when(k == 1, "JSON is not Supported here").when(k == 2, "bad json")
    return read("events").select("event_id", answers.json_mode_refused(message).alias("refused"))


_BLOCKS_SQL = "CASE WHEN doc_id % 4 = 1 THEN '' ELSE source END AS o, CASE WHEN doc_id % 4 = 2 THEN '' ELSE lang END AS t, doc_id % 4 = 3 AS none"


@query(f"SELECT doc_id, CASE WHEN none THEN '' WHEN o <> '' THEN o ELSE t END AS primary_text, CASE WHEN none THEN '' WHEN t <> '' THEN t ELSE o END AS translated, CASE WHEN none THEN '' ELSE concat_ws(chr(10) || chr(10), nullif(o, ''), nullif(t, '')) END AS both_texts FROM (SELECT doc_id, {_BLOCKS_SQL} FROM documents)")
def f20_page_body(read):
    k = F.col("doc_id") % 4
    item = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    made = F.filter(F.array(item("原文", F.when(~k.isin(1, 3), F.col("source")).otherwise("")), item("译文", F.when(~k.isin(2, 3), F.col("lang")).otherwise(""))), lambda b: b["text"] != "")
    return read("documents").select("doc_id", render.page_body(made, False, False).alias("primary_text"), render.page_body(made, True, False).alias("translated"), render.page_body(made, True, True).alias("both_texts"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T' WHEN doc_id % 3 = 1 THEN source ELSE lang END AS body, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'c' END AS caption FROM (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS ct, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS lang FROM documents)")
def f21_figure_texts(read):
    k, even = F.col("doc_id") % 3, F.col("doc_id") % 2 == 0
    body, caption = render.figure_texts(F.when(k == 1, F.col("source")).otherwise(""), F.lit("c"), F.when(k == 0, "T").otherwise(""), F.when(even, F.col("lang")).otherwise(""), True)
    return read("documents").select("doc_id", body.alias("body"), caption.alias("caption"))


@query("SELECT doc_id, '<table><thead><tr><th>' || lang || '</th><th><strong>b</strong></th></tr></thead><tbody><tr><td>' || doc_id || '</td><td>&lt;x&gt;</td></tr><tr><td>--- </td></tr></tbody></table>' AS html FROM documents".replace("--- ", "---"))
def f23_table(read):
    """A table: its rule line goes, cells are trimmed, escaped and marked up; a line with one cell is a row too."""
    made = F.concat(F.lit("| "), "lang", F.lit(" | **b** |\n|---|:--|\n| "), "doc_id", F.lit(" | <x> |\n| --- |"))
    return read("documents").select("doc_id", markdown.markdown_to_html(made, F.lit(0)).alias("html"))


@query("SELECT doc_id, 'T ' || doc_id || chr(10) || chr(10) || lang || chr(10) || 'b' || chr(10) || chr(10) || 'q r' || chr(10) || chr(10) || 'ab' || chr(10) || source || '2' || chr(10) || chr(10) || 'x < y' || chr(10) || chr(10) || 'end of ' || source AS text FROM documents")
def f25_markdown_plain(read):
    return read("documents").select("doc_id", markdown.markdown_to_plain(_markdown()).alias("text"))


@query("SELECT doc_id, source || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'F' || doc_id || chr(10) || chr(10) ELSE '' END || 'b & c' || chr(10) || chr(10) || 'G' AS text FROM documents")
def f27_interleave(read):
    """Markdown and figures in turn; an unknown placeholder leaves nothing, the last of equal numbers counts."""
    text = F.concat(F.lit("**"), "source", F.lit("**[[FIG:"), (F.col("doc_id") % 3).cast("string"), F.lit("]]b & c\n[[fig 9]]"))
    item = lambda n, order, body: F.struct(F.lit(n).alias("n"), F.lit(order).alias("ord"), body.alias("body"))
    figures = read("documents").select("doc_id", F.explode(F.array(item(0, 0, F.lit("old")), item(0, 1, F.concat(F.lit("F"), "doc_id")), item(9, 2, F.lit("G")))).alias("f")).select("doc_id", "f.*")
    return align.interleave(read("documents").select("doc_id", text.alias("text")), figures, "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 100 ELSE 0 END::INTEGER AS n FROM documents")
def f37_candidate_count(read):
    hint = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("在该页检测到 "), (F.col("doc_id") % 100).cast("string"), F.lit(" 个可能是插图的区域, "))).otherwise("无")
    return read("documents").select("doc_id", prompts.candidate_count(hint).alias("n"))


@query("""SELECT conv_id, to_json({'items': list({'id': conv_id || ':' || turn, 'text': role, 'context': substr(text, 1, 400)} ORDER BY turn)})::VARCHAR AS payload FROM conversations GROUP BY conv_id""")
def f38_batch_payload(read):
    item = F.struct("turn", F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("role").alias("text"), F.col("text").alias("context"))
    return read("conversations").groupBy("conv_id").agg(prompts.payload(F.sort_array(F.collect_list(item))).alias("payload"))


@query("SELECT doc_id, (n_chars * 15 + (n_chars // 2) * 60) / 100.0 AS low, (n_chars * 15 + (n_chars // 2) * 60) / 50.0 AS high FROM documents")
def f41_cost(read):
    low = fx.cost(F.col("n_chars"), F.expr("n_chars div 2"))
    return read("documents").select("doc_id", low.alias("low"), (low * 2).alias("high"))


@query("SELECT conv_id, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM conversations WHERE trim(text, E' \\t\\n\\r') <> '' GROUP BY conv_id")
def p5_filled_blocks(read):
    """Blocks with text; a book without any is not in the result (the caller's error)."""
    return read("conversations").where(fx.strip(F.col("text")) != "").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT l_orderkey AS page_no, count(*)::BIGINT AS rects FROM lineitem WHERE l_orderkey <= 200 GROUP BY 1")
def o4_first_pages(read):
    """The first 200 pages, the operator's own limit: a filter that reaches the scan."""
    return read("lineitem").where("l_orderkey <= 200").groupBy(F.col("l_orderkey").alias("page_no")).agg(F.count("*").alias("rects"))


@query("SELECT l_orderkey AS page_no, string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS figures FROM lineitem GROUP BY 1")
def o5_figures_sorted(read):
    """A page's figures by number."""
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    made = F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), ",")
    return read("lineitem").groupBy(F.col("l_orderkey").alias("page_no")).agg(made.alias("figures"))


@query("SELECT l_orderkey AS page_no, l_returnflag = 'R' AS is_drawing, count(*)::BIGINT AS rects FROM lineitem GROUP BY 1, 2")
def u2_candidate_union(read):
    """Bitmaps and drawings, two inputs, as one."""
    pick = lambda drawing: read("lineitem").where((F.col("l_returnflag") == "R") == drawing).select(F.col("l_orderkey").alias("page_no"), F.lit(drawing).alias("is_drawing"))
    return pick(False).unionByName(pick(True)).groupBy("page_no", "is_drawing").agg(F.count("*").alias("rects"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS place FROM conversations")
def w6_ordinals(read):
    return read("conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("place"))


@query("SELECT event_id AS id, 'K' || event_id AS name, event_type || '=x' AS value FROM events WHERE event_id % 4 < 2")
def s9_settings(read):
    k = F.col("event_id") % 4
    pair = F.concat(F.lit(" K"), "event_id", F.lit(" = "))
    line = F.when(k == 0, F.concat(pair, F.lit('"'), "event_type", F.lit('=x" '))).when(k == 1, F.concat(pair, F.lit("'"), "event_type", F.lit("=x'"))).when(k == 2, F.concat(F.lit("# "), pair)).otherwise("K0")
    return settings.pairs(read("events").select(line.alias("value"))).select(F.substring("name", 2, 20).cast("long").alias("id"), "name", "value")


@query("""SELECT source, '{"settings":{"api_key":"***","lang":"' || min(lang) || '"},"usage":{"texts":' || count(*) || '}}' AS meta FROM documents GROUP BY source""")
def k6_meta(read):
    g = read("documents").groupBy("source").agg(F.min("lang").alias("lang"), F.count("*").alias("n"))
    return g.select("source", settings.report(F.create_map(F.lit("api_key"), F.col("source"), F.lit("lang"), F.col("lang")), F.create_map(F.lit("texts"), F.col("n"))).alias("meta"))


@query("SELECT conv_id AS book, turn::INTEGER + 1 AS ord, CASE WHEN turn % 2 = 0 THEN 'new ' || role ELSE text END AS content FROM conversations")
def k4_package_copy(read):
    """Packages copied with some documents replaced, and read back."""
    rows = read("conversations").select(F.col("conv_id").alias("book"), F.col("turn").cast("int").alias("ord"), F.format_string("c%04d.xhtml", "turn").alias("name"), F.encode("text", "UTF-8").alias("data"))
    new = read("conversations").where("turn % 2 = 0").select(F.col("conv_id").alias("book"), F.format_string("c%04d.xhtml", "turn").alias("name"), F.encode(F.concat(F.lit("new "), "role"), "UTF-8").alias("data"))
    made = sinks.packages(sinks.overlay(rows, new)).select(F.col("book").cast("string").alias("path"), "content")
    return files.epub_entries(made).where("name != 'mimetype'").select(F.col("path").cast("long").alias("book"), "ord", F.decode("data", "UTF-8").alias("content"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '没有收到文件' WHEN event_id % 7 = 1 THEN '文件内容为空' WHEN event_id % 7 = 2 THEN '未配置 API Key' WHEN event_id % 5 <> 3 THEN NULL ELSE '不支持的文件类型' END AS refusal FROM events""")
def p15_upload_refusals(read):
    k, m = F.col("event_id") % 7, F.col("event_id") % 5
    name = F.when(m == 0, "a.b/c.PDF").when(m == 1, "书.epub").when(m == 2, "").when(m == 3, F.when(k > 4, ".txt").otherwise("a.docx")).otherwise("x.tar.TXT")
    return read("events").select("event_id", uploads.refusal(name, F.when(k == 0, None).when(k == 1, 0).otherwise(9), k != 2).alias("refusal"))


@query("""SELECT doc_id, 'attachment; filename="' || CASE WHEN doc_id % 2 = 0 THEN '__ ' || doc_id || '~_.zip' ELSE 'output.zip' END || '"; filename*=UTF-8' || chr(39) || chr(39) || CASE WHEN doc_id % 2 = 0 THEN '%E6%B1%89_%20' || doc_id || '~_.zip' ELSE 'output.zip' END AS header FROM documents""")
def f42_download_header(read):
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("汉: "), "doc_id", F.lit("~*"))).otherwise("")
    return read("documents").select("doc_id", uploads.content_disposition(F.concat(uploads.download_name(title), F.lit(".zip"))).alias("header"))
