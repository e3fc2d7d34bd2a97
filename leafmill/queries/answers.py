"""Model answers: parsing, alignment, reassembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as fa
from ..operators import align
from . import query

_ANS = "'  text ' || doc_id || ' [[FIG:' || (doc_id % 3) || ']] [[ fig 7 ]] [[FIG:7]]' || CASE WHEN doc_id % 2 = 0 THEN '<<<FIGURES>>> {\"figures\": []} ' ELSE '' END"


def _answer():
    return F.concat(F.lit("  text "), "doc_id", F.lit(" [[FIG:"), (F.col("doc_id") % 3).cast("string"), F.lit("]] [[ fig 7 ]] [[FIG:7]]"), F.when(F.col("doc_id") % 2 == 0, '<<<FIGURES>>> {"figures": []} ').otherwise(""))


@query(f"SELECT doc_id, trim(string_split(a, '<<<FIGURES>>>')[1]) AS text, string_split(a, '<<<FIGURES>>>')[2] AS rest FROM (SELECT doc_id, {_ANS} AS a FROM documents)")
def f14_split_answer(read):
    text, rest = fa.split_answer(_answer())
    return read("documents").select("doc_id", text.alias("text"), rest.alias("rest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '0,7' WHEN doc_id % 3 = 1 THEN '1,7' ELSE '2,7' END AS numbers FROM documents")
def a9_placeholders(read):
    return read("documents").select("doc_id", F.array_join(fa.placeholders(_answer()), ",").alias("numbers"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{\"a\": ' || doc_id || '}' WHEN 1 THEN '{\"a\": ' || doc_id || '}' WHEN 2 THEN NULL ELSE NULL END AS json FROM documents")
def f15_loose_json(read):
    k = F.col("doc_id") % 4
    obj = F.concat(F.lit('{"a": '), "doc_id", F.lit("}"))
    made = F.when(k == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), obj, F.lit(" done"))).when(k == 2, "[1, 2]").otherwise("{broken")
    return read("documents").select("doc_id", fa.loose_json(made).alias("json"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '原文=' || source || ';译文=' || lang WHEN 1 THEN '译文=' || lang WHEN 2 THEN '译文=' || source ELSE '译文=' || lang END AS blocks FROM documents""")
def f18_answer_blocks(read):
    k = F.col("doc_id") % 4
    made = F.when(k == 0, F.concat(F.lit("【原文】 "), "source", F.lit("\n（译文）"), "lang")).when(k == 1, F.concat(F.lit("x【译文】\n"), "lang")).when(k == 2, F.col("source")).otherwise(F.concat(F.lit("（原文） 【译文】"), "lang"))
    return read("documents").select("doc_id", F.array_join(F.transform(fa.answer_blocks(made, True), lambda b: F.concat(b["label"], F.lit("="), b["text"])), ";").alias("blocks"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS out, true AS by_id FROM conversations")
def f16_translation_mapping(read):
    """Answers as one JSON text per conversation, read back as (id, text); an entry without text is empty."""
    item = F.struct(F.col("turn").cast("string").alias("id"), F.when(F.col("turn") % 3 == 0, F.col("text")).alias("text"), F.when(F.col("turn") % 3 == 1, F.col("text")).alias("translation"))
    made = read("conversations").groupBy("conv_id").agg(F.concat(F.lit("ok "), F.to_json(F.struct(F.collect_list(item).alias("translations")))).alias("answer"))
    out = made.select("conv_id", F.explode(fa.translations(F.col("answer"))).alias("x"))
    return out.select("conv_id", F.col("x.id").cast("long").alias("turn"), F.col("x.text").alias("out"), F.lit(True).alias("by_id"))


@query("""WITH p AS (SELECT conv_id AS batch, turn AS ordinal, 's' || turn AS id, text FROM conversations), a AS (SELECT conv_id AS batch, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, CASE WHEN turn % 4 = 1 THEN NULL ELSE 's' || turn END AS id, 'o' || turn AS out FROM conversations WHERE turn % 5 <> 3)
SELECT p.batch, p.ordinal, coalesce(x.out, y.out) AS out, x.out IS NULL AND y.out IS NOT NULL AS positional FROM p LEFT JOIN a x ON p.batch = x.batch AND p.id = x.id LEFT JOIN a y ON p.batch = y.batch AND p.ordinal = y.ordinal""")
def j3_align(read):
    from pyspark.sql.window import Window

    c = read("conversations")
    p = c.select(F.col("conv_id").alias("batch"), F.col("turn").alias("ordinal"), F.concat(F.lit("s"), "turn").alias("id"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = c.where("turn % 5 != 3").select(F.col("conv_id").alias("batch"), (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.when(F.col("turn") % 4 != 1, F.concat(F.lit("s"), "turn")).alias("id"), F.concat(F.lit("o"), "turn").alias("out"))
    return align.to_pieces(p, a).select("batch", "ordinal", "out", "positional")


@query("""WITH p AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 3 = 0 AND turn % 3 = 1 THEN NULL ELSE 'o' || turn || chr(10) END AS out FROM conversations)
SELECT conv_id, string_agg(CASE WHEN n = 1 THEN coalesce(out, text) ELSE regexp_replace(coalesce(out, text), '^\\n+|\\n+$', '', 'g') END, chr(10) ORDER BY turn) AS text, bool_and(out IS NOT NULL) AS all_ok, count(*) FILTER (out IS NULL)::BIGINT AS skipped FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM p) GROUP BY conv_id""")
def a3_reassemble(read):
    out = F.when(~((F.col("conv_id") % 3 == 0) & (F.col("turn") % 3 == 1)), F.concat(F.lit("o"), "turn", F.lit("\n")))
    rows = read("conversations").select(F.col("conv_id").alias("seg_id"), F.col("turn").alias("k"), "text", out.alias("out"))
    return align.reassemble(rows).withColumnRenamed("seg_id", "conv_id")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '输出被截断' WHEN event_id % 5 = 1 THEN '返回缺失或为空' WHEN event_id % 5 = 2 THEN '疑似模型拒答' WHEN event_id % 5 = 3 THEN '照抄原文未翻译' END AS reason FROM events")
def c8_reject_reasons(read):
    k = F.col("event_id") % 5
    out = F.when(k == 1, " ").when(k == 2, "As an AI ...").otherwise(F.lit("译"))
    return read("events").select("event_id", align.reason(out, F.when(k == 0, "length").otherwise("stop"), k == 3, "zh").alias("reason"))


@query("SELECT event_id, 'c' || event_id AS content, 'stop' AS finish, event_id AS completion_tokens FROM events")
def f39_response(read):
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("c"), "event_id").alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), F.struct(F.col("event_id").alias("completion_tokens"), F.struct(F.lit(1).alias("x")).alias("details")).alias("usage")))
    return read("events").select("event_id", fa.response(body).alias("r")).select("event_id", "r.content", "r.finish", "r.completion_tokens")


@query("""SELECT doc_id, 'a' || CASE WHEN doc_id % 3 = 0 THEN 'F' || doc_id ELSE '' END || 'b' || 'G' AS text FROM documents""")
def j8_figure_join(read):
    """Placeholders replaced by their page's figure; of equal numbers the last counts, a missing one is empty."""
    text = F.concat(F.lit("a[[FIG:"), (F.col("doc_id") % 3).cast("string"), F.lit("]]b[[fig 9]]"))
    pages = read("documents").select("doc_id", text.alias("text"))
    figures = read("documents").select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("ord"), F.lit("old").alias("body")), F.struct(F.lit(0).alias("n"), F.lit(1).alias("ord"), F.concat(F.lit("F"), "doc_id").alias("body")), F.struct(F.lit(9).alias("n"), F.lit(2).alias("ord"), F.lit("G").alias("body")))).alias("f")).select("doc_id", "f.*")
    return align.place_figures(pages, figures, "doc_id")
