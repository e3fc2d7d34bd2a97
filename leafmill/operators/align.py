"""Answers aligned to requests, pieces put together, figures put in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import PLACEHOLDER
from ..functions.markdown import markdown_parts_to_html, markdown_parts_to_plain
from ..functions.text import is_blank, usable


def to_pieces(pieces: DataFrame, answers: DataFrame) -> DataFrame:
    """Pieces (batch, ordinal, id) with out: the answer of that id, else the batch's answer at that place (positional)."""
    by_id = answers.where("id is not null").groupBy("batch", "id").agg(F.max_by("out", "ordinal").alias("_by_id"))
    by_place = answers.select("batch", "ordinal", F.col("out").alias("_by_place"))
    joined = pieces.join(by_id, ["batch", "id"], "left").join(by_place, ["batch", "ordinal"], "left")
    return joined.select(*pieces.columns, F.coalesce("_by_id", "_by_place").alias("out"), (F.col("_by_id").isNull() & F.col("_by_place").isNotNull()).alias("positional"))


def reassemble(pieces: DataFrame, *carried: str) -> DataFrame:
    """A3: segments (seg_id, text, all_ok, skipped) of pieces (seg_id, k, text, out); a missing answer leaves the source.
    carried: further columns, of which the first piece that has a value counts."""
    part = F.struct("k", F.coalesce("out", "text").alias("t"))
    g = pieces.groupBy("seg_id").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.bool_and(F.col("out").isNotNull()).alias("all_ok"), F.count_if(F.col("out").isNull()).alias("skipped"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("k"))).alias(c) for c in carried])
    one = F.col("parts")[0]["t"]
    many = F.array_join(F.transform("parts", lambda x: F.regexp_replace(x["t"], "^\\n+|\\n+$", "")), "\n")
    return g.select("seg_id", F.when(F.size("parts") == 1, one).otherwise(many).alias("text"), "all_ok", "skipped", *carried)


def reason(out: Column, finish: Column, echo: Column, target: str) -> Column:
    """Why an answer is rejected, or null."""
    return F.when(finish == "length", "输出被截断").when(is_blank(out), "返回缺失或为空").when(~usable(out, target), "疑似模型拒答").when(echo, "照抄原文未翻译")


def _parts(pages: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """(key, texts, figs): what lies between a page's placeholders, and what each placeholder stands for (null if nothing)."""
    last = figures.groupBy(key, "n").agg(F.max_by("body", "ord").alias("body"))
    by_page = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("n", "body"))).alias("figs"))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(1)), lambda x: x.cast("int"))
    return pages.join(by_page, key, "left").select(key, F.split("text", PLACEHOLDER).alias("texts"), F.transform(numbers, lambda n: F.try_element_at("figs", n)).alias("figs"))


def place_figures(pages: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """Pages (key, text) with placeholders replaced by bodies of figures (key, n, ord, body)."""
    body = F.zip_with("texts", "figs", lambda t, f: F.concat(F.coalesce(t, F.lit("")), F.coalesce(f, F.lit(""))))
    return _parts(pages, figures, key).select(key, F.array_join(body, "").alias("text"))


def interleave(pages: DataFrame, figures: DataFrame, key: str, as_html: bool = False, heading_offset: int = 2) -> DataFrame:
    """pages (key, text) rendered: Markdown parts and figures' bodies (rendered already) in turn, blank ones left out."""
    parts = _parts(pages, figures, key)
    made = markdown_parts_to_html("texts", F.lit(heading_offset)) if as_html else markdown_parts_to_plain("texts")
    both = F.flatten(F.zip_with("made", "figs", lambda t, f: F.array(t, f)))
    return parts.select(key, made.alias("made"), "figs").select(key, F.array_join(F.filter(both, lambda x: F.trim(x) != ""), "\n" if as_html else "\n\n").alias("text"))
