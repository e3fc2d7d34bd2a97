"""Requests to models: a batch as JSON, a lone text, a page's picture, the number of figure candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import FIGURES, ORIGINAL, TRANSLATION

#: Fixed value: how a prompt tells the number of figure candidates.
CANDIDATES = "检测到 (\\d+) 个可能是插图的区域"
#: Most characters of context that a request carries.
CONTEXT = 400


def payload(items: Column) -> Column:
    """a batch (array of id, text, context, in order) as a JSON object; contexts are cut, null ones left out."""
    return F.to_json(F.struct(F.transform(items, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), F.substring(x["context"], 1, CONTEXT).alias("context"))).alias("items")))


def batch_prompt(items: Column, target: str) -> Column:
    return F.concat(F.lit(f'Translate each text of the JSON below into {target}. Keep ids, order, Markdown and placeholders. Answer with {{"translations":[{{"id":"…","text":"…"}}]}} alone.\n\n'), payload(items))


def single_prompt(text: Column, target: str) -> Column:
    return F.concat(F.lit(f"Translate this text into {target}. Keep Markdown and placeholders. Answer with the translation alone.\n\n"), text)


def vision_prompt(translate: bool, with_original: bool, target: Column, candidates: Column) -> Column:
    """the request for a page's picture in three variants: transcribe, translate, or both; with the number of regions that may be
    figures, if there are any. The answer's format is what answers.split_answer, placeholders and answer_blocks read."""
    fields = '"n":1,"type":"photo|chart|diagram|map|comic|other","caption":"…","text":"…"' + (',"caption_t":"…","text_t":"…"' if translate else "")
    ask = (
        "Transcribe all text of this page in its own language and reading order, complete, as Markdown (headings, lists, tables). "
        "Where a figure stands, put [[FIG:n]] on a line of its own, numbered from 1 from top to bottom and left to right; tables are no figures. "
        f"After all text write {FIGURES} on a line of its own and then one JSON object, "
        f'{{"figures":[{{{fields}}}]}}, with an empty list where there are none. A blank page is [空白页/无内容]. Explain nothing.'
    )
    hint = F.when(candidates > 0, F.concat(F.lit("\n\n提示: 版面分析在该页检测到 "), candidates.cast("string"), F.lit(" 个可能是插图的区域。"))).otherwise("")
    if not translate:
        return F.concat(F.lit(ask), hint)
    named = F.coalesce(F.nullif(target, F.lit("")), F.lit("目标语言"))
    if with_original:
        tail = F.concat(F.lit("\n\nThen translate it into "), named, F.lit(f". Answer in this order: 【{ORIGINAL}】, the transcription; 【{TRANSLATION}】, the translation, both with their placeholders; {FIGURES} and the JSON with caption_t and text_t."))
    else:
        tail = F.concat(F.lit("\n\nWrite the text in its translation into "), named, F.lit(f" only, structure and placeholders kept, without 【{ORIGINAL}】; {FIGURES} and the JSON with caption_t and text_t follow all the same."))
    return F.concat(F.lit(ask), hint, tail)


def candidate_count(prompt: Column) -> Column:
    """the number of candidates that a prompt names, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(prompt, CANDIDATES, 1), F.lit("")).cast("int"), F.lit(0))
