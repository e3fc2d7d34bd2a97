"""Pages and figures as text and XHTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, xml_escape

#: The separator between both versions and what a page without content shows, in both forms.
SEPARATOR = {True: '<p class="tr-sep">— 译文 —</p>', False: "— 译文 —"}
NOTHING = {True: "<p><i>(本页无可用内容)</i></p>", False: "(本页无可用内容)"}


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def block(blocks: Column, label: str) -> Column:
    """the text of the first block with that label, else empty."""
    return F.coalesce(F.get(F.filter(blocks, lambda b: b["label"] == label), F.lit(0))["text"], F.lit(""))


def page_body(blocks: Column, translate: bool, with_original: bool) -> Column:
    """what a page shows of its blocks (label, text): the first, the translation (else the first), or both versions."""
    primary = F.coalesce(F.get(blocks, F.lit(0))["text"], F.lit(""))
    if not translate:
        return primary
    original, translation = block(blocks, "原文"), block(blocks, "译文")
    if with_original:
        return F.concat_ws("\n\n", F.nullif(original, F.lit("")), F.nullif(translation, F.lit("")))
    return filled(translation, primary)


def figure_texts(text: Column, caption: Column, text_t: Column, caption_t: Column, translated: bool) -> tuple[Column, Column]:
    """a figure's text, for which its caption stands in, and its caption; translated ones first where asked for."""
    if not translated:
        return filled(text, caption), filled(caption)
    return filled(text_t, text, caption_t), filled(caption_t, caption)


def figure_plain(body: Column, caption: Column) -> Column:
    """a figure's text, with its caption in brackets where both differ."""
    return F.when((body != "") & (caption != "") & (caption != body), F.concat(body, F.lit("\n〔"), caption, F.lit("〕"))).otherwise(filled(body, caption))


def figure_html(body: Column, caption: Column, href: Column) -> Column:
    """a figure with its picture, or a note without one; nothing where there is nothing to show."""
    text = F.when(body != "", F.replace(xml_escape(body), F.lit("\n"), F.lit("<br/>")))
    span = F.when((caption != "") & (caption != body), F.concat(F.lit('<span class="fig-cap">'), xml_escape(caption), F.lit("</span>")))
    parts = F.concat_ws(" ", text, span)
    shown = F.when(parts != "", F.concat(F.lit("<figcaption>"), parts, F.lit("</figcaption>"))).otherwise("")
    picture = F.concat(F.lit('<figure class="fig"><img src="'), xml_escape(href), F.lit('" alt=""/>'), shown, F.lit("</figure>"))
    note = F.when(shown != "", F.concat(F.lit('<p class="fig-note">'), shown, F.lit("</p>"))).otherwise("")
    return F.when(F.coalesce(href, F.lit("")) != "", picture).otherwise(note)


def page(original: Column, primary: Column, translation: Column, translate: bool, with_original: bool, as_html: bool) -> Column:
    """a page of its rendered texts (empty or null where there is none): the first block's as it is, the translation's alone, or both
    around a separator; a page without any says so."""
    first = F.nullif(original if translate else primary, F.lit("")) if not translate or with_original else F.lit(None).cast("string")
    second = F.nullif(translation, F.lit("")) if translate else F.lit(None).cast("string")
    mark = F.when(first.isNotNull() & second.isNotNull(), SEPARATOR[as_html])
    shown = F.filter(F.array(first, mark, second), lambda x: x.isNotNull() & (strip(x) != ""))
    return F.coalesce(F.nullif(F.array_join(shown, "\n" if as_html else "\n\n"), F.lit("")), F.lit(NOTHING[as_html]))


def page_plain(original: Column, translation: Column, bilingual: bool) -> Column:
    """F28 of a translated page as plain text, with the original where bilingual."""
    return page(original, original, translation, True, bilingual, False)


def xhtml_page(title: Column, body: Column, lang: Column, css: str = "style.css") -> Column:
    """a body as an XHTML document."""
    return F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="'),
        xml_escape(lang), F.lit('">\n<head><title>'), xml_escape(title), F.lit(f'</title><link rel="stylesheet" type="text/css" href="{css}"/></head>\n<body>\n'), body, F.lit("\n</body></html>"),
    )
