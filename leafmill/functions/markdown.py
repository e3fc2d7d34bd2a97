"""Markdown to XHTML and to plain text (F22-F25): a line grammar, applied in a vectorised UDF.

A document is cut into lines; each line is classed once (LINE_KINDS, in order of precedence), and neighbouring lines of one kind
form an element that its kind renders.
"""

from __future__ import annotations

import html
import re
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What makes a line of each kind.
FENCE = re.compile(r"```|~~~")
HEADING = re.compile(r"(#{1,6})\s+(.*)$")
RULE = re.compile(r"\s*(-{3,}|\*{3,}|_{3,})\s*$")
QUOTE = re.compile(r"\s*>\s?(.*)$")
ITEM = re.compile(r"(\s*)([-*+]|\d+[.)])\s+(.*)$")
TABLE_RULE = re.compile(r"\s*\|?(:?-{2,}:?\|)+\s*$")
INLINE = [
    (re.compile(r"`([^`]+)`"), r"<code>\1</code>"),
    (re.compile(r"\*\*([^*]+)\*\*"), r"<strong>\1</strong>"),
    (re.compile(r"__([^_]+)__"), r"<strong>\1</strong>"),
    (re.compile(r"(?<!\*)\*([^*\n]+)\*(?!\*)"), r"<em>\1</em>"),
    (re.compile(r"(?<!_)_([^_\n]+)_(?!_)"), r"<em>\1</em>"),
]
LINK = re.compile(r"\[([^\]]*)\]\((https?://[^)\s]+)\)")


def inline(text: str) -> str:
    """One line's marks, of text that isn't escaped yet."""
    out = LINK.sub(lambda m: f'<a href="{html.escape(m[2])}">{m[1]}</a>', html.escape(text))
    for pattern, to in INLINE:
        out = pattern.sub(to, out)
    return out


def classed(lines: list[str]) -> list[tuple[str, str]]:
    """(kind, line). Fenced lines are "code"; each fence has a number, so that neighbouring ones stay apart."""
    out: list[tuple[str, str]] = []
    fence, table = 0, False
    for line in lines:
        bare = line.strip()
        if FENCE.match(bare):
            fence += 1
            kind = f"fence{(fence + 1) // 2}"
            out.append((kind, "") if fence % 2 else (kind, "\0"))
            table = False
            continue
        if fence % 2:
            out.append((f"fence{(fence + 1) // 2}", line))
            continue
        if bare.startswith("|") or (table and "|" in bare):
            table = True
            out.append(("table", bare))
            continue
        table = False
        kind = "heading" if HEADING.match(line) else "rule" if RULE.match(bare) else "quote" if QUOTE.match(line) else "item" if ITEM.match(line) else "text" if bare else "blank"
        out.append((kind, line))
    return out


def _table(rows: list[str]) -> str:
    cells = [[inline(c.strip()) for c in r.strip("|").split("|")] for r in rows if not TABLE_RULE.match(r)]
    if not cells:
        return "".join(f"<p>{inline(r)}</p>" for r in rows)
    row = lambda tag, r: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in r) + "</tr>"
    return f"<table><thead>{row('th', cells[0])}</thead><tbody>{''.join(row('td', r) for r in cells[1:])}</tbody></table>"


def to_html(text: str, offset: int = 0) -> str:
    """F24. List markers always make an unordered list."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    out: list[str] = []
    for kind, group in groupby(classed(lines), key=lambda x: x[0]):
        rows = [line for _, line in group]
        if kind.startswith("fence"):
            out.append("<pre>" + "\n".join(html.escape(r) for r in rows[1:] if r != "\0") + "</pre>")
        elif kind == "heading":
            for r in rows:
                m = HEADING.match(r)
                level = min(len(m[1]) + offset, 6)
                out.append(f"<h{level}>{inline(m[2].strip())}</h{level}>")
        elif kind == "rule":
            out += ["<hr/>"] * len(rows)
        elif kind == "quote":
            out.append("<blockquote><p>" + inline(" ".join(QUOTE.match(r)[1] for r in rows)) + "</p></blockquote>")
        elif kind == "item":
            out.append("<ul>" + "".join(f"<li>{inline(ITEM.match(r)[3])}</li>" for r in rows) + "</ul>")
        elif kind == "table":
            out.append(_table(rows))
        elif kind == "text":
            out.append("<p>" + inline(" ".join(r.strip() for r in rows)) + "</p>")
    made = "\n".join(out)
    return made if made.strip() else "<p></p>"


def to_plain(text: str) -> str:
    """F25, with all entities undone."""
    body = re.sub(r"<br\s*/?>|</(p|h[1-6]|li|tr|div|pre|blockquote)>", "\n", to_html(text))
    return re.sub(r"\n{3,}", "\n\n", html.unescape(re.sub(r"<[^>]+>", "", body))).strip()


@F.pandas_udf(T.StringType())
def markdown_to_html(texts: pd.Series, offsets: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else to_html(t, int(n)) for t, n in zip(texts, offsets, strict=True)])


@F.pandas_udf(T.StringType())
def markdown_to_plain(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else to_plain(t) for t in texts])


@F.pandas_udf(T.ArrayType(T.StringType()))
def markdown_parts_to_plain(parts: pd.Series) -> pd.Series:
    """Each part of a text by itself."""
    return pd.Series([None if p is None else [None if t is None else to_plain(t) for t in p] for p in parts])


@F.pandas_udf(T.ArrayType(T.StringType()))
def markdown_parts_to_html(parts: pd.Series, offsets: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else [None if t is None else to_html(t, int(n)) for t in p] for p, n in zip(parts, offsets, strict=True)])
