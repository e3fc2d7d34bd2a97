"""Scalar functions on texts, keys and settings, as Spark column expressions."""

from __future__ import annotations

import functools
import html
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Refusals, character ranges, what echo comparison ignores, file extensions.
REFUSALS = ["无法翻译", "无法完成", "不能翻译", "无法为你翻译", "请提供", "作为ai", "作为 ai", "我是一个ai", "我是一个人工智能", "i cannot", "i can't", "i'm unable", "as an ai", "unable to translate", "cannot translate"]
KANA = "[\\u3040-\\u309f\\u30a0-\\u30ff]"
CJK = "[\\u4e00-\\u9fff]"
ECHO_STRIP = "[\\s\\u3000、。，,．.！!？?…「」『』（）()\\[\\]【】〈〉《》\\-—ー~〜\"'“”‘’·]+"
ECHO_STRIPPED = "\t\n\x0b\x0c\r \u3000、。，,．.！!？?…「」『』（）()[]【】〈〉《》-—ー~〜\"'“”‘’·"
VISUAL_EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "gif", "jp2", "j2k", "pnm", "pgm", "ppm"]


#: Fixed value: what Unicode counts as white space (with the four separators of ASCII).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends, as Unicode defines it."""
    return F.btrim(text, F.lit(WHITE))


def strip_ruby(text: Column) -> Column:
    """without <rt> and <rp> elements and what is in them."""
    return F.regexp_replace(text, "(?is)<(rt|rp)\\b[^>]*>.*?</\\1\\s*>", "")


#: The entities that are undone by replacements alone, the ampersand last.
COMMON_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&amp;", "&")]
#: An ampersand that begins none of these, but maybe another entity (named, numeric, or without its semicolon).
OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e, _ in COMMON_ENTITIES) + ");)[#A-Za-z]"


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def common_unescaped(text: Column) -> Column:
    """The common entities as their characters, whole as they are listed; any other stays as it is written."""
    for entity, char in COMMON_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def unescape(text: Column, source: Column | None = None) -> Column:
    """Entities as their characters. Texts with the common ones alone stay in the JVM; others, of which Python knows all, go there.
    source: what text was made from, if it tells as well, and cheaper, whether there are others."""
    other = _unescaped(F.when((text if source is None else source).rlike(OTHER_ENTITY), text))
    return F.coalesce(other, common_unescaped(text))


def plain_text(xhtml: Column) -> Column:
    """XHTML as text with a line per block."""
    x = F.regexp_replace(xhtml, "(?is)<([s\u017f]cript|[s\u017f]tyle)(?![\\p{L}\\p{N}_]).*?</\\1>", " ")
    x = F.regexp_replace(x, "(?i)<br\\s*/?>", "\n")
    x = F.regexp_replace(x, "(?iu)</(p|div|h[1-6]|li|tr|blockquote|section|article)>", "\n")
    rest = F.substring_index(x, ">", -1)  # no tag ends there, however many seem to begin
    x = F.concat(F.regexp_replace(F.left(x, F.length(x) - F.length(rest)), "(?s)<[^>]+>", ""), rest)
    x = unescape(x, xhtml)
    x = F.regexp_replace(x, "[ \\t\\u00a0]+", " ")
    return strip(F.regexp_replace(x, "\\n{3,}", "\n\n"))


def normalized(text: Column) -> Column:
    """without the characters that echo comparison ignores (ECHO_STRIP's, one by one: no pattern is searched for)."""
    return F.translate(text, ECHO_STRIPPED, "")


def text_key(target: Column, text: Column) -> Column:
    """the cache key of a segment."""
    return F.md5(F.concat_ws("|", F.lit("t5"), target, text))


def job_key(fields: list[Column]) -> Column:
    """12 hex digits over a job's nine fields."""
    return F.substring(F.sha1(F.concat_ws("|", *fields)), 1, 12)


def data_url(mime: Column, data: Column) -> Column:
    """F8: base64 on one line."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), "[\\r\\n]", ""))


def blocks(text: Column) -> Column:
    """an array of blocks between blank lines, stripped, empty ones left out."""
    parts = F.split(F.regexp_replace(text, "\\r\\n?", "\n"), "\n\n")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def wants_chinese(target: str) -> bool:
    low = target.lower()
    return "中文" in target or "chinese" in low or low == "zh"


def is_blank(value: Column) -> Column:
    """Null, empty, or white space alone, as Unicode defines it."""
    return ~F.coalesce(value, F.lit("")).rlike("(?U)\\S")


def is_refusal(value: Column) -> Column:
    """Whether a refusal's mark is in it; the value is put in lower case once, whatever the number of marks."""
    marked = lambda low: functools.reduce(operator.or_, [F.contains(low, F.lit(m)) for m in REFUSALS])
    return F.exists(F.array(F.lower(F.coalesce(value, F.lit("")))), marked)


def usable(value: Column, target: str) -> Column:
    """Not blank, no refusal and, for Chinese, not kana alone."""
    out = ~is_blank(value) & ~is_refusal(value)
    if wants_chinese(target):
        out = out & ~(value.rlike(KANA) & ~value.rlike(CJK))
    return out


def trustworthy(value: Column, target: str) -> Column:
    """Usable and, for Chinese, a tenth of kana at most."""
    out = usable(value, target)
    if wants_chinese(target):
        kana, cjk = F.regexp_count(value, F.lit(KANA)), F.regexp_count(value, F.lit(CJK))
        out = out & (~value.rlike(KANA) | (kana * 10 <= F.greatest(kana + cjk, F.lit(1))))
    return out


def stub_translation(text: Column) -> Column:
    """The offline model: a mark, and each kana as an asterisk."""
    return F.concat(F.lit("【译】"), F.regexp_replace(text, KANA, "*"))


def kind(head_hex: Column, name: Column) -> Column:
    """An input's kind from the hex of its first bytes and its name; null if unknown."""
    ext = F.lower(F.regexp_extract(name, "\\.([^./]*)$", 1))
    return (
        F.when(F.startswith(head_hex, F.lit("255044462D")), "pdf")
        .when(F.startswith(head_hex, F.lit("504B0304")) | (ext == "epub"), "epub")
        .when(ext.isin(VISUAL_EXTENSIONS), "image")
        .when(ext == "txt", "txt")
    )


def language_tag(target: Column) -> Column:
    """a target language's tag; zh-CN where nothing else fits."""
    low = F.lower(target)
    out = F.when(F.contains(target, F.lit("中文")) | F.contains(target, F.lit("汉语")) | F.startswith(low, F.lit("zh")) | F.contains(low, F.lit("chinese")), "zh-CN")
    for tag, name in (("en", "english"), ("ja", "japanese"), ("ko", "korean"), ("fr", "french"), ("de", "german")):
        out = out.when(F.startswith(low, F.lit(tag)) | F.contains(low, F.lit(name)), tag)
    return out.otherwise("zh-CN")


# HTTP codes and words of refused accounts, codes worth another attempt.
AUTH_CODES, AUTH_WORDS = [401, 402, 403], ["insufficient", "balance", "unauthorized", "invalid api key"]
RETRY_CODES = [429, 500, 502, 503, 504]


def http_class(code: Column, message: Column) -> Column:
    """Auth (no retry, abort), retry, or fail."""
    low = F.lower(F.coalesce(message, F.lit("")))
    auth = code.isin(AUTH_CODES)
    for word in AUTH_WORDS:
        auth = auth | F.contains(low, F.lit(word))
    return F.when(auth, "auth").when(code.isin(RETRY_CODES), "retry").otherwise("fail")


def is_auth_error(code: int, low: str) -> bool:
    """P12 for one error, of a message in lower case."""
    return code in AUTH_CODES or any(w in low for w in AUTH_WORDS)


def backoff(attempt: Column) -> Column:
    """seconds before the next attempt."""
    return F.least(F.pow(F.lit(2), attempt), F.lit(30)).cast("long")


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    """the lower estimate in millionths of a dollar; the peak price doubles it."""
    return (input_tokens * 15 + output_tokens * 60) / 100


def content_escape(text: Column) -> Column:
    """& < > alone, as between tags."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def xml_escape(text: Column) -> Column:
    """& < > and both quotes, as in attributes too."""
    return F.replace(F.replace(content_escape(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def inline_markdown(text: Column) -> Column:
    """links, code, strong and emphasis of one escaped line."""
    for pattern, to in (
        ("\\[([^\\]]*)\\]\\((https?://[^)\\s]+)\\)", '<a href="$2">$1</a>'),
        ("`([^`]+)`", "<code>$1</code>"),
        ("\\*\\*([^*]+)\\*\\*", "<strong>$1</strong>"),
        ("__([^_]+)__", "<strong>$1</strong>"),
        ("(?<!\\*)\\*([^*\\n]+)\\*(?!\\*)", "<em>$1</em>"),
        ("(?<!_)_([^_\\n]+)_(?!_)", "<em>$1</em>"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text
