"""What models answer: JSON, blocks, figures, translations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The separator before figures, the placeholder, and the block marks.
FIGURES = "<<<FIGURES>>>"
PLACEHOLDER = "(?i)\\[\\[\\s*FIG\\s*:?\\s*(\\d+)\\s*\\]\\]"
ORIGINAL, TRANSLATION = "原文", "译文"


def loose_json(answer: Column) -> Column:
    """the JSON object in an answer as text: without code fences; the whole, or from the first brace to the last; else null."""
    t = strip(F.regexp_replace(strip(answer), "(?im)^```(?:json)?\\s*|\\s*```$", ""))
    inner = F.regexp_extract(t, "(?s)\\{.*\\}", 0)

    def is_object(x: Column) -> Column:
        return F.startswith(F.ltrim(x), F.lit("{")) & F.try_parse_json(x).isNotNull()

    return F.when(is_object(t), t).when(is_object(inner), inner)


def split_answer(answer: Column) -> tuple[Column, Column]:
    """(text, what follows the figures' separator or null)."""
    parts = F.split(answer, FIGURES, 2)
    return strip(parts[0]), F.get(parts, F.lit(1))


def placeholders(text: Column) -> Column:
    """The distinct numbers of figure placeholders, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)), lambda x: x.cast("int"))))


def answer_blocks(answer: Column, translate: bool) -> Column:
    """an array of (label, text) of an answer marked with original and translation; unmarked ones get the mode's label."""
    head, tail = f"【{ORIGINAL}】", f"【{TRANSLATION}】"
    text = F.replace(F.replace(answer, F.lit(f"（{ORIGINAL}）"), F.lit(head)), F.lit(f"（{TRANSLATION}）"), F.lit(tail))
    after = F.get(F.split(text, head, 2), F.lit(1))
    both = F.split(after, tail, 2)
    block = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("text"))
    found = F.when(F.contains(text, F.lit(head)) & F.contains(after, F.lit(tail)), F.array(block(ORIGINAL, strip(both[0])), block(TRANSLATION, strip(F.get(both, F.lit(1))))))
    found = found.when(~F.contains(text, F.lit(head)) & F.contains(text, F.lit(tail)), F.array(block(TRANSLATION, strip(F.get(F.split(text, tail, 2), F.lit(1))))))
    other = F.array(block(TRANSLATION if translate else ORIGINAL, answer))
    return F.when(found.isNull(), other).otherwise(F.filter(found, lambda b: b["text"] != ""))


def translations(answer: Column) -> Column:
    """F16: the answer's translations in order: (ordinal from 0, id, text). An entry is a text, or an object with text (or
    translation; without either, empty); its place stands in for a missing id, and entries of other types are passed over."""
    made = F.try_variant_get(F.try_parse_json(loose_json(answer)), "$.translations", "array<variant>")

    def entry(x: Column, i: Column) -> Column:
        is_object = F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
        given = F.coalesce(F.try_variant_get(x, "$.text", "variant"), F.try_variant_get(x, "$.translation", "variant"))
        value = F.when(is_object, F.coalesce(given, F.parse_json(F.lit('""')))).otherwise(x)
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        return F.struct(F.coalesce(F.try_variant_get(x, "$.id", "string"), i.cast("string")).alias("id"), text.alias("text"))

    kept = F.filter(F.transform(made, entry), lambda x: x["text"].isNotNull())
    return F.transform(kept, lambda x, i: F.struct(i.alias("ordinal"), x["id"].alias("id"), x["text"].alias("text")))


def single_answer(answer: Column) -> Column:
    """a lone answer without the JSON around it; JSON that holds no translation counts as empty."""
    t = strip(F.coalesce(answer, F.lit("")))
    return F.when(t.rlike(r"^[{\[]"), F.coalesce(strip(F.get(translations(t), F.lit(0))["text"]), F.lit(""))).otherwise(t)


def json_mode_refused(message: Column) -> Column:
    """Whether a service's error says that it knows no JSON mode."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.contains(low, F.lit("response_format")) | (F.contains(low, F.lit("json")) & F.contains(low, F.lit("support")))


def response(body: Column) -> Column:
    """content, finish reason and numeric usage of a chat completion."""
    kind = "choices array<struct<message:struct<content:string>,finish_reason:string>>, usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>"
    x = F.from_json(body, kind)
    first = F.get(x["choices"], F.lit(0))
    return F.struct(F.coalesce(first["message"]["content"], F.lit("")).alias("content"), F.coalesce(first["finish_reason"], F.lit("")).alias("finish"), F.coalesce(x["usage"]["completion_tokens"], F.lit(0)).alias("completion_tokens"))
