"""XHTML as tokens, text slots and translation units (windows over token positions)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import content_escape, strip
from ..sources.tables import written

# Tags whose content is skipped, and tags that end a unit.
SKIP = ["script", "style", "pre", "code", "svg", "math"]
BLOCK = ["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "blockquote", "section", "article", "figcaption", "figure", "dd", "dt", "aside", "header", "footer", "nav", "title", "caption", "body", "html"]
STRUCT = ["img", "br", "hr", "svg", "image", "table", "tr", "td", "th", "figure", "video", "audio", "object", "iframe"]
#: Characters of running context.
CONTEXT = 400
TOKEN = "(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|<\\?.*?\\?>|<[^>]*>|[^<]+(?:<(?![^>]*>).*)?|<.*"
#: What begins a token and what ends it; and how many beginnings without an end the pattern may meet, each of which costs it a look through the
#: rest (but for an angle's, after which all is text).
OPENED = [("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<", ">")]
FEW = 16


def split_tokens(html: str) -> list[str]:
    """The pattern's tokens in one pass, however many beginnings have no end: once an end is missing, it is for all that follows."""
    out, text_from, at, missing = [], 0, 0, set()
    while (at := html.find("<", at)) >= 0:
        stop = -1
        for opening, ending in OPENED:
            if ending not in missing and html.startswith(opening, at):
                found = html.find(ending, at + len(opening))
                if found >= 0:
                    stop = found + len(ending)
                    break
                missing.add(ending)
        if stop < 0:
            if ">" in missing:
                break
            at += 1
            continue
        if at > text_from:
            out.append(html[text_from:at])
        out.append(html[at:stop])
        text_from = at = stop
    return [*out, html[text_from:]] if text_from < len(html) else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_tokens(html: pd.Series) -> pd.Series:
    return html.map(lambda t: None if t is None else split_tokens(t))


def _tokens_of(html: Column) -> Column:
    """A document's tokens. Documents with many beginnings that have no end go to Python; the others stay in the JVM."""
    unclosed = sum(((F.length(rest) - F.length(F.replace(rest, F.lit(opening), F.lit("")))) / len(opening) for opening, ending in OPENED[:-1] for rest in [F.substring_index(html, ending, -1)]), F.lit(0))
    many = unclosed > FEW
    return F.coalesce(_split_tokens(F.when(many, html)), F.regexp_extract_all(F.when(~many, html), F.lit(TOKEN), F.lit(0)))


def tokens(docs: DataFrame, id_col: str, html: Column) -> DataFrame:
    """(id_col, pos, tok, name, skip depth, group): one row a token. Windows run within a document."""
    t = docs.select(id_col, F.posexplode(_tokens_of(html)).alias("pos", "tok"))
    is_tag = F.col("tok").rlike("(?s)^<.*>$")
    t = t.withColumn("name", F.when(is_tag, F.lower(F.regexp_extract("tok", "^</?\\s*([A-Za-z0-9:_-]+)", 1))).otherwise(""))
    change = F.when(~F.col("name").isin(SKIP), 0).when(F.col("tok").startswith("</"), -1).when(F.col("tok").endswith("/>"), 0).otherwise(1)
    upto = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("sum", F.sum(change).over(upto))
    # a sum that is cut at zero at every step, in closed form
    t = t.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    ends = F.col("name").isin(sorted({*SKIP, *BLOCK, *STRUCT})).cast("int")
    t = t.withColumn("grp", F.sum(ends).over(upto))
    slot = ~is_tag & F.col("tok").rlike("\\p{L}") & (F.col("depth") == 0)
    return t.select(id_col, "pos", "tok", "name", "depth", "grp", slot.alias("is_slot"))


def units(toks: DataFrame, id_col: str) -> DataFrame:
    """(id_col, unit, text, first_pos, slots): slots between boundaries joined in order, stripped, blank ones left out."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), "")
    g = toks.where("is_slot").groupBy(id_col, "grp").agg(strip(joined).alias("text"), F.min("pos").alias("first_pos"), F.count("*").alias("slots")).where("text != ''")
    return g.withColumn("unit", F.row_number().over(Window.partitionBy(id_col).orderBy("grp")) - 1).select(id_col, "unit", "grp", "text", "first_pos", "slots")


def splice(toks: DataFrame, translated: DataFrame, id_col: str) -> DataFrame:
    """Documents with translations in their units' first slots; other slots of a unit empty, white space at slots' ends
    kept, & < > escaped; where a translation has no letter its unit's first slot keeps its own text. Units without a row in translated
    stay as they are. translated: (id_col, grp, first_pos, out)."""
    # a document's tokens lie together already, and stay where they are: its translations come as one map
    told = translated.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("grp", F.struct("first_pos", "out")))).alias("told"))
    t = toks.join(told, id_col, "left").withColumn("said", F.try_element_at("told", F.col("grp"))).select("*", "said.first_pos", "said.out")
    lead, tail = F.regexp_extract("tok", "(?U)^\\s*", 0), F.regexp_extract("tok", "(?U)(?<!\\s)\\s*$", 0)
    said = F.when(F.col("out").rlike("\\p{L}"), strip(F.col("out"))).otherwise(strip(F.col("tok")))
    body = F.when(F.col("pos") == F.col("first_pos"), content_escape(said)).otherwise("")
    part = F.when(F.col("is_slot") & F.col("first_pos").isNotNull(), F.concat(lead, body, tail)).otherwise(F.col("tok"))
    return t.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]), "").alias("html"))


class Running:
    """The text since the last reset, of which only the last CONTEXT characters count: parts joined by spaces, white space at their ends dropped (at their
    beginnings too where nothing stands before). Two stretches of parts add up: the suffix of the later one, or where it is short the earlier one's
    with it. raw: the end of what was added, as if something stood before it; n: its length if nothing does."""

    def __init__(self):
        self.raw, self.n = "", 0

    def add(self, part: str) -> None:
        part = part.rstrip()
        if not part:
            return
        self.n = self.n + 1 + len(part) if self.n else len(part.lstrip())
        self.raw = f"{self.raw} {part}"[-CONTEXT:]

    def after(self, before: str) -> str:
        return f"{before}{self.raw}"[-CONTEXT:] if before else self.raw[len(self.raw) - min(self.n, len(self.raw)) :]


def last_step(before: str, part: str | None) -> str:
    """The context after a part: what stood before it is cut already, loses white space at its ends, takes the part, and is cut again."""
    return "" if part is None else f"{before} {part}".strip()[-CONTEXT:]


def short(part: str | None) -> str | None:
    """A part of which as much is left as contexts can tell; the mark in front of a cut one is cut off itself."""
    kept = part and part.rstrip()
    return part if part is None else (kept or " ") if len(kept or "") <= CONTEXT else f"|{kept[-CONTEXT:]}"


def grown(before: str, part: str | None) -> str:
    """A stretch's text, cut, with a part more."""
    now = Running()
    if part is not None:
        now.add(part)
    return now.after(before)


@F.pandas_udf(T.StringType())
def _lent_context(before: pd.Series, part: pd.Series, raw: pd.Series, n: pd.Series, last: pd.Series) -> pd.Series:
    """Contexts of rows whose stretch begins in an earlier range, which left `before` and `part`."""
    out = []
    for b, p, r, k, own in zip(before, part, raw, n, last, strict=True):
        now = Running()
        if b is None or r is None:
            out.append(None)
        elif own is None:
            out.append(last_step(b, p))
        else:
            now.raw, now.n = r, int(k)
            out.append(last_step(now.after(grown(b, p)), own))
    return pd.Series(out, dtype=object)


def contexts(toks: DataFrame, id_col: str) -> DataFrame:
    """(id_col, pos, context) for every slot: the last CONTEXT characters of the text since the last opening block tag.

    A parallel scan: ranges of (id_col, pos) are read in order, each with what its own rows say; what each range leaves to the next, some CONTEXT
    characters, is added up over the ranges on the driver and set before the rows that no reset parts from their range's beginning. So a
    document is as many tasks' as its tokens fill."""
    opens = F.col("name").isin(BLOCK) & ~F.col("tok").startswith("</")
    is_text = (F.col("name") == "") & ~F.col("tok").rlike("(?s)^<.*>$")
    kept = toks.where(opens | is_text).select(id_col, "pos", F.to_json(F.struct(F.col(id_col).alias("i"))).alias("_doc"), F.when(is_text, F.col("tok")).alias("part"), "is_slot")
    ordered = kept.repartitionByRange(id_col, "pos").sortWithinPartitions(id_col, "pos")
    names = [id_col, "pos", "context", "head", "raw", "n", "part", "_part", "_doc", "is_slot"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, doc, head, now, last, kinds = TaskContext.get().partitionId(), None, True, Running(), None, None

        def row(i, pos, is_slot):
            said = last_step(now.after(""), last)
            return (i, pos, said, head, *((now.raw, now.n, short(last)) if head or not is_slot else (None, None, None)), number, doc, is_slot)

        def out(made):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

        for b in batches:
            kinds = [b.schema.field(0).type, b.schema.field(1).type, pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
            made = []
            for i, pos, key, part, is_slot in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != doc:
                    head, now, last, doc = doc is None, Running(), None, key
                if is_slot:
                    made.append(row(i, pos, True))
                if part is None:
                    head, now, last = False, Running(), None
                else:
                    if last is not None:
                        now.add(last)
                    last = part
            if made:
                yield out(made)
        if doc is not None:
            yield out([row(i, pos, False)])  # what the range leaves to the next one

    id_kind, pos_kind = (kept.schema[c].dataType.simpleString() for c in (id_col, "pos"))
    found = written(ordered.mapInArrow(run, f"{id_col} {id_kind}, pos {pos_kind}, context string, head boolean, raw string, n long, part string, _part int, _doc string, is_slot boolean"), "contexts")
    before, part, doc, lent = "", None, None, []
    for r in found.where("not is_slot").orderBy("_part").select("_part", "_doc", "head", "raw", "n", "part").collect():  # a row a partition
        if doc is not None and part is not None:
            lent.append((r["_part"], doc, before, part))
        now = Running()
        now.raw, now.n = r["raw"], r["n"]
        goes_on = r["head"] and r["_doc"] == doc
        if not goes_on:
            before, part = "", None
        if r["part"] is not None:
            before, part = now.after(grown(before, part)), r["part"]
        doc = r["_doc"]
    slots = found.where("is_slot")
    if lent:
        more = toks.sparkSession.createDataFrame(lent, "_part int, _doc string, _before string, _last string")  # a row a partition at most
        slots = slots.join(F.broadcast(more), ["_part", "_doc"], "left")
        slots = slots.withColumn("context", F.coalesce(_lent_context(F.when(F.col("head"), F.col("_before")), "_last", "raw", "n", "part"), "context"))
    return slots.select(id_col, "pos", "context")
