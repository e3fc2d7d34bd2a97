"""Splitting long texts, packing pieces into batches, chapters.

Splitting carries state along one text, from piece to piece of a regular expression; batches of a long document are found in parallel.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import WHITE
from ..sources.tables import written

# Characters after which a text may be cut (white space too), and the limits.
SENTENCE_END = "。！？!?；;…．.\n）)】」』”\"'’、，,：:"
PIECE_CHARS, BATCH_CHARS, BATCH_ITEMS = 1200, 1800, 24


def cuts(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """pieces of at most limit characters; a cut comes after the last sentence end or space in a piece's second half."""
    ends = re.compile(f"(?s)^.*[{re.escape(SENTENCE_END)}\\s]")
    out, start = [], 0
    while len(text) - start > limit:
        floor = max(limit // 2, 1)
        m = ends.match(text[start + floor : start + limit])
        stop = start + floor + m.end() if m else start + limit
        out.append(text[start:stop])
        start = stop
    return [*out, text[start:]]


def piece_pattern(limit: int = PIECE_CHARS) -> str:
    """F3's pieces, found one after the other by Java's regular expressions: the same as cuts() makes."""
    floor = max(limit // 2, 1)
    end = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted({*SENTENCE_END, *WHITE})) + "]"
    half = f".{{{floor}}}.{{0,{limit - floor - 1}}}{end}|" if limit > floor else ""
    return f"(?s)(?=.{{{limit + 1}}})(?:{half}.{{{limit}}})|.{{1,{limit}}}+"


def split_long(text: Column, limit: int = PIECE_CHARS) -> Column:
    """F3 as a column, which stays in the JVM. Short texts are a piece of their own."""
    return F.when(F.length(text) > limit, F.regexp_extract_all(text, F.lit(piece_pattern(limit)), F.lit(0))).when(text.isNotNull(), F.array(text))


def batch_numbers(sizes: list[int], chars: int = BATCH_CHARS, items: int = BATCH_ITEMS) -> list[int]:
    """Greedy batches; one closes when the next piece would exceed its characters, or when it has all its items."""
    out, batch, used, n = [], 0, 0, 0
    for size in sizes:
        if n and (used + size > chars or n >= items):
            batch, used, n = batch + 1, 0, 0
        out.append(batch)
        used, n = used + size, n + 1
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def batch_ids(sizes: pd.Series) -> pd.Series:
    """W2 as a column: sizes in order to batch numbers."""
    return pd.Series([None if s is None else batch_numbers(list(s)) for s in sizes])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, k, batch, text): each document's pieces in order with their batches."""
    split = docs.select(id_col, split_long(F.col(text_col)).alias("parts"))
    split = split.select(id_col, "parts", batch_ids(F.transform("parts", F.length)).alias("batches"))
    return split.select(id_col, F.posexplode(F.arrays_zip("parts", "batches")).alias("k", "p")).select(id_col, "k", F.col("p.batches").alias("batch"), F.col("p.parts").alias("text"))


def next_starts(sizes, new_doc, chars: int, items: int):
    """For a stretch of pieces in order: where the next batch begins if one begins at each, by binary search over the sums of sizes (numpy
    arrays; new_doc: whether a piece is its document's first). A batch that could take more than the stretch has ends at its end."""
    import numpy as np

    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    begins = np.append(np.nonzero(new_doc)[0], n)
    at = np.arange(n)
    fits = np.searchsorted(sums, sums[:-1] + chars, "right") - 1
    return np.maximum(np.minimum(np.minimum(fits, at + items), begins[np.searchsorted(begins, at, "right")]), at + 1)


def last_starts(nexts):
    """The last batch's beginning, and the number of batches, if one begins at each place: pointer doubling."""
    import numpy as np

    n = len(nexts)
    to = np.where(nexts < n, nexts, np.arange(n))
    steps = (nexts < n).astype("i8")
    while (steps[to] > 0).any():
        steps, to = steps + steps[to], to[to]
    return to, steps + 1


def batched(rows: DataFrame, by: list[str], chars: int = BATCH_CHARS, items: int = BATCH_ITEMS) -> DataFrame:
    """W2 over texts in their order, across segments: (part, nth, items), a whole batch a row, numbered in order (part is 0); exactly the loop's
    batches, however many tasks a document fills.

    rows: (doc, seg_id, k, text, perhaps context, and what else by names); a batch holds texts of one doc. by: the order of docs and segments, in which
    no two rows with one k are equal. Sizes alone are dealt by ranges of that order; each range says, for the first places where a batch may
    begin in it, what its last batch then holds. The driver follows those from range to range, some numbers a range, and then each range knows its
    first batch. Texts meet by their batch's number."""
    texts = rows if "context" in rows.columns else rows.withColumn("context", F.lit(None).cast("string"))
    key = F.to_json(F.struct(F.col("doc").alias("d"))).alias("_doc")
    sized = rows.select(*by, "k", key, F.length("text").cast("long").alias("_size"))
    ordered = sized.repartitionByRange(*by, "k").sortWithinPartitions(*by, "k")
    names = [*sized.columns, "_new", "_part", "_at", "_first", "_used", "_held", "_count"]

    def ranges(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number, at, last, sizes, new, row, first_doc = TaskContext.get().partitionId(), 0, None, [], [], None, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            docs = b.column(b.num_columns - 2)
            fresh = np.ones(n, bool)
            fresh[1:] = pc.not_equal(docs.slice(1), docs.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = last is None or docs[0].as_py() != last
            first_doc = docs[0].as_py() if last is None else first_doc
            last, row = docs[n - 1].as_py(), b.slice(n - 1, 1)
            sizes.append(b.column(b.num_columns - 1).to_numpy())
            new.append(fresh)
            blank = [pa.nulls(n, pa.list_(pa.int64()))] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fresh), pa.array(np.full(n, number, "i4")), pa.array(np.arange(at, at + n)), *blank], names)
            at += n
        if row is None:
            return
        sizes, new = np.concatenate(sizes), np.concatenate(new)
        n = len(sizes)
        to, count = last_starts(next_starts(sizes, new, chars, items))
        few = min(n, items + 1)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        begins = np.nonzero(new)[0]
        own = few if len(begins) < 2 else min(few, int(begins[1]))  # sizes of the range's first document
        told = [sizes[:own], sums[n] - sums[to[:few]], n - to[:few], count[:few]]
        end = [*row.columns[:-2], pa.array([first_doc]), pa.array([n]), pa.array([True]), pa.array([number], pa.int32()), pa.array([-1]), *[pa.array([t], pa.list_(pa.int64())) for t in told]]
        yield pa.RecordBatch.from_arrays(end, names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema)
    found = written(ordered.mapInArrow(ranges, f"{kinds}, _new boolean, _part int, _at long, _first array<long>, _used array<long>, _held array<long>, _count array<long>"), "sizes")
    last_doc = found.where("_at >= 0").groupBy("_part").agg(F.max_by("_doc", "_at").alias("last"))
    ends = found.where("_at < 0").select("_part", "_doc", F.col("_size").alias("n"), "_first", "_used", "_held", "_count").join(last_doc, "_part").orderBy("_part").collect()  # a row a partition
    begins, total, open_, doc = {}, 0, None, None
    for r in ends:
        at = 0
        if open_ is not None and r["_doc"] == doc:  # the batch that the ranges before left open takes what it can
            used, held = open_
            while at < len(r["_first"]) and held < items and used + r["_first"][at] <= chars:
                used, held, at = used + r["_first"][at], held + 1, at + 1
            open_ = (used, held)
        begins[r["_part"]] = (at, total)
        if at < r["n"]:
            open_, total = (r["_used"][at], r["_held"][at]), total + r["_count"][at]
        doc = r["last"]

    def numbered(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by("_at")
        at, batch = begins[t["_part"][0].as_py()]
        nexts = next_starts(t["_size"].to_numpy(), t["_new"].to_numpy(zero_copy_only=False), chars, items)
        starts = np.zeros(len(nexts), "i8")
        while at < len(nexts):
            starts[at] = 1
            at = nexts[at]
        return pa.table([*[t[c] for c in keys], pa.array(batch - 1 + np.cumsum(starts))], [*keys, "nth"])

    keys = [*by, "k"]
    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in keys)
    numbers = found.where("_at >= 0").groupBy("_part").applyInArrow(numbered, f"{schema}, nth long") if begins else found.select(*keys, F.lit(0).cast("long").alias("nth"))
    item = lambda x: F.struct(x["seg_id"].alias("seg_id"), x["k"].cast("int").alias("k"), x["text"].alias("text"), x["context"].alias("context"))
    kept = list(dict.fromkeys([*by, "k", "seg_id", "text", "context"]))
    made = texts.select(*kept).join(numbers, keys).groupBy("nth").agg(F.sort_array(F.collect_list(F.struct(*kept))).alias("xs"))
    return made.select(F.lit(0).alias("part"), "nth", F.transform("xs", item).alias("items"))


def block_pages(docs: DataFrame, id_col: str, blocks: Column) -> DataFrame:
    """A text's blocks as pages (id_col, page_no from 1, text)."""
    return docs.select(id_col, F.posexplode(blocks).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


def chapters(pages: DataFrame, partition: str, order: str, size: int) -> DataFrame:
    """Pages numbered into chapters of `size` (1 where that is 0 or less)."""
    w = Window.partitionBy(partition).orderBy(order)
    return pages.withColumn("chapter", F.floor((F.row_number().over(w) - 1) / max(size, 1)).cast("int"))
