"""P10: whether an answer copies its source."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import KANA, normalized


#: Fixed value: the matcher's ratio from which on an answer is a copy.
LEAST = 0.9


#: Fixed value: so many rows are strings at a time.
ROWS = 256


def holds(a: str, b: str) -> bool:
    """Whether one text lies in the other and is, whole, the matcher's first block; where this is False it may still be.

    The matcher looks for the longest run, first in a and then in b, of characters that are not frequent in b, and widens what it finds. Of a text that
    lies in the other all runs do, so its longest ones are those to be found, and the first of them meets itself unless the rest has one earlier."""
    if len(a) <= len(b):
        at = b.find(a)
    else:
        at = a.find(b)
    if at < 0:
        return False
    frequent = {c for c, n in Counter(b).items() if n > len(b) // 100 + 1} if len(b) >= 200 else set()
    runs = (re.split(f"[{re.escape(''.join(frequent))}]+", min(a, b, key=len)) if frequent else [min(a, b, key=len)])
    longest = max(map(len, runs))
    if not longest:
        return False
    if len(a) <= len(b):
        first = next(r for r in runs if len(r) == longest)
        return b.find(first) == at + a.find(first)
    head = a[: at + longest - 1]
    return not any(r in head for r in {r for r in runs if len(r) == longest})


def near(a: str, b: str) -> bool:
    """Whether the sequence matcher's ratio of a and b is LEAST or more, with no more of its work than that takes: what both share of characters, in
    any order, bounds the ratio from above, and its first block, the longest, from below; only what neither settles is matched to the end."""
    total = len(a) + len(b)
    if not total or 2.0 * min(len(a), len(b)) / total < LEAST:
        return not total
    if holds(a, b):
        return True
    if 2.0 * sum((Counter(a) & Counter(b)).values()) / total < LEAST:
        return False
    matcher = SequenceMatcher(None, a, b)
    if 2.0 * matcher.find_longest_match().size / total >= LEAST:
        return True
    return matcher.ratio() >= LEAST


@F.arrow_udf(T.BooleanType())
def _judged(rows: pa.Array) -> pa.Array:
    """Of (known, a, b) what is known, and else what the matcher says."""
    out = []
    for at in range(0, len(rows), ROWS):
        columns = [c.to_pylist() for c in rows.slice(at, ROWS).flatten()]
        out += [near(a, b) if known is None and a is not None else known for known, a, b in zip(*columns, strict=True)]
    return pa.array(out, pa.bool_())


def is_echo(source: Column, value: Column) -> Column:
    """The tests that columns can do come first; the sequence matcher only sees what they leave open (others pass as null).

    Both texts are stripped once, and what is found out about them is the one argument of the function that has the last word."""
    spoken = F.coalesce(source, F.lit("")).rlike(KANA)  # others are no echo, and none of what follows looks at them
    pair = F.struct(*(normalized(F.coalesce(x, F.lit(""))).alias(name) for x, name in ((source, "a"), (value, "b"))))

    def known(x):
        a, b = x["a"], x["b"]
        able = (F.length(a) >= 8) & a.rlike(f"(?:{KANA}{KANA.replace('[', '[^')}*+){{3}}")
        alike = F.abs(F.length(a) - F.length(b)) <= F.greatest(F.lit(2), (F.length(a) * 0.25).cast("int"))
        return F.struct(F.when(~able, False).when(a == b, True).when(~alike, False).when(~b.rlike(KANA), False).alias("known"), a.alias("a"), b.alias("b"))

    def left_open(x):  # in this order: from 200 characters on the matcher leaves out what is frequent in its second text
        return F.struct(x["known"].alias("known"), F.when(x["known"].isNull(), x["b"]).alias("a"), F.when(x["known"].isNull(), x["a"]).alias("b"))

    judged = F.transform(F.transform(F.array(pair), known), left_open)
    return F.coalesce(_judged(F.when(spoken, F.get(judged, F.lit(0)))), F.lit(False))
