"""Quality rules as a learned decision list, in Spark expressions alone.

Features of whole texts are counted by built-in expressions. A rule is a conjunction of threshold tests; it is grown on two
thirds of the labelled rows (the test with the highest FOIL gain comes next), pruned on the rest (tests at its end
that don't raise precision there go), and taken if it is precise enough there; the rows it covers leave, and the next rule is
learned (sequential covering). Learning reads counts per (feature, threshold bin, label) only: one aggregation a step over
all labelled rows, a few hundred rows to the driver. The outcome is one ordered CASE WHEN expression.

Defined results: null and empty texts have no words and every count 0 (they fail the base rule); rows count as often as
they occur; without labels of both classes the list is empty and keeps all that the base rule keeps; the features depend on
the text column alone, whatever other columns there are; very long texts are counted whole; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The word pattern's space, the characters that count as symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once a row, whatever the optimizer does with projections."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeated(words: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more: windows' hashes are sorted with their
    places; a window repeats where a neighbour's hash is the same."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return _let(F.sort_array(windows), places)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    of_words = _let(
        F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != ""),
        lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), _repeated(w).alias("n_repeat_words")),
    )
    of_lines = _let(F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    made = docs.select(docs[id_col].alias("doc_id"), text.alias("text")).select(
        "doc_id",
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.translate("text", SPACE, "")).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("text"), CAPITALS).alias("n_capitals"),
        _count(F.col("text"), "!?").alias("n_marks"),
        _count(F.col("text"), "0123456789").alias("n_digits"),
        _count(F.col("text"), ".,").alias("n_stops"),
    )
    return made.select("doc_id", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("w.n_words", "w.n_distinct", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_digits", "n_stops")])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _per(n: str, of: str) -> Column:
    """Thousandths, rounded down."""
    return F.coalesce(F.expr(f"({n} * 1000) div nullif({of}, 0)"), F.lit(0).cast("long"))


#: Features that tests may use: thousandths of words, lines or characters, and the number of words.
FEATURES: dict[str, Column] = {}


def features() -> dict[str, Column]:
    if not FEATURES:
        FEATURES.update(
            symbols=_per("n_symbols", "word_chars"),
            capitals=_per("n_capitals", "word_chars"),
            marks=_per("n_marks", "word_chars"),
            digits=_per("n_digits", "word_chars"),
            stops=_per("n_stops", "n_words"),
            repeated=_per("n_repeat_words", "n_words"),
            distinct=_per("n_distinct", "n_words"),
            dup_lines=_per("n_dup_lines", "n_lines"),
            word_length=_per("word_chars", "n_words"),
            words=F.col("n_words"),
        )
    return FEATURES


@dataclass(frozen=True)
class Test:
    """feature >= threshold, or feature < threshold."""

    feature: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold}"


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def learn(table: DataFrame, max_rules: int = 8, max_tests: int = 3, precision: float = 0.9, cuts: int = 24) -> list[list[Test]]:
    """Rules for rows with bad = 1. table: counts() and bad (0 or 1), of labelled rows."""
    names = list(features())
    steps = [round((k + 0.5) / cuts, 4) for k in range(cuts)]
    valued = materialize(table.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grows"), *[c.alias(f"f_{n}") for n, c in features().items()]), "values")
    found = valued.groupBy("bad").agg(F.count("*").alias("n"), *[F.percentile_approx(f"f_{n}", steps, 2000).alias(n) for n in names]).collect()
    if len(found) < 2:
        return []
    edges = {n: sorted({v for r in found for v in r[n]} | {v + 1 for r in found for v in r[n]}) for n in names}  # at most 4 * cuts each

    def bin_of(n: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges[n]]), lambda t: t <= F.col(f"f_{n}"))).cast("int")

    data = materialize(valued.select("bad", "grows", F.array(*map(bin_of, names)).alias("bins")), "bins")

    def holds(tests: list[Test]) -> Column:
        out = F.lit(True)
        for t in tests:
            k, at = names.index(t.feature), edges[t.feature].index(t.threshold) + 1
            out = out & (F.col("bins")[k] >= at if t.at_least else F.col("bins")[k] < at)
        return out

    def tally(rest: Column) -> dict[tuple[int, bool], dict[str, list[int]]]:
        """By (bad, grows): counts per feature and bin of the rows where rest holds."""
        made: dict = {(b, g): {n: [0] * (len(edges[n]) + 1) for n in names} for b in (0, 1) for g in (True, False)}
        rows = data.where(rest).select("bad", "grows", F.posexplode("bins").alias("f", "bin")).groupBy("bad", "grows", "f", "bin").agg(F.count("*").alias("n"))
        for r in rows.collect():
            made[r["bad"], r["grows"]][names[r["f"]]][r["bin"]] += r["n"]
        return made

    rules: list[list[Test]] = []
    while len(rules) < max_rules:
        left = F.lit(True)
        for r in rules:
            left = left & ~holds(r)
        tests: list[Test] = []
        trail: list[tuple[int, int]] = []  # (bad, good) among the pruning rows after each test
        at = tally(left)
        total = {k: sum(v[names[0]]) for k, v in at.items()}
        if not total[1, True]:
            break
        while len(tests) < max_tests and total[0, True]:
            best = (0.0, None, 0, 0)
            for n in names:
                p_all, n_all = sum(at[1, True][n]), sum(at[0, True][n])
                p_low = n_low = 0
                for k, edge in enumerate(edges[n]):
                    p_low, n_low = p_low + at[1, True][n][k], n_low + at[0, True][n][k]
                    for is_least, p, q in ((True, p_all - p_low, n_all - n_low), (False, p_low, n_low)):
                        gain = _gain(p, q, p_all, n_all)
                        if gain > best[0] + 1e-9:
                            best = (gain, Test(n, is_least, edge), p, q)
            if best[1] is None:
                break
            tests.append(best[1])
            at = tally(left & holds(tests))
            total = {k: sum(v[names[0]]) for k, v in at.items()}
            trail.append((total[1, False], total[0, False]))
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in trail]
        if not worth:
            break
        keep = max(range(len(worth)), key=lambda k: (worth[k], -k))
        p, n = trail[keep]
        if (p + 1) / (p + n + 2) < precision and p / max(p + n, 1) < precision or not p:
            break
        rules.append(tests[: keep + 1])
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The ordered conditional expression: the first rule that holds rejects, else the row is kept."""
    out = None
    for tests in rules:
        holds = tests[0].column()
        for t in tests[1:]:
            holds = holds & t.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, counts, base_failed and kept, by rules learned from all labelled rows."""
    table = materialize(counts(docs), "counts")
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))
    rules = learn(table.join(known, F.col("doc_id") == F.col("_id")).select(*table.columns, (1 - F.col("_y")).alias("bad")))
    return table.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict(rules)})
