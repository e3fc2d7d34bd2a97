"""The text channel: segments through cache, pieces, batches and a model back to whole texts.

Batches go across segments of a document, in order; rounds.ask_all sends them under limits that hold for the whole job. Budget, send and
ask are the same policy for a handful of texts in one process, without a Spark job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.echo import is_echo
from ..functions.text import stub_translation, text_key, usable
from ..operators import align, cache, chunking
from ..sources import tables
from .rounds import Chat, Limits, Run, ask_all

#: A backend takes the texts of one batch and returns as many answers, None where there is none; or those and the number of
#: output tokens that they took. ConnectionError says that the service can't be reached, PermissionError that it refuses the account.
Backend = Callable[[list[str]], list[str | None] | tuple[list[str | None], int]]


class Stopped(Exception):
    """An authorization error ended the run."""


@dataclass
class Budget:
    """Limits of one process's run; requests beyond them aren't sent, and their pieces keep their source."""

    max_requests: int = 1 << 60
    stall_limit: int = 25
    failure_limit: int = 5
    max_tokens: int = 1 << 60
    requests: int = 0
    tokens: int = 0
    stalled: int = 0
    failed: int = 0

    def open(self) -> bool:
        return self.requests < self.max_requests and self.tokens < self.max_tokens and self.stalled < self.stall_limit and self.failed < self.failure_limit


def send(backend: Backend, texts: list[str], budget: Budget) -> list[str | None] | None:
    """One request and what it used up; None where a limit forbids it or the service can't be reached."""
    if not budget.open():
        return None
    budget.requests += 1
    try:
        got = backend(texts)
    except ConnectionError:
        budget.failed += 1
        return None
    except PermissionError as e:
        raise Stopped(str(e)) from e
    answers, tokens = got if isinstance(got, tuple) else (got, 0)
    budget.failed, budget.tokens = 0, budget.tokens + tokens
    answers = ([*answers] + [None] * len(texts))[: len(texts)]
    budget.stalled = 0 if any(answers) else budget.stalled + 1
    return answers


def ask(backend: Backend, texts: list[str], budget: Budget, depth: int = 4) -> list[str | None]:
    """A batch's answers. C5: texts without one are halved and asked again, at most `depth` times, then one by one;
    C6: a text that stays alone without an answer gets one request more. A transport failure (C2) isn't followed up."""
    got = send(backend, texts, budget)
    if got is None:
        return [None] * len(texts)
    missing = [i for i, x in enumerate(got) if not x]
    if not missing:
        return got
    if len(texts) == 1 or not depth:
        for i in missing:
            got[i] = (send(backend, [texts[i]], budget) or [None])[0]
        return got
    half = max(len(missing) // 2, 1)
    for part in (missing[:half], missing[half:]):
        if part:
            for i, x in zip(part, ask(backend, [texts[i] for i in part], budget, depth - 1), strict=True):
                got[i] = x
    return got


def translate(segments: DataFrame, known: DataFrame, target: str, backend: Backend | Chat | None = None, limits: Limits | None = None) -> DataFrame:
    """segments (seg_id, text, doc where they belong to several, context where requests are to carry what stands before) with out, state (blank,
    hit, rejected_cache, miss), ok and why.

    known: the cache (k, t). Segments of equal text are asked for once. The offline model is an expression and stays in the JVM; its answers are
    judged as any others. With a backend the requests are sent when this is called."""
    return translate_run(segments, known, target, backend, limits)[0]


def translate_run(segments: DataFrame, known: DataFrame, target: str, backend: Backend | Chat | None = None, limits: Limits | None = None) -> tuple[DataFrame, Run]:
    """translate() and what it used. ok: all pieces were answered; why: the reason of the first piece that was not ("未译" if never asked)."""
    if "doc" not in segments.columns:
        segments = segments.withColumn("doc", F.lit(0))
    if "context" not in segments.columns:
        segments = segments.withColumn("context", F.lit(None).cast("string"))
    key = text_key(F.lit(target), F.col("text"))
    filled = segments.where(F.trim("text") != "").withColumn("_key", key)
    # texts meet by their digests; a text moves once as its digest's first segment, and once in the last join
    firsts = filled.groupBy("_key").agg(F.min_by(F.struct("doc", "seg_id", "text", "context"), F.struct("doc", "seg_id")).alias("x")).select(F.col("_key").alias("key"), "x.*")
    looked = cache.lookup(firsts, known, F.col("key"), is_echo(F.col("text"), F.col("cached")) | ~usable(F.col("cached"), target))
    run = Run(limits or Limits())
    if backend is not None:
        looked = tables.written(looked, "looked")
    split = chunking.split_long(F.when(F.col("state") != "hit", F.col("text")))
    pieces = looked.select("doc", "seg_id", "key", "state", "cached", "context", F.posexplode(F.coalesce(split, F.array("cached"))).alias("k", "text"))
    if backend is None:
        made = stub_translation(F.col("text"))
        why = F.when(F.col("state") != "hit", align.reason(made, F.lit("stop"), is_echo(F.col("text"), made), target))
        answered = pieces.withColumn("why", why).withColumn("out", F.when(F.col("state") == "hit", F.col("cached")).when(F.col("why").isNull(), made))
    else:
        asked, run = ask_all(chunking.batched(pieces.where("state != 'hit'").select("doc", F.col("seg_id").alias("order"), F.col("key").alias("seg_id"), "k", "text", "context"), ["doc", "order"]), target, backend, limits)
        asked = asked.select(F.col("seg_id").alias("key"), "k", F.col("out").alias("_out"), "why")
        answered = pieces.join(asked, ["key", "k"], "left").withColumn("out", F.when(F.col("state") == "hit", F.col("cached")).otherwise(F.col("_out")))
    whole = align.reassemble(answered.select(F.col("key").alias("seg_id"), "k", "text", "out", "state", "why"), "state", "why")
    whole = whole.select(F.col("seg_id").alias("_key"), F.col("text").alias("out"), "state", F.col("all_ok").alias("ok"), "why")
    if backend is not None:
        whole = tables.written(whole, "texts")
        tables.release(looked)
    kept = ["doc", "seg_id", "text"]
    blank = segments.where((F.trim("text") == "") | F.col("text").isNull()).select(*kept, F.col("text").alias("out"), F.lit("blank").alias("state"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("why"))
    return filled.join(whole, "_key").select(*kept, "out", "state", "ok", "why").unionByName(blank), run


def new_cache_lines(translated: DataFrame, target: str) -> DataFrame:
    """Lines (k, t, v) for what was asked and answered in full; copies of the source are left out. Answers were judged piece by piece, and pieces
    that are usable make a usable whole: no refusal's mark spans two lines."""
    asked = translated.where(F.col("ok") & F.col("state").isin("miss", "rejected_cache") & ~is_echo(F.col("text"), F.col("out")))
    return asked.select(text_key(F.lit(target), F.col("text")).alias("k"), F.col("out").alias("t"), F.lit(1).alias("v")).distinct()


def failures(translated: DataFrame, chars: int = 300, most: int = 500) -> DataFrame:
    """(doc, seg_id, why, source) of the first `most` segments, in order, that kept their source in part; the source is cut as the report has it."""
    bad = translated.where(~F.col("ok")).select("doc", "seg_id", "why", F.left("text", F.lit(chars)).alias("source"))
    return bad.orderBy("doc", "seg_id").limit(most)
