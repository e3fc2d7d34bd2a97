"""Paid requests in rounds: what is asked together is one job, and what it finds out decides about the next one.

The plan is a written table of batches, a row each, numbered in order. A round takes the next few requests, sends each once, and writes
what came back before anything else happens; so limits hold over the whole job and not per task, a batch lies in one row and is never cut,
an error is a row and never a failed task, and only an executor that is lost within a round can send a request again. Follow-ups
(halves, single texts) go before the plan's next batches. A round starts with one request and doubles as long as answers come
in; after a failure it is down to one, so a service that is down or refuses the account costs a request, not a cluster's worth of them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, prompts
from ..functions.echo import is_echo
from ..functions.text import RETRY_CODES, is_auth_error
from ..operators import align
from ..sources import tables

#: A plain backend takes the texts of one batch and returns as many answers, None where there is none; or those and the number of output
#: tokens that they took. Errors: PermissionError (the account is refused), TimeoutError, ConnectionError, ServiceError.
Backend = Callable[[list[str]], list[str | None] | tuple[list[str | None], int]]
#: Halvings of a batch, tokens that a request may answer with.
DEPTH, ANSWER_TOKENS = 4, 8192
#: Outcomes of requests that brought an answer to judge.
JUDGED = ("ok", "length")


class ServiceError(Exception):
    """A service's error: its HTTP status (0 where there is none) and what it says."""

    def __init__(self, code: int = 0, message: str = ""):
        super().__init__(f"HTTP {code}: {message}" if code else message)
        self.code, self.message = code, message


@dataclass(frozen=True)
class Chat:
    """A backend that speaks with a chat model: call(prompt, fields) gives (content, output tokens, finish reason).

    fields (C12): json (ask for a JSON object), thinking ("disabled", "enabled", "auto"), max_tokens. Prompts and the reading of answers are
    the engine's: answers are matched by id, else by place."""

    call: Callable[[str, dict], tuple[str, int, str]]
    thinking: str = "disabled"
    max_tokens: int = ANSWER_TOKENS


@dataclass(frozen=True)
class Limits:
    """Guards of a whole job, and how a request is tried: attempts with pauses (2 ** n seconds times `pause`, 30 at most) on errors that
    pass; time-outs, whose answer may be paid for already, only if asked for. together: requests of a round at most."""

    max_requests: int = 1 << 60
    max_tokens: int = 1 << 60
    stall_limit: int = 25
    failure_limit: int = 5
    attempts: int = 3
    pause: float = 1.0
    retry_timeouts: bool = False
    together: int | None = None


@dataclass
class Run:
    """What a job has used, and why it stopped (None while it may go on)."""

    limits: Limits = field(default_factory=Limits)
    requests: int = 0
    tokens: int = 0
    stalled: int = 0
    failed: int = 0
    filled: int = 0
    json_mode: bool = True
    second: bool = True  # whether a single text has a second attempt, with thinking
    why: str | None = None
    detail: str = ""
    pace: int = 1

    def room(self) -> int:
        """Requests that the next round may send; 0 where a guard stops the job."""
        x = self.limits
        if self.why is None:
            self.why = "requests" if self.requests >= x.max_requests else "output_tokens" if self.tokens >= x.max_tokens else "stall" if self.stalled >= x.stall_limit else None
        if self.why is not None:
            return 0
        room = min(self.pace, x.max_requests - self.requests, x.together or 1 << 30)
        if self.tokens:  # no more than what is left of the tokens would pay for, by what requests took so far
            room = min(room, max((x.max_tokens - self.tokens) * self.requests // self.tokens, 1))
        return room

    def note(self, kind: str, mode: str, tokens: int, filled: int, detail: str = "") -> None:
        """One request's outcome, in the order of the plan."""
        self.requests, self.tokens, self.filled = self.requests + 1, self.tokens + tokens, self.filled + filled
        if kind == "auth":
            self.why, self.detail = "auth", detail
        elif kind == "transport":
            self.failed, self.detail = self.failed + 1, detail
            self.why = self.why or ("failures" if self.failed >= self.limits.failure_limit else None)
        elif kind == "json_mode":
            self.json_mode = False
        elif filled:
            self.stalled = self.failed = 0
        elif not (mode == "batch" and kind == "length") and not (mode == "single" and self.second and kind in JUDGED):
            self.stalled += 1  # a cut batch is a matter of size; a single text's second attempt is to come

    def paced(self, bad: bool) -> None:
        self.pace = 1 if bad else min(self.pace * 2, 1 << 30)


def once(backend, texts: list[str], prompt: str | None, fields: dict, limits: Limits) -> dict:
    """One request, tried as the limits say: kind (ok, length, transport, auth, json_mode, error), answers or content, tokens, detail."""
    out = {"kind": "ok", "answers": None, "content": None, "tokens": 0, "detail": ""}
    for attempt in range(1, max(limits.attempts, 1) + 1):
        again = False
        try:
            if isinstance(backend, Chat):
                content, tokens, finish = backend.call(prompt, fields)
                return out | {"kind": "length" if finish == "length" else "ok", "content": content or "", "tokens": int(tokens or 0)}
            got = backend(texts)
            found, tokens = got if isinstance(got, tuple) else (got, 0)
            return out | {"answers": ([*found] + [None] * len(texts))[: len(texts)], "tokens": int(tokens or 0)}
        except PermissionError as e:
            return out | {"kind": "auth", "detail": str(e)}
        except TimeoutError as e:
            out["kind"], out["detail"], again = "transport", f"timeout: {e}", limits.retry_timeouts
        except ConnectionError as e:
            out["kind"], out["detail"], again = "transport", str(e), True
        except ServiceError as e:
            low = e.message.lower()
            if is_auth_error(e.code, low):
                return out | {"kind": "auth", "detail": str(e)}
            if "response_format" in low or ("json" in low and "support" in low):
                return out | {"kind": "json_mode" if fields.get("json") else "error", "detail": str(e)}
            if not e.code:
                return out | {"kind": "error", "detail": str(e)}
            out["kind"], out["detail"], again = "transport", str(e), e.code in RETRY_CODES
        except Exception as e:  # whatever else a backend raises is this request's error, not the job's
            return out | {"kind": "error", "detail": f"{type(e).__name__}: {e}"}
        if not again or attempt == max(limits.attempts, 1):
            break
        time.sleep(limits.pause * min(2**attempt, 30))
    return out


def _requests(waiting: DataFrame, target: str, backend, run: Run) -> DataFrame:
    """waiting (pos, path, depth, mode, items) with what came back: each row is one request."""
    single = F.col("mode") != "batch"
    if isinstance(backend, Chat):
        items = F.transform("items", lambda x: F.struct(F.concat_ws(":", x["seg_id"].cast("string"), x["k"].cast("string")).alias("id"), x["text"].alias("text"), x["context"].alias("context")))
        waiting = waiting.withColumn("prompt", F.when(single, prompts.single_prompt(F.col("items")[0]["text"], target)).otherwise(prompts.batch_prompt(items, target)))
    else:
        waiting = waiting.withColumn("prompt", F.lit(None).cast("string"))
    limits, json_mode = run.limits, run.json_mode

    def call(frames):
        import pyarrow as pa

        for b in frames:
            for i in range(b.num_rows):  # a row at a time: an answer is handed on as soon as it is there
                row = b.slice(i, 1)
                texts = [x["text"] for x in row.column("items")[0].as_py()]
                mode = row.column("mode")[0].as_py()
                fields = {"json": json_mode and mode == "batch"}
                if isinstance(backend, Chat):
                    fields |= {"thinking": "enabled" if mode == "thinking" else backend.thinking, "max_tokens": backend.max_tokens}
                got = once(backend, texts, row.column("prompt")[0].as_py(), fields, limits)
                made = [pa.array([got["kind"]]), pa.array([got["answers"]], pa.list_(pa.string())), pa.array([got["content"]], pa.string()), pa.array([got["tokens"]], pa.int64()), pa.array([got["detail"]])]
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in kept], *made], [*kept, "kind", "answers", "content", "tokens", "detail"])

    kept = ["pos", "path", "depth", "mode", "items"]
    schema = ", ".join(f"{c} {waiting.schema[c].dataType.simpleString()}" for c in kept)
    return waiting.select(*kept, "prompt").mapInArrow(call, f"{schema}, kind string, answers array<string>, content string, tokens long, detail string")


def _judged(came: DataFrame, target: str) -> DataFrame:
    """came with checked: per item seg_id, k, text, out (null where rejected), answer, why."""
    found = answers.translations(F.col("content"))

    def of(item: Column, at: Column) -> Column:
        key = F.concat_ws(":", item["seg_id"].cast("string"), item["k"].cast("string"))
        by_id = F.try_element_at(F.filter(F.col("found"), lambda t: t["id"] == key), F.lit(-1))["text"]
        by_place = F.get(F.col("found"), at)["text"]
        spoken = F.when(F.col("mode") == "batch", F.coalesce(by_id, by_place)).otherwise(answers.single_answer(F.col("content")))
        return F.struct(item["seg_id"].alias("seg_id"), item["k"].alias("k"), item["text"].alias("text"), item["context"].alias("context"), F.when(F.col("answers").isNotNull(), F.get("answers", at)).otherwise(spoken).alias("answer"))

    flat = came.withColumn("found", F.when(F.size("items") > 0, F.coalesce(found, F.expr("cast(array() as array<struct<ordinal:int,id:string,text:string>>)"))))
    flat = flat.select("pos", "path", "depth", "mode", "kind", F.posexplode(F.transform("items", of)).alias("at", "x")).select("pos", "path", "depth", "mode", "kind", "at", "x.*")
    why = F.when(F.col("kind").isin("ok", "length"), align.reason(F.col("answer"), F.when(F.col("kind") == "length", "length").otherwise("stop"), is_echo(F.col("text"), F.col("answer")), target)).otherwise(F.concat(F.lit("未译: "), "kind"))
    return flat.withColumn("why", why).withColumn("out", F.when(F.col("why").isNull(), F.col("answer")))


def _follow_ups(judged: DataFrame, second: bool) -> DataFrame:
    """What is asked next (pos, path, depth, mode, items): C4 the batch again, C5 halves of what is missing (all of it where the answer was
    cut), then single texts, C6 a single text whose answer was rejected once more with thinking (second), if it was not on already. Transport failures,
    and errors on single texts, aren't followed up."""
    left = judged.where("out is null and kind not in ('transport', 'auth')")
    rows = left.groupBy("pos", "path", "depth", "mode", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "seg_id", "k", "text", "context"))), lambda x: F.struct(*[x[c].alias(c) for c in ("seg_id", "k", "text", "context")])).alias("items"))
    n, half = F.size("items"), F.floor(F.size("items") / 2).cast("int")
    request = lambda step, depth, mode, items: F.struct(F.concat("path", F.lit(step)).alias("path"), depth.alias("depth"), F.lit(mode).alias("mode"), items.alias("items"))
    halves = F.array(request(".0", F.col("depth") + 1, "batch", F.slice("items", F.lit(1), half)), request(".1", F.col("depth") + 1, "batch", F.slice("items", half + 1, n)))
    singles = F.transform("items", lambda x, i: F.struct(F.concat("path", F.lit("."), F.lpad(i.cast("string"), 2, "0")).alias("path"), F.col("depth").alias("depth"), F.lit("single").alias("mode"), F.array(x).alias("items")))
    again = F.when(F.col("kind") == "json_mode", F.array(request(".r", F.col("depth"), "batch", F.col("items"))))
    again = again.when((F.col("mode") == "single") & F.col("kind").isin(*JUDGED) & F.lit(second), F.array(request(".t", F.col("depth"), "thinking", F.col("items"))))
    again = again.when((F.col("mode") == "batch") & (n > 1) & (F.col("depth") < DEPTH), halves).when(F.col("mode") == "batch", singles)
    return rows.select("pos", F.explode(again).alias("x")).select("pos", "x.*")


def ask_all(batches: DataFrame, target: str, backend, limits: Limits | None = None) -> tuple[DataFrame, Run]:
    """Sends the batches (part, nth, items) of chunking.batched: (seg_id, k, text, out, answer, why) of every item, and the run.

    out is null where no answer was accepted; why then tells the last reason ("未译" where nothing was asked any more)."""
    spark = batches.sparkSession
    run = Run(limits or Limits(), second=not (isinstance(backend, Chat) and backend.thinking == "enabled"))
    plan = dealt = tables.written(batches, "batches")
    sizes = {r["part"]: r["n"] for r in plan.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map()
    numbered = plan.select((starts[F.col("part")] + F.col("nth")).cast("long").alias("pos"), "items") if before else plan.select(F.col("nth").alias("pos"), "items")
    plan_path = tables.new_path(spark, "plan")
    numbered.write.parquet(plan_path)
    plan = spark.read.parquet(plan_path)
    tables.release(dealt)
    fresh = plan.select("pos", F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit("batch").alias("mode"), "items")
    log = tables.new_path(spark, "answers")
    wide = (limits.together if limits and limits.together else None) or 32 * spark.sparkContext.defaultParallelism
    waiting, queued, at = None, 0, 0
    while (queued or at < total) and (room := min(run.room(), wide)):
        if queued:
            n = min(room, queued)
            taken = waiting.orderBy("pos", "path").limit(n) if n < queued else waiting
        else:
            n = min(room, total - at)
            taken = fresh.where((F.col("pos") >= at) & (F.col("pos") < at + n))
            at += n
        came = tables.written(_requests(taken.repartition(min(n, spark.sparkContext.defaultParallelism)), target, backend, run), "came")
        judged = _judged(came, target)
        judged.select("seg_id", "k", "pos", F.length("path").alias("step"), "out", "answer", "why").write.mode("append").parquet(log)
        filled = judged.groupBy("pos", "path").agg(F.count("out").alias("filled"))
        rows = came.select("pos", "path", "mode", "kind", "tokens", "detail").join(filled, ["pos", "path"]).collect()  # a small row a request, `together` at most
        before_, failed = run.filled, run.failed
        for r in sorted(rows, key=lambda r: (r["pos"], r["path"])):
            run.note(r["kind"], r["mode"], r["tokens"], r["filled"], r["detail"])
        run.paced(run.filled == before_ or run.failed > failed)
        rest = waiting.join(taken.select("pos", "path"), ["pos", "path"], "left_anti") if queued and n < queued else None
        more = _follow_ups(judged, run.second)
        before_ = waiting
        waiting = tables.written(more if rest is None else more.unionByName(rest.select(*more.columns)), "waiting")
        tables.release(came, before_)
        queued = waiting.count()
    tables.release(waiting)
    asked = spark.read.schema(f"seg_id {_seg_kind(batches)}, k int, pos long, step int, out string, answer string, why string").parquet(log) if run.requests else None
    items = plan.select(F.explode("items").alias("x")).select("x.seg_id", "x.k", "x.text")
    if asked is None:
        return items.withColumns({"out": F.lit(None).cast("string"), "answer": F.lit(None).cast("string"), "why": F.lit("未译")}), run
    last = asked.groupBy("seg_id", "k").agg(F.max("out").alias("out"), F.max_by(F.struct("answer", "why"), "step").alias("x"))
    got = items.join(last, ["seg_id", "k"], "left")
    return got.select("seg_id", "k", "text", "out", F.col("x.answer").alias("answer"), F.when(F.col("out").isNull(), F.coalesce("x.why", F.lit("未译"))).alias("why")), run


def _seg_kind(batches: DataFrame) -> str:
    return batches.schema["items"].dataType.elementType["seg_id"].dataType.simpleString()
