"""The guards' running state over a stream of requests, one small state per job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "requests long, tokens long, stall long, why string"


def running(log: DataFrame, job: str, order: str, max_requests: int, max_tokens: int, stall_limit: int) -> DataFrame:
    """Streaming log (job, order, tokens, progress) to (job, requests, tokens, stall, why): each job's counters after every
    micro-batch that has requests of it, and the guard that stopped it (null while it runs).

    Requests of a job come in order within a micro-batch; a stopped job's later requests aren't counted. The result's last row
    of a job agrees with operators.guards.budget over the whole log."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        requests, tokens, stall, why = state.get if state.exists else (0, 0, 0, None)
        rows = pd.concat(list(frames)).sort_values(order)
        for used, progress in zip(rows["tokens"], rows["progress"], strict=True):
            why = why or ("requests" if requests >= max_requests else "output_tokens" if tokens >= max_tokens else "stall" if stall >= stall_limit else None)
            if why:
                break
            requests, tokens, stall = requests + 1, tokens + int(used), 0 if progress else stall + 1
        state.update((requests, tokens, stall, why))
        yield pd.DataFrame({job: [key[0]], "requests": [requests], "tokens": [tokens], "stall": [stall], "why": [why]})

    kind = log.schema[job].dataType.simpleString()
    return log.select(job, order, "tokens", "progress").groupBy(job).applyInPandasWithState(step, f"{job} {kind}, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)
