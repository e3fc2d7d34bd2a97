"""Progress of streaming runs, kept where a caller can ask for it, and the time that is left."""

from __future__ import annotations

import time

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def minutes_left(elapsed: Column, requests: Column, done: Column, total: Column) -> Column:
    """Minutes that the remaining batches take at the pace so far (seconds a request), to one decimal; null where nothing is left or
    nothing is known yet."""
    left = (total - done) * elapsed / requests / 60
    return F.when((requests > 0) & (done > 0) & (left > 0), F.bround(left, 1))


class Progress(StreamingQueryListener):
    """By query id: state (running, done or error), rows read, micro-batches, error. Register it with spark.streams.addListener."""

    def __init__(self):
        self.jobs: dict[str, dict] = {}

    def _job(self, event_id) -> dict:
        return self.jobs.setdefault(str(event_id), {"state": "running", "rows": 0, "batches": 0, "error": None, "since": time.time()})

    def minutes_left(self, event_id, total: int) -> float | None:
        """W10 for a query of `total` micro-batches."""
        job = self._job(event_id)
        left = (total - job["batches"]) * (time.time() - job["since"]) / max(job["batches"], 1) / 60
        return round(left, 1) if job["batches"] and left > 0 else None

    def onQueryStarted(self, event):
        self._job(event.id)

    def onQueryProgress(self, event):
        job = self._job(event.progress.id)
        job["rows"] += event.progress.numInputRows
        job["batches"] += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        job = self._job(event.id)
        job["error"] = event.exception
        job["state"] = "error" if event.exception else "done"
