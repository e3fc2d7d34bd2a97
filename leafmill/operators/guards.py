"""Budgets and runs of failures over an ordered request log, by parallel scans: a job may hold any share of all requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scan


def _counted(log: DataFrame, job: str, order: str, broken: Column, sums: list[str]) -> DataFrame:
    """log with _n (its job's rows before), NAME_before for sums (what they add up to), _run (rows in a row before this one that aren't broken) and
    _broken (1 or 0). Two scans: along jobs, and along the stretches between broken rows that the first one has numbered."""
    keyed = log.withColumns({"_job": F.to_json(F.struct(F.col(job).alias("j"))), "_broken": F.coalesce(broken, F.lit(False)).cast("long")})
    along = scan(keyed, [order], "_job", ["_broken", *sums]).withColumnRenamed("nth", "_n")
    stretches = along.withColumn("_job", F.concat_ws(":", "_broken_before", "_job")).drop("_broken_before")
    return scan(stretches, [order], "_job").withColumnRenamed("nth", "_run").drop("_job")


def run_length(log: DataFrame, job: str, order: str, broken: Column, name: str) -> DataFrame:
    """How many rows in a row, up to this one, aren't `broken` (which resets to 0). A row of unknown state (null) isn't broken."""
    counted = _counted(log, job, order, broken, [])
    return counted.withColumn(name, F.when(F.col("_broken") == 1, 0).otherwise(F.col("_run") + 1)).select(*log.columns, name)


def budget(log: DataFrame, job: str, order: str, max_requests: int, max_tokens: int, stall_limit: int) -> DataFrame:
    """Per job, the first request that a guard stops and which guard it is (requests, output tokens, stall, in this order).

    log: (job, order, tokens, progress). Guards look at what earlier requests have used."""
    counted = _counted(log.withColumn("_tokens", F.col("tokens").cast("long")), job, order, F.col("progress"), ["_tokens"])
    why = F.when(F.col("_n") >= max_requests, "requests").when(F.col("_tokens_before") >= max_tokens, "output_tokens").when(F.col("_run") >= stall_limit, "stall")
    stopped = counted.withColumn("why", why).where("why is not null")
    return stopped.groupBy(job).agg(F.min_by(F.struct(order, "why"), order).alias("x")).select(job, F.col(f"x.{order}").alias("stopped_at"), "x.why")
