"""Request logs: guards, runs of failures, counters, error classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import guards as ops
from . import query

_LOG = "log AS (SELECT user_id AS job, event_id AS seq, (event_id * 37 % 900)::BIGINT AS tokens, event_type <> 'click' AND event_id % 3 = 0 AS progress FROM events)"


def _log(read):
    e = read("events")
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 900).alias("tokens"), ((F.col("event_type") != "click") & (F.col("event_id") % 3 == 0)).alias("progress"))


@query(f"""WITH {_LOG}, i AS (SELECT *, sum(progress::INT) OVER (PARTITION BY job ORDER BY seq) AS isl FROM log), s AS (SELECT *, sum((NOT progress)::INT) OVER (PARTITION BY job, isl ORDER BY seq) AS stall FROM i)
SELECT job, seq, stall::BIGINT AS stall FROM s""")
def w8_stall_runs(read):
    return ops.run_length(_log(read), "job", "seq", F.col("progress"), "stall").select("job", "seq", F.col("stall").cast("long").alias("stall"))


@query(f"""WITH {_LOG}, i AS (SELECT *, sum(progress::INT) OVER (PARTITION BY job ORDER BY seq) AS isl FROM log), s AS (SELECT *, sum((NOT progress)::INT) OVER (PARTITION BY job, isl ORDER BY seq) AS stall FROM i),
g AS (SELECT *, count(*) OVER w AS n, coalesce(sum(tokens) OVER w, 0) AS t, coalesce(lag(stall) OVER (PARTITION BY job ORDER BY seq), 0) AS st FROM s WINDOW w AS (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, CASE WHEN n >= 12 THEN 'requests' WHEN t >= 4000 THEN 'output_tokens' WHEN st >= 6 THEN 'stall' END AS why FROM g)
SELECT job, min(seq) AS stopped_at, arg_min(why, seq) AS why FROM y WHERE why IS NOT NULL GROUP BY job""")
def c1_guard_trip(read):
    return ops.budget(_log(read), "job", "seq", 12, 4000, 6)


@query(f"WITH {_LOG} SELECT job, count(*)::BIGINT AS requests, sum(tokens)::BIGINT AS output_tokens, count(*) FILTER (progress)::BIGINT AS translated, count(*) FILTER (NOT progress)::BIGINT AS skipped, round_even(100.0 * count(*) FILTER (NOT progress) / count(*), 1) AS skipped_percent FROM log GROUP BY job")
def a13_run_counters(read):
    n = F.count_if(~F.col("progress"))
    return _log(read).groupBy("job").agg(F.count("*").alias("requests"), F.sum("tokens").alias("output_tokens"), F.count_if("progress").alias("translated"), n.alias("skipped"), F.bround(n * 100.0 / F.count("*"), 1).alias("skipped_percent"))


@query("""SELECT event_id, CASE WHEN code IN (401, 402, 403) OR contains(msg, 'balance') OR contains(msg, 'unauthorized') THEN 'auth' WHEN code IN (429, 500, 502, 503, 504) THEN 'retry' ELSE 'fail' END AS class
FROM (SELECT event_id, (CASE event_id % 6 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 400 WHEN 4 THEN 404 ELSE 402 END) AS code, CASE WHEN event_id % 12 = 3 THEN 'insufficient balance' ELSE 'x' END AS msg FROM events)""")
def p12_http_class(read):
    k = F.col("event_id") % 6
    code = F.when(k == 0, 401).when(k == 1, 429).when(k == 2, 503).when(k == 3, 400).when(k == 4, 404).otherwise(402)
    return read("events").select("event_id", fx.http_class(code, F.when(F.col("event_id") % 12 == 3, "Insufficient Balance").otherwise("x")).alias("class"))


@query("SELECT k, sum(v)::BIGINT AS total FROM (SELECT unnest(['prompt_tokens', 'completion_tokens']) AS k, unnest([event_id, event_id % 7]) AS v FROM events) GROUP BY k")
def a1_usage_totals(read):
    """Sums per key of usage maps, whatever keys they have."""
    m = F.create_map(F.lit("prompt_tokens"), "event_id", F.lit("completion_tokens"), F.col("event_id") % 7)
    return read("events").select(F.explode(m).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("total"))


@query("SELECT event_id, left(event_type || '-' || event_id, 300) AS why FROM events WHERE event_id % 5 = 0 ORDER BY event_id LIMIT 500")
def o6_failure_report(read):
    """The first 500 failures, texts cut to 300 characters: the report's own limits."""
    failed = read("events").where("event_id % 5 = 0").select("event_id", F.substring(F.concat_ws("-", "event_type", "event_id"), 1, 300).alias("why"))
    return failed.orderBy("event_id").limit(500)


@query("SELECT user_id, max(event_id) AS newest, count(*)::BIGINT AS jobs FROM events GROUP BY user_id ORDER BY newest DESC LIMIT 60")
def o8_newest_jobs(read):
    """The 60 newest jobs stay in the table."""
    return read("events").groupBy("user_id").agg(F.max("event_id").alias("newest"), F.count("*").alias("jobs")).orderBy(F.desc("newest")).limit(60)


@query("SELECT event_type, avg((value > 50)::INT) AS accuracy FROM events GROUP BY event_type")
def a14_accuracy(read):
    return read("events").groupBy("event_type").agg(F.avg((F.col("value") > 50).cast("int")).alias("accuracy"))


@query("SELECT event_type AS k, min(event_id) AS first FROM events GROUP BY event_type")
def t1_stream_first_results(read):
    """The checkpoint as a stream: each key's first result, from what has arrived so far."""
    from ..sources import tables
    from ..streaming import checkpoints

    events = read("events")
    spark = events.sparkSession
    stream = checkpoints.arrivals(spark, f"{read.folder}/events.parquet", events.schema).select(F.col("event_type").alias("k"), F.col("event_id").alias("first"))
    out = tables.new_path(spark, "first")
    checkpoints.run_complete(checkpoints.first_of(stream.withColumn("order", F.col("first")), "k", "order"), out, tables.new_path(spark, "progress"))
    return spark.read.parquet(out).select("k", "first")


@query("SELECT event_id, CASE WHEN event_id % 7 > 0 AND event_id % 50 > event_id % 7 THEN round_even((event_id % 50 - event_id % 7) * elapsed / (event_id % 9 + 1) / 60, 1) END AS minutes FROM (SELECT event_id, event_id % 977 + 0.5::DOUBLE AS elapsed FROM events)")
def w10_minutes_left(read):
    from ..streaming.progress import minutes_left

    n = lambda k: F.col("event_id") % k
    return read("events").select("event_id", minutes_left(n(977) + F.lit(0.5), n(9) + 1, n(7), n(50)).alias("minutes"))
