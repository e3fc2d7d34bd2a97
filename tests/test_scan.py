"""Parallel scans against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import guards
from leafmill.operators.scan import scan


def plain(rows):
    out, now = [], {}
    for s, k, v in sorted(rows, key=lambda r: (r[0], r[1])):
        n, total = now.get(s, (0, 0))
        out.append((s, k, v, n, total))
        now[s] = (n + 1, total + (v or 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 1500])
def test_segments(spark, hot):
    r = random.Random(hot)
    rows = [(f"s{r.randint(0, 40)}", k, r.choice([None, -3, 5, 10])) for k in range(1500)] + [("s20", k, 2) for k in range(1500, 1500 + hot)]
    df = spark.createDataFrame(rows, "s string, k int, v long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan(df, ["k"], "s", ["v"])
        assert got.columns == ["s", "k", "v", "nth", "v_before"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
        whole = scan(df.withColumn("extra", F.lit(1)), [F.desc("k")], drop=["extra"]).collect()
        assert [r["nth"] for r in sorted(whole, key=lambda r: -r["k"])] == list(range(len(rows)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert scan(df.where("false"), ["k"], "s", ["v"]).count() == 0


@pytest.mark.parametrize("partitions", [1, 6])
def test_guards_over_a_hot_job(spark, partitions):
    r = random.Random(partitions)
    rows = [(0 if r.random() < 0.6 else r.randint(1, 30), i, r.choice([0, 5, None]), r.choice([True, False, False, False, None])) for i in range(6000)]
    rows += [(None, i, 1, False) for i in range(20)]
    df = spark.createDataFrame(rows, "job int, seq long, tokens int, progress boolean").repartition(5)
    runs, stops, used = {}, {}, {}
    for job, seq, tokens, progress in sorted(rows, key=lambda x: x[1]):
        n, total, stall = used.get(job, (0, 0, 0))
        why = "requests" if n >= 150 else "output_tokens" if total >= 200 else "stall" if stall >= 9 else None
        if why and job not in stops:
            stops[job] = (job, seq, why)
        stall = 0 if progress else stall + 1
        used[job] = (n + 1, total + (tokens or 0), stall)
        runs[(job, seq)] = stall
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = guards.run_length(df, "job", "seq", F.col("progress"), "stall")
        assert got.columns == ["job", "seq", "tokens", "progress", "stall"]
        assert {(x["job"], x["seq"]): x["stall"] for x in got.collect()} == runs
        assert sorted(map(tuple, guards.budget(df, "job", "seq", 150, 200, 9).collect()), key=str) == sorted(stops.values(), key=str)
        assert guards.budget(df.where("false"), "job", "seq", 1, 1, 1).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
