"""Streams against the same operators over whole tables."""

import time

import pandas as pd
from pyspark.sql import functions as F

from leafmill.operators import guards
from leafmill.streaming import guards as streamed
from leafmill.streaming.progress import Progress


def test_running_guards_equal_the_batch_guards(spark, tmp_path):
    src, log = str(tmp_path / "in"), spark.range(300).select((F.col("id") % 7).alias("job"), F.col("id").alias("seq"), (F.col("id") * 37 % 900).alias("tokens"), (F.col("id") % 5 == 0).alias("progress"))
    for k in range(3):  # three micro-batches, in order
        log.where(f"seq div 100 = {k}").coalesce(1).write.mode("append").json(src)
        time.sleep(1.1)  # files are taken by their times
    seen = []
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("job long, seq long, tokens long, progress boolean").option("maxFilesPerTrigger", 1).json(src)
        out = streamed.running(stream, "job", "seq", 12, 12000, 6)
        run = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: seen.extend((n, *r) for r in df.collect())).start()
        run.awaitTermination()
        time.sleep(2)
    finally:
        spark.streams.removeListener(listener)
    got = pd.DataFrame(seen, columns=["batch", "job", "requests", "tokens", "stall", "why"]).sort_values("batch").groupby("job").last()
    want = guards.budget(log, "job", "seq", 12, 12000, 6).toPandas().set_index("job")
    assert got["why"].dropna().to_dict() == want["why"].to_dict() and len(want)
    job = listener.jobs[str(run.id)]
    assert job["state"] == "done" and job["rows"] == 300 and job["batches"] >= 3
