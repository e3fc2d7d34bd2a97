"""The append-only checkpoint as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_results(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A streaming frame of JSON lines, the first arrival of each key."""
    return spark.readStream.schema(schema).json(path).dropDuplicates([key])


def arrivals(spark: SparkSession, path: str, schema) -> DataFrame:
    """A streaming frame of Parquet files: those of a folder, or a single one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def first_of(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Per key its first row by order, kept up to date: one small state a key. Run it in complete mode."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])


def run_complete(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Handles what has arrived; out (Parquet) holds the whole result after it."""
    query = stream.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Handles what has arrived, appends it to out (Parquet), remembers in checkpoint where it stopped."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
