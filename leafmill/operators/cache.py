"""The content-keyed cache: first-wins loading, lookups, audits, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trustworthy, usable


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregation that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_k(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows by order of each class: every task keeps k of a class at most before the shuffle (a rank's limit is pushed below it)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def load_cache(lines: DataFrame, target: str, version: int = 1) -> DataFrame:
    """(k, t): lines (n, k, t, v) of the right version, the first of each key, then only usable ones: an unusable first
    line hides later lines of its key (P11, A8, P8)."""
    kept = first_wins(lines.where((F.col("v") == version) & F.col("k").isNotNull() & F.col("t").isNotNull()), ["k"], ["n"])
    return kept.where(usable(F.col("t"), target)).select("k", "t")


def lookup(segments: DataFrame, cache: DataFrame, key: Column, echo: Column) -> DataFrame:
    """Segments with hit, rejected (a hit that echoes its source) and the cached text."""
    joined = segments.withColumn("_key", key).join(cache.select(F.col("k").alias("_key"), F.col("t").alias("cached")), "_key", "left")
    rejected = F.col("cached").isNotNull() & echo
    return joined.withColumn("state", F.when(F.col("cached").isNull(), "miss").when(rejected, "rejected_cache").otherwise("hit")).drop("_key")


def pending(images: DataFrame, done: DataFrame) -> DataFrame:
    """Images (key) that the checkpoint doesn't have."""
    return images.join(done.select("key"), "key", "left_anti")


def audit(lines: DataFrame, target: str) -> DataFrame:
    """One row of counts: total, good, bad, legacy (without version)."""
    good = trustworthy(F.col("t"), target)
    return lines.agg(F.count("*").alias("total"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.count_if(F.col("v").isNull()).alias("legacy"))


def samples(lines: DataFrame, target: str, order: list[str], good: int = 3, bad: int = 6) -> DataFrame:
    """The first trustworthy and the first other lines by order, with is_good."""
    judged = lines.withColumn("is_good", F.coalesce(trustworthy(F.col("t"), target), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("is_good").orderBy(*order))
    return judged.withColumn("_rank", rank).where(F.col("_rank") <= max(good, bad)).where(F.col("_rank") <= F.when(F.col("is_good"), good).otherwise(bad)).drop("_rank")


def clean(lines: DataFrame, target: str) -> DataFrame:
    """Lines worth keeping."""
    return lines.where(trustworthy(F.col("t"), target))


def running(partition: list[str], order: list[str]):
    """All rows up to the current one."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
