"""Connected components of a links table, without any of it passing through the driver.

Partition-local union-find first shrinks the links to forests; then rounds of large-star and small-star contraction
(Kiveris et al., "Connected Components in MapReduce and Beyond") make every vertex point at the smallest vertex of its component.
Each round is written to the shared folder. A vertex of many links is aggregated (min, which combines before the shuffle), and its links meet what is
known of it by join_one: they stay where they are, so a star of any size fills no task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_one, materialize, release


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) reduced, within each partition and batch, to a spanning forest's (vertex, root) links, root < vertex."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            parent: dict[int, int] = {}

            def root(x: int, parent=parent) -> int:
                top = x
                while parent.get(top, top) != top:
                    top = parent[top]
                while parent.get(x, x) != top:
                    parent[x], x = top, parent[x]
                return top

            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            made = [(x, root(x)) for x in parent]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.int64()), pa.array([y for _, y in made], pa.int64())], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): every vertex of links (a, b; no nulls) with the smallest vertex of its component.

    Rounds go on until nothing is left to move: their number grows with the logarithm of the longest path, and is not limited."""
    now = materialize(forest(links).where("a != b").distinct(), "links")
    while True:
        # large star: neighbours greater than u move to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        low = materialize(low, "low")
        large = join_one(both, low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = materialize(large.distinct(), "large")
        release(low)
        # small star: smaller neighbours of u, and u itself, move to the smallest of them
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        moved = join_one(large, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        new = materialize(small, "links")
        release(low, large)
        # done when every vertex has one link and no root has any
        tall = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        deep = 0 if tall else new.join(new.select(F.col("a").alias("r")), F.col("b") == F.col("r"), "left_semi").limit(1).count()
        release(now)
        now = new
        if not tall and not deep:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
