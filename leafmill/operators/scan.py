"""Running counts and sums along an order, in parallel: no segment is one task's, however many rows it has.

Rows are dealt into ranges of the order and sorted; each range counts and sums within its segments and says what its last segment has come to. Those
summaries, one a range, are added up in order on the driver, and what a segment had before a range is added to the range's first segment.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def scan(rows: DataFrame, order: Sequence[Column | str], segment: str | None = None, sums: Sequence[str] = (), drop: Sequence[str] = (), write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """rows, each with nth (rows before it in its segment) and, per column of sums, NAME_before (the sum over those rows).

    segment: a column (without nulls) whose rows of one value belong together; without it all rows are one segment. sums: long columns, nulls count
    as 0. drop: columns that the order needs but the result doesn't. write: writes the ranges to the shared folder and reads them back. Rows that are equal in all of order come in any order; no rows give none."""
    keys = [F.col(segment)] if segment else []
    ordered = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).drop(*drop)
    names, outs = ordered.columns, ["nth", *[f"{s}_before" for s in sums]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at, segments, last, carried = 0, 0, None, np.zeros(1 + len(sums), "i8")
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            if segment:
                own = b.column(names.index(segment))
                new[1:] = pc.not_equal(own.slice(1), own.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[0] = at > 0 and own[0].as_py() != last
                last = own[n - 1].as_py()
            begun = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # where a row's segment begins, -1: before the batch
            cols = []
            for k, values in enumerate([np.ones(n, "i8"), *[b.column(names.index(s)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8") for s in sums]]):
                before = np.cumsum(values) - values
                before = np.where(begun < 0, before + carried[k], before - before[begun])
                cols.append(before)
                carried[k] = before[-1] + values[-1]
            head = segments + np.cumsum(new) == 0
            segments += int(new.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, cols), pa.array(np.full(n, part, "i4")), pa.array(head), pa.array(np.arange(at, at + n))], [*names, *outs, "_part", "_head", "_at"])
            at += n

    made = write(ordered.mapInArrow(run, f"{kinds}, {', '.join(f'{o} long' for o in outs)}, _part int, _head boolean, _at long"), "scan")
    totals = [F.col("nth") + 1, *[F.col(f"{s}_before") + F.coalesce(F.col(s), F.lit(0)) for s in sums]]
    key = F.col(segment) if segment else F.lit(0)
    ends = made.groupBy("_part").agg(F.min_by(key, "_at").alias("first"), F.max_by(F.struct(key.alias("key"), "_head", *[t.alias(f"t{k}") for k, t in enumerate(totals)]), "_at").alias("last"))
    carry, so_far, owed = None, [0] * len(outs), []
    for r in ends.orderBy("_part").collect():  # a row a partition
        goes_on = carry is not None and r["first"] == carry[0]
        if goes_on and any(so_far):
            owed.append((r["_part"], *so_far))
        own = [r["last"][f"t{k}"] for k in range(len(outs))]
        so_far = [x + y for x, y in zip(so_far, own, strict=True)] if goes_on and r["last"]["_head"] else own
        carry = (r["last"]["key"],)
    if not owed:
        return made.drop("_part", "_head", "_at")
    more = made.sparkSession.createDataFrame(owed, f"_part int, {', '.join(f'_{o} long' for o in outs)}")
    full = made.join(F.broadcast(more), "_part", "left")  # as many rows as partitions at most
    added = {o: F.col(o) + F.when(F.col("_head"), F.coalesce(F.col(f"_{o}"), F.lit(0))).otherwise(0) for o in outs}
    return full.withColumns(added).drop("_part", "_head", "_at", *[f"_{o}" for o in outs])
