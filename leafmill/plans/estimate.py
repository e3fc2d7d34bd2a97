"""What a run would take, from pieces and batches alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cost

#: Requests of a batch at worst, tokens a request may answer with.
WORST, OUTPUT_LIMIT = 4, 8192


def plan(pieces: DataFrame, id_col: str) -> DataFrame:
    """One row. pieces: (id_col, k, batch, text). Documents are batched each for itself, as a run does."""
    d = pieces.groupBy(id_col).agg(F.count("*").alias("pieces"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("chars"), (F.max("batch") + 1).alias("batches"))
    t = d.agg(
        F.count("*").alias("segments"), F.sum("pieces").alias("pieces"), F.sum("batches").cast("long").alias("batches"), F.sum("chars").alias("chars"),
        F.max("longest").cast("long").alias("max_piece"), F.max("chars").alias("max_segment"),
    )
    t = t.withColumns({"requests_worst": F.col("batches") * WORST, "input_tokens": F.expr("(chars * 9) div 10 + 500 * batches"), "output_tokens": F.expr("(chars * 11) div 10"), "output_limit": F.col("batches") * OUTPUT_LIMIT})
    low = cost(F.col("input_tokens"), F.col("output_tokens"))
    return t.withColumns({"cost_low": low, "cost_high": low * 2})
