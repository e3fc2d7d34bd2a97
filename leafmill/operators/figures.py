"""Figure candidates on pages, and figures matched to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry


def suppress(rects: DataFrame) -> DataFrame:
    """Largest first, a rectangle goes if a kept one covers more than 0.7 of it. rects: (page_no, cand_idx, x0, y0, x1, y1).

    Pages hold few rectangles; the overlaps come from a join within the page, the greedy choice is a fold over one page's array."""
    r = rects.withColumn("area", geometry.area(""))
    a = r.select("page_no", *[F.col(c).alias(f"a_{c}") for c in ("cand_idx", "x0", "y0", "x1", "y1", "area")])
    b = r.select("page_no", *[F.col(c).alias(f"b_{c}") for c in ("cand_idx", "x0", "y0", "x1", "y1", "area")])
    before = (F.col("b_area") > F.col("a_area")) | ((F.col("b_area") == F.col("a_area")) & (F.col("b_cand_idx") < F.col("a_cand_idx")))
    edges = a.join(b, "page_no").where(before & (geometry.overlap("a_", "b_") > F.col("a_area") * 0.7)).groupBy("page_no", F.col("a_cand_idx").alias("cand_idx")).agg(F.collect_list("b_cand_idx").alias("covers"))
    full = r.join(edges, ["page_no", "cand_idx"], "left")
    item = F.struct((-F.col("area")).alias("o"), F.col("cand_idx").alias("i"), F.coalesce("covers", F.array().cast("array<bigint>")).alias("covers"))
    pages = full.groupBy("page_no").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kept = F.aggregate("items", F.array().cast("array<bigint>"), lambda acc, x: F.when(F.arrays_overlap(acc, x["covers"]), acc).otherwise(F.array_append(acc, x["i"])))
    return r.join(pages.select("page_no", F.explode(kept).alias("cand_idx")), ["page_no", "cand_idx"], "left_semi").select(*rects.columns)


def reading_order(rects: DataFrame, most: int = 8) -> DataFrame:
    """O1, O3: the first `most` of a page by rounded y, rounded x (half to even), with their rank from 0."""
    w = Window.partitionBy("page_no").orderBy(F.bround("y0"), F.bround("x0"), F.col("area").desc() if "area" in rects.columns else F.lit(0), "cand_idx")
    return rects.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most)


def candidates(rects: DataFrame, width: float, height: float, most: int = 8) -> DataFrame:
    """A page's figure candidates (P6), without covered ones (J6), the first `most` in reading order (O1, O3), with zones.

    rects: bitmaps and drawings as one (U2): (page_no, cand_idx, x0, y0, x1, y1, is_drawing)."""
    kept = suppress(rects.where(geometry.is_candidate(width, height))).withColumn("area", geometry.area(""))
    return reading_order(kept, most).withColumn("zone", geometry.zone(width, height))


def match(figures: DataFrame, candidates: DataFrame) -> DataFrame:
    """(page_no, n, cand_idx, how). Figures take candidates of their zone in order; the rest are paired by order.

    Zones don't overlap, so first-unused in order is equal rank on both sides."""

    def ranked(df: DataFrame, by: list[str], order: str) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order)))

    f, c = figures.select("page_no", "n", "pos"), candidates.select("page_no", "cand_idx", "zone")
    by_zone = ranked(f, ["page_no", "pos"], "n").join(ranked(c, ["page_no", "zone"], "cand_idx").withColumnRenamed("zone", "pos"), ["page_no", "pos", "_r"]).select("page_no", "n", "cand_idx", F.lit("zone").alias("how"))
    rest_f = f.join(by_zone.select("page_no", "n"), ["page_no", "n"], "left_anti")
    rest_c = c.join(by_zone.select("page_no", "cand_idx"), ["page_no", "cand_idx"], "left_anti")
    by_order = ranked(rest_f, ["page_no"], "n").join(ranked(rest_c, ["page_no"], "cand_idx"), ["page_no", "_r"]).select("page_no", "n", "cand_idx", F.lit("order").alias("how"))
    return by_zone.unionByName(by_order)
