"""Rectangles on pages: areas, overlaps, zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zones of a page, row by row.
ZONES = ["top-left", "top", "top-right", "middle-left", "center", "middle-right", "bottom-left", "bottom", "bottom-right"]


def area(r: str) -> Column:
    """a rectangle's area, 0 where it is turned inside out. r: prefix of x0, y0, x1, y1."""
    return F.greatest(F.col(f"{r}x1") - F.col(f"{r}x0"), F.lit(0.0)) * F.greatest(F.col(f"{r}y1") - F.col(f"{r}y0"), F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """the area of two rectangles' intersection."""
    w = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    h = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def zone(width: float, height: float) -> Column:
    """the ninth of the page that holds the centre of x0, y0, x1, y1."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2

    def third(v: Column, size: float) -> Column:
        return F.when(v < size / 3, 0).when(v < 2 * size / 3, 1).otherwise(2)

    return F.element_at(F.array(*map(F.lit, ZONES)), third(cy, height) * 3 + third(cx, width) + 1)


def is_candidate(width: float, height: float) -> Column:
    """Bitmaps of 30 points a side, drawings of 40, covering a hundredth to 0.72 of the page."""
    side = F.when(F.col("is_drawing"), 40).otherwise(30)
    big = (F.col("x1") - F.col("x0") >= side) & (F.col("y1") - F.col("y0") >= side)
    share = area("") / (width * height)
    return big & (share >= 0.01) & (share <= 0.72)
