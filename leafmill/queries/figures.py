"""Page geometry: candidates, suppression, order, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import figures as ops
from . import query

#: Rectangles from order lines: six or so to a page of 600 x 800.
_RECTS = "rects AS (SELECT l_orderkey AS page_no, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS cand_idx, (l_partkey % 300)::DOUBLE AS x0, (l_suppkey % 400)::DOUBLE AS y0, (l_partkey % 300 + 20 + l_quantity * 6)::DOUBLE AS x1, (l_suppkey % 400 + 20 + (l_partkey % 50) * 7)::DOUBLE AS y1, l_returnflag = 'R' AS is_drawing FROM lineitem)"
_CAND = "cand AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM rects WHERE x1 - x0 >= CASE WHEN is_drawing THEN 40 ELSE 30 END AND y1 - y0 >= CASE WHEN is_drawing THEN 40 ELSE 30 END AND (x1 - x0) * (y1 - y0) / 480000 BETWEEN 0.01 AND 0.72)"
_ZONE = "(['top-left','top','top-right','middle-left','center','middle-right','bottom-left','bottom','bottom-right'])[(CASE WHEN (y0 + y1) / 2 < 800.0 / 3 THEN 0 WHEN (y0 + y1) / 2 < 1600.0 / 3 THEN 1 ELSE 2 END) * 3 + (CASE WHEN (x0 + x1) / 2 < 200 THEN 0 WHEN (x0 + x1) / 2 < 400 THEN 1 ELSE 2 END) + 1]"
_KEPT = f"""WITH RECURSIVE {_RECTS}, {_CAND}, s AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY area DESC, cand_idx) AS r FROM cand),
k(page_no, r, kept) AS (SELECT page_no, 1::BIGINT, [r] FROM s WHERE r = 1 UNION ALL
 SELECT s.page_no, s.r, CASE WHEN EXISTS (SELECT 1 FROM s o WHERE o.page_no = s.page_no AND list_contains(k.kept, o.r) AND greatest(least(s.x1, o.x1) - greatest(s.x0, o.x0), 0) * greatest(least(s.y1, o.y1) - greatest(s.y0, o.y0), 0) > s.area * 0.7) THEN k.kept ELSE list_append(k.kept, s.r) END FROM k JOIN s ON s.page_no = k.page_no AND s.r = k.r + 1),
f AS (SELECT page_no, kept FROM (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY r DESC) AS z FROM k) WHERE z = 1),
kept AS (SELECT s.* FROM s JOIN f ON s.page_no = f.page_no AND list_contains(f.kept, s.r))"""


def _rects(read):
    """A page is an order."""
    x, y = F.col("l_partkey") % 300, F.col("l_suppkey") % 400
    return read("lineitem").select(
        F.col("l_orderkey").alias("page_no"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("cand_idx"), x.cast("double").alias("x0"), y.cast("double").alias("y0"),
        (x + 20 + F.col("l_quantity") * 6).cast("double").alias("x1"), (y + 20 + (F.col("l_partkey") % 50) * 7).cast("double").alias("y1"), (F.col("l_returnflag") == "R").alias("is_drawing"),
    )


def _candidates(read):
    return _rects(read).where(geometry.is_candidate(600.0, 800.0))


@query(f"WITH {_RECTS}, {_CAND} SELECT page_no, cand_idx FROM cand")
def p6_figure_candidates(read):
    return _candidates(read).select("page_no", "cand_idx")


@query(f"WITH {_RECTS} SELECT page_no, cand_idx, {_ZONE} AS zone FROM rects")
def f9_zone(read):
    return _rects(read).select("page_no", "cand_idx", geometry.zone(600.0, 800.0).alias("zone"))


@query(_KEPT + " SELECT page_no, cand_idx FROM kept")
def j6_suppress(read):
    return ops.suppress(_candidates(read)).select("page_no", "cand_idx")


@query(f"WITH {_RECTS}, {_CAND} SELECT page_no, cand_idx, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY round_even(y0, 0), round_even(x0, 0), cand_idx) - 1 AS r FROM cand) WHERE r < 8")
def o3_reading_order(read):
    return ops.reading_order(_candidates(read)).select("page_no", "cand_idx", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_RECTS}, c AS (SELECT page_no, cand_idx, {_ZONE} AS zone FROM rects), f AS (SELECT page_no, 10 - cand_idx AS n, CASE WHEN cand_idx % 3 = 0 THEN '' WHEN cand_idx % 3 = 1 THEN 'center' ELSE zone END AS pos FROM c),
fr AS (SELECT *, row_number() OVER (PARTITION BY page_no, pos ORDER BY n) AS r FROM f), cr AS (SELECT *, row_number() OVER (PARTITION BY page_no, zone ORDER BY cand_idx) AS r FROM c),
z AS (SELECT fr.page_no, n, cand_idx, 'zone' AS how FROM fr JOIN cr ON fr.page_no = cr.page_no AND pos = zone AND fr.r = cr.r),
g AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY n) AS r FROM f ANTI JOIN z USING (page_no, n)), h AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY cand_idx) AS r FROM c ANTI JOIN z USING (page_no, cand_idx))
SELECT * FROM z UNION ALL SELECT g.page_no, n, cand_idx, 'order' FROM g JOIN h ON g.page_no = h.page_no AND g.r = h.r""")
def j4_j5_match(read):
    c = _rects(read).withColumn("zone", geometry.zone(600.0, 800.0))
    k = F.col("cand_idx") % 3
    f = c.select("page_no", (10 - F.col("cand_idx")).alias("n"), F.when(k == 0, "").when(k == 1, "center").otherwise(F.col("zone")).alias("pos"))
    return ops.match(f, c)


@query(f"WITH {_RECTS}, {_CAND} SELECT r.page_no, count(c.cand_idx)::BIGINT AS candidates FROM (SELECT DISTINCT page_no FROM rects) r LEFT JOIN cand c USING (page_no) GROUP BY r.page_no")
def j11_candidate_count(read):
    pages = _rects(read).select("page_no").distinct()
    n = _candidates(read).groupBy("page_no").agg(F.count("*").alias("candidates"))
    return pages.join(n, "page_no", "left").na.fill(0, ["candidates"])


@query(_KEPT + f", o AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY round_even(y0, 0), round_even(x0, 0), area DESC, cand_idx) - 1 AS z FROM kept) SELECT page_no, cand_idx, z::BIGINT AS rank, {_ZONE} AS zone FROM o WHERE z < 8")
def g1_page_candidates(read):
    """Candidates of whole pages, step after step."""
    return ops.candidates(_rects(read), 600.0, 800.0).select("page_no", "cand_idx", F.col("rank").cast("long").alias("rank"), "zone")


@query("SELECT o_orderkey, printf('figures/fig_%04d_%d.png', o_orderkey, o_custkey) AS href FROM orders")
def f43_asset_href(read):
    return read("orders").select("o_orderkey", F.format_string("figures/fig_%04d_%d.png", "o_orderkey", "o_custkey").alias("href"))
