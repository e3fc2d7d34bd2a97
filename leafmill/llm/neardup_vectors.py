"""Exact near-duplicate vectors: a metric range join with pivots.

Vectors of one label (and dimension) are compared by the angle between them, a metric; cosine >= c means angle <= eps. Equal
vectors fall together first and count by their number. Pivots, a bounded number per label drawn by a hash, cut each label into
cells (nearest pivot). A vector x can have a partner in another cell j only if, by the triangle inequality,
    angle(x, p_j) <= angle(x, p_own) + 2 eps   and   angle(x, p_j) <= radius_j + eps
and, as the cell's vectors lie beyond the plane between both pivots, only if x is within eps of that plane:
    asin((cos(x, p_own) - cos(x, p_j)) / |p_own - p_j|) <= eps.
So it is replicated to just the cells that pass. Pivots meet the vectors of their label in groups of a bounded size, once a
group; which cells a vector goes to is settled on keys alone, and the vectors follow once that is known. Each cell then joins on
its own: home vectors against all that are in it, in blocks, by matrix products in double precision (the vectors travel
in their own type). A vector's links are all counted in its home cell, so none is counted twice. A block emits, per home
vector, a count and at most one link per spanning-forest edge, so output stays linear where whole groups are linked.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and those with a null label, have no
links; repeated ids form one row each time they occur, and link with each other as other vectors do; rows with a null id
are left out and count for nobody; vectors of any length are taken whole, those of other lengths don't meet; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_one, materialize, passing
from .components import components

#: Vectors per cell aimed at, most cells of a label, vectors of a block (twice as many of the home side), components of the vectors
#: that meet one copy of their label's pivots.
CELL, MAX_CELLS, BLOCK, DEAL = 4000, 512, 2000, 1 << 20
#: Cosines this near to the threshold in the matrix product are worked out again one by one.
EDGE = 1e-9


def _exact(x, y) -> float:
    """Cosine in double precision by correctly rounded sums."""
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x)) / math.sqrt(math.fsum(y * y))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("v")).where("id is not null")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull()
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # equal vectors of a label: one class with a key of its own, as ids may repeat; rep is its smallest id; -0.0 and 0.0 are equal
    plain = F.transform("v", lambda x: x + F.lit(0.0).cast(kind[6:-1]))
    keyed = rows.where("usable").select("id", F.struct(F.col("label").cast("string").alias("label"), F.size("v").alias("dim")).alias("grp"), plain.alias("v"))
    keyed = keyed.withColumn("vd", F.struct(F.xxhash64("grp", "v").alias("x"), F.hash("grp", "v").alias("y")))  # 96 bits tell vectors apart
    with passing(vectors.sparkSession) as keep:
        classes = keyed.groupBy("grp", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vd").alias("vd"))
        classes = materialize(classes.withColumn("key", F.monotonically_increasing_id()), "vectors")  # written, so that it stays
        found = _found(_blocks(classes, math.acos(cosine) + 1e-7, kind), cosine)  # widened, so that rounding can only add candidates
        groups = components(found.select(F.col("key").alias("a"), F.explode("to").alias("b")))
        grouped = materialize(classes.select("key", "rep").join(groups.withColumnRenamed("id", "key"), "key"), "groups")
        least = grouped.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n"))  # a component bears its smallest id
        named = join_one(grouped, materialize(least, "names"), "component").select("key", "least")
        per_class = classes.join(found.groupBy("key").agg(F.sum("n").alias("n")), "key", "left").join(named, "key", "left")
        per_class = per_class.select("vd", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
        per_class = materialize(per_class, "classes")
        keep(per_class)
    linked = join_one(keyed.select("id", "vd"), per_class, "vd", "weight").select("id", "n_links", "component_id")  # copies of one vector stay where they are
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _blocks(classes: DataFrame, eps: float, kind: str):
    """Classes (grp, v, weight, key) in the blocks that meet: two frames to cogroup by (grp, cell, i, j)."""
    of_group = materialize(classes.groupBy("grp").agg(F.count("*").alias("n")), "labels")
    cells = F.least(F.ceil(F.col("n") / CELL), F.lit(MAX_CELLS))
    deals_of = F.ceil(F.col("n") / F.greatest(F.lit(DEAL) / F.col("grp.dim"), F.lit(1000.0))).cast("int")
    # a bounded number of pivots for each label, in hash order; the share to pick from is enough, whatever the group's size
    share = F.abs(F.xxhash64("rep") / F.lit(2.0**63))
    drawn = classes.join(of_group, "grp").where(share <= 8.0 * cells / F.col("n") + 64.0 / F.col("n"))
    order = Window.partitionBy("grp").orderBy(F.xxhash64("rep"), "rep", "key")
    pivots = drawn.withColumn("cell", F.row_number().over(order) - 1).where(F.col("cell") < cells)
    pivots = materialize(pivots.select("grp", F.col("cell").cast("int").alias("cell"), F.col("v").alias("p"), deals_of.alias("deals")), "pivots")
    # a label's vectors meet its pivots in deals; labels are few, but not bounded, and one may hold a third of all rows
    dealt = lambda n: F.pmod(F.xxhash64("key", F.lit(1)), F.col(n)).cast("int")
    deals = classes.join(of_group, "grp").withColumn("deals", deals_of)
    deals = deals.select(F.to_json("grp").alias("g"), dealt("deals").alias("deal"), "key", "v")
    copies = pivots.select(F.to_json("grp").alias("g_"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal_"), "cell", "p")

    def nearest(vectors, centres):
        import numpy as np
        import pyarrow as pa

        names, kinds = ["key", "home", "own", "cells", "angles"], [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
        centres = centres.sort_by("cell")
        x, p = _unit(vectors["v"]), _unit(centres["p"])
        gaps = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
        out: list[list] = [[] for _ in names]
        for at in range(0, len(x), 2048):
            cos = np.clip(x[at : at + 2048] @ p.T, -1, 1)
            angle, home = np.arccos(cos), cos.argmax(1)
            rows = np.arange(len(home))
            own, top = angle[rows, home], cos[rows, home]
            passes = (angle <= own[:, None] + 2 * eps) & (top[:, None] - cos <= math.sin(min(eps, math.pi / 2)) * gaps[home] + 1e-9)
            passes[rows, home] = True
            out[1].extend(home.tolist())
            out[2].extend(own.tolist())
            for k in rows:
                cells = np.nonzero(passes[k])[0]
                out[3].append(cells)
                out[4].append(angle[k, cells])
        return pa.table([vectors["key"], *[pa.array(c, t) for c, t in zip(out[1:], kinds[1:], strict=True)]], names)

    placed = deals.groupBy("g", "deal").cogroup(copies.groupBy("g_", "deal_")).applyInArrow(nearest, "key long, home int, own double, cells array<int>, angles array<double>")
    placed = materialize(placed.join(classes.select("key", "grp"), "key"), "placed")
    # keys alone: which cells a vector goes to, and how many blocks a cell has
    radius = placed.groupBy("grp", F.col("home").alias("cell")).agg(F.max("own").alias("radius"))
    spread = placed.select("grp", "key", "home", F.explode(F.arrays_zip("cells", "angles")).alias("x")).select("grp", "key", "home", F.col("x.cells").alias("cell"), F.col("x.angles").alias("angle"))
    is_home = F.col("cell") == F.col("home")
    spread = spread.join(radius, ["grp", "cell"]).where(is_home | (F.col("angle") <= F.col("radius") + eps))
    spread = materialize(spread.select("grp", "cell", "key", is_home.alias("is_home")), "cells")
    sizes = spread.groupBy("grp", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.count_if("is_home") / (2 * BLOCK)).cast("int").alias("home_blocks"))
    goes = spread.join(sizes, ["grp", "cell"]).select("key", F.struct("cell", "is_home", dealt("home_blocks").alias("i"), dealt("all_blocks").alias("j"), "home_blocks", "all_blocks").alias("to"))
    goes = classes.join(goes.groupBy("key").agg(F.collect_list("to").alias("to")), "key")  # at most MAX_CELLS each
    goes = goes.select(F.to_json("grp").alias("grp"), "key", "v", "weight", F.explode("to").alias("to"))
    left = goes.where("to.is_home").select("grp", "to.cell", "to.i", F.explode(F.sequence(F.lit(0), F.col("to.all_blocks") - 1)).alias("j"), "key", "v", "weight")
    right = goes.select("grp", "to.cell", F.explode(F.sequence(F.lit(0), F.col("to.home_blocks") - 1)).alias("i"), "to.j", "key", "v", "weight")
    return left, right.select(*[F.col(c).alias(f"{c}_") for c in left.columns])


def _unit(column):
    """A column of vectors of one length as rows of unit length, in double precision."""
    x = _doubles(column)
    x /= _norms(x)[:, None]
    return x


def _doubles(column):
    import numpy as np

    n = len(column)
    return np.array(column.combine_chunks().flatten()).astype("f8").reshape(n, -1)


def _norms(x):
    import numpy as np

    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _found(blocks, cosine: float) -> DataFrame:
    """Per home vector and block with links: key, n (links there), to (keys of a spanning forest's links)."""

    def join(a, b):
        import numpy as np
        import pyarrow as pa

        ia, ib, wb = a["key"].to_numpy(), b["key_"].to_numpy(), b["weight_"].to_numpy()
        out_id, out_n, out_to = [], [], []
        if len(ia) and len(ib):
            xa, xb = _doubles(a["v"]), _doubles(b["v_"])
            c = xa @ xb.T
            c /= _norms(xa)[:, None]
            c /= _norms(xb)[None]
            for i, k in zip(*np.nonzero(np.abs(c - cosine) <= EDGE), strict=True):
                c[i, k] = _exact(xa[i], xb[k])
            near = (c >= cosine) & (ia[:, None] != ib[None])
            n = near @ wb
            parent: dict[int, int] = {}

            def root(x):
                while parent.get(x, x) != x:
                    parent[x] = parent.get(parent[x], parent[x])
                    x = parent[x]
                return x

            for i in np.nonzero(n)[0]:
                x = int(ia[i])
                tos = []
                for k in np.nonzero(near[i])[0]:
                    y = int(ib[k])
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        parent[max(rx, ry)] = min(rx, ry)
                        tos.append(y)
                out_id.append(x)
                out_n.append(int(n[i]))
                out_to.append(tos)
        return pa.table([pa.array(out_id, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_to, pa.list_(pa.int64()))], ["key", "n", "to"])

    left, right = blocks
    keys = ["grp", "cell", "i", "j"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*[f"{k}_" for k in keys]))
    return materialize(pairs.applyInArrow(join, "key long, n long, to array<long>"), "found")
