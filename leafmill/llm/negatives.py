"""Hard negatives by a forest of vantage-point trees over norm-augmented vectors.

Every vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, so that all lie on one sphere; an anchor q gets 0. Then
    |q - x|^2 = |q|^2 + M^2 - 2 q.x,
so a higher inner product is a smaller distance, and a window of scores is an annulus around the anchor. A vantage-point tree halves its points by their
distance to one of them; by the triangle inequality the distances of both halves bound how near and how far an anchor can be to their points.

1. A top tree, built on a bounded sample (SAMPLE points, SAMPLE_CELLS components), deals all vectors into cells; a cell is dealt by a hash into
   blocks of bounded size, and each block becomes a tree of its own, a row of a written table. All vectors are indexed.
2. A query (an anchor, a window of scores, same or different label, k) goes to the cells that its annulus meets: first to the one where
   it may lie nearest, which gives a score that k rows reach; then to those that can hold a better row.
3. In a block, nodes are expanded nearest first, from the annulus' inner edge outwards, until no node left can hold one of the first k rows.
   Queries and blocks meet in tasks of bounded size, and only the first k of a block leave it.

An anchor's positives are the first rows of its label, without a window; each then gives a window for the rows of other labels. Scores are exact
integers and only the order of visits depends on rounding (bounds are widened by more than it), so the result is that of comparing all.

Defined results: rows with a null id, label or vector, or with null or non-finite components take no part; vectors of other lengths don't meet;
zero vectors have score 0 with all; rows that repeat an id are rows each, but none is a positive or negative of an anchor with its id; equal scores come in the order of
ids; scores beyond 64 bits count as the greatest or least long; an anchor without positives, or with no row in a window, gives no rows; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_one, materialize, passing, release

#: Rows of a block and components of its vectors, points of a leaf, queries that meet a block at once.
BLOCK, BLOCK_CELLS, LEAF, DEAL = 4096, 1 << 22, 256, 1024
#: Points that the top tree is built on at most, their components, and how many it needs for a cell.
SAMPLE, SAMPLE_CELLS, PER_CELL = 4096, 1 << 20, 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scores(q, x):
    """Inner products of the rows of two integer arrays, exact; beyond 64 bits the greatest or least long."""
    import numpy as np

    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), "i8")
    top = max(abs(int(q.max())), abs(int(q.min()))) * max(abs(int(x.max())), abs(int(x.min()))) * x.shape[1]
    if top < 1 << 52:
        return (q.astype("f8") @ x.astype("f8").T).astype("i8")
    return np.clip(q.astype(object) @ x.astype(object).T, LEAST, MOST).astype("i8")


class Sphere:
    """Distances between points on the sphere of radius sqrt(m2), and from anchors to them."""

    def __init__(self, m2: float):
        self.m2 = m2

    def lift(self, x):
        import numpy as np

        x = x.astype("f8")
        return np.concatenate([x, np.sqrt(np.maximum(self.m2 - np.einsum("ij,ij->i", x, x), 0))[:, None]], 1)

    def between(self, lifted, point):
        import numpy as np

        return np.sqrt(np.maximum(2 * self.m2 - 2 * (lifted @ point), 0))

    def from_anchor(self, norm2, dots):
        import numpy as np

        return np.sqrt(np.maximum(norm2 + self.m2 - 2.0 * dots, 0))

    def score_range(self, norm2, near, far):
        """Least and greatest score at distances between near and far, widened by more than rounding can be."""
        import numpy as np

        slack = 1e-7 * (np.sqrt(norm2) + self.m2**0.5)
        least = (norm2 + self.m2 - (far + slack) ** 2) / 2
        greatest = (norm2 + self.m2 - np.maximum(near - slack, 0) ** 2) / 2
        return least - 1, greatest + 1


class TopTree:
    """A full binary vantage-point tree of `depth` levels; its leaves are cells. ranges, once known: per cell and level the least and
    greatest distance of the cell's points to the level's vantage point."""

    def __init__(self, points, depth: int, sphere: Sphere):
        import numpy as np

        lifted = sphere.lift(points)
        self.depth = depth
        self.points = np.zeros(((1 << depth) - 1, points.shape[1]), "i8")
        self.radius = np.zeros((1 << depth) - 1)
        members = {0: np.arange(len(points))}
        for node in range((1 << depth) - 1):
            own = members.pop(node)
            at = own[0]
            far = sphere.between(lifted[own], lifted[at])
            order = np.argsort(far, kind="stable")
            half = len(own) // 2
            self.points[node], self.radius[node] = points[at], far[order[half - 1]] if half else 0
            members[2 * node + 1], members[2 * node + 2] = own[order[:half]], own[order[half:]]
            for child in (2 * node + 1, 2 * node + 2):  # a half without points keeps its parent's vantage point
                if not len(members[child]):
                    members[child] = own[:1]
        self.ranges = None

    def place(self, x, sphere: Sphere):
        """Cells of points, and the distances to the vantage points on their way."""
        import numpy as np

        lifted, vantage = sphere.lift(x), sphere.lift(self.points)
        node, far = np.zeros(len(x), "i8"), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            far[:, level] = np.sqrt(np.maximum(2 * sphere.m2 - 2 * np.einsum("ij,ij->i", lifted, vantage[node]), 0))
            node = 2 * node + 1 + (far[:, level] > self.radius[node])
        return node - ((1 << self.depth) - 1), far

    def reach(self, q, norm2, sphere: Sphere):
        """Least and greatest score that each anchor can have in each cell; nothing can be in a cell without points."""
        import numpy as np

        dist = sphere.from_anchor(norm2[:, None], scores(q, self.points).astype("f8"))
        n = 1 << self.depth
        near, far = np.zeros((len(q), n)), np.full((len(q), n), np.inf)
        node = np.arange(n) + n - 1
        for level in reversed(range(self.depth)):
            node = (node - 1) // 2
            lo, hi = self.ranges[:, level, 0], self.ranges[:, level, 1]
            d = dist[:, node]
            near = np.maximum(near, np.maximum(d - hi, lo - d))
            far = np.minimum(far, d + hi)
        least, greatest = sphere.score_range(norm2[:, None], near, far)
        return least, np.where(np.isfinite(self.ranges[:, 0, 1]) if self.depth else True, greatest, -np.inf)


def build(x, sphere: Sphere):
    """A block's tree: the order of its points, and its nodes (from, to, vantage point's place in the order, left, right, and the least and greatest
    distance of both halves to it); leaves have left = -1."""
    import numpy as np

    lifted, order = sphere.lift(x), np.arange(len(x))
    nodes: list[list] = []
    todo = [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][3 + side] = len(nodes)
        nodes.append([a, b, -1, -1, -1, 0.0, 0.0, 0.0, 0.0])
        if b - a <= LEAF:
            continue
        own = order[a:b]
        vantage = own[far_from(lifted[own])]
        far = sphere.between(lifted[own], lifted[vantage])
        by = np.argsort(far, kind="stable")
        order[a:b], far = own[by], far[by]
        half = a + (b - a) // 2
        nodes[-1][2] = vantage
        nodes[-1][5:] = far[0], far[half - a - 1], far[half - a], far[-1]
        todo += [(half, b, len(nodes) - 1, 1), (a, half, len(nodes) - 1, 0)]
    place = np.empty(len(x), "i8")
    place[order] = np.arange(len(x))
    for node in nodes:
        if node[3] >= 0:
            node[2] = place[node[2]]
    return order, nodes


def far_from(lifted) -> int:
    """The point furthest from the points' mean: distances to points at the rim differ most."""
    mean = lifted.mean(0)
    return int(((lifted - mean) ** 2).sum(1).argmax())


def hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows of vectors that meet the condition) and
    each of its first `positives` rows of its label, the first `negatives` rows of other labels whose score lies between low and high percent of the
    positive's. Components are multiplied by scale and rounded down; a score is the integer inner product."""
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(F.expr(anchors), F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    whole = F.transform("x", lambda c: F.floor(c * scale))
    spark = vectors.sparkSession
    with passing(spark) as keep:
        points = materialize(rows.select(F.monotonically_increasing_id().alias("key"), "id", "label", F.size("x").alias("dim"), "anchor", whole.alias("v")), "points")
        index = Index(points)
        asked = points.where("anchor").select(F.col("key").alias("q"), F.col("key").alias("a"), F.col("id").alias("qid"), F.col("label").alias("qlabel"), "dim", "v", F.lit(True).alias("same"), F.lit(positives).alias("k"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
        found = index.search(asked)
        wide = F.col("score").cast("decimal(20,0)")
        windows = F.ceil(wide * low / 100).cast("long").alias("lo"), F.floor(wide * high / 100).cast("long").alias("hi")
        asked = found.withColumnRenamed("q", "a").join(asked.select("a", "qid", "qlabel", "dim", "v"), "a")
        asked = asked.select(F.monotonically_increasing_id().alias("q"), "a", "qid", "qlabel", "dim", "v", F.lit(False).alias("same"), F.lit(negatives).alias("k"), *windows, F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        asked = materialize(asked.where("lo <= hi"), "windows")
        out = index.search(asked.drop("positive_id", "positive_score"))
        out = out.join(asked.select("q", F.col("qid").alias("anchor_id"), "positive_id", "positive_score"), "q")
        out = materialize(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        keep(out)
    return out


class Index:
    """The forest over a written table of points (key, id, label, dim, v): cells, blocks, trees."""

    def __init__(self, points: DataFrame):
        self.spark = points.sparkSession
        square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        n, m2, widest = points.agg(F.count("*"), F.max(square), F.max("dim")).first()
        self.sphere = Sphere(m2 or 0.0)
        self.trees = self._top(points, n, widest or 1)
        placed = self._placed(points)
        counts = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"))
        at_once = F.greatest(F.lit(LEAF), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_CELLS) / F.greatest("dim", F.lit(1)))))
        self.cells = materialize(counts.withColumn("parts", F.ceil(F.col("n") / at_once).cast("int")), "cells")
        dealt = join_one(placed, self.cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        self.forest = materialize(self._grown(dealt), "forest")

    def _top(self, points: DataFrame, n: int, widest: int) -> dict[int, TopTree]:
        """A top tree for each vector length that the sample has enough of."""
        import numpy as np

        most = min(SAMPLE, SAMPLE_CELLS // widest)
        if n <= BLOCK or most < 2 * PER_CELL:
            return {}
        share = F.abs(F.xxhash64("key", F.lit(5)) / F.lit(2.0**63))
        drawn = points.where(share <= min(1.0, 2 * most / n)).orderBy(share, "key").limit(most).select("dim", "v").collect()
        by_dim: dict[int, list] = {}
        for r in drawn:
            by_dim.setdefault(r["dim"], []).append(r["v"])
        trees = {}
        for dim, own in by_dim.items():
            cells = min(len(own) // PER_CELL, int(n * len(own) / len(drawn)) // BLOCK)
            if dim and cells >= 2:
                trees[dim] = TopTree(np.array(own, "i8"), cells.bit_length() - 1, self.sphere)
        return trees

    def _placed(self, points: DataFrame) -> DataFrame:
        """Points with their cell; the top trees learn the ranges of their cells."""
        import numpy as np

        trees, sphere = self.trees, self.sphere

        def run(batches):
            import pyarrow as pa

            for b in batches:
                dims = b.column(3).to_numpy()
                cell, far = np.zeros(len(dims), "i4"), [None] * len(dims)
                for dim in np.unique(dims).tolist():
                    if dim in trees:
                        own = np.nonzero(dims == dim)[0]
                        cell[own], d = trees[dim].place(_matrix(b.column(4).take(pa.array(own)), dim), sphere)
                        for k, row in zip(own, d, strict=True):
                            far[k] = row
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far, pa.list_(pa.float64()))], ["key", "id", "label", "dim", "v", "cell", "far"])

        rows = points.select("key", "id", "label", "dim", "v")
        placed = materialize(rows.mapInArrow(run, "key long, id long, label string, dim int, v array<long>, cell int, far array<double>"), "placed")
        if trees:  # as many rows as the top trees have cells and levels, both bounded by the sample
            ends = placed.select("dim", "cell", F.posexplode("far").alias("level", "d")).groupBy("dim", "cell", "level").agg(F.min("d"), F.max("d")).collect()
            for dim, tree in trees.items():
                tree.ranges = np.tile([np.inf, -np.inf], (1 << tree.depth, tree.depth, 1))
                for d, cell, level, least, greatest in ends:
                    if d == dim:
                        tree.ranges[cell, level] = least, greatest
                tree.ranges[~np.isfinite(tree.ranges)] = np.inf  # a cell without points
        return placed.drop("far")

    def _grown(self, dealt: DataFrame) -> DataFrame:
        sphere = self.sphere

        def grow(t):
            import numpy as np
            import pyarrow as pa

            t = t.sort_by([("key", "ascending")])
            x = _matrix(t["v"].combine_chunks(), t["dim"][0].as_py())
            order, nodes = build(x, sphere)
            return pa.table(
                {
                    **{c: t[c].slice(0, 1) for c in ("dim", "cell", "part")},
                    "ids": pa.array([t["id"].to_numpy()[order]], pa.list_(pa.int64())),
                    "labels": pa.array([t["label"].take(pa.array(order)).to_pylist()], pa.list_(pa.string())),
                    "flat": pa.array([x[order].reshape(-1)], pa.list_(pa.int64())),
                    "shape": pa.array([np.array([r[:5] for r in nodes], "i4").reshape(-1)], pa.list_(pa.int32())),
                    "ends": pa.array([np.array([r[5:] for r in nodes], "f8").reshape(-1)], pa.list_(pa.float64())),
                }
            )

        schema = "dim int, cell int, part int, ids array<long>, labels array<string>, flat array<long>, shape array<int>, ends array<double>"
        return dealt.groupBy("dim", "cell", "part").applyInArrow(grow, schema)

    def search(self, asked: DataFrame) -> DataFrame:
        """q, rank (from 1), id, score: the first k rows of every query of a written table (q, a, qid, qlabel, dim, v, same, k, lo, hi), in the order of
        falling scores and rising ids. a: queries of one anchor bear one number, and share their scores."""
        none = asked.withColumn("cut", F.lit(LEAST))
        first = materialize(_best(self._visited(self._visits(none, True)), asked), "first")
        if not self.trees:
            return first
        enough = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        cut = asked.join(enough, "q", "left").withColumn("cut", F.when(F.col("n") >= F.col("k"), F.col("worst")).otherwise(F.lit(LEAST))).drop("n", "worst")
        rest = self._visited(self._visits(cut, False))
        return materialize(_best(first.drop("rank").unionByName(rest), asked), "found")

    def _visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """Queries with the cells that they go to: the one where they may find the highest score, or else all others that can hold a row of their
        window that is not below cut."""
        trees, sphere = self.trees, self.sphere
        names = ["q", "a", "qid", "qlabel", "dim", "v", "same", "k", "lo", "hi", "cut"]

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for b in batches:
                dims, (lo, hi, cut) = b.column(4).to_numpy(), (b.column(k).to_numpy().astype("f8") for k in (8, 9, 10))
                cells: list = [[0] if first else []] * len(dims)
                for dim in set(dims.tolist()) & set(trees):
                    own = np.nonzero(dims == dim)[0]
                    q = _matrix(b.column(5).take(pa.array(own)), dim)
                    least, greatest = trees[dim].reach(q, (q.astype("f8") ** 2).sum(1), sphere)
                    top = np.where((least <= hi[own, None]) & (greatest >= lo[own, None]), np.minimum(greatest, hi[own, None]), -np.inf)
                    nearest = top.argmax(1)
                    for k, i in enumerate(own):
                        if first:
                            cells[i] = [nearest[k]]
                        else:
                            goes = np.nonzero((top[k] >= cut[i]) & np.isfinite(top[k]))[0]
                            cells[i] = goes[goes != nearest[k]]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], [*names, "cells"])

        rows = queries.select(*names)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{schema}, cells array<int>").select(*names, F.explode("cells").alias("cell"))

    def _visited(self, visits: DataFrame) -> DataFrame:
        """q, id, score: the first k rows of every block of the cells that queries go to."""
        visits = materialize(visits, "visits")
        deals = visits.groupBy("dim", "cell").agg(F.count("*").alias("visits")).join(self.cells, ["dim", "cell"])
        deals = materialize(deals.select("dim", "cell", "parts", "visits", F.ceil(F.col("visits") / DEAL).cast("int").alias("deals")), "deals")
        asked = join_one(visits, deals, ["dim", "cell"], "visits").select(*visits.columns, F.pmod(F.xxhash64("a", F.lit(3)), "deals").cast("int").alias("deal"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        trees = join_one(self.forest, deals, ["dim", "cell"], "parts").select(*[F.col(c).alias(f"{c}_") for c in self.forest.columns], F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal_"))
        sphere = self.sphere

        def run(queries, tree):
            import pyarrow as pa

            out: list[tuple] = []
            if queries.num_rows and tree.num_rows:
                out = Tree(tree, sphere).first(queries.sort_by([("a", "ascending"), ("q", "ascending")]))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            return pa.table([pa.array(c, pa.int64()) for c in cols], ["q", "id", "score"])

        keys = ["dim", "cell", "part", "deal"]
        found = asked.groupBy(*keys).cogroup(trees.groupBy(*[f"{k}_" for k in keys])).applyInArrow(run, "q long, id long, score long")
        out = materialize(found, "found")
        release(visits)
        return out


def _best(found: DataFrame, asked: DataFrame) -> DataFrame:
    """The first k rows of every query."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    k = asked.select(F.max("k")).first()[0] or 0
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(column, dim: int):
    """A column of integer vectors of one length as rows."""
    import numpy as np

    return np.array(column.flatten()).astype("i8").reshape(len(column), dim)


class Tree:
    """A block's tree, as grown."""

    def __init__(self, row, sphere: Sphere):
        import numpy as np

        self.sphere = sphere
        flat = lambda c: np.array(row[c].combine_chunks().flatten())
        self.ids, labels = flat("ids_"), row["labels_"][0].as_py()
        self.codes = {s: k for k, s in enumerate(dict.fromkeys(labels))}
        self.labels = np.array([self.codes[s] for s in labels], "i8")
        self.x = flat("flat_").astype("i8").reshape(len(self.ids), row["dim_"][0].as_py())
        self.nodes, self.ends = flat("shape_").reshape(-1, 5), flat("ends_").reshape(-1, 4).tolist()
        self.steps = self.nodes.tolist()

    def first(self, queries) -> list[tuple]:
        """(q, id, score) of each query's first rows here; queries of one anchor follow each other."""
        import numpy as np

        q = _matrix(queries["v"].combine_chunks(), self.x.shape[1])
        norm2 = (q.astype("f8") ** 2).sum(1)
        inner = np.nonzero(self.nodes[:, 3] >= 0)[0]
        dist = np.zeros((len(q), len(self.nodes)))
        dist[:, inner] = self.sphere.from_anchor(norm2[:, None], scores(q, self.x[self.nodes[inner, 2]]).astype("f8"))
        names = ["q", "a", "qid", "qlabel", "same", "k", "lo", "hi", "cut"]
        out: list[tuple] = []
        last, leaves = None, {}
        for row, (number, a, qid, label, same, k, lo, hi, cut) in enumerate(zip(*[queries[c].to_pylist() for c in names], strict=True)):
            if a != last:
                last, leaves = a, {}
            code = self.codes.get(label, -1)
            out += [(number, i, s) for s, i in self._one(q[row : row + 1], float(norm2[row]), dist[row].tolist(), leaves, qid, code, same, k, lo, hi, cut)]
        return out

    def _one(self, q, norm2: float, dist: list, leaves: dict, qid: int, code: int, same: bool, k: int, lo: int, hi: int, cut: int) -> list[tuple]:
        import numpy as np

        best: list[tuple] = []  # (-score, id), rising
        worst = max(lo, cut)  # rows below it are of no use
        both, slack = norm2 + self.sphere.m2, 1e-7 * (math.sqrt(norm2) + math.sqrt(self.sphere.m2))  # as Sphere.score_range has it
        heap = [(float("-inf"), 0, 0.0, float("inf"))]  # nodes by the highest score within the window that they can hold
        while heap:
            top, node, near, far = heapq.heappop(heap)
            if -top < worst:
                break
            a, b, _, left, right = self.steps[node]
            if left < 0:
                if node not in leaves:
                    leaves[node] = scores(q, self.x[a:b])[0]
                s, labels, ids = leaves[node], self.labels[a:b], self.ids[a:b]
                fits = np.nonzero((s >= worst) & (s <= hi) & ((labels == code) == same) & (ids != qid))[0]
                if len(fits):
                    best = sorted([*best, *zip((-s[fits]).tolist() if s[fits].min() > LEAST else [-int(v) for v in s[fits]], ids[fits].tolist(), strict=True)])[:k]
                    if len(best) == k:
                        worst = max(worst, -best[-1][0])
                continue
            d, ends = dist[node], self.ends[node]
            for child, least, greatest in ((left, ends[0], ends[1]), (right, ends[2], ends[3])):
                n, f = max(near, d - greatest, least - d), min(far, d + greatest)
                low, high = (both - (f + slack) ** 2) / 2 - 1, (both - max(n - slack, 0.0) ** 2) / 2 + 1
                if high >= worst and low <= hi:
                    heapq.heappush(heap, (-min(high, hi), child, n, f))
        return [(-s, i) for s, i in best]
