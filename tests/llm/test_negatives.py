"""Hard negatives against comparing all with all."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import negatives, queries

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, positives=5, count=10, low=30, high=90, scale=256):
    """All rows against all, by exact Python integers."""
    clip = lambda s: max(min(s, negatives.MOST), negatives.LEAST)
    usable = [(i, [max(min(math.floor(float(np.float32(x)) * scale), negatives.MOST), negatives.LEAST) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, y in (r for r in usable if r[0] % every == 0):
        scored = sorted((-clip(sum(a * b for a, b in zip(q, x, strict=True))), j, z) for j, x, z in usable if j != i and len(x) == len(q))
        for s, j, _ in [r for r in scored if r[2] == y][:positives]:
            fits = [r for r in scored if r[2] != y and low * -s <= 100 * -r[0] <= high * -s]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:count])]
    return sorted(out)


def got(df, **kw):
    return sorted(map(tuple, negatives.hard_negatives(df, **kw).collect()))


@pytest.fixture
def small_blocks(monkeypatch):
    """Many blocks, cells and deals of few rows."""
    for name, n in (("BLOCK", 60), ("LEAF", 4), ("DEAL", 3), ("SAMPLE", 200), ("PER_CELL", 5)):
        monkeypatch.setattr(negatives, name, n)


def test_random_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, (r.normal(size=8) / 3).tolist(), int(r.integers(4))) for i in range(900)]
    assert got(spark.createDataFrame(rows, KIND), anchors="vec_id % 30 = 0") == brute(rows, 30)


def test_clusters_with_many_cells(spark, small_blocks):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 6))
    rows = [(i, (centres[c] * (1 + c % 3) + r.normal(size=6) / 8).tolist(), int(c % 5)) for i, c in enumerate(r.integers(12, size=1500))]
    df = spark.createDataFrame(rows, KIND)
    index = negatives.Index(df.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.lit(6).alias("dim"), F.transform("embedding", lambda x: F.floor(x * 256)).alias("v")))
    assert len(index.trees) == 1 and index.cells.count() > 4 and index.forest.count() > 20
    assert got(df, anchors="vec_id % 50 = 0") == brute(rows, 50)


def test_equal_vectors_and_ties(spark, small_blocks):
    r = random.Random(3)
    rows = [(i, r.choice([[1.0, 0.0], [0.0, 1.0], [0.5, 0.5], [0.0, 0.0], [-1.0, 0.25]]), i % 3) for i in range(700)]
    assert got(spark.createDataFrame(rows, KIND), anchors="vec_id % 20 = 0") == brute(rows, 20)


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 2), (None, [1.0, 1.0], 2)]
    rows += [(7, [0.4, 0.4], None), (8, [1.0, 0.5, 0.25], 2), (100, [0.9, 0.9, 0.9], 2), (9, [0.6, 0.6, 0.5], 1), (200, [], 1), (201, [], 1), (202, [], 3), (0, [0.9, 0.5], 1), (10, [0.0, 0.0], 2), (300, [1e30, 1.0, 1.0, 1.0], 1), (301, [1e30, 0.0, 0.0, 0.0], 1), (302, [2e7, 1e7, 0.0, 0.0], 2), (400, [-1.0, -1.0], 5)]
    df = spark.createDataFrame(rows, KIND)
    for name in ("id", "key", "x", "v", "q", "rank", "dim", "anchor", "cell", "score"):
        df = df.withColumn(name, F.lit("own"))
    assert got(df) == brute(rows)
    assert got(df.where("false")) == [] and got(df.where("vec_id = 0")) == []


def test_long_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=30_000).tolist(), i // 4 % 2) for i in range(9)]
    assert got(spark.createDataFrame(rows, KIND), anchors="vec_id % 2 = 0", low=-1000, high=1000) == brute(rows, 2, low=-1000, high=1000) != []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    mine = queries.queries()["op11_hard_negatives"](spark, data)
    order = sorted(mine.columns)
    want = con.sql(queries.ORACLE_SQL["op11_hard_negatives"]).df()[order]
    assert sorted(map(tuple, mine.select(*order).collect())) == sorted(want.itertuples(index=False, name=None)) and len(want)
