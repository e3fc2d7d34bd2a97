"""The prefix trie against one built by plain Python."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.llm import queries, trie

KIND = "conv_id long, turn long, role string, text string"


def plain(rows, family=20, heads=4):
    """A dictionary of prefixes, each with its members."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % family if c >= 0 else -(-c % family))
        built[c] = tuple(turns.get(base, [])[:h] + mine[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {p: 0 for p in members}
    leaves, saved = dict(kids), dict(kids)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(who) - 1) * words
            leaves[p[:d]] += not kids[p]
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], leaves[p], saved[p], sha(sorted(c for c in who if len(built[c]) == len(p)))) for p, who in members.items())


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0], r[1]))


@pytest.fixture
def small(monkeypatch):
    """Many blocks and levels of names over few rows."""
    for name, n in (("FAN", 3), ("BLOCK", 7), ("STRETCH", 2)):
        monkeypatch.setattr(trie, name, n)


def conversations(seed, n, longest, alphabet):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        seq = [r.choice(alphabet) for _ in range(r.randint(1, longest))]
        rows += [(3 * c - n, k, "user" if k % 2 else "assistant", x) for k, x in enumerate(seq)]
    return rows


@pytest.mark.parametrize("seed, n, longest, alphabet", [(1, 300, 9, "ab"), (2, 120, 40, "a"), (3, 400, 4, "abcd"), (4, 60, 25, ["one two", "one\ttwo three"])])
def test_random_conversations(spark, small, seed, n, longest, alphabet):
    rows = conversations(seed, n, longest, alphabet)
    assert order(trie.prefix_trie(spark.createDataFrame(rows, KIND)).collect()) == plain(rows)


def test_many_blocks_without_small_names(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = conversations(9, 900, 6, "ab")
    assert order(trie.prefix_trie(spark.createDataFrame(rows, KIND)).collect()) == plain(rows)


def test_odd_inputs(spark):
    long = "word " * 200_000
    rows = [(1, None, None, None), (1, 0, "user", "a  b"), (1, 0, "user", "a  b"), (1, 0, "assistant", "z"), (2, 5, "user", long), (2, 6, None, ""), (21, 0, "user", "x"), (22, 0, "user", "only"), (None, 0, "user", "left out"), (60, 0, "", "\x1c \x85"), (-3, 0, "user", "neg"), (-41, 1, "user", "neg")]
    rows += [(c, 0, "user", "same") for c in range(100, 140)] + [(c, 1, "assistant", "same") for c in range(100, 140)]
    df = spark.createDataFrame(rows, KIND)
    for name in ("c", "d", "i", "key", "depth", "conv", "n", "h", "w"):
        df = df.withColumn(name, F.lit("own"))
    got = order(trie.prefix_trie(df).collect())
    assert got == plain(rows)
    assert trie.prefix_trie(df.where("false")).count() == 0
    empty = [(3, 0, "user", "x"), (5, 0, "user", "y")]  # h is 1 or more for both, and no family has a first one
    assert all(zlib.crc32(str(c).encode()) % 4 for c, *_ in empty)
    assert order(trie.prefix_trie(spark.createDataFrame(empty, KIND)).collect()) == plain(empty)
    assert len(plain(empty)) == 1


def test_nearest_smaller_and_minimum():
    import numpy as np

    r = random.Random(5)
    for _ in range(200):
        v = [r.randint(0, 5) for _ in range(r.randint(1, 30))]
        n = len(v)
        assert trie.smaller(v) == [max([j for j in range(k) if v[j] < v[k]], default=-1) for k in range(n)]
        assert trie.smaller(v, range(n - 1, -1, -1)) == [min([j for j in range(k + 1, n) if v[j] < v[k]], default=-1) for k in range(n)]
        a, b = np.array([(x, y) for x in range(n) for y in range(x + 1, n + 1)]).T
        assert trie.Minimum(v)(a, b).tolist() == [min(v[x:y]) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_a_trie_of_all_conversations(spark, sf):
    data = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = order(queries.queries()["op13_prefix_trie"](spark, data).collect())
    assert got == plain(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert order(con.sql(queries.ORACLE_SQL["op13_prefix_trie"]).fetchall()) == got
