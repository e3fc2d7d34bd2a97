"""URL filters as a cascade of Bloom filters, in Spark expressions alone.

A list of (host, path) keys is asked, for each url, about every key that could cover it: each suffix of the host at a dot, with each
prefix of the path of a length that the list has. The corpus's own candidate keys are the universe. Level 0 of the cascade
encodes the listed keys; level 1 those keys of the universe that pass level 0 although they aren't listed; level 2 the listed ones
among what passes level 1; and so on until no false positive is left. A key is listed exactly if the first level
that refuses it has an odd number. Membership is thereby exact on all keys of the corpus, by bit tests alone: no join.

A level has its bits sized by the keys it encodes; level 0 is sized by the universe too, so that about as many
false positives as listed keys remain. So the cascade's size follows the list and the logarithm of the corpus. Filters travel as
literals of the expression. A list whose level 0 would take more than MAX_BITS is dealt over shards by a hash of the key, each
with a cascade of its own, and shards are asked PASS_BITS at a time: a pass takes from each url's candidates those of its shards
that aren't listed. Shards are built one by one and written to the shared folder; a pass fetches its own. So lists beyond one filter's size give exact
verdicts and cost passes, not accuracy, and the driver holds a shard (while it is built) or a pass at a time, however many there are.

Defined results: a null url, or one without "://", has empty host and path; only rules with an empty host cover it; very long urls are
taken whole. Repeated urls are judged alike; an empty table gives an empty table; without rules every url gets the default; of two rules
for one key that which blocks holds; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, passing, release, shared_path

#: Bits that a level of a shard has about at most (8 MB), and those of all shards that one expression asks.
MAX_BITS = 1 << 26
PASS_BITS = 1 << 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, url_col: str) -> DataFrame:
    """pages with host and path: after the first "://" up to / ? # or end (A-Z lower-cased); then up to ? # or end."""
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (key, size) that could cover host and path, the longest first; of equal sizes, that with the longer host.
    A key is host, a line feed, path."""
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in sorted(set(lengths), reverse=True)]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct((-F.length(h) - F.length(p)).alias("order"), (-F.length(h)).alias("then"), F.concat(h, F.lit("\n"), p).alias("key")))))
    return F.transform(F.sort_array(pairs), lambda x: x["key"])


def _bits(key: Column, level: int, hashes: int, size: int) -> Column:
    """The key's bit positions at a level: double hashing with two halves of a 64-bit hash that the level's number seeds."""
    h = F.xxhash64(F.lit(level), key)
    first, stride = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1).cast("long"))
    return F.array(*[(first + F.lit(k).cast("long") * stride) % F.lit(size) for k in range(hashes)])


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)).cast("int")


class Cascade:
    """Levels of (hashes, bits, array of 64-bit words)."""

    def __init__(self, levels: list[tuple]):
        self.levels = levels

    def passes(self, key: Column, level: int) -> Column:
        hashes, size, words = self.levels[level]
        table = F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>")  # folded to one literal
        return F.forall(_bits(key, level, hashes, size), lambda at: F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)

    def listed(self, key: Column) -> Column:
        """Whether the key is listed; exact for keys of the universe and of the list."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out

    def bits(self) -> int:
        return sum(size for _, size, _ in self.levels)


def _size(n: int, bits_per_key: float) -> int:
    return max(64, 64 * math.ceil(n * bits_per_key / 64))


def _level(keys: DataFrame, number: int, n: int, bits_per_key: float) -> tuple:
    """One filter over keys (column key): positions are set by an aggregation per 64-bit word."""
    import numpy as np

    size = _size(n, bits_per_key)
    hashes = max(1, min(16, round(math.log(2) * size / max(n, 1))))
    words = np.zeros(size // 64, "i8")
    at = keys.select(F.explode(_bits(F.col("key"), number, hashes, size)).alias("at"))
    one = F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")
    made = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # size / 64 rows at most
    words[made["word"].to_numpy()] = made["bits"].to_numpy()
    return hashes, size, words


def build(spark: SparkSession, listed: list[str], universe: DataFrame) -> Cascade:
    """The cascade of a list of keys over the universe (column key, repeats allowed)."""
    return cascade_of(spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string"), materialize(universe.select("key").distinct(), "universe"))


def cascade_of(keys: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the listed keys (column key, distinct) over the universe (column key, distinct). Both are written tables.

    Each level halves what is left about three times over and takes a hash of its own, so levels end; their number isn't limited."""
    import numpy as np

    n = keys.count()
    if not n:
        return Cascade([(1, 64, np.zeros(1, "i8"))])
    levels = [_level(keys, 0, n, bits_of(n, universe.count()))]
    # false positives of level 0; only these few are told from the listed keys by comparison
    wrong = universe.where(Cascade(levels).passes(F.col("key"), 0)).join(keys, "key", "left_anti")
    inside, outside = keys, None
    while True:
        wrong = materialize(wrong, "false-positives")
        left = wrong.count()
        if not left:
            return Cascade(levels)
        at = len(levels)
        levels.append(_level(wrong, at, left, 2.5))
        inside, outside = (inside, wrong) if at % 2 else (wrong, outside)
        # the next level encodes what of the other side passes this one
        wrong = (inside if at % 2 else outside).where(Cascade(levels).passes(F.col("key"), at))


def bits_of(listed: int, universe: int) -> float:
    """Bits that level 0 gives each listed key, for about as many false positives as there are listed keys."""
    return max(2.0, 1.44 * math.log2(max(universe, 2) / max(listed, 1) + 2))


class Filter:
    """The cascades of all shards of a list, to be asked pass by pass: a single one in memory, or a written table of several (shard, level, hashes,
    size, words), of which the driver knows the sizes."""

    def __init__(self, shards: int, bits: dict[int, int], cascade: Cascade | None = None, table: DataFrame | None = None):
        self.shards, self.bits, self.cascade, self.table = shards, bits, cascade, table

    def passes(self) -> list[list[int]]:
        """The shards' numbers, as many at a time as PASS_BITS hold (one at least)."""
        out: list[list[int]] = []
        room = 0
        for k, bits in self.bits.items():
            if not out or bits > room:
                out.append([])
                room = PASS_BITS
            out[-1].append(k)
            room -= bits
        return out

    def fetched(self, among: list[int]) -> dict[int, Cascade]:
        """The cascades of some shards, a pass's at most."""
        import numpy as np

        levels: dict[int, list] = {k: [] for k in among}
        for r in self.table.where(F.col("shard").isin(among)).orderBy("shard", "level").toArrow().to_pylist():
            levels[r["shard"]].append((r["hashes"], r["size"], np.frombuffer(r["words"], "<i8")))
        return {k: Cascade(v) for k, v in levels.items()}

    @property
    def cascades(self) -> dict[int, Cascade]:
        """All of them, to look at."""
        return self.fetched(list(self.bits)) if self.cascade is None else {0: self.cascade}

    def listed(self, key: Column, among: list[int]) -> Column:
        """Whether a key of one of these shards is listed; true for keys of others, which another pass asks."""
        if self.cascade is not None:
            return self.cascade.listed(key)
        shard, out = shard_of(key, self.shards), F.lit(True)
        for k, cascade in self.fetched(among).items():
            out = F.when(shard == k, cascade.listed(key)).otherwise(out)
        return out


def filter_of(keys: DataFrame, universe: DataFrame) -> Filter:
    """The exact filter of the listed keys over the universe (both column key, distinct, written tables)."""
    n, total = keys.count(), universe.count()
    shards = max(1, math.ceil(1.1 * _size(n, bits_of(n, total)) / MAX_BITS))  # hashed shards are not quite equal
    if shards == 1:
        cascade = cascade_of(keys, universe)
        return Filter(1, {0: cascade.bits()}, cascade)
    spark, bits, path = keys.sparkSession, {}, shared_path(keys.sparkSession, "shards")
    schema = "shard int, level int, hashes int, size long, words binary"
    for k in range(shards):
        cascade = cascade_of(*(t.where(shard_of(F.col("key"), shards) == k) for t in (keys, universe)))
        rows = [(k, level, hashes, size, bytearray(words.astype("<i8").tobytes())) for level, (hashes, size, words) in enumerate(cascade.levels)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        bits[k] = cascade.bits()
    return Filter(shards, bits, table=spark.read.schema(schema).parquet(path))


def left_of(asked: DataFrame, wanted: Filter) -> DataFrame:
    """asked with the listed ones alone of its candidates (column asked); a written table where that takes several passes."""
    passes = wanted.passes()
    for among in passes:
        made = asked.withColumn("asked", F.filter("asked", lambda x: wanted.listed(x, among)))  # noqa: B023 (called at once)
        if len(passes) == 1:
            return made
        made = materialize(made, "asked")
        release(asked)
        asked = made
    return asked


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, or null), verdict.

    rules: (verdict, host, path), as a list or as a table of any size with these columns. A rule fits its host (A-Z lower-cased) and
    all subdomains, if the url's path starts with the rule's. Of two rules for one key, that which blocks holds. Urls that no
    rule fits get `otherwise`."""
    spark = pages.sparkSession
    with passing(spark) as keep:
        if not isinstance(rules, DataFrame):
            rules = spark.createDataFrame(rules, "verdict string, host string, path string")
        key = F.concat(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.lit("\n"), F.coalesce("path", F.lit("")))
        ruled = materialize(rules.groupBy(key.alias("key")).agg(F.min(F.coalesce(F.length("path"), F.lit(0))).alias("n"), F.bool_or(F.col("verdict") == "block").alias("block")), "rules")
        lengths = sorted(r["n"] for r in ruled.select("n").distinct().collect())  # path lengths: as many as the longest path has characters
        seen = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")), "_url").select("page_id", "host", "path")
        asked = seen.select("page_id", "host", "path", candidates(F.col("host"), F.col("path"), lengths or [0]).alias("asked"))
        universe = materialize(asked.select(F.explode("asked").alias("key")).distinct(), "universe")
        keys = materialize(ruled.select("key"), "keys")
        known = filter_of(keys, universe)
        bad = filter_of(materialize(ruled.where("block").select("key"), "blocked"), keys)  # only listed keys are asked about it
        release(universe)
        asked = left_of(asked, known)
        keep(asked)
        asked = left_of(asked.select("page_id", "host", "path", F.get("asked", F.lit(0)).alias("key"), F.slice("asked", 1, 1).alias("asked")), bad)
        keep(asked)
    verdict = F.when(F.col("key").isNull(), otherwise).when(F.size("asked") > 0, "block").otherwise("allow")
    return asked.select("page_id", "host", "path", F.translate("key", "\n", "").alias("rule"), verdict.alias("verdict"))
