"""The prefix trie of conversations, by the Cartesian tree over the array of longest common prefixes.

A turn is known by a digest of its role and text; texts themselves are read once and don't move. Steps:
1. Turns get their place and the words before them by a parallel scan (operators.scan), so a conversation may hold any share of all rows.
2. Conversations are sorted by their digests. One of more than FAN turns is sorted by names of its stretches of FAN turns, which are their ranks
   among all stretches, and so on until FAN names suffice; no row holds more than FAN.
3. lcp[i] is the number of turns that conversation i (in that order) shares with the one before it, found by joining both's turns.
4. All nearest smaller values of lcp: each block of the order finds its own with a stack; what looks beyond its block finds the block by the blocks'
   minima, of which there are at most as many as the square root of the number of conversations, and the place there by the block's record values.
   Positions with one left neighbour and one lcp are one node of the Cartesian tree: the conversations from that neighbour to before the next smaller value.
5. Nodes' aggregates are differences of running sums and minima over their intervals. Each stands for the depths between its parent's and its own, which
   are added; depths that a conversation shares with none are its own turns.

saved_tokens of a node: each conversation of its interval but the first shares lcp turns with the one before it, of which those from the node's
depth on are saved; so it is a difference of running sums of the words in shared turns.

Defined results: null roles and texts are empty; null conversation ids are left out; turns of equal number come in the order of role and of a digest of role and
text, null numbers first; repeated rows are turns each; very long texts are read whole, and only their digest and words are kept; conversations without
turns are members of the root; equal conversations end in one node; an empty table gives an empty table (no root either); further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import scan
from .common import join_one, materialize, passing

#: Names in a sort key; least positions of a block; depths of a node that are added at once.
FAN, BLOCK, STRETCH = 64, 4096, 4096
NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, nth, h, w, w_before) of a table (conv_id, turn, role, text): the turn's place from 0, its digest, its words and those before it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), digest.alias("h"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w")
    )
    return scan(rows, [F.col("turn").asc_nulls_first(), "role", "h"], "c", ["w"], drop=["turn", "role"], write=materialize)


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their family's first one: c begins with the first h turns of c - c % family, then has its own after its
    first h; h = crc32(c in decimal) % heads. turns: as turns_of() gives them. Two written tables: turns (c, d, h, w, wb: depth from 1, words before) and
    conversations (c, n_turns)."""
    own_h = (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("int")
    own_first = F.sum(F.when(F.col("nth") < own_h, F.col("w")).otherwise(0)).alias("own_words")
    convs = turns.groupBy("c").agg(F.count("*").alias("n"), own_first).withColumn("take", own_h).withColumn("b", F.col("c") - F.col("c") % family)
    convs = materialize(convs, "convs")
    first = turns.where((F.col("nth") < heads - 1) & (F.col("c") % family == 0)).withColumnRenamed("c", "b")
    shared = materialize(convs.select("c", "b", "take").join(first, "b").where(F.col("nth") < F.col("take")), "shared")  # heads - 1 rows a conversation at most
    taken = shared.groupBy("c").agg(F.count("*").alias("k"), F.sum("w").alias("words"))
    k, words = F.coalesce("k", F.lit(0)), F.coalesce("words", F.lit(0))
    convs = convs.join(taken, "c", "left").select("c", "n", "take", (k - F.col("take")).alias("shift"), (words - F.col("own_words")).alias("more"), (k + F.greatest(F.col("n") - F.col("take"), F.lit(0))).alias("n_turns"))
    convs = materialize(convs, "lengths")
    own = join_one(turns, convs, "c").where(F.col("nth") >= F.col("take")).select("c", (F.col("nth") + 1 + F.col("shift")).alias("d"), "h", "w", (F.col("w_before") + F.col("more")).alias("wb"))
    both = shared.select("c", (F.col("nth") + 1).alias("d"), "h", "w", F.col("w_before").alias("wb")).unionByName(own)
    return materialize(both, "turns"), convs.select("c", "n_turns")


def _ordered(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations in the order of their turns: i (from 0), c, n_turns, gk (a digest of all turns, equal for equal conversations)."""
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    names, name_type = turns.select("c", "d", F.col("h").alias("name")), "binary"
    listed = F.transform(F.array_sort(F.collect_list(F.struct("d", "name"))), lambda x: x["name"]).alias("key")
    as_text = lambda x: F.hex(x) if name_type == "binary" else x.cast("string")
    digest = F.unhex(F.sha2(F.array_join(F.transform("key", as_text), ","), 256))
    while longest > FAN:
        stretches = names.groupBy("c", F.floor((F.col("d") - 1) / FAN).alias("at")).agg(listed)  # FAN rows each
        stretches = materialize(stretches.withColumn("kd", digest), "stretches")
        known = scan(stretches.groupBy("kd").agg(F.first("key").alias("key"), F.count("*").alias("n")), ["key"], drop=["key"], write=materialize)
        names = join_one(stretches.select("c", "at", "kd"), materialize(known, "names"), "kd").select("c", (F.col("at") + 1).alias("d"), F.col("nth").alias("name"))
        name_type, longest = "bigint", -(-longest // FAN)
    keyed = convs.join(names.groupBy("c").agg(listed), "c", "left").withColumn("key", F.coalesce("key", F.expr(f"cast(array() as array<{name_type}>)")))
    keyed = keyed.select("c", "n_turns", "key", digest.alias("gk"))
    return materialize(scan(keyed, ["key", "c"], drop=["key"], write=materialize).withColumnRenamed("nth", "i"), "ordered")


def _positions(rows: DataFrame, ordered: DataFrame) -> DataFrame:
    """ordered with lcp, wl (words of the turns shared with the conversation before) and lcp_next (0 at the end)."""
    before = rows.select((F.col("i") + 1).alias("i"), "d", F.col("h").alias("h_before"))
    differs = ~F.col("h").eqNullSafe(F.col("h_before"))
    found = rows.join(before, ["i", "d"], "left").groupBy("i").agg(
        F.min(F.when(differs, F.col("d"))).alias("first"), F.min(F.when(differs, F.col("wb"))).alias("until"), F.max(F.col("wb") + F.col("w")).alias("all")
    )
    own = ordered.join(found, "i", "left").select("i", "c", "n_turns", F.coalesce(F.col("first") - 1, "n_turns").alias("lcp"), F.coalesce("until", "all", F.lit(0)).alias("wl"))
    own = materialize(own, "lcp")
    after = own.select((F.col("i") - 1).alias("i"), F.col("lcp").alias("lcp_next"))
    return own.join(after, "i", "left").withColumn("lcp_next", F.coalesce("lcp_next", F.lit(0).cast("long")))


class Minimum:
    """Least value of any stretch of an array."""

    def __init__(self, values):
        import numpy as np

        self.levels = [np.array(values, "i8")]
        while 2 << (len(self.levels) - 1) <= len(values):
            step, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a, b):
        """Least values from a to before b, arrays with a < b."""
        import numpy as np

        level = np.floor(np.log2(b - a)).astype("i8")
        out = np.empty(len(a), "i8")
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][a[own]], self.levels[k][b[own] - (1 << k)])
        return out


def smaller(values: list, places=None) -> list:
    """The place of the nearest smaller value to the left of each, -1 where there is none; with falling places, to the right."""
    out, open_ = [-1] * len(values), []
    for k in range(len(values)) if places is None else places:
        while open_ and values[open_[-1]] >= values[k]:
            open_.pop()
        out[k] = open_[-1] if open_ else -1
        open_.append(k)
    return out


def _in_blocks(positions: DataFrame, size: int) -> DataFrame:
    """positions with blk and, from within their block: left and right (nearest smaller lcp, null beyond the block), least (smallest c of the interval
    between, null beyond), from_start and to_end (smallest c up to and from here), sw and leaves (running sums of wl and of conversations that none goes on
    from), is_first and is_last (lcp is below all before it, or after it)."""

    def run(t):
        import numpy as np
        import pyarrow as pa

        t = t.sort_by("i")
        i, c, lcp, after = (t[x].to_numpy() for x in ("i", "c", "lcp", "lcp_next"))
        n, values = len(i), lcp.tolist()
        left, right = np.array(smaller(values)), np.array(smaller(values, range(n - 1, -1, -1)))
        inside = (left >= 0) & (right >= 0)
        least = np.zeros(n, "i8")
        least[inside] = Minimum(c)(left[inside], right[inside])
        records = [np.concatenate([[True], v[1:] < np.minimum.accumulate(v)[:-1]]) for v in (lcp, lcp[::-1])]
        more = {
            "left": pa.array(i[0] + left, mask=left < 0),
            "right": pa.array(i[0] + right, mask=right < 0),
            "least": pa.array(least, mask=~inside),
            "from_start": np.minimum.accumulate(c),
            "to_end": np.minimum.accumulate(c[::-1])[::-1],
            "sw": np.cumsum(t["wl"].to_numpy()),
            "leaves": np.cumsum(t["n_turns"].to_numpy() > after).astype("i8"),
            "is_first": records[0],
            "is_last": records[1][::-1],
        }
        for name, column in more.items():
            t = t.append_column(name, column if isinstance(column, pa.Array) else pa.array(column))
        return t

    keyed = positions.withColumn("blk", F.floor(F.col("i") / size).cast("long"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
    longs = ", ".join(f"{x} long" for x in ("left", "right", "least", "from_start", "to_end", "sw", "leaves"))
    return materialize(keyed.groupBy("blk").applyInArrow(run, f"{kinds}, {longs}, is_first boolean, is_last boolean"), "blocks")


def _answered(local: DataFrame, minima: list[int], n: int) -> DataFrame:
    """(side, blk, lcp, at): the nearest position beyond block blk whose lcp is smaller, on its left (side 0) or right (1); n past the end."""
    asks = [local.where((F.col("lcp") >= 1) & F.col(x).isNull()).select(F.lit(side).alias("side"), "blk", "lcp") for side, x in ((0, "left"), (1, "right"))]
    back = smaller(minima), smaller(minima, range(len(minima) - 1, -1, -1))

    def aim(batches):
        import pyarrow as pa

        for b in batches:
            to = []
            for side, blk, lcp in zip(*[c.to_pylist() for c in b.columns], strict=True):
                at = blk + (1 if side else -1)
                while 0 <= at < len(minima) and minima[at] >= lcp:
                    at = back[side][at]
                to.append(at if 0 <= at < len(minima) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.int64())], ["side", "blk", "lcp", "to"])

    asked = asks[0].unionByName(asks[1]).distinct().mapInArrow(aim, "side int, blk long, lcp long, to long")
    asked = materialize(asked, "asked")
    records = [local.where(x).select(F.lit(side).alias("side_"), F.col("blk").alias("to_"), "i", F.col("lcp").alias("value")) for side, x in ((0, "is_last"), (1, "is_first"))]

    def find(asked, records):
        import numpy as np
        import pyarrow as pa

        if not asked.num_rows:
            return pa.table({"side": pa.array([], pa.int32()), **{x: pa.array([], pa.int64()) for x in ("blk", "lcp", "at")}})
        side = asked["side"][0].as_py()
        records = records.sort_by([("i", "ascending" if side else "descending")])  # values fall
        place = np.searchsorted(-records["value"].to_numpy(), -asked["lcp"].to_numpy(), "right")
        return pa.table({"side": asked["side"], "blk": asked["blk"], "lcp": asked["lcp"], "at": records["i"].to_numpy()[place]})

    met = asked.where("to is not null").groupBy("side", "to").cogroup(records[0].unionByName(records[1]).groupBy("side_", "to_")).applyInArrow(find, "side int, blk long, lcp long, at long")
    return materialize(met.unionByName(asked.where("to is null").select("side", "blk", "lcp", F.lit(n).cast("long").alias("at"))), "answers")


def _neighbours(positions: DataFrame, n: int) -> tuple[DataFrame, list]:
    """positions with left and right for all with an lcp, sw and leaves running over all of them, and the smallest c of each block."""
    size = max(BLOCK, math.isqrt(n - 1) + 1)
    local = _in_blocks(positions, size)
    blocks = local.groupBy("blk").agg(F.min("lcp"), F.min("c"), F.max("sw"), F.max("leaves")).orderBy("blk").collect()  # at most sqrt(n) rows
    offsets, sw, leaves = [], 0, 0
    for r in blocks:
        offsets.append((r[0], sw, leaves))
        sw, leaves = sw + r[3], leaves + r[4]
    answers = _answered(local, [r[1] for r in blocks], n)
    full = local.join(F.broadcast(local.sparkSession.createDataFrame(offsets, "blk long, sw_off long, leaves_off long")), "blk")  # at most sqrt(n) rows
    for side, x in ((0, "left"), (1, "right")):
        full = full.join(answers.where(F.col("side") == side).select("blk", "lcp", F.col("at").alias(f"{x}_at")), ["blk", "lcp"], "left").withColumn(x, F.coalesce(x, f"{x}_at"))
    full = full.withColumns({"sw": F.col("sw") + F.col("sw_off"), "leaves": F.col("leaves") + F.col("leaves_off")})
    return materialize(full.drop("sw_off", "leaves_off", "left_at", "right_at", "is_first", "is_last"), "neighbours"), [r[2] for r in blocks]


def _tree(full: DataFrame, least_of_block: list[int]) -> DataFrame:
    """The Cartesian tree's nodes, equal values merged: l, depth, r, conv, kids, n_leaves, words (sum of wl beyond l), low (the parent's depth), up_l (where
    the parent begins)."""
    spans = full.where("lcp >= 1").groupBy(F.col("left").alias("l"), F.col("lcp").alias("depth")).agg((F.max("right") - 1).alias("r"), F.count_if(F.col("n_turns") > F.col("lcp")).alias("goes_on"), F.min("least").alias("least"))
    at_l = full.select(F.col("i").alias("l"), F.col("n_turns").alias("turns_l"), F.col("lcp").alias("lcp_l"), F.col("left").alias("left_l"), F.col("to_end"), F.col("sw").alias("sw_l"), F.col("leaves").alias("leaves_l"), (F.col("n_turns") > F.col("lcp_next")).cast("long").alias("leaf_l"), F.col("blk").alias("blk_l"))
    at_r = full.select(F.col("i").alias("r"), F.col("lcp_next").alias("lcp_after"), "from_start", F.col("sw").alias("sw_r"), F.col("leaves").alias("leaves_r"), F.col("blk").alias("blk_r"))
    both = spans.join(at_l, "l").join(at_r, "r")
    before = F.col("lcp_l") >= F.col("lcp_after")
    made = both.select(
        "l", "depth", "r", "least", "to_end", "from_start", "blk_l", "blk_r",
        (F.col("goes_on") + (F.col("turns_l") > F.col("depth")).cast("long")).alias("kids"),
        (F.col("leaves_r") - F.col("leaves_l") + F.col("leaf_l")).alias("n_leaves"),
        (F.col("sw_r") - F.col("sw_l")).alias("words"),
        F.greatest("lcp_l", "lcp_after").alias("low"),
        F.when(before, F.col("left_l")).otherwise(F.col("l")).alias("up_l"),
    )
    kept = ["l", "depth", "r", "kids", "n_leaves", "words", "low", "up_l"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        between = Minimum(least_of_block)
        for b in batches:
            known, end, start, bl, br = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3, 8))
            inside = ~np.isnan(known.astype("f8"))
            least = np.where(bl == br, end, np.minimum(end, start))  # within one block only an interval up to its end is not known yet
            far = np.nonzero(br - bl > 1)[0]
            least[far] = np.minimum(least[far], between(bl[far] + 1, br[far]))
            least[inside] = b.column(3).fill_null(0).to_numpy(zero_copy_only=False)[inside]
            yield pa.RecordBatch.from_arrays([pa.array(least), *[b.column(b.schema.get_field_index(x)) for x in kept]], ["conv", *kept])

    return materialize(made.mapInArrow(run, f"conv long, {', '.join(f'{x} long' for x in kept)}"), "tree")


def _ends(ordered: DataFrame) -> DataFrame:
    """(c, d, ends): for each distinct conversation its smallest id, its turns, and the digest of the ids of all equal ones."""
    groups = materialize(ordered.groupBy("gk").agg(F.count("*").alias("n"), F.min("c").alias("c"), F.first("n_turns").alias("d")), "equal")
    alone = groups.where("n = 1").select("c", "d", F.sha2(F.col("c").cast("string").cast("binary"), 256).alias("ends"))
    many = groups.where("n > 1")
    members = join_one(ordered.select("gk", "c"), many.select("gk", "n"), "gk").select("gk", "c")
    # a digest can't be split: one pass for each group, with the memory of an id
    ordered_ids = members.repartition("gk").sortWithinPartitions("gk", "c")

    def run(batches):
        import hashlib

        import pyarrow as pa

        now, digest, done = None, None, []
        for b in batches:
            for key, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(str(c).encode())
                else:
                    digest.update(f",{c}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["gk", "ends"])
            done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["gk", "ends"])

    digests = ordered_ids.mapInArrow(run, "gk binary, ends string")
    return materialize(alone.unionByName(many.join(digests, "gk").select("c", "d", "ends")), "ends")


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per distinct sequence of first d turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: a written table (c, d, h, w, wb) with depths from 1 without gaps; convs: (c, n_turns), each conversation once."""
    spark = turns.sparkSession
    with passing(spark) as keep:
        ordered = _ordered(turns, convs)
        n = ordered.count()
        if not n:
            return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
        rows = materialize(join_one(turns, ordered.select("c", "i", "n_turns"), "c", "n_turns").select("i", "d", "h", "w", "wb"), "rows")
        full, least_of_block = _neighbours(_positions(rows, ordered), n)
        tree = _tree(full, least_of_block)
        top = min(least_of_block)
        low, before = F.greatest("lcp", "lcp_next"), F.col("lcp") >= F.col("lcp_next")
        alone = full.where(F.col("n_turns") > low).select(F.col("i").alias("l"), F.lit(None).cast("long").alias("depth"), low.alias("low"), F.when(before, F.col("left")).otherwise(F.col("i")).alias("up_l"))
        edges = materialize(tree.select("l", "depth", "low", "up_l").unionByName(alone).where("low > 0"), "edges")
        # a node has as many edges below it as children
        parents = materialize(tree.select(F.col("l").alias("up_l"), F.col("depth").alias("low"), F.col("conv").alias("up"), F.col("kids").alias("n")), "parents")
        found = materialize(join_one(edges, parents, ["up_l", "low"]).select("l", "depth", "up"), "found")
        of_node = tree.join(found.where("depth is not null"), ["l", "depth"], "left").withColumn("up", F.coalesce("up", F.lit(top)))
        parts = of_node.withColumn("from", F.explode(F.sequence(F.col("low") + 1, "depth", F.lit(STRETCH).cast("long"))))
        shared = parts.select(F.col("l").alias("i"), F.explode(F.sequence("from", F.least(F.col("from") + STRETCH - 1, F.col("depth")))).alias("d"), "depth", "r", "conv", "kids", "n_leaves", "words", "low", "up")
        leaf = found.where("depth is null").select(F.col("l").alias("i"), F.col("up").alias("up_own"))
        own = full.join(leaf, "i", "left").select("i", "c", "n_turns", "lcp", low.alias("low_own"), F.coalesce("up_own", F.lit(top)).alias("up_own"))
        begun = join_one(rows.select("i", "d", "wb"), materialize(own, "own"), "i", "n_turns").where(F.col("d") > F.col("lcp"))
        ends = _ends(ordered)
        out = begun.join(shared, ["i", "d"], "left").join(ends, ["c", "d"], "left")
        conv = F.coalesce("conv", "c")
        parent = F.when(F.col("conv").isNull(), F.when(F.col("d") == F.col("low_own") + 1, F.col("up_own")).otherwise(F.col("c"))).otherwise(F.when(F.col("d") == F.col("low") + 1, F.col("up")).otherwise(F.col("conv")))
        kids = F.when(F.col("conv").isNull(), (F.col("d") < F.col("n_turns")).cast("long")).otherwise(F.when(F.col("d") < F.col("depth"), F.lit(1)).otherwise(F.col("kids")))
        out = out.select(
            conv.alias("conv_id"), F.col("d").alias("depth"), parent.alias("parent_conv_id"),
            F.coalesce(F.col("r") - F.col("i") + 1, F.lit(1)).alias("n_convs"),
            kids.alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            F.coalesce(F.col("words") - (F.col("r") - F.col("i")) * F.col("wb"), F.lit(0)).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        root = full.agg(
            F.lit(top).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.count("*").alias("n_convs"),
            F.count_if((F.col("lcp") == 0) & (F.col("n_turns") > 0)).alias("n_children"), F.greatest(F.max("leaves"), F.lit(1)).alias("n_leaves"), F.sum("wl").alias("saved_tokens"),
            F.lit((ends.where("d = 0").first() or {"ends": NO_ENDS})["ends"]).alias("ends_sha256"),
        )
        out = materialize(out.unionByName(root), "trie")
        keep(out)
    return out


def prefix_trie(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """The trie of rebuilt() conversations of a table (conv_id, turn, role, text)."""
    with passing(conversations.sparkSession) as keep:
        out = nodes(*rebuilt(turns_of(conversations), family, heads))
        keep(out)
    return out
