"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

SuperMinHash (Ertl 2017): every element draws one random permutation of the signature's places and one uniform number per
rank; its value at the place of rank j lies in [j, j + 1). A place keeps its least value. So ranks can be worked through one
by one for all of a set's elements at once, and a set is finished at the rank where its last place is filled (early
stopping); the shared permutation makes places negatively correlated, and estimates less variable than MinHash's.

The steps:
1. Each text's distinct word shingles, hashed to 64 bits; texts with the same shingle set fall into one class (128-bit digest
   of the sorted set), which its smallest id represents.
2. Representatives' signatures in BANDS bands of ROWS places. Two sets of similarity s share no band with probability
   (1 - s**ROWS)**BANDS: under 1e-5 at 0.8.
3. In each band bucket every member is paired with the bucket's smallest id. Pairs are verified on the full shingle sets, and
   components of the verified links are grouped. Where a bucket still holds several components, members outside its largest
   are compared with the bucket's others in blocks, and new links regroup; so no link that joins components is lost, and
   no group is expanded into all its pairs.

A bucket, a set or a hub that many texts share is never one task's: such keys are told by their counts and broadcast (join_one),
hubs' texts are dealt over salted copies, and blocks are of bounded size.

Defined results: null, empty and blank texts have no shingles and stand alone; very long texts are taken whole; a text with fewer words than a shingle has its
whole word sequence as its one shingle; repeated texts form one class; rows that repeat an id form one row of the
result, linked with whatever any of them is linked with, and the largest of their set sizes; null ids are left out; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, join_one, materialize, mix64, passing, release, worker_cache
from .components import components

BANDS, ROWS = 40, 6
PLACES = BANDS * ROWS
MAX_WORDS = 400_000
#: Elements whose permutations are in memory at once.
BLOCK = 1 << 15
#: Pairs a row up to which a group's strays are paired one by one; beyond, blocks of rows meet, by so many shingles at a time.
FEW, BLOCK_ROWS, COLUMNS = 16, 128, 1 << 16


class WordHashes:
    """64-bit hashes of words; words met before are remembered."""

    def __init__(self):
        self.known = Words(MAX_WORDS)

    def __call__(self, words: list[bytes]):
        import numpy as np
        import xxhash

        return np.frombuffer(b"".join(self.known.of(words, lambda new: [xxhash.xxh3_64_digest(w) for w in new])), ">u8").astype("u8")


def shingles(text: str | None, size: int, word_hashes: WordHashes):
    """Sorted distinct 64-bit hashes of the text's shingles of `size` words (A-Z lower-cased)."""
    import numpy as np

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    h = word_hashes(words)
    n = max(len(h) - size + 1, 1)
    made = np.full(n, min(len(h), size), "u8")
    for k in range(min(size, len(h))):
        made = mix64(made * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(made)


def signatures(sets: list, places: int = PLACES):
    """SuperMinHash of non-empty sets of 64-bit hashes: an array (sets, places) of 64-bit values; similar sets agree at a
    share of places that estimates their Jaccard similarity."""
    import numpy as np

    out = np.full((len(sets), places), np.uint64(0xFFFFFFFFFFFFFFFF))
    at = 0
    while at < len(sets):  # a block of whole sets
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= BLOCK):
            n += len(sets[end])
            end += 1
        _block(sets[at:end], out[at:end], places)
        at = end
    return out


def _block(sets: list, out, places: int) -> None:
    import numpy as np

    lengths = [len(s) for s in sets]
    if len(sets) == 1 and lengths[0] > BLOCK:  # a long set, by parts: the least value of each place counts
        parts = np.full((-(-lengths[0] // BLOCK), places), out[0, 0])
        for k in range(len(parts)):
            _block([sets[0][k * BLOCK : (k + 1) * BLOCK]], parts[k : k + 1], places)
        out[0] = parts.min(0)
        return
    doc = np.repeat(np.arange(len(sets)), lengths)
    seed = np.concatenate(sets)
    perm = np.empty((len(seed), places), "u1" if places <= 256 else "u2")
    perm[:] = np.arange(places)
    row = np.arange(len(seed))
    flat = out.reshape(-1)
    step = np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64((1 << 54) - 1)
    for j in range(places):
        seed = seed + step
        draw = mix64(seed.copy())
        # one draw gives the permutation's next place (high bits) and the value within the rank (low bits)
        k = j + ((draw >> np.uint64(44)) % np.uint64(places - j)).astype("i8")
        here = perm[row, k].astype("i8")
        perm[row, k] = perm[row, j]
        value = (np.uint64(j) << np.uint64(54)) | (mix64(draw) & low)
        np.minimum.at(flat, doc * places + here, value)
        if j % 2 or j > 6:
            open_ = (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
            if not open_.any():
                return
            live = open_[doc]
            if live.sum() < 0.7 * len(live):
                doc, seed, row = doc[live], seed[live], row[live]


def bands(signature):
    """A 64-bit bucket key per band, of its places' values and its number."""
    import numpy as np

    s = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype="u8"), s.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return key.view("i8")


def _described(docs: DataFrame, size: int) -> DataFrame:
    """id, n (shingles), digest of the set, band keys (null without shingles)."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        hashes = worker_cache("word-hashes", WordHashes)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t.as_py(), size, hashes) for t in part.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, bands(signatures([sets[i] for i in full])), strict=True):
                        keys[i] = row
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.array([len(s) for s in sets], "i8")), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "digest", "keys"]
                )

    return docs.mapInArrow(run, "id long, n long, digest binary, keys array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    pairs and docs are written tables. b's text meets its pairs by a plain join on distinct ids; a may be the centre of many pairs, so
    its text goes out in as many salted copies as its pairs fill blocks of 256, and pairs are dealt over those."""
    fan = 256
    degree = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("top", (F.col("n") / fan).cast("int")), "degrees")
    left = docs.join(degree.select(F.col("a").alias("id"), "top"), "id").select("id", F.col("text").alias("text_a"), "top", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("copy"))
    with_top = join_one(pairs, degree, "a").select("a", "b", F.expr(f"cast(pmod(xxhash64(b), {1 << 20}) % (top + 1) as int)").alias("copy"))
    both = (
        with_top.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(left.select(F.col("id").alias("a"), "copy", "text_a"), ["a", "copy"])
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = worker_cache("word-hashes", WordHashes)
        last, kept = None, None
        for b in batches:
            good = []
            for a, ta, tb in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if a != last:
                    last, kept = a, shingles(ta.as_py(), size, hashes)
                other = shingles(tb.as_py(), size, hashes)
                small, large = sorted((len(kept), len(other)))
                if 100 * small < percent * large:
                    good.append(False)
                    continue
                shared = len(np.intersect1d(kept, other, assume_unique=True))
                good.append(100 * shared >= percent * (small + large - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), mask], ["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def _verified_blocks(near: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components in the groups of near (main, id, comp, all, strays), strays against all of the group.

    Both sides are dealt into blocks of BLOCK_ROWS; a task counts all intersections of two blocks by a matrix product over the
    shingles that both have, and emits links only."""
    texts = near.join(docs, "id").select("main", "id", "comp", "text", F.ceil(F.col("all") / BLOCK_ROWS).cast("int").alias("wide"), F.ceil(F.col("strays") / BLOCK_ROWS).cast("int").alias("tall"))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    strays = texts.where("comp != main").select("main", dealt("tall").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), "id", "comp", "text")
    others = texts.select("main", F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("i"), dealt("wide").alias("j"), "id", "comp", "text")
    others = others.select(*[F.col(c).alias(f"{c}_") for c in others.columns])

    def compare(left, right):
        import numpy as np
        import pyarrow as pa

        hashes = worker_cache("word-hashes", WordHashes)
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            xs = [shingles(t.as_py(), size, hashes) for t in left["text"]]
            ys = [shingles(t.as_py(), size, hashes) for t in right["text_"]]
            both = np.intersect1d(np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys)), assume_unique=True)
            shared = np.zeros((len(xs), len(ys)), "f4")
            for at in range(0, len(both), COLUMNS):
                part = both[at : at + COLUMNS]
                shared += _matrix(xs, part) @ _matrix(ys, part).T
            sizes = np.array([len(x) for x in xs], float)[:, None] + np.array([len(y) for y in ys], float)[None]
            ids, others = left["id"].to_numpy(), right["id_"].to_numpy()
            linked = (100 * shared.astype("f8") >= percent * (sizes - shared)) & (left["comp"].to_numpy()[:, None] != right["comp_"].to_numpy()[None])
            for i, k in zip(*np.nonzero(linked), strict=True):
                out_a.append(int(ids[i]))
                out_b.append(int(others[k]))
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    keys = ["main", "i", "j"]
    return strays.groupBy(*keys).cogroup(others.groupBy("main_", "i_", "j_")).applyInArrow(compare, "a long, b long")


def _matrix(sets: list, columns):
    """Rows of ones where a set has a column's shingle; counts stay exact in single precision up to 2 ** 24."""
    import numpy as np

    out = np.zeros((len(sets), len(columns)), "f4")
    for i, s in enumerate(sets):
        at = np.searchsorted(columns, s)
        at[at == len(columns)] = 0
        out[i, at[columns[at] == s]] = 1
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: doc_id, n_shingles, component_id (the smallest id reachable by links), kept (doc_id = component_id)."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    with passing(docs.sparkSession) as keep:
        classes, group = _grouped(rows, size, percent)
        keep(classes, group)
    top = group.select(F.col("id").alias("rep"), "component")
    return classes.join(top, "rep", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), (F.col("id") == F.coalesce("component", "rep")).alias("kept")
    )


def _grouped(rows: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: ids with set sizes and their classes (id, n, rep), and the components of linked classes (id, component)."""
    known = materialize(_described(rows, size), "shingles")
    # classes of equal sets; reps are vertices of the links. Only sets that occur again are joined.
    again = known.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("times")).where("rep < last")
    again = materialize(again.select("digest", "rep", "times"), "copies")
    filled = join_one(known.select("id", "n", "digest").where("n > 0"), again, "digest", "times", "left")
    each = filled.select("id", "n", F.coalesce("rep", "id").alias("rep")).unionByName(known.where("n = 0").select("id", "n", F.col("id").alias("rep")))
    each = materialize(each, "each")
    classes = materialize(each.groupBy("id").agg(F.max("n").alias("n"), F.min("rep").alias("rep"), F.max("rep").alias("high")), "classes")
    twice = each.join(classes.where("rep < high").select("id", F.col("rep").alias("low")), "id").where("rep > low")  # ids with several rows
    own = known.where("n > 0").join(each.where("id = rep and n > 0").select("id").distinct(), "id", "left_semi")
    keys = materialize(own.select("id", F.explode("keys").alias("key")).distinct(), "bands")
    buckets = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(join_one(keys, materialize(buckets, "hubs"), "key").select("key", "hub", "id"), "buckets")  # members of buckets of two or more
    release(known, again, keys)
    texts = materialize(rows.join(shared.select("id").distinct(), "id", "left_semi"), "texts")
    pairs = materialize(shared.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    found = materialize(_verified(pairs, texts, size, percent), "verified")
    links = found.where("linked").select("a", "b").unionByName(twice.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    group = materialize(components(links), "groups")
    # Buckets that still hold several components: the largest is the bucket's main one, members of others are strays. A pair
    # that joins components has a stray in it, so strays are compared with all that share a bucket of the same main component.
    placed = materialize(shared.join(group, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "placed")
    by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mains = by_comp.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("n"), F.count("*").alias("comps"))
    mains = materialize(mains.where("comps > 1").select("key", "main", "n"), "mains")
    near = join_one(placed, mains, "key").select("main", "id", "comp").distinct().join(classes.select("id", "n"), "id")
    near = materialize(near, "near")
    fill = near.groupBy("main").agg(F.count("*").alias("all"), F.count_if(F.col("comp") != F.col("main")).alias("strays"))
    fill = materialize(fill.withColumn("few", F.col("strays") * F.col("all") <= FEW * (F.col("strays") + F.col("all"))), "fill")
    near = materialize(join_one(near, fill, "main", "all"), "near")
    few = near.where("few")  # at most FEW pairs a row
    crossed = few.where("comp != main").select("main", F.col("id").alias("x"), F.col("comp").alias("comp_x"), F.col("n").alias("n_x")).join(
        few.select("main", F.col("id").alias("y"), F.col("comp").alias("comp_y"), F.col("n").alias("n_y")), "main"
    )
    crossed = crossed.where((F.col("comp_x") != F.col("comp_y")) & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent))
    crossed = crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(found.select("a", "b"), ["a", "b"], "left_anti")
    more = _verified(materialize(crossed, "crossed"), texts, size, percent).where("linked").select("a", "b")
    more = materialize(more.unionByName(_verified_blocks(near.where("not few"), texts, size, percent)), "more")
    if more.limit(1).count():
        group = materialize(components(links.unionByName(more)), "groups")
    return classes, group
