"""Helpers that the training-data operators share: tables in the shared folder, worker caches."""

from __future__ import annotations

import atexit
import math
import shutil
import sys
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []
_own_dir: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Longest word, in characters or bytes, whose value a worker remembers; bounds its memory together with the number of words.
LONGEST = 64
#: Most keys that join_one() broadcasts, and rows of a key up to which it leaves them to the shuffle.
HOT_KEYS, HOT_ROWS = 50_000, 1000
#: Bytes of text of each class that training takes at most.
CLASS_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="leafmill-"))
    return f"file://{_own_dir[0]}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when this process ends or by drop()."""
    path = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove paths of the shared folder."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in _made:
            _made.remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and a lost executor costs only a reread."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that materialize() wrote, once all that reads them is written itself."""
    for t in tables:
        if (path := _path_of.pop(t, None)) is not None:
            drop(t.sparkSession, path)


@contextmanager
def passing(spark: SparkSession):
    """Tables written inside go at the end, but for those handed to the function that this gives."""
    before, kept = set(_made), set()
    yield lambda *tables: kept.update(_path_of[t] for t in tables if t in _path_of)
    drop(spark, *[p for p in _made if p not in before and p not in kept])


def join_one(rows: DataFrame, one: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with one, a table of a row per key that tells in column n how many of rows have the key. Both are written tables.

    A key of more than HOT_ROWS rows and more than one in HOT_KEYS of all rows is hot. There are at most HOT_KEYS such keys, whatever
    the corpus, so they are broadcast and their rows don't move; no other key can fill a task of the shuffle."""
    total, most = one.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    least = max(HOT_ROWS, total // HOT_KEYS)
    if most <= least:
        return rows.join(one, key, how)
    hot, rest = one.where(F.col(n) > least), one.where(F.col(n) <= least)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


class Words(dict):
    """What a worker remembers of words: `most` of them at most (and those of one text), none longer than LONGEST; longer ones are
    worked out each time."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def of(self, words: list, make) -> list:
        """The words' values. make() gives those of a list of distinct words."""
        try:
            return list(map(self.__getitem__, words))
        except KeyError:
            pass
        if len(self) > self.most:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self]
        made = dict(zip(new, make(new), strict=True))
        self.update((w, v) for w, v in made.items() if len(w) <= LONGEST)
        return [made[w] if w in made else self[w] for w in words]


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            drop(spark, *list(_made))
    except Exception:  # the session may be gone; what is left lies in the cluster's scratch folder
        pass
    for path in _own_dir:
        shutil.rmtree(path, ignore_errors=True)


def worker_cache(key: str, make):
    """make() once in each Python worker process, for all its tasks that use the key in a row. Only the latest key's value is
    kept: workers live on through stages, and each stage has its own bounded memory."""
    store = sys.modules["__main__"].__dict__.setdefault("_leafmill_cache", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def held_out(doc_id):
    """True where crc32 of the id's decimal text leaves 0 when divided by 5; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mix64(x):
    """Finaliser of a 64-bit hash over a numpy uint64 array (in place where it can be)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = CLASS_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """Rows to learn from (doc_id, text, y): labelled 0 or 1, not held out, picked among docs in the order of a hash of the id.

    Documented bounds of training: per_class rows of each class, and class_bytes of whole texts of each class; a text that doesn't
    fit any more is passed over, never cut. An id that docs repeat is one row (of its least text), one that labels repeat has its
    higher label. The counts of both classes, which come with the sample, cover all labelled ids of docs."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & ~held_out(F.col("_id"))
    )
    known = known.groupBy("_id").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    if not n:
        return docs.select("doc_id", "text", F.lit(0).alias("y")).limit(0), {}
    order = F.xxhash64(F.col("_id"), F.lit(label))
    picked = None
    for y in sorted(counts):
        part = known.where(F.col("y") == y).orderBy(order, "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # the bound is 2 * per_class small rows, so this side of the join may be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    sample = materialize(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample").select("doc_id", "text", "y")
    sizes = sample.select("doc_id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("doc_id", F.lit(label)).alias("order")).collect()
    room, over = dict.fromkeys(counts, class_bytes), []
    for r in sorted(sizes, key=lambda r: (r["order"], r["doc_id"])):
        if r["size"] <= room[r["y"]]:
            room[r["y"]] -= r["size"]
        else:
            over.append(r["doc_id"])
    return sample.where(~F.col("doc_id").isin(over)) if over else sample, counts


def in_order(ids) -> list[int]:
    """Places of a sample's rows by their ids (a chunked Arrow column)."""
    values = ids.to_pylist()
    return sorted(range(len(values)), key=values.__getitem__)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def map_scores(docs: DataFrame, make, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row. make() gives, on an executor, a function from a text or None to a float."""

    def run(batches):
        import pyarrow as pa

        one = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def filter_scores(docs: DataFrame, make, passes, text_col: str = "text") -> DataFrame:
    """docs' rows, unchanged, whose text's score passes."""

    def run(batches):
        import pyarrow as pa

        one = make()
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([passes(one(t.as_py())) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
