"""Tables in the folder that all executors share: what is written there is neither worked out again nor lost with an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and the session is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="leafmill-runs-"))
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path there; what is under it goes when this process ends, or by remove()."""
    path = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def release(*dfs: DataFrame | None) -> None:
    """Remove what written() wrote, once all that reads it is written itself; None is passed over."""
    for df in dfs:
        if df is not None and (path := _path_of.pop(df, None)) is not None:
            remove(df.sparkSession, path)


def first_writable(spark: SparkSession, candidates: list[str]) -> tuple[str, bool]:
    """U4, K9: the first folder that can be written to, and whether it is another than the first that was asked for. Candidates that differ
    in upper and lower case alone are one; folders are made where they are missing; PermissionError where none will do."""
    seen: set[str] = set()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in candidates:
        if path.lower() in seen:
            continue
        seen.add(path.lower())
        probe = hadoop.Path(f"{path}/.probe-{uuid.uuid4().hex[:8]}")
        try:
            system = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            system.mkdirs(hadoop.Path(path))
            system.create(probe, True).close()
            system.delete(probe, False)
        except Exception:  # whatever a file system refuses with, the next folder is tried
            continue
        return path, path != candidates[0]
    raise PermissionError(f"no folder can be written to: {', '.join(candidates)}")


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    try:
        for path in list(_made) if spark is not None else []:
            remove(spark, path)
    except Exception:  # the session may be gone; what is left lies in the cluster's scratch folder
        pass
    for path in _own_dir:
        shutil.rmtree(path, ignore_errors=True)
