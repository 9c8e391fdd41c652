"""Shared scratch storage: cuts lineage with files that every executor and the driver can read.

The folder is the one the session names in ``spark.checkpoint.dir``. In local mode, where driver and
executors are one process, an unset one is replaced by a folder under the system's temporary
directory; on a cluster an unset one is an error, since executors would write where nobody reads.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}
#: Spark's own switch: shuffle files go when the execution that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only if that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        _made.append((spark, _own["dir"]))
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@contextmanager
def _short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, an execution's shuffle files are deleted as soon as it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors, cuts lineage.

    The shuffle files behind it go with the write, whatever the driver still refers to.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _short_lived_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system; a path that is gone already is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``materialise`` wrote, once nothing will read them again."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            remove(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is None:
            continue
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; nothing depends on this
            pass
