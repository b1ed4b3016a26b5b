"""Intermediate tables in the folder all executors share.

Iterative operators read an intermediate result several times. It is written once as Parquet
under ``spark.checkpoint.dir``, which cuts the lineage and survives the loss of an executor. Only
on one machine (``local[...]``) a temporary folder is made where the session names none. The tables
are deleted at the end of the :func:`scope` they were written in, else with the session's JVM.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for deleting the shuffle files of a query at its end.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []
_state = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one made for this process if all executors are in it.

    Raises on a cluster without such a folder: each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="pairloom-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run within are deleted as it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of what was written, in folders by a column if asked. The schema is kept, also when empty."""
    if is_dry():
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom-{uuid.uuid4().hex}"
    where, files = _at(spark, path)
    files.deleteOnExit(where)
    with _shuffles_dropped(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    scopes = getattr(_state, "scopes", [])
    if scopes:
        scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def open_folder(path: str):
    """A Parquet folder of the shared one as a worker reads it, as a pyarrow dataset; None if there is none."""
    files, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    if files.get_file_info(at).type == fs.FileType.NotFound:
        return None
    return ds.dataset(at, filesystem=files, format="parquet")


@contextmanager
def scope() -> Iterator[None]:
    """Tables written within are deleted at its end; results that read them must have been used by then."""
    scopes = _state.scopes = getattr(_state, "scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for spark, path in scopes.pop():
            where, files = _at(spark, path)
            files.delete(where, True)
            files.cancelDeleteOnExit(where)


@contextmanager
def outliving() -> Iterator[None]:
    """Tables written within stay when the scopes around end."""
    held, _state.scopes = getattr(_state, "scopes", []), []
    try:
        yield
    finally:
        _state.scopes = held


def is_dry() -> bool:
    return getattr(_state, "dry", False)


@contextmanager
def dry() -> Iterator[None]:
    """Within, :func:`materialize` writes nothing and gives its argument back: for plans that are shown and not run."""
    before, _state.dry = getattr(_state, "dry", False), True
    try:
        yield
    finally:
        _state.dry = before
