"""Helpers that every layer shares: shipping functions to workers, shared-folder tables, table access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import importlib
import os
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _resolve(module: str, name: str, root: str) -> Callable:
    if root not in sys.path:
        sys.path.append(root)
    return getattr(importlib.import_module(module), name)


def remote(func: Callable, *args, **kwargs) -> Callable:
    """A one-argument callable for mapInArrow and the like that imports ``func`` on the worker.

    The module-level function is looked up by name, so caches in its module live as long as the worker has calls of that module only.
    """
    module, name, root = func.__module__, func.__qualname__, ROOT

    def call(batches):
        import importlib as _importlib
        import sys as _sys

        if root not in _sys.path:
            _sys.path.append(root)
        return _importlib.import_module("vecloom.runtime").called(module, name, (batches, *args), kwargs)

    return call


def remote1(func: Callable, *args, **kwargs) -> Callable:
    """As ``remote``, for applyInArrow, which counts a function's parameters."""
    return remote(func, *args, **kwargs)


def remote2(func: Callable, *args, **kwargs) -> Callable:
    """As ``remote``, for the two tables of a cogroup."""
    module, name, root = func.__module__, func.__qualname__, ROOT

    def call(left, right):
        import importlib as _importlib
        import sys as _sys

        if root not in _sys.path:
            _sys.path.append(root)
        return _importlib.import_module("vecloom.runtime").called(module, name, (left, right, *args), kwargs)

    return call


_last_module, _last_trim = "", 0.0


def called(module: str, name: str, args: tuple, kwargs: dict):
    """On a worker: the function's result. Workers stay for later stages, so what they don't need any more goes back to the system:
    the tables and caches (``_LOADED``) of another module they worked for before, and freed memory after each task."""
    global _last_module
    if _last_module not in ("", module):
        getattr(sys.modules.get(_last_module), "_LOADED", {}).clear()
        trim()
    _last_module = module
    out = getattr(importlib.import_module(module), name)(*args, **kwargs)
    if isinstance(out, Iterator):
        return _to_the_end(out)
    if time.monotonic() - _last_trim > 2:  # one group of many
        trim()
    return out


def _to_the_end(items: Iterator) -> Iterator:
    try:
        yield from items
    finally:
        trim()


def trim() -> None:
    """Give freed memory back to the system, which the allocators otherwise keep."""
    global _last_trim
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another libc
        pass
    _last_trim = time.monotonic()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="vecloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        _remove_at_exit(spark, found)
    return found.rstrip("/")


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM may be gone at interpreter exit
            pass

    atexit.register(remove)


def staged(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there, whoever dies later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def staged_by(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder with a folder for each value of ``columns``, for tasks that read some of them by path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*columns).parquet(path, compression="none")
    _remove_at_exit(spark, path)
    df._staged_at = path
    return df


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more, and let Spark's cleaner drop the shuffle files of finished jobs.

    Spark removes those once its driver finds them unreachable, which on a large driver may take as long as the whole
    job; whatever was staged doesn't need them.
    """
    for t in tables:
        path = getattr(t, "_staged_at", None)
        if path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows that a broadcast may have; beyond, the join shuffles both sides.
BROADCAST_ROWS = 500_000


def fitting_join(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Join with ``right`` broadcast if it is counted to be small, by shuffle otherwise. ``right`` should be staged."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)
