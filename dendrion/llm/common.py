"""Helpers shared by the corpus operators: table access, scratch tables, small columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch between the JVM and a Python worker, where the session has no bound of its own.
BATCH_BYTES = 2 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` where the cluster names one, else a folder in the warehouse (which
    the driver and the executors share as well); never a machine-local temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/corpus-{spark.sparkContext.applicationId}"


def new_scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, so that a lost executor costs the tasks of the current step only, and keeps
    an expensive step from running again for each of its readers.  The table stays until
    ``release`` is called, since a caller may still read frames derived from it.
    """
    spark = df.sparkSession
    path = new_scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once all that was derived from them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/{scratch_root(spark).rpartition('/')[2]}/" in f:
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, instead of at the driver's next garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete this application's intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that to texts of ASCII alone, and far faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def named(df: DataFrame, **columns: str) -> DataFrame:
    """The given columns of ``df`` under fixed names, and nothing else: extra columns can't clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def mapped(df: DataFrame, f: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``f`` over the Arrow batches of each partition, which are small whatever the length of the texts.

    Spark's own bound is 64 MB, and a batch exists several times over (in the JVM's buffer, which
    doubles as it grows, in the worker and in its result) for each core.  It is read when a query
    runs, so it is set in the session; a bound that the session was given already stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key).rstrip("bB") == str(64 << 20):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(thrifty(f), schema)


def thrifty(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function whose worker gives freed memory back at the task's end.

    Spark keeps idle Python workers for the next stage; without this each of them holds the most
    that any stage before it needed.
    """

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


_kept: dict[Hashable, dict] = {}


def kept(owner: Hashable, key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives for ``key``, kept by this process from task to task, for one owner at a time.

    Spark keeps its Python workers from stage to stage.  What an operator remembers there goes once
    another one asks; it would else lie beside all that the later ones need.
    """
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    held = _kept[owner]
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Return this process's freed memory, Arrow's and the allocator's, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
