"""What the operators of this subpackage have in common."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Tables that settle() wrote in this process, by session application id.
_settled: dict[str, list[str]] = {}


#: So many rows of a few numbers make a file of a settled table worth its own task.
FILE_ROWS = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own if all runs on this machine, and an error on a cluster, whose executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = f"{tempfile.gettempdir()}/tracewright-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(spark: SparkSession, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and a lost executor loses nothing.

    rows: how many rows there are at most, if that is known and each is a few numbers. A small table then goes into a file for FILE_ROWS rows, and
    one for each core at least, rather than one for each shuffle partition: every file costs a process or a request.
    """
    if rows is not None:
        files = max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
        if files < partitions(spark):
            df = df.coalesce(files)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that settle() wrote for this session; results that still read them must be stored first."""
    for path in _settled.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, folds: int):
    """Whether crc32(doc_id as text) mod folds is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a worker process keeps between tasks: the last thing that was asked for.
_kept: dict = {}


def kept(key, make):
    """make(), once in each worker process, until another operator keeps something there: workers serve one operator after the other, and what all of them keep wouldn't fit."""
    if key not in _kept:
        if _kept:
            _kept.clear()
            trim()
        _kept[key] = make()
    return _kept[key]


def trim() -> None:
    """Give the memory that this process no longer uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sorted_groups(batches: Iterator, keys: list[str]) -> Iterator[tuple]:
    """Runs of rows with equal keys from Arrow batches sorted by them: (key values, True where the run starts, rows as a batch). A run that spans batches comes in several parts."""
    import numpy as np

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, dtype=bool)
        cut[0] = True
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        at = [*np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:], strict=False):
            key = tuple(c[a] for c in cols)
            yield key, key != last, batch.slice(a, b - a)
            last = key
