"""Helpers that the corpus operators share: tables, stored stages, and text as byte arrays."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.storage import scratch

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, lost executors lose
    nothing, and Spark may delete the shuffle files of the job that made it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """name, or name with underscores after it, such that no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """A stored table as a broadcast side if it has at most max_rows rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def worker_cache(name: str, make: Callable):
    """One object per Python worker, kept from task to task."""
    store = sys.__dict__.setdefault("_factloom", {})
    if name not in store:
        store[name] = make()
    return store[name]


def text_chunks(column, max_bytes: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts an Arrow string column into runs of whole rows of about max_bytes. Yields the first
    row's index, the rows' offsets (one more than rows, from 0) and the UTF-8 bytes; null: empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place: every input bit reaches every output bit."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
