"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from mnemograph.session import stage_folder

__all__ = ["Folder", "arrow_map", "documents", "free_shuffles", "no_cycles",
           "quiet_tokenizers", "row_key", "stage",
           "table", "text_slices", "tokenizer_path", "unstage"]

Folder = str
BATCH_BYTES = 4 << 20     # of an Arrow batch between Spark and a worker


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared stage folder and read it back."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete stage tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: Folder, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: Folder) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies on this machine (every machine has its own copy)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def row_key(*cols: Column | str) -> Column:
    """A 64-bit key of the given columns that nulls do not break."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*[p for c in cols for p in (c.isNull(), c)])


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
              schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, and workers that keep no free memory.

    Workers outlive their tasks, and so would what Arrow's pool holds back in each of them.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, most: int
                ) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds about ``most`` bytes of ``column``.

    A slice has one row at least, so a longer text stands alone. Slices bound the
    memory of a task by bytes, whatever the number of rows in a batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.binary_length(batch.column(column)).fill_null(0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, done + most, side="right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            pa.default_memory_pool().release_unused()
            start, done = stop, int(ends[stop - 1])


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner follows the driver's garbage collector, which may not run for hours on a
    quiet driver, while the files of finished steps fill the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def no_cycles() -> Iterator[None]:
    """Holds the cycle collector off while many small objects are made.

    They are freed by their counts; each run of the collector would walk all of them.
    """
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def quiet_tokenizers() -> None:
    """A task has one core: the tokenizers library must not start its own threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
